"""Answering a stream of questions against a static corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def answer_stream(questions: DataFrame, places: DataFrame, relation: Callable[[DataFrame, DataFrame], DataFrame], path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes the answers of every micro-batch of questions as a Parquet table.

    A relation is stateless per question, so each batch is answered like a
    table. A batch goes to a folder of its own that a repeated batch replaces,
    which makes the sink exactly-once.
    """

    def answer(batch: DataFrame, number: int) -> None:
        relation(batch, places).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
