"""References to keys that do not exist, or do not hold when they are referred to.

Parent keys are sorted and compressed into contiguous runs; a reference is
matched with the run that starts at or before it, and is an orphan if that
run ends before the key, or doesn't hold at the reference's time.

Scale: runs never cross a block of 2**BLOCK_BITS keys. So runs are built by a
window over at most that many rows, and the as-of match is an equi-join on the
block with a range condition: no global sort, no unbounded window. The run
table is written and read back, so the planner broadcasts it only if its real
size is below ``spark.sql.autoBroadcastJoinThreshold``; else the references are
shuffled by block and adaptive execution splits hot blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terramill.session import Scratch

BLOCK_BITS = 8
EVER, NEVER = -(1 << 62), 1 << 62


def validity(parents: DataFrame, key: str, since: str, until: str, first: int, last: int) -> DataFrame:
    """(key, lo, hi) in microseconds, clipped to the referring period [first, last], overlaps merged.

    A row holds from ``since`` (inclusive) until ``until`` (exclusive; null:
    still holds). Rows with a null key or null ``since`` never hold. Most keys
    hold over the whole period and get the same (EVER, NEVER).
    """
    lo, hi = F.unix_micros(since), F.unix_micros(until)
    rows = parents.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(
        F.col(key).cast("long").alias("key"),
        F.when(lo <= first, EVER).otherwise(lo).alias("lo"),
        F.when(hi.isNull() | (hi > last), NEVER).otherwise(hi).alias("hi"),
    ).where((F.col("lo") < F.col("hi")) & (F.col("lo") <= last) & (F.col("hi") > first)).distinct()
    by_key = Window.partitionBy("key").orderBy("lo", "hi")
    before = F.max("hi").over(by_key.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("opens", F.when(before.isNull() | (F.col("lo") > before), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("opens").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("key", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def runs(valid: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Contiguous runs (block, run_start, run_end, lo, hi) of keys with the same validity."""
    block = F.shiftright("key", bits)
    order = Window.partitionBy("block", "lo", "hi").orderBy("key")
    numbered = valid.withColumn("block", block).withColumn("gap", F.col("key") - F.row_number().over(order))
    return numbered.groupBy("block", "lo", "hi", "gap").agg(F.min("key").alias("run_start"), F.max("key").alias("run_end")).drop("gap")


def span(rows: DataFrame, at: str) -> tuple[int | None, int | None]:
    return tuple(rows.agg(F.unix_micros(F.min(at)), F.unix_micros(F.max(at))).first())


def orphan_references(
    references: DataFrame,
    parents: DataFrame,
    *,
    key: str,
    at: str,
    parent_key: str,
    since: str,
    until: str,
    period: tuple[int | None, int | None] | None = None,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """The rows of ``references`` whose ``key`` holds in no parent row at time ``at``.

    Null keys refer to nothing and are no orphans. A null ``at`` is a moment
    at which nothing is known to hold: its references are orphans. An empty
    parent table makes every reference an orphan. Repeated parent rows count
    once. Repeated references are kept; other columns pass through unchanged.
    ``period``: least and greatest ``at`` in microseconds where the caller knows
    them (a wider period is allowed); else they are aggregated here.
    """
    spark = references.sparkSession
    references = references.where(F.col(key).isNotNull())
    first, last = period or span(references, at)
    scratch = Scratch(spark, "runs")
    table = scratch.cut(runs(validity(parents, parent_key, since, until, first if first is not None else 0, last if last is not None else 0), bits), "runs")
    table = table.select(*[F.col(c).alias(f"__{c}") for c in table.columns])
    asked = references.withColumns({"__k": F.col(key).cast("long"), "__t": F.unix_micros(at), "__b": F.shiftright(F.col(key).cast("long"), bits)})
    holds: Column = (
        (F.col("__b") == F.col("__block"))
        & (F.col("__run_start") <= F.col("__k")) & (F.col("__k") <= F.col("__run_end"))
        & (F.col("__lo") <= F.col("__t")) & (F.col("__t") < F.col("__hi"))
    )
    return asked.join(table, holds, "left_anti").drop("__k", "__t", "__b")


def question_references(benchmark: DataFrame) -> DataFrame:
    """(question_id, field, poi_id, created_at): every anchor and answer reference of a question."""
    fields = F.array(F.struct(F.lit("anchor_index").alias("field"), F.col("anchor_index").cast("long").alias("poi_id")))
    answers = F.transform(
        F.coalesce(F.col("results_poi_id"), F.array().cast("array<bigint>")),
        lambda i: F.struct(F.lit("results_poi_id").alias("field"), i.cast("long").alias("poi_id")),
    )
    return benchmark.select("question_id", "created_at", F.inline(F.concat(fields, answers))).select("question_id", "field", "poi_id", "created_at")


def orphans_found(benchmark: DataFrame, df_osm: DataFrame) -> DataFrame:
    """p7_found: distinct (question_id, field, poi_id, created_at) of references that don't hold."""
    refs = question_references(benchmark)
    return orphan_references(refs, df_osm, key="poi_id", at="created_at", parent_key="poi_id", since="loaded_at", until="deleted_at", period=span(benchmark, "created_at")).distinct()


def orphans_report(found: DataFrame) -> DataFrame:
    """Orphans per field and month (null: no created_at) with the questions concerned."""
    return found.groupBy("field", F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n_orphans"), F.countDistinct("question_id").alias("n_questions")
    )
