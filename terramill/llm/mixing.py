"""Mixtures of sources in target shares of tokens.

Shares are normalised target weights, or temperature weights: source token
shares raised to an exponent that is bisected until the mixture has a target
entropy, or repeats no source more often than allowed. Weights become token
budgets, and budgets become documents by block permutations: the documents of a
source are permuted by a seeded hash, block by block; whole passes over all of
them are taken while the budget lasts, then the blocks' documents up to the rest.

Scale: documents are tokenised once. Running sums are taken within hash blocks
after adding the sums of earlier blocks, so a source with a third of all
documents is spread over all blocks. Only per-source totals reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terramill.functions.text import fold_label
from terramill.llm.bpe import TOKENIZERS, count_tokens
from terramill.session import Scratch

#: Blocks of the permutation of a source, a power of two.
BLOCKS = 1024


def temperature_weights(sizes: dict[str, float], exponent: float) -> dict[str, float]:
    """Normalised weights proportional to size ** exponent; empty sources get 0."""
    live = {s: math.log(n) for s, n in sizes.items() if n > 0}
    top = max(live.values(), default=0.0)
    raw = {s: math.exp(exponent * (v - top)) for s, v in live.items()}
    total = sum(raw.values()) or 1.0
    return {s: raw.get(s, 0.0) / total for s in sizes}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def bisect(good, low: float, high: float, rounds: int = 80) -> float:
    """The border between ``low``, where ``good`` fails or is to be improved on, and ``high``, where it holds."""
    if good(low):
        return low
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (low, mid) if good(mid) else (mid, high)
    return high


def exponent_for_entropy(sizes: dict[str, float], target: float) -> float:
    """The exponent in [0, 64] whose mixture has the target entropy: 0 is the most even mixture, large ones take the largest source only."""
    return bisect(lambda a: entropy(temperature_weights(sizes, a)) <= target + 1e-12, 0.0, 64.0)


def exponent_for_repeats(sizes: dict[str, float], total: float, repeats: dict[str, float]) -> float:
    """The least exponent in [0, 1], so the most even mixture, that repeats no source above its limit; 1 if none does."""

    def fits(a: float) -> bool:
        weights = temperature_weights(sizes, a)
        return all(weights[s] * total <= repeats[s] * sizes[s] * (1 + 1e-12) for s in sizes)

    return bisect(fits, 0.0, 1.0)


@dataclass
class Budget:
    mix_id: int
    source: str
    target_share: float
    available: int
    target_tokens: float
    budget: float
    repeats: int


def budgets(targets: list, sizes: dict[str, int]) -> list[Budget]:
    """Token budget of every mix and source.

    A source gets its normalised share of the mix's total_tokens, but no more
    than max_repeats passes over what it has: what it lacks is not given to
    others, whose shares of the total would no longer be theirs. A null total
    is the largest at which every source that has documents meets its share.
    Null, NaN and negative weights are 0; null max_repeats is 1; rows of one
    mix and source add their weights and take the lower limit.
    """
    out: list[Budget] = []
    for mix in sorted({t["mix_id"] for t in targets if t["mix_id"] is not None}):
        rows = [t for t in targets if t["mix_id"] == mix and t["source"] is not None]
        weight, repeats = {}, {}
        for t in rows:
            w = t["target_weight"]
            weight[t["source"]] = weight.get(t["source"], 0.0) + (w if w is not None and math.isfinite(w) and w > 0 else 0.0)
            limit = 1 if t["max_repeats"] is None else max(0, t["max_repeats"])
            repeats[t["source"]] = min(limit, repeats.get(t["source"], limit))
        whole = sum(weight.values())
        if whole <= 0:
            continue
        share = {s: w / whole for s, w in weight.items()}
        total = max((t["total_tokens"] for t in rows if t["total_tokens"] is not None), default=None)
        if total is None:
            total = min((repeats[s] * sizes[s] / share[s] for s in share if share[s] > 0 and sizes.get(s, 0) > 0), default=0)
        for s in sorted(share):
            have = sizes.get(s, 0)
            out.append(Budget(mix, s, share[s], have, share[s] * total, min(share[s] * total, float(repeats[s] * have)), repeats[s]))
    return out


BUDGET = "mix_id long, source string, target_share double, available long, target_tokens double, budget double, repeats int"


def source_tokens(documents: DataFrame, scratch: Scratch, path: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents with tokens and a source, written once; repeated rows count once."""
    sized = count_tokens(documents.where("doc_id IS NOT NULL").withColumn("source", fold_label(F.col("source"))).where("source IS NOT NULL"), ["doc_id", "source"], path)
    return scratch.cut(sized.where("n_tokens > 0").groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens")), "sizes")


def realise(docs: DataFrame, plan: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """(keys, source, doc_id, n_tokens, copies) of the documents that ``plan`` (keys, source, available, budget) takes.

    Passes over all documents of a source while the budget lasts, then those of
    its permutation, block by block, up to the rest. A source's tokens stay
    below its budget by less than its longest document.
    """
    passes = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available") + 1e-12)).otherwise(0)
    table = plan.select(*keys, "source", passes.cast("int").alias("passes"), (F.col("budget") - passes * F.col("available") + 1e-6).alias("rest"))
    # as many rows as mix_targets
    rows = docs.join(F.broadcast(table), "source").withColumn("order", F.xxhash64(F.lit(seed), *keys, "doc_id"))
    rows = rows.withColumn("block", F.shiftrightunsigned("order", 64 - (BLOCKS.bit_length() - 1)))
    sums = rows.groupBy(*keys, "source", "block").agg(F.sum("n_tokens").alias("here"))
    before = Window.partitionBy(*keys, "source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "source", "block", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(*keys, "source", "block").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(sums, [*keys, "source", "block"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(within))
    rows = rows.withColumn("copies", F.col("passes") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0))
    return rows.where("copies > 0").select(*keys, "source", "doc_id", "n_tokens", "copies")


def planned(documents: DataFrame, mix_targets: DataFrame, path: str) -> tuple[DataFrame, list[Budget]]:
    """Sized documents, and the budgets of the targets."""
    docs = source_tokens(documents, Scratch(documents.sparkSession, "mix"), path)
    targets = [r.asDict() for r in mix_targets.withColumn("source", fold_label(F.col("source"))).distinct().collect()]
    named = sorted({t["source"] for t in targets if t["source"]})
    totals = docs.where(F.col("source").isin(named)).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect() if named else []
    return docs, budgets(targets, {r["source"]: r["n"] for r in totals})


def mix(documents: DataFrame, mix_targets: DataFrame, path: str = TOKENIZERS, seed: int = 42) -> tuple[DataFrame, list[Budget]]:
    """The chosen documents (mix_id, source, doc_id, n_tokens, copies) and the budgets they realise.

    Documents without tokens or source are in no mix. Empty tables give no rows.
    """
    docs, plan = planned(documents, mix_targets, path)
    table = docs.sparkSession.createDataFrame([tuple(vars(b).values()) for b in plan], BUDGET)
    return realise(docs, table, ["mix_id"], seed), plan


def mix_documents(documents: DataFrame, mix_targets: DataFrame, path: str = TOKENIZERS) -> DataFrame:
    """p9_mix (mix_id, source, doc_id, n_tokens, copies)."""
    return mix(documents, mix_targets, path)[0]


def mix_report(documents: DataFrame, mix_targets: DataFrame, path: str = TOKENIZERS) -> DataFrame:
    """p9_report: for each mix and source the target share and tokens, the tokens and share reached, the highest use of a document, and the shortage."""
    chosen, plan = mix(documents, mix_targets, path)
    table = documents.sparkSession.createDataFrame([tuple(vars(b).values()) for b in plan], BUDGET)
    return _reached(chosen, table, ["mix_id"])


def _reached(chosen: DataFrame, table: DataFrame, keys: list[str], *more: str) -> DataFrame:
    got = chosen.groupBy(*keys, "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"), F.count("*").alias("n_documents"))
    rows = table.join(got, [*keys, "source"], "left")
    tokens = F.coalesce("tokens", F.lit(0).cast("long"))
    all_tokens = F.sum(tokens).over(Window.partitionBy(*keys))  # a mix has as many rows as it names sources
    return rows.select(
        *keys, "source", *more, "target_share", "available", F.round("target_tokens").cast("long").alias("target_tokens"), tokens.alias("tokens"),
        F.try_divide(tokens, all_tokens).alias("actual_share"), F.try_divide(tokens, F.col("target_tokens") / F.col("target_share")).alias("share_of_target_total"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("n_documents", F.lit(0).cast("long")).alias("n_documents"),
        F.greatest(F.lit(0).cast("long"), F.round(F.col("target_tokens") - F.col("budget")).cast("long")).alias("shortage"),
    )


TEMPERATURE = "rule string, exponent double, " + BUDGET


def temperature_budgets(plan: list[Budget]) -> list[tuple]:
    """TEMPERATURE rows: the budgets of each mix by temperature weights instead of fixed ones, over its sources that have documents.

    Rule 'entropy': the exponent whose mixture is as diverse as the target
    weights. Rule 'repeats': the least exponent, so the most even mixture, that
    keeps max_repeats at the mix's total. Both spend that total, as far as
    max_repeats lets them.
    """
    out = []
    for mix_id in sorted({b.mix_id for b in plan}):
        rows = [b for b in plan if b.mix_id == mix_id and b.available > 0]
        sizes = {b.source: float(b.available) for b in rows}
        if not sizes:
            continue
        whole = sum(b.target_share for b in rows) or 1.0
        total = sum(b.target_tokens for b in plan if b.mix_id == mix_id)
        exponents = {
            "entropy": exponent_for_entropy(sizes, entropy({b.source: b.target_share / whole for b in rows})),
            "repeats": exponent_for_repeats(sizes, total, {b.source: float(b.repeats) for b in rows}),
        }
        for rule, exponent in exponents.items():
            weights = temperature_weights(sizes, exponent)
            out += [(rule, exponent, mix_id, b.source, weights[b.source], b.available, weights[b.source] * total, min(weights[b.source] * total, float(b.repeats * b.available)), b.repeats) for b in rows]
    return out


def temperature(documents: DataFrame, mix_targets: DataFrame, path: str = TOKENIZERS, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The documents of the temperature mixes (mix_id, rule, source, doc_id, n_tokens, copies), and their TEMPERATURE table."""
    docs, plan = planned(documents, mix_targets, path)
    table = docs.sparkSession.createDataFrame(temperature_budgets(plan), TEMPERATURE)
    return realise(docs, table, ["mix_id", "rule"], seed), table


def temperature_documents(documents: DataFrame, mix_targets: DataFrame, path: str = TOKENIZERS) -> DataFrame:
    """p9_temperature_mix (mix_id, rule, source, doc_id, n_tokens, copies)."""
    return temperature(documents, mix_targets, path)[0]


def temperature_report(documents: DataFrame, mix_targets: DataFrame, path: str = TOKENIZERS) -> DataFrame:
    """p9_temperature: for each mix, rule and source the exponent, its weight as target_share, and what the realised mix reaches, as in ``mix_report``."""
    chosen, table = temperature(documents, mix_targets, path)
    return _reached(chosen, table, ["mix_id", "rule"], "exponent")
