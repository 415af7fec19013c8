"""Deterministic sampling: apportionment, exact splits, proportional subsets, draws per group.

Draws follow a hash of seed and key, never an engine's random stream: any
layout of the data gives the same rows. md5 makes them the same in SQL.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terramill.session import Scratch


#: How many times deeper strata that lack questions are looked at next.
DEEPER = 8


def draw_order(seed: int | str, *keys: str) -> Column:
    """The order of a draw: md5 of seed and keys, joined by colons."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def allocate(n: int, ratios: dict) -> dict:
    """n units over weights by largest remainders; ties in the order given; weights that add up to nothing raise."""
    total = sum(ratios.values())
    exact = {k: n * w / total for k, w in ratios.items()}
    out = {k: math.floor(v) for k, v in exact.items()}
    by_remainder = sorted(exact, key=lambda k: out[k] - exact[k])
    for k in by_remainder[: n - sum(out.values())]:
        out[k] += 1
    return out


def allocate_table(weights: DataFrame, n: int, key: str, weight: str) -> DataFrame:
    """(key, quota): the same for a table of strata; ties go to the smaller key. One row per stratum, so one partition holds them."""
    everywhere = Window.partitionBy(F.lit(0))
    exact = F.lit(float(n)) * F.col(weight) / F.sum(weight).over(everywhere)
    rows = weights.select(key, exact.alias("exact")).withColumn("low", F.floor("exact").cast("long"))
    rows = rows.withColumn("place", F.row_number().over(everywhere.orderBy(F.desc(F.col("exact") - F.col("low")), key)))
    rows = rows.withColumn("open", F.lit(n) - F.sum("low").over(everywhere))
    return rows.select(key, (F.col("low") + F.when(F.col("place") <= F.col("open"), 1).otherwise(0)).alias("quota"))


def per_group(rows: DataFrame, group: list[str], order: list, n: int | Column) -> DataFrame:
    """The first n rows of every group."""
    ranked = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("__rn") <= n).drop("__rn")


def first_answered(
    scratch: Scratch, strata: list[tuple[int, float]], n: int, candidates: Callable[[int], DataFrame], answer: Callable[[DataFrame], DataFrame], key: list[str]
) -> tuple[DataFrame, DataFrame]:
    """n candidates that have answers, spread over the strata by weight, and the answers of all candidates looked at.

    ``strata``: (number, weight). ``candidates(depth)``: (stratum, place, key,
    ...) of each stratum's first ``depth`` candidates, numbered from 1 without
    gaps. ``answer(candidates)``: rows with the key. A stratum gets its share of
    n by largest remainders; what it lacks goes to the others in their shares, so
    that fewer than n come out only if there aren't more. Candidates are looked
    at in their order, as deep as it takes: the result doesn't depend on depth.
    Only strata that may give more go on, and only with candidates not seen yet.
    """
    weights = {s: float(w) for s, w in strata if w > 0}
    if not weights or n < 1:
        empty = candidates(1).limit(0)
        return empty, answer(empty)
    quota = allocate(n, weights)
    depth, turn = 2 * max(quota.values()) + 2, 0
    table = scratch.spark.createDataFrame([(s, w, quota[s]) for s, w in weights.items()], "stratum int, weight double, quota long")
    before, more, counts = 0, list(weights), {}
    good = answers = None
    while True:
        rows = candidates(depth)
        if turn:
            rows = rows.where((F.col("place") > before) & F.col("stratum").isin(more))
        seen = scratch.cut(rows, f"seen{turn}")
        found = scratch.cut(answer(seen), f"answers{turn}")
        fits = scratch.cut(seen.join(found.select(*key).distinct(), key, "left_semi"), f"good{turn}")
        good, answers = (good.unionByName(fits), answers.unionByName(found)) if turn else (fits, found)
        ranked = good.withColumn("turn", F.row_number().over(Window.partitionBy("stratum").orderBy("place"))).join(table, "stratum")
        score = F.struct((F.col("turn") > F.col("quota")).alias("extra"), ((F.col("turn") - 0.5) / F.col("weight")).alias("score"), "stratum")
        chosen = scratch.cut(ranked.withColumn("score", score).orderBy("score").limit(n), f"chosen{turn}")
        for r in seen.groupBy("stratum").agg(F.max("place")).collect():
            counts[r[0]] = [r[1], counts.get(r[0], [0, 0])[1]]
        for r in fits.groupBy("stratum").count().collect():
            counts[r[0]][1] += r[1]
        n_chosen, last = chosen.agg(F.count("*"), F.max("score")).first()
        # where there may be more, the next one would come after all that are chosen
        comes = lambda s: (counts[s][1] + 1 > quota[s], (counts[s][1] + 0.5) / weights[s], s)
        more = [s for s in counts if s in weights and counts[s][0] >= depth and (n_chosen < n or comes(s) < tuple(last))]
        if not more:
            return chosen.drop("turn", "weight", "quota", "score", "place"), answers
        before, depth, turn = depth, depth * DEEPER, turn + 1


def numbered(rows: DataFrame, bucket: Column, order: list, group: list[str] | None = None) -> DataFrame:
    """Adds place, from 0, and total, the number of rows, within each group. Buckets follow ``order``, and no task sorts more than one of them."""
    group = group or []
    rows = rows.withColumn("__bucket", bucket)
    everywhere = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    counts = rows.groupBy(*group, "__bucket").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(everywhere.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*group, "__bucket", before.alias("__before"), F.sum("__n").over(everywhere).alias("total"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy(*group, "__bucket").orderBy(*order)) - 1
    return rows.join(counts, [*group, "__bucket"]).withColumn("place", place).drop("__bucket", "__before")


def exact_split(rows: DataFrame, key: str, ratio: float, seed: int = 42, buckets: int = 256) -> DataFrame:
    """Adds is_test: exactly floor(n * ratio) rows, the first of the draw. Keys are unique.

    The rank of a row is its rank within a bucket of the draw plus the rows of
    the buckets before: no task sorts all rows.
    """
    order = draw_order(seed, key)
    rows = rows.withColumn("__order", order).withColumn("__bucket", F.conv(F.substring("__order", 1, 4), 16, 10).cast("int") % 65536)
    rows = rows.withColumn("__bucket", F.floor(F.col("__bucket") / (65536 // buckets)).cast("int"))
    counts = rows.groupBy("__bucket").agg(F.count("*").alias("__n"))
    total = F.sum("__n").over(Window.partitionBy(F.lit(0)))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__bucket", before.alias("__before"), F.floor(total * F.lit(ratio)).alias("__test"))
    ranked = rows.join(F.broadcast(counts), "__bucket")  # as many rows as buckets
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__bucket").orderBy("__order", key))
    return ranked.withColumn("is_test", place <= F.col("__test")).drop("__order", "__bucket", "__before", "__test")


def stratify(rows: DataFrame, stratum: str, ratios: dict, key: str, seed: int = 42) -> DataFrame:
    """The largest subset whose strata have the given shares; the poorest stratum decides.

    Without ratios all rows are kept. Rows of strata that aren't named go; a
    named stratum without rows leaves nothing.
    """
    ratios = {k: r for k, r in (ratios or {}).items() if r is not None and r > 0}
    if not ratios:
        return rows
    counts = {r[0]: r[1] for r in rows.where(F.col(stratum).isin(list(ratios))).groupBy(stratum).count().collect()}
    total = min(counts.get(k, 0) / r for k, r in ratios.items())
    quota = F.create_map(*[F.lit(v) for k, r in ratios.items() for v in (k, math.floor(total * r + 1e-9))])
    named = rows.where(F.col(stratum).isin(list(ratios)))
    return per_group(named, [stratum], [draw_order(seed, key), key], F.try_element_at(quota, F.col(stratum)))
