"""Samples whose category shares meet targets.

Targets are calibrated on the exponential-tilting dual: a record's inclusion
probability is its design weight times exp(lambda of its category), but 1 at most,
and Newton iterations move the lambdas until the expected counts are those asked
for. A category whose probability reaches 1 while less is expected than wanted is
a gap. The size of the sample is a margin of its own: what short categories leave
open goes to the others by one multiplier of all shares, within each category's
floor and what there is of it, which Newton iterations find as well. The moments
they need are the categories' record counts, aggregated once over all rows.
Records are then drawn by the pivotal method, which keeps every category's size
exactly: blocks of records first, then the at most one undecided record of each
block.

Scale: one aggregation for the moments. A draw exchanges the distinct records of
the categories asked for once, whatever the number of configurations. Blocks are
bounded, so a category with a third of all rows is spread over as many tasks as
it needs, and so are the undecided records of its blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terramill.functions.text import fold_category
from terramill.session import Scratch

#: Records of a block of the pivotal method, about.
BLOCK = 50_000
#: Category that stands for the whole population where a configuration sets no shares.
ALL = "*"


@dataclass
class Plan:
    """What a configuration asks of one category, and what it can get."""

    config_id: int
    population: str
    category: str
    share: float
    available: int
    wanted: int
    target: int
    weight: float
    seed: int
    short: bool


def folded_shares(configs: DataFrame) -> DataFrame:
    """(config_id, population, sample_size, min_per_category, seed, category, share): shares of one folded category add up.

    Configurations without shares (null or empty map) get one row of category
    ALL with share 1. Null keys, and shares that are null, NaN or not above 0,
    are left out. Null sample_size, floor and seed count as 0.
    """
    base = [F.col("config_id").cast("long").alias("config_id"), "population", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("sample_size", "min_per_category", "seed")]]
    shares = F.coalesce(F.map_entries("ratio_category"), F.array().cast("array<struct<key:string,value:double>>"))
    rows = configs.where("config_id IS NOT NULL AND population IS NOT NULL").select(*base, shares.alias("shares")).distinct()
    named = rows.select("*", F.inline("shares")).where("value > 0 AND NOT isnan(value)").withColumn("category", fold_category(F.col("key")))
    names = ["config_id", "population", "sample_size", "min_per_category", "seed"]
    named = named.groupBy(*names, "category").agg(F.sum("value").alias("share"))
    return named.unionByName(rows.where(F.size("shares") == 0).select(*names, F.lit(ALL).alias("category"), F.lit(1.0).alias("share")))


def population(df_osm: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(population, id, category): POIs and questions by folded category, null categories dropped."""
    pois = df_osm.select(F.lit("df_osm").alias("population"), F.col("poi_id").cast("long").alias("id"), F.col("category"))
    asked = benchmark.select(F.lit("benchmark").alias("population"), F.col("question_id").cast("long").alias("id"), F.col("category_query").alias("category"))
    rows = pois.unionByName(asked).where("id IS NOT NULL")
    return rows.withColumn("category", fold_category(F.col("category")))


def moments(records: DataFrame, wanted: list[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """Distinct ids of each wanted (population, category); as many numbers as the configurations name."""
    names = sorted({c for _, c in wanted if c != ALL})
    counts = {}
    if names:
        rows = records.where(F.col("category").isin(names)).groupBy("population", "category").agg(F.countDistinct("id").alias("n"))
        counts = {(r["population"], r["category"]): r["n"] for r in rows.collect()}
    whole = sorted({p for p, c in wanted if c == ALL})
    if whole:
        rows = records.where(F.col("population").isin(whole)).groupBy("population").agg(F.countDistinct("id").alias("n"))
        counts |= {(r["population"], ALL): r["n"] for r in rows.collect()}
    return counts


def tilt(available: np.ndarray, wanted: np.ndarray, tolerance: float = 1e-12, limit: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Inclusion probabilities of the categories' records and their expected counts, by Newton iterations on the exponential-tilting dual.

    The dual's gradient is the expected counts minus the wanted ones, its
    Hessian the diagonal of expected counts; steps are kept within 2. Where even
    probability 1 doesn't do, it stays there. A category without records has
    probability 1 and expects nothing.
    """
    n = available.astype(float)
    design = min(1.0, wanted.sum() / max(1.0, n.sum())) or 1.0
    most = -math.log(design)
    lam = np.where(n > 0, 0.0, most)
    live = (n > 0) & (wanted > 0)
    for _ in range(limit):
        expected = n * design * np.exp(lam)
        gap = wanted - expected
        moving = live & (np.abs(gap) > tolerance * np.maximum(1.0, wanted)) & ~((lam >= most) & (gap > 0))
        if not moving.any():
            break
        lam = np.where(moving, np.minimum(most, lam + np.clip(gap / np.where(live, expected, 1.0), -2, 2)), lam)
    chance = np.where(lam >= most, 1.0, design * np.exp(lam))
    chance = np.where(live | (n == 0), chance, 0.0)
    return chance, n * chance


def level(shares: np.ndarray, low: np.ndarray, high: np.ndarray, size: float, limit: int = 200) -> np.ndarray:
    """Shares times one multiplier, kept within low and high, that add up to ``size``; all low or all high if it is beyond them.

    Newton iterations on the multiplier's logarithm; steps that leave the
    bracket known so far are halved into it.
    """
    if size <= low.sum():
        return low.astype(float)
    if size >= high.sum():
        return high.astype(float)
    at = lambda x: np.clip(shares * math.exp(x), low, high)
    left, right = -60.0, 60.0 + max(0.0, math.log(max(1.0, high.max()) / shares.min()))
    x = math.log(size / shares.sum())
    for _ in range(limit):
        now = at(x)
        gap = size - now.sum()
        if abs(gap) <= 1e-12 * max(1.0, size):
            break
        left, right = (x, right) if gap > 0 else (left, x)
        slope = now[(now > low) & (now < high)].sum()
        x = x + gap / slope if slope > 0 else math.inf
        if not left < x < right:
            x = (left + right) / 2
    return at(x)


def integer_targets(shares: dict[str, float], available: dict[str, int], size: int, floor: int) -> dict[str, int]:
    """Records to take of each category: floors kept, nothing above what there is, the rest in the given shares (``level``), rounded by largest remainders.

    What a short category leaves open is spread over the others in their shares,
    so that ``size`` records come out wherever the population has them.
    """
    if not shares:
        return {}
    names = list(shares)
    high = np.array([available[c] for c in names], float)
    exact = dict(zip(names, level(np.array([shares[c] for c in names]), np.minimum(floor, high), high, size).tolist()))
    whole = {c: math.floor(v + 1e-9) for c, v in exact.items()}
    missing = round(sum(exact.values())) - sum(whole.values())
    for c in sorted(exact, key=lambda c: (round(whole[c] - exact[c], 9), c)):
        if missing <= 0:
            break
        if whole[c] < available[c]:
            whole[c] += 1
            missing -= 1
    return whole


def calibrate(records: DataFrame, configs: DataFrame) -> list[Plan]:
    """Targets, probabilities and shortages of every configuration and category.

    The result has a row for each share the configurations name, whatever the
    size of the population.
    """
    asked = folded_shares(configs).collect()
    counts = moments(records, [(r["population"], r["category"]) for r in asked])
    plans: list[Plan] = []
    for config in sorted({r["config_id"] for r in asked}):
        rows = sorted((r for r in asked if r["config_id"] == config), key=lambda r: r["category"])
        size, floor = rows[0]["sample_size"], rows[0]["min_per_category"]
        shares = {r["category"]: r["share"] for r in rows}
        available = {c: counts.get((rows[0]["population"], c), 0) for c in shares}
        targets = integer_targets(shares, available, size, 0 if ALL in shares else floor)
        wanted = [max(math.floor(share * size + 0.5 + 1e-9), floor if c != ALL else 0) for c, share in shares.items()]
        there = np.array([available[c] for c in shares])
        asked_chance, expected = tilt(there, np.array(wanted, float))
        weights, _ = tilt(there, np.array([targets[c] for c in shares], float))
        for i, (c, share) in enumerate(shares.items()):
            short = asked_chance[i] >= 1 and expected[i] < wanted[i]
            plans.append(Plan(config, rows[0]["population"], c, share, available[c], wanted[i], targets[c], float(weights[i]), rows[0]["seed"], bool(short)))
    return plans


PLAN = "config_id long, population string, category string, share double, available long, wanted long, target long, weight double, seed long, short boolean"


def plan_table(records: DataFrame, plans: list[Plan]) -> DataFrame:
    return records.sparkSession.createDataFrame([tuple(vars(p).values()) for p in plans], PLAN)


def quota_gaps(df_osm: DataFrame, benchmark: DataFrame, configs: DataFrame) -> DataFrame:
    """p3_found (config_id, category): categories that have fewer distinct records than they are to have, by the calibrated solution: probability 1, and less expected than wanted.

    A category that no record has is one; categories with share 0 and
    configurations without shares have none.
    """
    records = population(df_osm, benchmark)
    gaps = [p for p in calibrate(records, configs) if p.category != ALL and p.short]
    return plan_table(records, gaps).select("config_id", "category")


def pivotal(weights: np.ndarray, seed: int) -> tuple[np.ndarray, int, float]:
    """Sequential pivotal method: taken units, the undecided unit (-1: none) and its probability.

    Two units fight: one gets all of their joint probability that a single
    unit can hold, and the expected value of each is kept. Units arrive in a
    random order; a probability within 1e-9 of 0 or 1 is settled.
    """
    rng = np.random.default_rng(seed)
    luck = rng.random(len(weights))
    taken = np.zeros(len(weights), bool)
    holder, held = -1, 0.0
    for i, p in enumerate(weights.tolist()):
        if p >= 1 - 1e-9:
            taken[i] = True
            continue
        if p <= 1e-9:
            continue
        if holder < 0:
            holder, held = i, p
            continue
        both = held + p
        if both < 1 - 1e-9:
            if luck[i] * both < p:
                holder = i
            held = both
        else:
            win = holder
            if luck[i] * (2 - both) < 1 - held:
                win, holder = i, holder
            else:
                holder = i
            taken[win] = True
            held = both - 1
            if held <= 1e-9:
                holder, held = -1, 0.0
    return taken, holder, held


def _fight(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["order", "id"], ignore_index=True)
    first = frame.iloc[0]
    seed = [int(first[c]) & 0xFFFFFFFF for c in ("seed", "config_id", "block", "turn")] + [xxhash.xxh32_intdigest(first["category"])]
    taken, holder, held = pivotal(frame["weight"].to_numpy(), np.random.SeedSequence(seed).generate_state(1)[0])
    frame["weight"] = taken.astype(float)
    if holder >= 0:
        frame.loc[holder, "weight"] = held
    return frame[frame["weight"] > 0]


UNIT = "config_id long, population string, category string, id long, weight double, seed long, order long, block long, turn int"


def quota_sample(df_osm: DataFrame, benchmark: DataFrame, configs: DataFrame) -> DataFrame:
    """p3_sample (config_id, population, category, id): the drawn records, the same on every layout of the data.

    Each record counts once. A configuration's sample has exactly the targets'
    sizes: see ``integer_targets``. Empty populations give no rows.
    """
    spark = df_osm.sparkSession
    scratch = Scratch(spark, "quota")
    records = population(df_osm, benchmark)
    plans = [p for p in calibrate(records, configs) if p.target > 0]
    if not plans:
        return spark.createDataFrame([], "config_id long, population string, category string, id long")
    plan = plan_table(records, plans).select("config_id", "population", "category", "weight", "seed", "available")
    cell = ["population", "category"]
    cells = plan.groupBy(*cell).agg(F.ceil(F.max("available") / BLOCK).alias("blocks"))
    keyed = records.withColumn("category", F.explode(F.array("category", F.lit(ALL)))).where("category IS NOT NULL")
    # both broadcast tables have as many rows as the configurations name shares
    placed = keyed.join(F.broadcast(cells), cell).withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks"))).drop("blocks")
    # a block is whole in one partition: repeated records, configurations and fights need no other exchange
    units = placed.repartition(*cell, "block").dropDuplicates([*cell, "block", "id"]).join(F.broadcast(plan.drop("available")), cell)
    units = units.select("config_id", *cell, "id", "weight", "seed", F.xxhash64("seed", "id").alias("order"), "block", F.lit(0).alias("turn"))
    group = ["config_id", *cell, "block"]
    turn, blocks = 0, max(-(-p.available // BLOCK) for p in plans)
    fought = scratch.cut(units.groupBy(*group).applyInPandas(_fight, UNIT), "fought0")
    drawn = [fought.where("weight = 1")]
    while blocks > 1:  # one undecided record of a block at most; they are put into blocks again
        turn, blocks = turn + 1, -(-blocks // BLOCK)
        rest = fought.where("weight < 1").withColumns({"block": F.floor(F.col("block") / BLOCK).cast("long"), "turn": F.lit(turn)})
        fought = scratch.cut(rest.groupBy(*group).applyInPandas(_fight, UNIT), f"fought{turn}")
        drawn.append(fought.where("weight = 1"))
    # what is left of a category's last probability is a rounding error of 0 or 1
    drawn.append(fought.where("weight >= 0.5 AND weight < 1"))
    return reduce(DataFrame.unionByName, drawn).select("config_id", "population", "category", "id")


def quota_report(df_osm: DataFrame, benchmark: DataFrame, configs: DataFrame) -> DataFrame:
    """p3_report: for each configuration and category the share asked for, what is wanted, available and drawn, and the shortage."""
    plans = calibrate(population(df_osm, benchmark), configs)
    rows = plan_table(df_osm, plans)
    return rows.select("config_id", "category", "share", "wanted", "available", F.col("target").alias("drawn"), F.greatest(F.lit(0).cast("long"), F.col("wanted") - F.col("available")).alias("shortage"))
