"""Groups of linked records, and splits that keep them together.

Linked records are the connected components of records and the keys they share.
Components are found by random-mate contraction: in each round every vertex
tosses a coin; a vertex with tails that has a neighbour with heads collapses
into it. Edges are rewritten by joins, loops and repeats vanish, until no edge
is left. The stored steps are then unwound by pointer doubling.

Scale: a key shared by many records becomes a two-level star instead of pairs:
records point to the least record of their salted part of the key, and these to
the least of the key. Each round costs joins over the edges that are left, a
constant factor fewer each time. Every round is a written table. The last edges,
few enough for one task whatever there was at first, are contracted in one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terramill.functions.text import fold_label
from terramill.session import Scratch

#: Parts into which the records of a key are salted.
SALTS = 64
#: Edges that one task contracts.
FEW = 200_000
#: Groups of a bucket of the running sums, at most about.
BUCKET = 20_000


def incidences(batches: DataFrame) -> DataFrame:
    """Distinct (batch_id, key) of every non-null poi_id and author; keys are hashed with their kind to 128 bits."""
    author = fold_label(F.col("author"))
    keys = F.concat(
        F.transform(F.coalesce(F.col("poi_ids"), F.array().cast("array<bigint>")), lambda p: F.concat(F.lit("p"), p.cast("string"))),
        F.array(F.concat(F.lit("a"), author)),
    )
    rows = batches.where("batch_id IS NOT NULL").select(F.col("batch_id").cast("long").alias("batch_id"), F.explode(F.array_distinct(keys)).alias("key"))
    return rows.where("key IS NOT NULL")


def star_edges(links: DataFrame, vertex: str = "batch_id", key: str = "key") -> DataFrame:
    """Edges (u, v), u < v, whose components are those of the records sharing keys.

    Salting bounds what a join task gets of one key: a part has at most about
    1/SALTS of its records, and the parts' heads are at most SALTS per key.
    """
    links = links.select(F.col(vertex).alias("v"), F.xxhash64(F.col(key)).alias("h1"), F.hash(F.col(key)).alias("h2"))
    links = links.withColumn("salt", F.pmod(F.xxhash64("v", F.lit(7)), F.lit(SALTS)).cast("int"))
    heads = links.groupBy("h1", "h2", "salt").agg(F.min("v").alias("u"))
    hub = heads.groupBy("h1", "h2").agg(F.min("u").alias("top"), F.array_distinct(F.collect_list("u")).alias("us"))
    upper = hub.select(F.col("top").alias("u"), F.explode("us").alias("v"))
    lower = links.join(heads, ["h1", "h2", "salt"]).select("u", "v")
    return lower.where("u < v").unionByName(upper.where("u < v")).distinct()


def _finish(frames: Iterator[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    """The same contraction of the few edges that are left, in memory: (vertex, parent) with each vertex's root as its parent."""
    edges = pd.concat([*frames, pd.DataFrame({"u": [], "v": []}, dtype="int64")], ignore_index=True)
    ids, ends = np.unique(edges[["u", "v"]].to_numpy(np.int64), return_inverse=True)
    u, v = ends.reshape(-1, 2).T
    root = np.arange(len(ids))
    rng = np.random.default_rng(seed)
    while len(u):
        heads = rng.random(len(ids)) < 0.5
        mixed = heads[u] != heads[v]
        tail, head = np.where(heads[u], v, u)[mixed], np.where(heads[u], u, v)[mixed]
        parent = np.full(len(ids), len(ids))
        np.minimum.at(parent, tail, head)
        moved = np.where(parent < len(ids), parent, np.arange(len(ids)))
        root, u, v = moved[root], moved[u], moved[v]
        u, v = np.unique(np.sort(np.column_stack([u, v])[u != v], axis=1), axis=0).T
    gone = root != np.arange(len(ids))
    yield pd.DataFrame({"vertex": ids[gone], "parent": ids[root[gone]]})


def contract(edges: DataFrame, scratch: Scratch, seed: int = 42, limit: int = 400) -> DataFrame | None:
    """(vertex, root) of every vertex on an edge, by random-mate contraction; None without edges.

    As soon as the edges left are FEW, one task ends it by the same rule: roots
    may be others then, components aren't.
    """
    edges = scratch.cut(edges, "edges0")
    steps: list[DataFrame] = []
    while left := edges.count():
        turn = len(steps)
        if left <= FEW:
            last = edges.coalesce(1).mapInPandas(lambda frames: _finish(frames, seed), "vertex long, parent long")
            steps.append(scratch.cut(last, f"step{turn}"))
            break
        if turn >= limit:
            raise RuntimeError(f"edges are left after {limit} rounds")
        heads = lambda c: F.xxhash64(F.lit(seed * 1_000_003 + turn), F.col(c)) % 2 == 0
        mixed = edges.where(heads("u") != heads("v"))
        step = mixed.select(F.when(heads("u"), F.col("v")).otherwise(F.col("u")).alias("vertex"), F.when(heads("u"), F.col("u")).otherwise(F.col("v")).alias("parent"))
        step = scratch.cut(step.groupBy("vertex").agg(F.min("parent").alias("parent")), f"step{turn}")
        steps.append(step)
        moved = edges
        for end in ("u", "v"):
            move = step.select(F.col("vertex").alias(end), F.col("parent").alias("to"))
            moved = moved.join(move, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        moved = moved.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        edges = scratch.cut(moved, f"edges{turn + 1}")
        scratch.drop(f"edges{turn}")
    if not steps:
        return None
    # each vertex collapses once; chains are as long as there are rounds at most
    labels = steps[0]
    for step in steps[1:]:
        labels = labels.unionByName(step)
    hops = 1
    labels = scratch.cut(labels, "labels0")
    for k in range(len(steps).bit_length()):
        if hops >= len(steps):
            break
        ahead = labels.select(F.col("vertex").alias("parent"), F.col("parent").alias("far"))
        labels = scratch.cut(labels.join(ahead, "parent", "left").select("vertex", F.coalesce("far", "parent").alias("parent")), f"labels{k + 1}")
        hops *= 2
    return labels.withColumnRenamed("parent", "root")


def linked_groups(batches: DataFrame, seed: int = 42) -> DataFrame:
    """(batch_id, group_id) of every batch of a group of two or more; group_id is the least batch_id of the group.

    Batches are linked by a common non-null poi_id or author (case and blanks
    around ignored, a blank author is none), directly or through others.
    Repeated rows count once; rows without a batch_id are left out.
    """
    scratch = Scratch(batches.sparkSession, "groups")
    labels = contract(star_edges(incidences(batches)), scratch, seed)
    if labels is None:
        return batches.sparkSession.createDataFrame([], "batch_id long, group_id long")
    # roots never collapsed, so they enter by themselves
    members = labels.select(F.col("vertex").alias("batch_id"), "root").unionByName(labels.select(F.col("root").alias("batch_id"), "root").distinct())
    members = scratch.cut(members, "members")
    least = members.groupBy("root").agg(F.min("batch_id").alias("group_id"))
    return members.join(least, "root").select("batch_id", "group_id")


def split_groups(weights: DataFrame, configs: DataFrame) -> DataFrame:
    """(config_id, group_id, split): whole groups assigned to test, validation and train by cumulative weight.

    ``weights``: (group_id, weight). A group heavier than 1 % of all is placed
    first, heaviest first, into the split with the largest open share: these are
    under 100, a bound that doesn't depend on the data. The others follow in the
    order of a seeded hash; those whose cumulative weight ends within the rest
    of the test share go to test, the next to validation, the others to train.
    The running sum is taken within hash buckets after adding the sums of the
    buckets before, so no task holds all groups; buckets grow in number with them.
    A null or negative ratio counts as 0; ratios above 1 together leave nothing for train.
    """
    count, total = weights.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    buckets = max(1024, 1 << (count // BUCKET).bit_length())
    large = weights.where(F.col("weight") > total / 100)
    if (n := large.count()) >= 100:
        raise RuntimeError(f"{n} groups above 1 % of all")
    heavy = [(r["group_id"], r["weight"]) for r in large.orderBy(F.desc("weight"), "group_id").collect()]
    light = weights.where(F.col("weight") <= total / 100)
    placed, open_shares = [], []
    for c in configs.select("config_id", "ratio_test", "ratio_validation", "seed").distinct().collect():
        test, valid = (min(1.0, max(0.0, r or 0.0)) for r in (c["ratio_test"], c["ratio_validation"]))
        valid = min(valid, 1.0 - test)
        rest = {"test": test * total, "validation": valid * total, "train": (1 - test - valid) * total}
        for group, weight in heavy:
            to = max(rest, key=lambda s: rest[s])
            rest[to] -= weight
            placed.append((c["config_id"], group, to))
        open_shares.append((c["config_id"], c["seed"] or 0, max(0.0, rest["test"]), max(0.0, rest["validation"])))
    spark = weights.sparkSession
    if not open_shares:
        return spark.createDataFrame([], "config_id long, group_id long, split string")
    # the configurations are few by nature: each row is repeated for every one
    shares = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(c, ("long", "long", "double", "double"), ("config_id", "seed", "test", "validation"))]) for c in open_shares])
    rows = light.select("group_id", "weight", F.inline(shares)).withColumn("order", F.xxhash64("seed", "group_id"))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("order", 64 - (buckets.bit_length() - 1)))
    sums = rows.groupBy("config_id", "bucket").agg(F.sum("weight").alias("here"))
    before = Window.partitionBy("config_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("config_id", "bucket", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("config_id", "bucket").orderBy(F.shiftrightunsigned("order", 1), "order", "group_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(sums, ["config_id", "bucket"]).withColumn("upto", F.col("before") + F.sum("weight").over(within))
    split = F.when(F.col("upto") <= F.col("test"), "test").when(F.col("upto") <= F.col("test") + F.col("validation"), "validation").otherwise("train")
    placed_rows = spark.createDataFrame(placed, "config_id long, group_id long, split string")
    return rows.select("config_id", "group_id", split.alias("split")).unionByName(placed_rows)


def group_splits(batches: DataFrame, configs: DataFrame) -> DataFrame:
    """p2_splits (config_id, batch_id, split): every batch in exactly one split per configuration, groups kept whole."""
    scratch = Scratch(batches.sparkSession, "splits")
    ids = batches.where("batch_id IS NOT NULL").select(F.col("batch_id").cast("long").alias("batch_id")).distinct()
    owner = scratch.cut(ids.join(linked_groups(batches), "batch_id", "left").select("batch_id", F.coalesce("group_id", "batch_id").alias("group_id")), "owner")
    weights = scratch.cut(owner.groupBy("group_id").agg(F.count("*").alias("weight")), "weights")
    chosen = scratch.cut(split_groups(weights, configs), "chosen")
    return owner.join(chosen, "group_id").select("config_id", "batch_id", "split")


def split_report(splits: DataFrame, configs: DataFrame) -> DataFrame:
    """Share reached by each split of each configuration beside its target."""
    counts = splits.groupBy("config_id", "split").agg(F.count("*").alias("n_batches"))
    total = splits.groupBy("config_id").agg(F.count("*").alias("n_all"))
    test, valid = F.coalesce("ratio_test", F.lit(0.0)), F.coalesce("ratio_validation", F.lit(0.0))
    goal = F.when(F.col("split") == "test", test).when(F.col("split") == "validation", valid).otherwise(1 - test - valid)
    return counts.join(total, "config_id").join(configs.select("config_id", "ratio_test", "ratio_validation").distinct(), "config_id").select(
        "config_id", "split", "n_batches", (F.col("n_batches") / F.col("n_all")).alias("share"), goal.alias("target")
    )
