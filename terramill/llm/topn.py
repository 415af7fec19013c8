"""Top N distinct items of every group by merging sorted runs with a loser tree.

Every task sorts its entries in bounded chunks into runs, ordered by group and
score, and stores of each run and group only the first N distinct items: an
item among a group's first N is among the first N of its run. Runs are exchanged
by group and stream through a loser tree, group by group: the tree merges the
slices that the runs have of a group, and after N outputs all of them seek to the
next group. At most FAN_IN runs are merged at once; more of them are merged in
passes, FAN_IN to one, until that few are left.

Scale: shuffles are of pruned runs only. The number of partitions follows the
number of their rows, the number of passes that of the runs. A task holds one
batch of rows and one group's slices, FAN_IN times N entries at most, however
large the group: one with a third of all rows has N entries in each run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terramill.functions.text import fold_category
from terramill.session import Scratch

#: Entries sorted at once into a run.
RUN = 1 << 18
#: Runs merged at once.
FAN_IN = 16
#: Entries of a partition of runs, about.
PART = 500_000
NO_RANK = (1 << 31) - 1
ENTRY = "category_query string, anchor_index long, poi_id long, dist double, rank int"
ENTRY_COLUMNS = [c.split()[0] for c in ENTRY.split(", ")]
RUNS = ENTRY + ", run long"
MERGED = RUNS + ", target long"
#: A group as far as one merge goes: ``target`` is the run that comes out.
GROUP = ["category_query", "anchor_index", "target"]
KEYS = ["category_query", "anchor_index", "dist", "rank", "poi_id"]


def entries(benchmark: DataFrame) -> DataFrame:
    """Valid answer entries (category_query, anchor_index, poi_id, dist, rank), one per list position."""
    at = lambda name: F.get(F.col(name), F.col("i"))
    rows = benchmark.where("category_query IS NOT NULL AND anchor_index IS NOT NULL AND results_poi_dist IS NOT NULL AND results_poi_id IS NOT NULL")
    rows = rows.select(
        fold_category(F.col("category_query")).alias("category_query"), F.col("anchor_index").cast("long").alias("anchor_index"),
        F.inline(F.transform("results_poi_id", lambda p, i: F.struct(p.cast("long").alias("poi_id"), F.get("results_poi_dist", i).cast("double").alias("dist"), F.get("results_poi_rank", i).cast("int").alias("rank")))),
    )
    rows = rows.where("poi_id IS NOT NULL AND dist IS NOT NULL AND NOT isnan(dist) AND dist >= 0")
    return rows.withColumns({"rank": F.coalesce("rank", F.lit(NO_RANK)), "dist": F.col("dist") + 0.0})


def sort_run(frame: pd.DataFrame, n: int) -> pd.DataFrame:
    """A run: sorted by group and score, each group cut to its first ``n`` distinct items."""
    category, names = pd.factorize(frame["category_query"], sort=True)
    anchor, dist, rank, poi = (frame[c].to_numpy() for c in KEYS[1:])
    best = np.lexsort((rank, dist, poi, anchor, category))
    c, a, p = category[best], anchor[best], poi[best]
    first = np.ones(len(best), bool)
    first[1:] = (c[1:] != c[:-1]) | (a[1:] != a[:-1]) | (p[1:] != p[:-1])
    best = best[first]
    order = best[np.lexsort((poi[best], rank[best], dist[best], anchor[best], category[best]))]
    c, a = category[order], anchor[order]
    start = np.ones(len(order), bool)
    start[1:] = (c[1:] != c[:-1]) | (a[1:] != a[:-1])
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    return frame.iloc[order[place < n]]


class LoserTree:
    """Tournament over sorted sources: the winner is on top, each inner node keeps the loser of its match.

    A key of None is an exhausted source, which loses against all others.
    """

    def __init__(self, keys: list):
        self.size = 1 << max(0, (len(keys) - 1).bit_length())
        self.keys = keys + [None] * (self.size - len(keys))
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._wins(a, b) else (b, a)
        self.winner = winners[1] if self.size > 1 else 0

    def _wins(self, a: int, b: int) -> bool:
        left, right = self.keys[a], self.keys[b]
        return left is not None and (right is None or left <= right)

    def replace(self, key) -> None:
        """The winner's source goes on to ``key``; only the matches on its path are played again."""
        source = self.winner
        self.keys[source] = key
        node, best, keys, losers = (source + self.size) >> 1, source, self.keys, self.losers
        while node:
            other = losers[node]
            left, right = keys[other], keys[best]
            if left is not None and (right is None or left < right):
                losers[node], best = best, other
            node >>= 1
        self.winner = best


def merge_slices(bounds: list[int], scores: list[tuple], n: int, fan_in: int) -> list[int]:
    """Positions of the first ``n`` distinct items of one group. Slice i is from bounds[i] to bounds[i + 1], sorted; a score ends with the item."""
    at, ends = bounds[:-1], bounds[1:]
    if len(at) > fan_in:
        raise ValueError(f"{len(at)} runs at once")
    tree = LoserTree([scores[i] for i in at])
    at, kept, seen = list(at), [], set()
    while len(kept) < n and (top := tree.keys[tree.winner]) is not None:
        source = tree.winner
        if top[-1] not in seen:
            seen.add(top[-1])
            kept.append(at[source])
        at[source] += 1
        tree.replace(scores[at[source]] if at[source] < ends[source] else None)
    return kept


def _differ(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Row by row, or against one row, whether the groups differ."""
    out = np.zeros(len(left), bool)
    for c in GROUP:
        out |= left[c].to_numpy() != right[c].to_numpy()
    return out


def merge_groups(frame: pd.DataFrame, n: int, fan_in: int) -> pd.DataFrame:
    """First ``n`` distinct items of every group of a frame of whole groups, ordered by group, run and score."""
    if not len(frame):
        return frame
    group = np.r_[True, _differ(frame.iloc[1:], frame.iloc[:-1])]
    run = frame["run"].to_numpy()
    part = group.copy()
    part[1:] |= run[1:] != run[:-1]
    starts, parts = np.flatnonzero(np.r_[group, True]), np.flatnonzero(np.r_[part, True])
    first = np.searchsorted(parts, starts)  # number of the group's first slice
    keep, order = np.ones(len(frame), bool), np.arange(len(frame))
    several = np.flatnonzero(np.diff(first) > 1)  # a single slice is a run's first n already
    if len(several):
        scores = list(zip(*(frame[c].tolist() for c in ("dist", "rank", "poi_id"))))
        bounds = parts.tolist()
        for g in several.tolist():
            kept = merge_slices(bounds[first[g] : first[g + 1] + 1], scores, n, fan_in)
            keep[starts[g] + len(kept) : starts[g + 1]] = False
            order[starts[g] : starts[g] + len(kept)] = kept
    return frame.iloc[order[keep]]


def merge_runs(frames: Iterator[pd.DataFrame], n: int, fan_in: int) -> Iterator[pd.DataFrame]:
    """The same for a stream of frames whose groups may go on in the next one."""
    held: pd.DataFrame | None = None
    for frame in frames:
        if not len(frame):
            continue
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        whole = len(frame) - int((~_differ(frame, frame.iloc[-1:])).sum())
        held = frame.iloc[whole:]
        if whole:
            yield merge_groups(frame.iloc[:whole], n, fan_in)
    if held is not None:
        yield merge_groups(held, n, fan_in)


def top_n(rows: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` first distinct items of each (category_query, anchor_index), by distance, rank, poi_id.

    ``rows`` has the columns of ``entries``; repeated entries count once, by
    the smallest distance and then rank. Ties go to the smaller poi_id. Groups
    with fewer items are kept whole; an empty input gives no rows.
    """
    spark = rows.sparkSession
    size, fan_in = RUN, FAN_IN

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        held: list[pd.DataFrame] = []
        n_held = 0
        for frame in frames:
            held.append(frame)
            n_held += len(frame)
            if n_held >= size:
                yield sort_run(pd.concat(held, ignore_index=True), n).assign(run=(part << 32) + count)
                held, n_held, count = [], 0, count + 1
        if n_held:
            yield sort_run(pd.concat(held, ignore_index=True), n).assign(run=(part << 32) + count)

    scratch = Scratch(spark, "runs")
    runs = scratch.cut(rows.select(*ENTRY_COLUMNS).mapInPandas(make, RUNS), "runs")
    names = runs.groupBy("run").agg(F.count("*").alias("n_rows"))
    names = scratch.cut(names.select("run", "n_rows", (F.row_number().over(Window.orderBy("run")) - 1).cast("long").alias("number")), "names")  # a row for each run
    left, total = names.agg(F.count("*"), F.sum("n_rows")).first()
    runs = runs.join(names.select("run", "number"), "run").select(*ENTRY_COLUMNS, F.col("number").alias("run"))
    parts, turn = max(1, -(-(total or 0) // PART)), 0
    while True:
        last = left <= fan_in
        target = F.lit(0).cast("long") if last else F.floor(F.col("run") / fan_in).cast("long")
        placed = runs.withColumn("target", target).repartition(parts, *GROUP).sortWithinPartitions(*GROUP, "run", "dist", "rank", "poi_id")
        merged = placed.mapInPandas(lambda frames: merge_runs(frames, n, fan_in), MERGED)
        if last:
            return merged.select(*ENTRY_COLUMNS)
        runs = scratch.cut(merged.select(*ENTRY_COLUMNS, F.col("target").alias("run")), f"merged{turn}")
        left, turn = -(-left // fan_in), turn + 1


def topn_found(benchmark: DataFrame, n: int = 5) -> DataFrame:
    """p4_found (category_query, anchor_index, poi_id)."""
    return top_n(entries(benchmark), n).select("category_query", "anchor_index", "poi_id")
