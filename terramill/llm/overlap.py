"""Records that stand, exactly or almost, in several splits.

The normalised passages of evaluation records are sharded; an Aho-Corasick
automaton of each shard, over words and poi_ids, scans all training records.
Passages have several tokens:

- Five words in a row of a record's text (the whole text if it is shorter). Their
  matches are intervals of the evaluation text; the intervals that all training
  texts match are merged into the record's coverage.
- Two neighbours in the order of a record's poi_ids (the poi_id itself if there is
  but one). They choose the records whose overlaps are then taken exactly. None is
  lost: with a Jaccard index t of 0.7, s common members and b = s (1/t - 1) others at
  most, the common ones stand in b + 1 runs, so two of them are neighbours on both
  sides wherever s > 1; and with s = 1 both sides are that one poi_id.

A passage that many records hold is looked up together with a rare word (prefix
filter: two sets with a Jaccard index of t share a member of each one's first
n - ceil(t n) + 1 in any common order), so poi_ids that a third of all records
share don't make all of them candidates. This loses no pair either.

Scale: shards are tables in the shared scratch folder. Training rows are never
shuffled: a task holds a bounded block of them and reads one bounded shard after
the other. Only evaluation records and results are exchanged.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terramill.functions.text import fold_label, words
from terramill.session import Scratch

THRESHOLD = 0.7
#: Words of a passage.
PASSAGE = 5
#: Evaluation classes of a shard on average; training rows of a block.
SHARD, BLOCK = 40_000, 20_000
#: Records of a passage from which it is looked up together with a word.
CROWD = 64
EVAL_SPLITS = ("validation", "test")


def records(batches: DataFrame) -> DataFrame:
    """(batch_id, split, source, pois, text) of each row with a split, poi_ids and words: sorted distinct poi_ids, and the words in their order.

    Case and blanks around a split are ignored. Null ids, questions, fragments
    and poi_ids are left out, and so are records without poi_ids or words.
    Rows of one batch_id that differ each count, equal ones once (in the results).
    """
    fragments = F.flatten(F.filter("questions", lambda q: q.isNotNull()))
    rows = batches.where("batch_id IS NOT NULL AND questions IS NOT NULL AND poi_ids IS NOT NULL").select(
        F.col("batch_id").cast("long").alias("batch_id"), fold_label(F.col("split")).alias("split"), fold_label(F.col("source")).alias("source"),
        F.array_sort(F.array_distinct(F.array_compact("poi_ids"))).cast("array<bigint>").alias("pois"), words(F.array_join(fragments, " ")).alias("text"),
    )
    return rows.where(F.col("split").isin("train", *EVAL_SPLITS) & (F.size("pois") > 0) & (F.size("text") > 0))


def needed(size: int, threshold: float) -> int:
    """Members that a set of this size must share with any set as similar as the threshold."""
    return max(1, math.ceil(threshold * size - 1e-9))


def runs(tokens: list, size: int) -> list[tuple]:
    """All runs of ``size`` tokens in a row; the whole list if it is shorter."""
    return [tuple(tokens[i : i + size]) for i in range(max(1, len(tokens) - size + 1))]


#: Stands for any token that a shard doesn't have.
OTHER = "\0"
#: Branches of the automaton's nodes at most, but for the first characters of codes.
BRANCHES = 32


def token_codes(tokens: list) -> dict:
    """A code of few different characters for each token; all have one length, and first characters that stand nowhere else, so that matches begin and end with tokens."""
    width = 1
    while BRANCHES**width < len(tokens):
        width += 1
    digit = lambda n, k: chr(0x100 * (k + 1) + n // BRANCHES**k % BRANCHES)
    return {t: "".join(digit(n, k) for k in reversed(range(width))) for n, t in enumerate(tokens)}


class Shard:
    """Evaluation classes with the automaton of their passages; ``spans``: with those of words."""

    def __init__(self, classes: list[int], pois: list[list[int]], texts: list[list[str]], threshold: float, spans: bool = False):
        if threshold <= 0.5:
            raise ValueError("records that share no neighbours can be as similar as that")
        self.threshold, self.classes = threshold, classes
        self.pois, self.terms = [frozenset(r) for r in pois], [frozenset(r) for r in texts]
        self.sizes = [len(r) for r in texts]
        self.used = Counter(t for row in self.terms for t in row)
        self.codes = token_codes([*dict.fromkeys(t for rows in (pois, texts if spans else ()) for row in rows for t in row)])
        self.holders: dict[str, list[int]] = defaultdict(list)
        for i, row in enumerate(pois):
            for passage in runs(row, 2):
                self.holders[self.coded(passage)].append(i)
        self.places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        if spans:
            for i, row in enumerate(texts):
                for at, passage in enumerate(runs(row, PASSAGE)):
                    self.places[self.coded(passage)].append((i, at))
        self.spans = spans
        self.passages = [*self.holders, *self.places]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for at, passage in enumerate(self.passages):
            self.automaton.add_word(passage, at)
        if self.passages:
            self.automaton.make_automaton()
        self.hit = bytearray(len(self.passages))
        self.crowds: dict[str, dict[str, list[int]]] = {}
        for passage, members in self.holders.items():
            if len(members) > CROWD:
                crowd = self.crowds[passage] = defaultdict(list)
                for i in members:
                    for w in self.rarest(self.terms[i], len(self.terms[i])):
                        crowd[w].append(i)

    def coded(self, tokens) -> str:
        return "".join([self.codes.get(t, OTHER) for t in tokens])

    def rarest(self, found, size: int) -> list[str]:
        """The found members among the first of a set's rare-first order; members that no record of the shard has come before them."""
        first = size - needed(size, self.threshold) + 1 - (size - len(found))
        return sorted(found, key=lambda t: (self.used[t], t))[: max(0, first)]

    def matches(self, pois: list[int], text: list[str]) -> list[tuple[int, float, float]]:
        """(record, overlap of poi_ids, overlap of words) of every record similar to a training record; the passages it matches are noted in ``hit``."""
        own_pois, own_terms = set(pois), set(text)
        candidates: set[int] = set()
        rare = None
        if self.passages:
            for _, at in self.automaton.iter(self.coded(pois) + OTHER + self.coded(text) if self.spans else self.coded(pois)):
                passage = self.passages[at]
                self.hit[at] = 1
                members = self.holders.get(passage)
                if members is None:
                    continue
                crowd = self.crowds.get(passage)
                if crowd is None:
                    candidates.update(members)
                else:
                    rare = self.rarest([w for w in own_terms if w in self.used], len(own_terms)) if rare is None else rare
                    for w in rare:
                        candidates.update(crowd.get(w, ()))
        out = []
        limit = self.threshold - 1e-12
        for i in candidates:
            a, b = len(self.pois[i] & own_pois), len(self.terms[i] & own_terms)
            size_a, size_b = len(self.pois[i]) + len(pois) - a, len(self.terms[i]) + len(own_terms) - b
            if a >= limit * size_a and b >= limit * size_b:
                out.append((i, a / size_a, b / size_b))
        return out

    def intervals(self) -> dict[int, list[tuple[int, int]]]:
        """Merged intervals (first word, word after the last) of each record that the passages noted so far match; forgets them."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at in range(len(self.holders), len(self.passages)):
            if self.hit[at]:
                for i, start in self.places[self.passages[at]]:
                    found[i].append((start, min(start + PASSAGE, self.sizes[i])))
        self.hit = bytearray(len(self.passages))
        return {i: merged(v) for i, v in found.items()}


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def qualified(spark, path: str) -> str:
    """A path with its file system, as ``pyarrow.fs`` takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    scheme, rest = full.split(":", 1)
    return f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}://{rest.removeprefix('//')}"


@lru_cache(1)
def load(uri: str, threshold: float, spans: bool) -> Shard:
    """The shard of a table in the shared folder; a worker holds one at a time."""
    files, path = pyarrow.fs.FileSystem.from_uri(uri)
    rows = pyarrow.dataset.dataset(path, filesystem=files, format="parquet").to_table(columns=["class", "pois", "text"]).to_pydict()
    return Shard(rows["class"], rows["pois"], rows["text"], threshold, spans)


#: A row is a similar pair, or what one block of training records matches of a class (train_id is null).
MATCH = "class long, train_id long, poi_overlap double, word_overlap double, spans array<struct<start:int,stop:int>>"
_MATCH = pa.schema([("class", pa.int64()), ("train_id", pa.int64()), ("poi_overlap", pa.float64()), ("word_overlap", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])


def scan(evaluation: DataFrame, training: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, spans: bool = False) -> DataFrame:
    """MATCH rows of evaluation classes (class, pois, text) and training records (batch_id, pois, text); ``spans``: matched intervals as well."""
    count = max(1, -(-evaluation.count() // SHARD))
    placed = evaluation.select("class", "pois", "text", F.pmod(F.xxhash64("class"), F.lit(count)).cast("int").alias("shard"))
    placed.repartition(count, "shard").write.partitionBy("shard").parquet(scratch.path("shards"))
    base, block_size = qualified(evaluation.sparkSession, scratch.path("shards")), BLOCK
    present = [r["shard"] for r in placed.select("shard").distinct().collect()]  # numbers of shards

    def sweep(block: list[tuple]) -> Iterator[pa.RecordBatch]:
        for n in sorted(present):
            shard = load(f"{base}/shard={n}", threshold, spans)
            rows: list[tuple] = [(shard.classes[i], key, a, b, None) for key, pois, text in block for i, a, b in shard.matches(pois, text)]
            if spans:
                rows += [(shard.classes[i], None, None, None, [{"start": a, "stop": b} for a, b in found]) for i, found in shard.intervals().items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), _MATCH)], schema=_MATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        for batch in batches:
            block += zip(*(batch[c].to_pylist() for c in ("batch_id", "pois", "text")))
            if len(block) >= block_size:
                yield from sweep(block)
                block = []
        if block:
            yield from sweep(block)

    return training.select("batch_id", "pois", "text").mapInArrow(run, MATCH)


def overlaps(batches: DataFrame, threshold: float = THRESHOLD, spans: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MATCH rows; the evaluation records (class, batch_id, split, source); the classes (class, size).

    A class are the evaluation records with the same poi_ids and the same words in the same order.
    """
    scratch = Scratch(batches.sparkSession, "overlap")
    rows = records(batches)
    evals = scratch.cut(rows.where("split <> 'train'").withColumn("key", F.unhex(F.md5(F.concat_ws("\x1f", F.concat_ws(" ", F.col("pois").cast("array<string>")), F.concat_ws(" ", "text"))))), "evaluation")
    classes = evals.groupBy("key").agg(F.first("pois").alias("pois"), F.first("text").alias("text"))
    classes = scratch.cut(classes.select(F.monotonically_increasing_id().alias("class"), "*"), "classes")
    found = scratch.cut(scan(classes, rows.where("split = 'train'"), scratch, threshold, spans), "matches")
    named = evals.select("key", "batch_id", "split", "source").distinct().join(classes.select("key", "class"), "key").drop("key")
    return found, named, classes.select("class", F.size("text").alias("size"))


def overlap_found(batches: DataFrame) -> DataFrame:
    """p1_found (batch_id_a, batch_id_b): pairs of a training and an evaluation batch with both overlaps of at least 0.7, smaller id first.

    Null splits, poi_ids and questions make no case, nor do batches without
    poi_ids or words; repeated rows give one pair; an empty table gives none.
    """
    found, evals, _ = overlaps(batches)
    pairs = found.where("train_id IS NOT NULL").join(evals, "class").where("batch_id <> train_id")
    return pairs.select(F.least("batch_id", "train_id").alias("batch_id_a"), F.greatest("batch_id", "train_id").alias("batch_id_b")).distinct()


def covered_words(spans: Column) -> Column:
    """Words in the union of intervals that may overlap."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("sum"))
    step = lambda acc, s: F.struct(F.greatest(acc["upto"], s["stop"]).alias("upto"), (acc["sum"] + F.greatest(F.lit(0), s["stop"] - F.greatest(acc["upto"], s["start"]))).alias("sum"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["sum"])


def overlap_report(batches: DataFrame) -> DataFrame:
    """p1_report: for each evaluation split and source its batches, those that stand in a training batch, exactly or almost, and the mean coverage of all of them.

    Coverage is the share of a batch's words in passages of any training batch;
    rows that differ in content give a batch its greatest. Null sources have a row of their own.
    """
    found, evals, sizes = overlaps(batches, spans=True)
    spans = found.where("train_id IS NULL").groupBy("class").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # merged for each block of training rows
    share = F.coalesce(covered_words(F.col("spans")) / F.col("size"), F.lit(0.0))
    keys = ["split", "source", "batch_id"]
    per_batch = evals.join(sizes, "class").join(spans, "class", "left").groupBy(*keys).agg(F.max(share).alias("coverage"))
    pairs = found.where("train_id IS NOT NULL").join(evals, "class").where("batch_id <> train_id")
    pairs = pairs.groupBy(*keys, "train_id").agg(F.max(F.least("poi_overlap", "word_overlap")).alias("best"))
    pairs = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.max("best").alias("best"))
    zero = F.lit(0).cast("long")
    rows = per_batch.select(*keys, "coverage", zero.alias("n"), F.lit(0.0).alias("best")).unionByName(pairs.select(*keys, F.lit(0.0).alias("coverage"), "n", "best"))
    rows = rows.groupBy(*keys).agg(F.max("coverage").alias("coverage"), F.max("n").alias("n"), F.max("best").alias("best"))
    return rows.groupBy("split", "source").agg(
        F.count("*").alias("n_batches"), F.count_if(F.col("n") > 0).alias("n_overlapping"), F.count_if(F.col("best") >= 1).alias("n_exact"), F.sum("n").alias("n_pairs"), F.round(F.avg("coverage"), 6).alias("mean_coverage")
    )
