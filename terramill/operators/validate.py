"""Coherence checks of a question set, as one table of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CORE = ["query", "category_query", "function"]
LISTS = ["results_poi_id", "results_poi_name", "results_poi_dist", "results_poi_rank"]
ANCHORS = ["anchor_index", "point_b_index", "poi_y_id", "anchor_a_index", "anchor_b_index"]


def _checks(rows: DataFrame, dist_is_ranking_key: bool, allow_empty: bool) -> list[tuple[str, Column]]:
    have = [c for c in LISTS if c in rows.columns]
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    ids = F.coalesce("results_poi_id", F.array().cast("array<bigint>"))
    full = F.size(ids) > 0
    parallel = reduce(lambda a, b: a & b, [size(c) == F.size(ids) for c in have], F.lit(True))
    usable = full & parallel
    checks = [("not_parallel", full & ~parallel), ("duplicate_ids", usable & (F.size(F.array_distinct(ids)) != F.size(ids)))]
    if not allow_empty:
        checks.append(("empty_answer", ~full))
    if "results_poi_rank" in have:
        expected = F.transform(F.sequence(F.lit(1), F.size(ids)), lambda i: i.cast("int"))
        checks.append(("bad_rank", usable & ~F.coalesce(F.col("results_poi_rank") == expected, F.lit(False))))
    if "results_poi_dist" in have:
        d = F.coalesce(F.col("results_poi_dist"), F.array().cast("array<double>"))
        broken = F.exists(d, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        negative = ~broken & F.exists(d, lambda v: v < 0)
        checks += [("bad_distance", usable & broken), ("negative_distance", usable & negative)]
        if dist_is_ranking_key:
            falls = F.exists(F.zip_with(F.slice(d, 1, F.greatest(F.size(d) - 1, F.lit(0))), F.slice(d, 2, F.greatest(F.size(d), F.lit(1))), lambda a, b: b < a), lambda v: v)
            checks.append(("falling_distance", usable & ~broken & ~negative & F.coalesce(falls, F.lit(False))))
    for c in ANCHORS:
        if c in rows.columns:
            checks.append((f"{c}_in_answer", usable & F.coalesce(F.array_contains(ids, F.col(c).cast("long")), F.lit(False))))
    blank = F.col("query").isNull() | (F.trim("query") == "")
    checks += [("blank_query", usable & blank), ("query_without_category", usable & ~blank & ~F.coalesce(F.contains("query", "category_query"), F.lit(False)))]
    return checks


def violations(rows: DataFrame, places: DataFrame | None = None, key: str = "question_id", dist_is_ranking_key: bool = True, allow_empty: bool = False) -> DataFrame:
    """(key, check, n): every check a question fails; n counts the answers concerned where the corpus is asked, else 1.

    A question without answers fails only ``empty_answer``, one with lists of
    unequal length only ``not_parallel``. With ``places`` (poi_id, poi_name,
    category, unique ids) the answers are looked up: ``unknown_poi``, and for
    questions whose answers are all known ``wrong_name`` and ``wrong_category``.
    Missing core columns raise ValueError.
    """
    missing = [c for c in [*CORE, *LISTS[:2]] if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    checks = _checks(rows, dist_is_ranking_key, allow_empty)
    failed = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]))
    found = rows.select(key, F.explode(failed).alias("check")).withColumn("n", F.lit(1).cast("long"))
    if places is None:
        return found
    parallel = dict(checks)["not_parallel"]
    answers = rows.where(~parallel & (F.size("results_poi_id") > 0)).select(key, "category_query", F.inline(F.arrays_zip("results_poi_id", "results_poi_name"))).withColumnRenamed("results_poi_id", "poi_id")
    looked = answers.join(places.select("poi_id", "poi_name", "category", F.lit(True).alias("exists")), "poi_id", "left")
    one = lambda cond, name: F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
    counts = looked.groupBy(key).agg(
        one(F.col("exists").isNull(), "unknown_poi"),
        one(F.col("exists") & ~F.col("results_poi_name").eqNullSafe(F.col("poi_name")), "wrong_name"),
        one(F.col("exists") & ~F.col("category_query").eqNullSafe(F.col("category")), "wrong_category"),
    )
    names = ["unknown_poi", "wrong_name", "wrong_category"]
    rest = counts.select(key, F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.when((F.col("unknown_poi") == 0) | (F.lit(c) == "unknown_poi"), F.col(c)).otherwise(0).alias("n")) for c in names]))).where("n > 0")
    return found.unionByName(rest)


def examples(found: DataFrame, max_rows: int, key: str = "question_id") -> DataFrame:
    """The first ``max_rows`` questions of every check, for reading."""
    ranked = found.withColumn("__rn", F.row_number().over(Window.partitionBy("check").orderBy(key)))
    return ranked.where(F.col("__rn") <= F.lit(max_rows)).drop("__rn")


def answer_stats(rows: DataFrame) -> DataFrame:
    """One row: questions, and least, greatest, mean (2 decimals), median and number of empty answers."""
    size = F.coalesce(F.size("results_poi_id"), F.lit(0))
    sized = rows.select(size.alias("n"))
    return sized.agg(
        F.count("*").alias("n_questions"), F.min("n").alias("min"), F.max("n").alias("max"), F.round(F.avg("n"), 2).alias("mean"),
        F.percentile("n", 0.5).alias("median"), F.count_if(F.col("n") == 0).alias("empty"),
    )


def frequencies(rows: DataFrame, column: str) -> DataFrame:
    """(value, n), most frequent first."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def direction_correlation(answers: DataFrame, keys: list[str], coordinate: str = "coordinate") -> DataFrame:
    """(keys, n, rho): Spearman's correlation of -rank and the coordinate signed by direction; ties get average ranks, null below two rows and where one side is all ties."""
    def average_rank(c: Column) -> Column:
        return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2

    rows = answers.select(*keys, (-F.col("rank")).alias("a"), F.col(coordinate).alias("b"))
    rows = rows.select(*keys, average_rank(F.col("a")).alias("a"), average_rank(F.col("b")).alias("b"))
    rho = F.try_divide(F.covar_pop("a", "b"), F.sqrt(F.var_pop("a") * F.var_pop("b")))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), rho.alias("rho"))
