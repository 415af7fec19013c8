"""Questions from attributes: combinations, hard negatives, training and test sets, groups of attributes."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terramill.functions.features import FEATURES, Feature, fragments
from terramill.operators.sampling import draw_order, exact_split, numbered, per_group
from terramill.session import Scratch


def subsets(items: Column, most: int) -> Column:
    """All non-empty subsets of an array of at most ``most`` items, in its order."""
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2.0), F.size(items)) - 1).cast("int"))
    chosen = F.transform(masks, lambda m: F.filter(items, lambda _, i: F.floor(m / F.pow(F.lit(2.0), i)) % 2 == 1))
    return F.when(F.size(items).between(1, most), chosen)


def question_id(question: str = "question") -> Column:
    return F.md5(F.array_join(question, "|"))


def question_places(places: DataFrame, features: list[Feature] | None = None) -> DataFrame:
    """(question_id, question, nb_feature, pairs, poi_id): every combination of fragments that a place has.

    Fragments are ordered by text. Rows per place are 2 ** features - 1, so a
    place should have few of them. No list grows with the data.
    """
    features = features or FEATURES
    rows = places.select("poi_id", F.explode(subsets(fragments(features), len(features))).alias("chosen"))
    pairs = F.transform("chosen", lambda c: F.struct(c["name"], c["value"]))
    return rows.select(question_id("chosen.text").alias("question_id"), F.col("chosen.text").alias("question"), F.size("chosen").alias("nb_feature"), pairs.alias("pairs"), "poi_id")


def questions(places: DataFrame, features: list[Feature] | None = None) -> DataFrame:
    """(question_id, question ARRAY<STRING>, nb_feature, features MAP, nb_answer, first_poi) of every combination; the places are in ``question_places``."""
    grouped = question_places(places, features).groupBy("question_id", "question", "nb_feature").agg(F.min("pairs").alias("pairs"), F.count("*").alias("nb_answer"), F.min("poi_id").alias("first_poi"))
    return grouped.withColumn("features", F.map_from_entries("pairs")).drop("pairs")


def count_matches(asked: DataFrame, places: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(question_id, n, poi_id, n_matched): places that match some of a question's n constraints, by an equi-join on name and value.

    ``asked``: question_id, features MAP. The rows are as many as matches: for
    a few questions; whole sets of hard negatives are drawn without listing them.
    """
    columns = columns or [f.column for f in FEATURES]
    wanted = asked.select("question_id", F.size("features").alias("n"), F.explode("features").alias("name", "value"))
    have = places.select("poi_id", F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]))).where("value IS NOT NULL")
    return wanted.join(have, ["name", "value"]).groupBy("question_id", "n", "poi_id").agg(F.count("*").alias("n_matched"))


#: Group of all places.
EVERY = "*"


def neighbours(asked: DataFrame, nb_unmatches: int = 1) -> DataFrame:
    """(question_id, group): the questions that a question becomes without ``nb_unmatches`` constraints; EVERY if it has no more of them.

    The hard negatives of a question are the places of its groups that aren't its own.
    """
    fewer = F.filter(subsets(F.col("question"), 32), lambda q: F.size(q) == F.size("question") - nb_unmatches)
    groups = F.when(F.size("question") <= nb_unmatches, F.array(F.lit(EVERY))).otherwise(F.transform(fewer, lambda q: F.md5(F.array_join(q, "|"))))
    return asked.select("question_id", F.explode(groups).alias("group"))


def grouped_places(long: DataFrame, places: DataFrame, groups: DataFrame, bucket: Column, order: list) -> DataFrame:
    """(group, poi_id, place, total): the places of every group in one order."""
    every = places.select(F.lit(EVERY).alias("group"), "poi_id").distinct()
    rows = long.select(F.col("question_id").alias("group"), "poi_id").unionByName(every).join(groups.select("group").distinct(), "group", "left_semi")
    return numbered(rows, bucket, order, ["group"])


def first_others(asked: DataFrame, matching: DataFrame, order: DataFrame, n: int) -> DataFrame:
    """(question_id, group, poi_id): for every question and group the group's first n places that don't match the question, from its start on around the order.

    ``asked``: question_id, group, start; ``matching``: question_id, poi_id, all
    of which are in the question's groups; ``order``: group, poi_id, place, total.
    Before the match that is i-th after the start lie its offset less i others,
    so the offset of the j-th other is j and the matches with at most j others
    before them. Rows are the matches and n for each question and group; others
    aren't listed.
    """
    keys = ["question_id", "group"]
    if n < 1:
        return asked.select(*keys).join(order.select("poi_id"), F.lit(False))
    asked = asked.join(order.groupBy("group").agg(F.max("total").alias("total")), "group").withColumn("start", F.pmod("start", "total"))
    met = matching.join(asked, "question_id").join(order.select("group", "poi_id", "place"), ["group", "poi_id"])
    met = met.select(*keys, F.pmod(F.col("place") - F.col("start"), F.col("total")).alias("offset"))
    met = numbered(met, F.floor(F.col("offset") / 65536), ["offset"], keys)
    skipped = met.select(*keys, (F.col("offset") - F.col("place")).alias("j")).where(F.col("j") < n).groupBy(*keys, "j").agg(F.count("*").alias("skip"))
    slots = asked.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))).join(skipped, [*keys, "j"], "left")
    offset = F.col("j") + F.coalesce(F.sum("skip").over(Window.partitionBy(*keys).orderBy("j")), F.lit(0))
    slots = slots.withColumn("offset", offset).where("offset < total")
    return slots.select(*keys, F.pmod(F.col("start") + F.col("offset"), F.col("total")).alias("place")).join(order, ["group", "place"]).select(*keys, "poi_id")


def drawn_hard_negatives(asked: DataFrame, long: DataFrame, places: DataFrame, n: int, nb_unmatches: int = 1, seed: int = 42) -> DataFrame:
    """(question_id, poi_id): at most n drawn places that match all but at most ``nb_unmatches`` of a question's constraints, but not all.

    ``asked``: question_id, question; ``long``: ``question_places``. Each group
    of a question gives n in its hashed order, from a start of its own; n of these
    are drawn. All come out where they are no more than n.
    """
    groups = neighbours(asked, nb_unmatches)
    order = grouped_places(long, places, groups, F.substring(draw_order(seed, "poi_id"), 1, 3), [draw_order(seed, "poi_id"), "poi_id"])
    start = F.conv(F.substring(draw_order(seed, "question_id", "group"), 1, 15), 16, 10).cast("long")
    matching = long.select("question_id", "poi_id").join(asked.select("question_id"), "question_id", "left_semi")
    found = first_others(groups.select("question_id", "group", start.alias("start")), matching, order, n).select("question_id", "poi_id").distinct()
    return per_group(found, ["question_id"], [draw_order(seed, "question_id", "poi_id"), "poi_id"], n)


def hard_negatives(asked: DataFrame, long: DataFrame, places: DataFrame) -> DataFrame:
    """(question_id, n_hard, first_poi, last_poi) of all places that match all but one of a question's constraints, without listing them; none without such a place.

    ``asked``: question_id, question, nb_answer. A place that lacks one
    constraint is in just one of the question's groups.
    """
    groups = neighbours(asked)
    up = grouped_places(long, places, groups, F.floor(F.col("poi_id") / 4096), ["poi_id"])
    down = up.withColumn("place", F.col("total") - 1 - F.col("place"))
    matching = long.select("question_id", "poi_id").join(asked.select("question_id"), "question_id", "left_semi")
    ends = []
    for order, name, least in ((up, "first_poi", F.min), (down, "last_poi", F.max)):
        found = first_others(groups.withColumn("start", F.lit(0).cast("long")), matching, order, 1)
        ends.append(found.groupBy("question_id").agg(least("poi_id").alias(name)))
    totals = up.groupBy("group").agg(F.max("total").alias("total"))
    n = groups.join(totals, "group").join(asked.select("question_id", "nb_answer"), "question_id").groupBy("question_id").agg(F.sum(F.col("total") - F.col("nb_answer")).alias("n_hard"))
    return n.join(ends[0], "question_id").join(ends[1], "question_id").select("question_id", "n_hard", "first_poi", "last_poi")


def train_test(places: DataFrame, features: list[Feature] | None = None, ratio_test: float = 0.1, n_hard: int = 20, nb_unmatches: int = 1, seed: int = 42) -> DataFrame:
    """(question_id, is_test, kind, poi_id): positives of all questions, and at most n_hard drawn hard negatives of the training ones.

    Questions of at most nb_unmatches attributes draw from all places that don't match.
    """
    scratch = Scratch(places.sparkSession, "sets")
    long = scratch.cut(question_places(places, features).select("question_id", "question", "poi_id"), "long")
    asked = long.groupBy("question_id").agg(F.first("question").alias("question"))
    asked = scratch.cut(exact_split(asked, "question_id", ratio_test, seed), "asked")
    positive = long.join(asked.select("question_id", "is_test"), "question_id").select("question_id", "is_test", F.lit("positive").alias("kind"), "poi_id")
    hard = drawn_hard_negatives(asked.where("NOT is_test"), long, places, n_hard, nb_unmatches, seed)
    return positive.unionByName(hard.select("question_id", F.lit(False).alias("is_test"), F.lit("hard").alias("kind"), "poi_id"))


def redraw_answers(batches: DataFrame, truth: DataFrame, n_answers: int, seed: int = 42) -> DataFrame:
    """Batches with other answers: (batch_id, poi_ids), at most n_answers drawn positives per question, then the old ids that are relevant to none.

    ``batches``: batch_id, questions ARRAY<ARRAY<STRING>>, poi_ids. ``truth``:
    question ARRAY<STRING>, poi_id (``question_places``). Questions without truth bring no answers.
    """
    scratch = Scratch(batches.sparkSession, "redrawn")
    # places are drawn once for each question, however many batches ask it; questions get short numbers
    long = scratch.cut(truth.select(question_id().alias("qid"), "poi_id"), "long")
    codes = scratch.cut(long.select("qid").distinct().withColumn("code", F.monotonically_increasing_id()), "codes")
    asked = batches.select("batch_id", F.explode("questions").alias("question")).where(F.forall("question", lambda f: f.isNotNull())).select("batch_id", question_id().alias("qid"))
    asked = scratch.cut(asked.join(codes, "qid").select("batch_id", "code").distinct(), "asked")
    used = scratch.cut(codes.join(asked.select("code").distinct(), "code", "left_semi"), "used")
    long = long.join(used, "qid")
    draw = Window.partitionBy("code").orderBy(draw_order(seed, "qid", "poi_id"), "poi_id")
    drawn = long.select("code", "poi_id", F.dense_rank().over(draw).alias("__rn")).where(F.col("__rn") <= n_answers)
    drawn = scratch.cut(drawn.select("code", "poi_id").distinct(), "drawn")
    drawn = asked.join(drawn, "code").select("batch_id", "poi_id", F.lit(0).alias("at")).distinct()
    old = scratch.cut(batches.select("batch_id", F.posexplode("poi_ids").alias("at", "poi_id")).where("poi_id IS NOT NULL"), "old")
    # the questions that an old answer fits, of those only that its batch asks: never all places of a question
    fits = old.select("batch_id", "poi_id").hint("merge").join(long.select("code", "poi_id"), "poi_id")
    fits = fits.hint("merge").join(asked, ["batch_id", "code"], "left_semi").select("batch_id", "poi_id").distinct()
    old = old.join(fits, ["batch_id", "poi_id"], "left_anti").groupBy("batch_id", "poi_id").agg((F.min("at") + 1).alias("at"))
    every = drawn.select("batch_id", "at", "poi_id").unionByName(old.select("batch_id", "at", "poi_id"))
    return every.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("at", "poi_id")))["poi_id"].alias("poi_ids"))


def attribute_groups(answers: DataFrame, columns: list[str], n: int, keys: list[str] | None = None, lists: bool = True) -> DataFrame:
    """(keys, features, values, poi_ids, first_poi, size): answers grouped by every combination of n attributes, rows with nulls in them left out.

    ``answers``: keys, rank, poi_id and the attribute columns; poi_ids keep the
    order of rank; groups without keys can have any size, so ``lists`` is to be False for them. One pass: each row is repeated for the combinations it has.
    """
    keys = keys or []
    combos = list(combinations(columns, n))
    each = F.array(*[F.struct(F.array(*map(F.lit, c)).alias("features"), F.array(*[F.col(x).cast("string") for x in c]).alias("values")) for c in combos])
    rows = answers.select(*keys, "rank", "poi_id", F.inline(F.filter(each, lambda e: F.forall(e["values"], lambda v: v.isNotNull()))))
    made = [F.array_sort(F.collect_list(F.struct("rank", "poi_id")))["poi_id"].alias("poi_ids")] if lists else []
    return rows.groupBy(*keys, "features", "values").agg(*made, F.min_by("poi_id", "rank").alias("first_poi"), F.count("*").alias("size"))


def composite(asked: DataFrame, answers: DataFrame, columns: list[str], quota: dict[int, int], seed: int = 42) -> DataFrame:
    """(question_id, query, n, features, values, poi_ids, size): questions narrowed by attribute groups of their own answers.

    ``asked``: question_id, query, category_query; ``answers``: question_id, rank,
    poi_id and the attribute columns. ``quota``: attributes combined -> groups
    drawn per question. The attributes stand after the category in the query.
    """
    parts = []
    for n, most in quota.items():
        groups = attribute_groups(answers, columns, n, ["question_id"]).withColumn("key", F.array_join(F.concat("features", "values"), "|"))
        parts.append(per_group(groups, ["question_id"], [draw_order(seed, "question_id", "key"), "key"], most).withColumn("n", F.lit(n)))
    rows = reduce(DataFrame.unionByName, parts).join(asked.select("question_id", "query", "category_query"), "question_id")
    added = F.array_join(F.transform(F.arrays_zip("features", "values"), lambda z: F.concat(z["features"], F.lit("="), z["values"])), " ")
    tail = F.substring(F.col("query"), F.length("category_query") + 1, F.length("query"))
    return rows.select("question_id", F.concat("category_query", F.lit(" "), added, tail).alias("query"), "n", "features", "values", "poi_ids", "size")
