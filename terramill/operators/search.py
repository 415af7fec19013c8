"""Ranked search: the k best places of a category around every asked position.

One operator serves all relations that rank by a distance. Positions and places
meet in grid cells as wide as the search radius; every question starts with the
radius at which the places around it promise k answers, and only questions that
found fewer search again, three times as wide. A round is exact: whatever scores below
the radius lies in the cells around the position that come closer. No global sort, no nested
loop, and a question touches the places near it only.

Scale: the density is that of the smallest quadtree cell around the position with
enough places, so neither a stray location nor a dense town changes what others
search. Equal questions are answered once. Places are repeated for the grid widths
that questions of their category use. A cell that many questions search is split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terramill.session import Scratch, parallelism

GROWTH = 3.0
#: Places that the first radius promises, in multiples of those wanted.
SURPLUS = 1.5
#: Level of the finest density cells (2**6 metres).
FINEST = 6
#: Questions of a cell beyond which they are salted.
CROWD = 2000


def cells(level: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Cell of a position in the grid of 2**level metres."""
    size = F.pow(F.lit(2.0), level)
    return F.floor(x / size).cast("long"), F.floor(y / size).cast("long")


def level_of(radius: Column) -> Column:
    return F.ceil(F.log2(F.greatest(radius, F.lit(1.0)))).cast("int")


PLACE = ["category", "level", "cx", "cy"]


def located(places: DataFrame) -> DataFrame:
    """(poi_id, category, x, y) of the places with a category and a location."""
    return places.select("poi_id", "category", "x", "y").where("x IS NOT NULL AND y IS NOT NULL AND category IS NOT NULL")


def shuffled(rows: DataFrame) -> DataFrame:
    """Rows that no join may broadcast: their size is estimated by the file they come from, which is packed, and from before they were repeated for cells or levels."""
    return rows.hint("merge")


def meet(covered: DataFrame, places: DataFrame, levels: DataFrame) -> DataFrame:
    """Covered rows (PLACE and others) with the places (poi_id, px, py) of their category in their cell; ``levels``: the distinct (category, level) in use."""
    spread = located(places).select("poi_id", "category", F.col("x").alias("px"), F.col("y").alias("py")).join(levels, "category")
    px, py = cells(F.col("level"), F.col("px"), F.col("py"))
    return covered.join(spread.withColumns({"cx": px, "cy": py}), PLACE).drop("level", "cx", "cy")


def ringed(asked: DataFrame) -> DataFrame:
    """Asked rows (x, y, reach) once for each cell, at least half as wide as the reach, that comes closer than the reach; adds level, cx, cy."""
    asked = asked.withColumn("level", ring_level(F.col("reach")))
    cx, cy = cells(F.col("level"), F.col("x"), F.col("y"))
    ring = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])
    size = F.pow(F.lit(2.0), F.col("level"))
    off = lambda c, at: F.greatest(F.lit(0.0), at * size - F.col(c), F.col(c) - (at + 1) * size)
    near = lambda r: F.pow(off("x", F.col("cx") + r["i"]), 2) + F.pow(off("y", F.col("cy") + r["j"]), 2) < F.pow(F.col("reach"), 2)
    asked = asked.withColumns({"cx": cx, "cy": cy}).withColumn("ring", F.explode(F.filter(ring, near)))
    return asked.withColumns({"cx": F.col("cx") + F.col("ring.i"), "cy": F.col("cy") + F.col("ring.j")}).drop("ring")


def ring_level(reach: Column) -> Column:
    return level_of(reach) - 1


def ring_levels(asked: DataFrame) -> DataFrame:
    return asked.select("category", ring_level(F.col("reach")).alias("level")).distinct()


def _gapped(met: DataFrame) -> DataFrame:
    dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    return met.withColumn("gap", F.sqrt(dx * dx + dy * dy)).where("gap < reach")


def radius_join(asked: DataFrame, places: DataFrame, radius: Column) -> DataFrame:
    """Pairs of asked rows (x, y, category, ...) and places (poi_id, px, py) of the same category, closer than ``radius`` (strict).

    Rows and places with nulls in these columns meet nothing.
    """
    asked = asked.withColumn("reach", radius).where("reach IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    return _gapped(meet(ringed(asked), places, ring_levels(asked)))


def top(rows: DataFrame, keys: list[str], order: list, k: int | None, rank: str = "rank") -> DataFrame:
    """Rows ranked from 1 within ``keys``; the first k, or all."""
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(rank) <= k)


class Index:
    """What searches among the same places share: the located places, their boxes and the counts of their quadtree cells, each made once."""

    def __init__(self, places: DataFrame):
        spark = places.sparkSession
        self.sparkSession = spark
        self.scratch = Scratch(spark, "index")
        # few rows make much work on either side: both are written in as many parts as there are tasks
        self.places = self.scratch.cut(located(places).repartition(parallelism(spark)), "places")
        self.box = tuple(self.places.agg(*[f(c) for c in ("x", "y") for f in (F.min, F.max)]).first())
        self.boxes = self.places.groupBy("category").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        self.held: tuple[float, DataFrame] | None = None

    def keep(self, least: float) -> "Index":
        """Writes the boxes, and the cells of at least ``least`` places, for many searches."""
        self.boxes = self.scratch.cut(self.boxes, "boxes")
        if self.box[0] is not None:
            self.held = least, self.scratch.cut(cell_counts(self.places, least, self.box), "counts")
        return self

    def counts(self, wanted: float) -> DataFrame:
        if self.held and self.held[0] <= wanted:
            return self.held[1].where(F.col("n") >= math.ceil(wanted))
        return cell_counts(self.places, wanted, self.box)


def quadtree(box: tuple[float, float, float, float]) -> list[int]:
    spread = max(abs(v) for v in box)
    return list(range(FINEST, max(FINEST + 1, math.ceil(math.log2(max(1.0, spread))) + 1)))


def cell_counts(places: DataFrame, wanted: float, box: tuple[float, float, float, float]) -> DataFrame:
    """(PLACE, n): the cells of all levels with at least ``wanted`` places of a category."""
    cx, cy = cells(F.lit(FINEST), F.col("x"), F.col("y"))
    fine = places.select("category", cx.alias("cx"), cy.alias("cy")).groupBy("category", "cx", "cy").agg(F.count("*").alias("n"))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level") - FINEST)).cast("long").alias(c)
    each = F.explode(F.array(*map(F.lit, quadtree(box)))).alias("level")
    return fine.select("category", "cx", "cy", "n", each).select("category", "level", up("cx"), up("cy"), "n").groupBy(*PLACE).agg(F.sum("n").alias("n")).where(F.col("n") >= math.ceil(wanted))


def first_radius(asked: DataFrame, places: DataFrame, wanted: float, box: tuple[float, float, float, float], counts: DataFrame | None = None) -> DataFrame:
    """asked (asked_id, category, x, y) with the radius that promises SURPLUS times ``wanted`` places; null if its category has fewer.

    The density is that of the smallest cell of the quadtree around the position
    with at least ``wanted`` places of the category.
    """
    counts = cell_counts(places, wanted, box) if counts is None else counts
    each = F.explode(F.array(*map(F.lit, quadtree(box)))).alias("level")
    own = asked.select("asked_id", "category", "x", "y", each)
    ax, ay = cells(F.col("level"), F.col("x"), F.col("y"))
    met = shuffled(own.withColumns({"cx": ax, "cy": ay})).join(counts, PLACE).groupBy("asked_id").agg(F.min(F.struct("level", "n")).alias("cell"))
    size = F.pow(F.lit(2.0), F.col("cell.level"))
    return asked.join(met, "asked_id", "left").withColumn("radius", size * F.sqrt(F.lit(SURPLUS * wanted / math.pi) / F.col("cell.n"))).drop("cell")


def _met(pending: DataFrame, places: DataFrame, scratch: Scratch, name: str, n: int) -> DataFrame:
    """The n pending rows (reach) with the places closer than their reach; cells with many questions are salted."""
    covered, levels = ringed(pending), ring_levels(pending)
    if n <= CROWD:
        return _gapped(meet(covered, places, levels))
    covered = shuffled(covered)
    crowds = scratch.cut(covered.groupBy(*PLACE).agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts")).where("parts > 1"), f"crowds{name}")
    if crowds.isEmpty():
        return _gapped(meet(covered, places, levels))
    plain = meet(shuffled(ringed(pending).join(crowds, PLACE, "left_anti")), places, levels)
    asked = ringed(pending).join(crowds, PLACE).withColumn("salt", F.pmod(F.xxhash64("asked_id"), F.col("parts")).cast("int")).drop("parts")
    held = located(places).select("poi_id", "category", F.col("x").alias("px"), F.col("y").alias("py")).join(crowds.select("category", "level").distinct(), "category")
    px, py = cells(F.col("level"), F.col("px"), F.col("py"))
    held = held.withColumns({"cx": px, "cy": py}).join(crowds, PLACE).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return _gapped(plain.unionByName(shuffled(asked).join(held, [*PLACE, "salt"]).drop("level", "cx", "cy", "salt")))


def ranked_search(
    asked: DataFrame, places: DataFrame | Index, keys: list[str], k: int, score: Column | None = None, match: Column | None = None, base: Column | None = None, widest: float | None = None,
    share: float = 1.0, shapes: DataFrame | None = None, shape_key: str | None = None, least: Column | None = None,
) -> DataFrame:
    """The asked rows' columns ``keys`` with poi_id, dist and rank of their k best places.

    ``score`` (default: the distance ``gap`` of position and place) must be at
    least ``gap`` - ``base``, and at most ``gap`` + ``base``; ``match`` filters
    pairs. Both may use the asked columns, ``px``, ``py`` and ``gap``, ``match``
    also ``dist``, and the columns of ``shapes``, which join late, by
    ``shape_key``; ``least`` is a bound below the score that does without them. ``share`` is about what part of the places ``match`` leaves.
    Ties go to the smaller poi_id. With ``widest`` only scores below it count.
    """
    spark = asked.sparkSession
    scratch = Scratch(spark, "search")
    score = F.col("gap") if score is None else score
    base = F.lit(0.0) if base is None else base
    none = asked.select(*keys, F.lit(0).cast("long").alias("poi_id"), F.lit(0.0).alias("dist"), F.lit(0).alias("rank")).limit(0)
    spread = parallelism(spark)
    index = places if isinstance(places, Index) else Index(places)
    places, box, boxes = index.places, index.box, index.boxes
    if box[0] is None:
        return none
    # questions that differ only in their keys are one
    asked = asked.where("category IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").withColumn("base", base)
    what = [c for c in asked.columns if c not in keys or c in ("category", "x", "y", shape_key)]
    named = scratch.cut(asked, "named")
    one = scratch.cut(named.select(*what).distinct().withColumn("asked_id", F.monotonically_increasing_id()), "asked")
    dx = F.greatest(F.abs(F.col("x") - F.col("x0")), F.abs(F.col("x") - F.col("x1")))
    dy = F.greatest(F.abs(F.col("y") - F.col("y0")), F.abs(F.col("y") - F.col("y1")))
    most = F.sqrt(dx * dx + dy * dy) + F.col("base") + 1.0 if widest is None else F.lit(float(widest))
    pending = first_radius(one, places, k / share, box, index.counts(k / share)).join(boxes, "category").withColumn("most", most).drop("x0", "x1", "y0", "y1")
    pending = scratch.cut(pending.withColumn("radius", F.least(F.col("most"), F.coalesce("radius", "most"))).repartition(spread), "pending0")
    results: list[DataFrame] = []
    turn = most_asked = 0
    while n := pending.count():
        most_asked = max(most_asked, n)
        reach = F.col("radius") + F.col("base")
        met = _met(pending.withColumn("reach", reach), places, scratch, str(turn), n)
        if least is not None:
            met = met.where(least < F.col("radius"))
        if shapes is not None:
            met = met.join(shapes, shape_key)
        # generated, so that the score is computed once, before any filter on it
        met = met.select("*", F.explode(F.array(score)).alias("dist")).where("dist < radius")
        if match is not None:
            met = met.where(match)
        found = scratch.cut(top(met.select("asked_id", "radius", "most", "poi_id", "dist"), ["asked_id"], ["dist", "poi_id"], k), f"found{turn}")
        full = found.where(F.col("rank") == k).select("asked_id")
        last = F.col("radius") >= F.col("most")
        results.append(found.where(last).unionByName(found.where(~last).join(full, "asked_id", "left_semi")).select("asked_id", "poi_id", "dist", "rank"))
        turn += 1
        rest = pending.where(~last).join(full, "asked_id", "left_anti").withColumn("radius", F.least(F.col("most"), F.col("radius") * GROWTH))
        pending = scratch.cut(rest.repartition(spread), f"pending{turn}")
    if not results:
        return none
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in what]
    hashed = lambda df: df.withColumn("__what", F.xxhash64(*what))
    whole = shuffled if most_asked > CROWD else lambda rows: rows
    names = whole(hashed(named)).alias("n").join(hashed(one).alias("o"), [F.col("n.__what") == F.col("o.__what"), *same]).select(*[F.col(f"n.{c}") for c in keys], "asked_id")
    return whole(names).join(out, "asked_id").select(*keys, "poi_id", "dist", "rank")
