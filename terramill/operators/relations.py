"""Answers of the twelve spatial relations, each for all questions at once.

Every operator takes asked rows and the places of ``corpus.pois`` and returns
the keys with poi_id, dist and rank (from 1). Anchors are excluded before the
ranking is cut; ties go to the smaller poi_id; rows with nulls in what a
relation needs have no answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terramill.functions import geometry as G
from terramill.operators.proximity import Hierarchy
from terramill.operators.search import level_of, meet, radius_join, ranked_search, top
from terramill.session import Scratch

K = 100
HALF_WIDTH = 70.0
CORRIDOR = 200.0
TOUCH = 1.0


def not_anchor(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & ~F.col("poi_id").eqNullSafe(F.col(c))
    return out


def near(asked: DataFrame, places: DataFrame, k: int = K) -> DataFrame:
    """asked: question_id, category, x, y, anchor_index."""
    return ranked_search(asked, places, ["question_id"], k, match=not_anchor("anchor_index"))


def near_metric(asked: DataFrame, places: DataFrame, k: int = K) -> DataFrame:
    """asked: question_id, category, x, y, anchor_index, distance; places strictly closer than the distance."""
    met = radius_join(asked, places, F.col("distance").cast("double")).where(not_anchor("anchor_index"))
    return top(met.withColumn("dist", F.col("gap")), ["question_id"], ["dist", "poi_id"], k).select("question_id", "poi_id", "dist", "rank")


def cardinal_center(direction: Column) -> Column:
    """Degrees of a direction; null for anything but the four names."""
    return F.try_element_at(F.create_map(*[F.lit(v) for item in G.CARDINAL.items() for v in item]), direction)


def sector_share(half_width: float) -> float:
    return min(1.0, max(half_width, 1.0) / 180)


def near_cardinal(asked: DataFrame, places: DataFrame, k: int = K, half_width: float = HALF_WIDTH) -> DataFrame:
    """asked: question_id, category, x, y, anchor_index, direction; a place at the anchor is to its north."""
    asked = asked.withColumn("center", cardinal_center(F.col("direction"))).where("center IS NOT NULL")
    angle = G.azimuth(F.col("px") - F.col("x"), F.col("py") - F.col("y"))
    return ranked_search(asked, places, ["question_id"], k, match=not_anchor("anchor_index") & G.in_sector(angle, F.col("center"), half_width), share=sector_share(half_width))


def towards(asked: DataFrame, places: DataFrame, k: int = K, half_width: float = HALF_WIDTH) -> DataFrame:
    """asked: question_id, category, x, y, bx, by, anchor_index, point_b_index; the cone from A around the direction to B, distances from A."""
    center = G.azimuth(F.col("bx") - F.col("x"), F.col("by") - F.col("y"))
    asked = asked.withColumn("center", center).where("center IS NOT NULL")
    angle = G.azimuth(F.col("px") - F.col("x"), F.col("py") - F.col("y"))
    return ranked_search(asked, places, ["question_id"], k, match=not_anchor("anchor_index", "point_b_index") & G.in_sector(angle, F.col("center"), half_width), share=sector_share(half_width))


def between(asked: DataFrame, places: DataFrame, k: int = K, corridor: float = CORRIDOR) -> DataFrame:
    """asked: as for towards; places beside the segment A-B, at most ``corridor`` off its line.

    Ranked by the offset from the line (the published dist), then by the way
    from A. A and B at one place have nothing between them.
    """
    ax, ay, abx, aby = F.col("ax"), F.col("ay"), F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    asked = asked.withColumnsRenamed({"x": "ax", "y": "ay"}).withColumn("ab", F.sqrt(abx * abx + aby * aby)).where("ab > 0")
    # cells that the corridor touches; wider ones for far ends, so that they stay few
    asked = asked.withColumn("level", level_of(F.greatest(F.lit(corridor), F.col("ab") / 16)))
    covered = _cells_of(asked, F.pow(F.lit(2.0), F.col("level")), corridor + 1.0)
    met = meet(covered, places, asked.select("category", "level").distinct()).where(not_anchor("anchor_index", "point_b_index"))
    dx, dy = F.col("px") - ax, F.col("py") - ay
    met = met.withColumns({"along": F.try_divide(dx * abx + dy * aby, F.col("ab")), "dist": F.try_divide(F.abs(dx * aby - dy * abx), F.col("ab"))})
    met = met.where(F.col("along").between(F.lit(0.0), F.col("ab")) & (F.col("dist") <= corridor))
    return top(met, ["question_id"], ["dist", "along", "poi_id"], k).select("question_id", "poi_id", "dist", "along", "rank")


AREA_KEYS = ["area_id", "category"]


def _framed(asked: DataFrame, shapes: DataFrame, key: str) -> DataFrame:
    """Asked (key, category) with the shape's box, its middle (x, y) and half its diagonal; the segments stay where they are."""
    b = F.col("bounds")
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
    shapes = shapes.select(key, *[b[c].alias(f"box_{c}") for c in ("x0", "y0", "x1", "y1")], ((b["x0"] + b["x1"]) / 2).alias("x"), ((b["y0"] + b["y1"]) / 2).alias("y"), (F.sqrt(w * w + h * h) / 2).alias("half"))
    return asked.select(key, "category").distinct().join(shapes, key)


def _nearest_to_shapes(asked: DataFrame, shapes: DataFrame, key: str, places: DataFrame, k: int, score: Column, match: Column | None = None) -> DataFrame:
    shapes = Scratch(places.sparkSession, "shapes").cut(shapes.select(key, "segments", "bounds"), "shapes")  # each round of the search joins them
    dx = F.greatest(F.lit(0.0), F.col("box_x0") - F.col("px"), F.col("px") - F.col("box_x1"))
    dy = F.greatest(F.lit(0.0), F.col("box_y0") - F.col("py"), F.col("py") - F.col("box_y1"))
    return ranked_search(
        _framed(asked, shapes, key), places, [key, "category"], k, score=score, match=match, base=F.col("half"), shapes=shapes.select(key, "segments"), shape_key=key, least=F.sqrt(dx * dx + dy * dy)
    )


def contained(asked: DataFrame, areas: DataFrame, places: DataFrame) -> DataFrame:
    """asked (area_id, category, ...) with the places of the category strictly inside the area, and the area's segments."""
    points = places.where("x IS NOT NULL AND y IS NOT NULL")
    areas = areas.join(asked.select("area_id").distinct(), "area_id", "left_semi")  # others aren't triangulated
    points = points.join(asked.select("category").distinct(), "category", "left_semi")
    pairs = Hierarchy(areas.select("area_id", "rings")).containing(points)
    met = pairs.join(points.select("poi_id", "category", F.col("x").alias("px"), F.col("y").alias("py")), "poi_id").join(asked.distinct(), ["area_id", "category"])
    met = met.join(areas.select("area_id", "segments", "bounds"), "area_id")
    return met.where(G.distance_to(F.col("segments"), F.col("px"), F.col("py")) > 0)


def inside(asked: DataFrame, areas: DataFrame, places: DataFrame) -> DataFrame:
    """All places inside; the distance to the solid area is 0 for each, so the poi_id ranks."""
    met = contained(asked.select(*AREA_KEYS), areas, places).withColumn("dist", F.lit(0.0))
    return top(met, AREA_KEYS, ["poi_id"], None).select(*AREA_KEYS, "poi_id", "dist", "rank")


def outside(asked: DataFrame, areas: DataFrame, places: DataFrame, k: int = K) -> DataFrame:
    """The k nearest places that are not within; those on the border are outside with distance 0."""
    gap = G.distance_to(F.col("segments"), F.col("px"), F.col("py"))
    return _nearest_to_shapes(asked, areas, "area_id", places, k, gap, ~(G.crosses_odd(F.col("segments"), F.col("px"), F.col("py")) & (F.col("dist") > 0)))


def border(asked: DataFrame, areas: DataFrame, places: DataFrame, k: int = K, solid: bool = False) -> DataFrame:
    """The k places nearest to the boundary, from either side; ``solid``: to the area, 0 inside."""
    gap = G.distance_to(F.col("segments"), F.col("px"), F.col("py"))
    if solid:
        gap = F.when(G.within(F.col("segments"), F.col("px"), F.col("py")), 0.0).otherwise(gap)
    return _nearest_to_shapes(asked, areas, "area_id", places, k, gap)


def direction_in(asked: DataFrame, areas: DataFrame, places: DataFrame) -> DataFrame:
    """asked: area_id, category, direction; places inside from the area's edge in that direction on, with their distance to it."""
    asked = asked.where(cardinal_center(F.col("direction")).isNotNull()).select(*AREA_KEYS, "direction")
    met = contained(asked, areas, places)
    b, d = F.col("bounds"), F.col("direction")
    gap = F.when(d == "north", b["y1"] - F.col("py")).when(d == "south", F.col("py") - b["y0"]).when(d == "east", b["x1"] - F.col("px")).otherwise(F.col("px") - b["x0"])
    keys = [*AREA_KEYS, "direction"]
    return top(met.withColumn("dist", gap), keys, ["dist", "poi_id"], None).select(*keys, "poi_id", "dist", "rank")


def along(asked: DataFrame, streets: DataFrame, places: DataFrame, k: int = K) -> DataFrame:
    """asked: id_street, category; the k places nearest to any part of the street."""
    gap = G.distance_to(F.col("segments"), F.col("px"), F.col("py"))
    return _nearest_to_shapes(asked, streets, "id_street", places, k, gap)


def _cells_of(segments: DataFrame, size: float | Column, margin: float) -> DataFrame:
    """Segments (ax, ay, bx, by) repeated for each grid cell that they, widened by the margin, may touch: column by column along the segment."""
    size = F.lit(float(size)) if isinstance(size, (int, float)) else size
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    cell = lambda v: F.floor(v / size).cast("long")
    x0, x1 = F.least(ax, bx), F.greatest(ax, bx)
    out = segments.withColumn("cx", F.explode(F.sequence(cell(x0 - margin), cell(x1 + margin))))
    # the part of the segment that is within the margin of the column
    slope = F.try_divide(by - ay, bx - ax)
    at = lambda x: F.coalesce(ay + (x - ax) * slope, ay)
    lo, hi = F.greatest(x0, F.col("cx") * size - margin), F.least(x1, (F.col("cx") + 1) * size + margin)
    ends = [F.when(bx == ax, f(ay, by)).otherwise(f(at(lo), at(hi))) for f in (F.least, F.greatest)]
    return out.withColumn("cy", F.explode(F.sequence(cell(ends[0] - margin - 1e-6), cell(ends[1] + margin + 1e-6))))


def segment_pairs(streets: DataFrame, margin: float, size: float = 200.0, by: list[str] | None = None) -> DataFrame:
    """Pairs of segments of different streets (a < b) whose boxes come closer than the margin, once each; ``by``: only of streets that agree in these columns."""
    by = by or []
    rows = streets.select("id_street", *by, F.inline("segments")).select("id_street", *by, "pos", "ax", "ay", "bx", "by")
    rows = _cells_of(rows, size, margin)
    left = rows.select(F.col("id_street").alias("a"), F.col("pos").alias("pa"), *[F.col(c).alias(f"{c}_1") for c in ("ax", "ay", "bx", "by")], "cx", "cy", *by)
    right = rows.select(F.col("id_street").alias("b"), F.col("pos").alias("pb"), *[F.col(c).alias(f"{c}_2") for c in ("ax", "ay", "bx", "by")], "cx", "cy", *by)
    return left.join(right, ["cx", "cy", *by]).where("a < b").drop("cx", "cy", *by).dropDuplicates(["a", "pa", "b", "pb"])


def _offsets(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points to segments, row by row."""
    d = b - a
    size = (d * d).sum(axis=1)
    t = np.clip(np.divide(((p - a) * d).sum(axis=1), size, out=np.zeros(len(d)), where=size > 0), 0.0, 1.0)
    e = p - (a + t[:, None] * d)
    return np.sqrt((e * e).sum(axis=1))


PAIR = "a long, b long, gap double, x double, y double"


def _meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distance of two segments and a point they share (null without one); collinear ones share an end that lies on the other."""
    for f in frames:
        a, b, c, d = (f[[f"{k}x_{n}", f"{k}y_{n}"]].to_numpy(float) for n in (1, 2) for k in ("a", "b"))
        r, s, q = b - a, d - c, c - a
        det = r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]
        safe = np.where(det == 0, 1.0, det)
        u, v = (q[:, 0] * s[:, 1] - q[:, 1] * s[:, 0]) / safe, (q[:, 0] * r[:, 1] - q[:, 1] * r[:, 0]) / safe
        proper = (det != 0) & (u >= 0) & (u <= 1) & (v >= 0) & (v <= 1)
        ends = [(c, _offsets(c, a, b)), (d, _offsets(d, a, b)), (a, _offsets(a, c, d)), (b, _offsets(b, c, d))]
        point = np.full((len(f), 2), np.nan)
        for at, gap in reversed(ends):
            point[gap == 0] = at[gap == 0]
        point[proper] = (a + u[:, None] * r)[proper]
        gap = np.where(proper, 0.0, np.min([g for _, g in ends], axis=0))
        out = pd.DataFrame({"a": f["a"], "b": f["b"], "gap": gap, "x": point[:, 0], "y": point[:, 1]})
        yield out.astype({"x": "Float64", "y": "Float64"}).where(out.notna(), pd.NA)


def touching_streets(streets: DataFrame, tolerance: float = TOUCH, by: list[str] | None = None) -> DataFrame:
    """(street_a, street_b, gap), a < b: streets at most ``tolerance`` apart; ``by``: only those that agree in these columns."""
    met = segment_pairs(streets, tolerance, max(200.0, tolerance), by).mapInPandas(_meet, PAIR).where(F.col("gap") <= tolerance)
    return met.groupBy(F.col("a").alias("street_a"), F.col("b").alias("street_b")).agg(F.min("gap").alias("gap"))


def crossings(streets: DataFrame) -> DataFrame:
    """(street_a, street_b, x, y), a < b: every point where two streets really meet."""
    met = segment_pairs(streets, TOUCH).mapInPandas(_meet, PAIR).where("x IS NOT NULL AND NOT isnan(x)")
    return met.select(F.col("a").alias("street_a"), F.col("b").alias("street_b"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y")).distinct()


def cross(asked: DataFrame, points: DataFrame, places: DataFrame, k: int = K) -> DataFrame:
    """asked: street_a, street_b, category; the k places nearest to any of the ``crossings`` of the two streets; none without one."""
    keys = ["street_a", "street_b", "category"]
    each = ranked_search(asked.select(*keys).distinct().join(points, ["street_a", "street_b"]), places, [*keys, "x", "y"], k)
    nearest = each.groupBy(*keys, "poi_id").agg(F.min("dist").alias("dist"))
    return top(nearest, keys, ["dist", "poi_id"], k).select(*keys, "poi_id", "dist", "rank")


def along_street_pairs(streets: DataFrame, places: DataFrame, reach: float, size: float = 256.0) -> DataFrame:
    """(id_street, poi_id, category) of the places at most ``reach`` off a street."""
    rows = _cells_of(streets.select("id_street", F.inline("segments")), size, reach).select("id_street", F.struct("ax", "ay", "bx", "by").alias("g"), "cx", "cy")
    cell = [F.floor(F.col(c) / size).cast("long").alias(f"c{c}") for c in ("x", "y")]
    points = places.where("x IS NOT NULL AND y IS NOT NULL").select("poi_id", "category", "x", "y", *cell)
    met = points.join(rows, ["cx", "cy"]).where(G.segment_distance(F.col("g"), F.col("x"), F.col("y")) <= reach)
    return met.select("id_street", "poi_id", "category").distinct()


def opposite_side(asked: DataFrame, streets: DataFrame, places: DataFrame, k: int = K, max_along: float = 80.0, max_cross: float = 40.0) -> DataFrame:
    """asked: id_street, poi_y (poi_id, at most max_cross off the street), category; places across the street from it.

    Ranked by the way along the street between the two; dist is the place's
    distance from the street. The nearest part of a street decides the side.
    """
    keys = ["id_street", "poi_y", "category"]
    at = places.select(F.col("poi_id").alias("poi_y"), F.col("x").alias("yx"), F.col("y").alias("yy"))
    asked = asked.select(*keys).distinct().join(at, "poi_y").join(streets.select("id_street", "segments"), "id_street")
    asked = asked.withColumn("y_at", G.locate(F.col("segments"), F.col("yx"), F.col("yy"))).where(F.col("y_at.dist") <= max_cross)
    asked = asked.withColumnsRenamed({"yx": "x", "yy": "y"})
    # both are at most max_cross off the street, and max_along apart along it
    met = radius_join(asked, places, F.lit(max_along + 2 * max_cross + 1.0)).where(not_anchor("poi_y"))
    met = met.withColumn("p_at", G.locate(F.col("segments"), F.col("px"), F.col("py")))
    met = met.withColumns({"dist": F.col("p_at.dist"), "score": F.abs(F.col("p_at.along") - F.col("y_at.along"))})
    met = met.where((F.col("p_at.side") != F.col("y_at.side")) & (F.col("dist") <= max_cross) & (F.col("score") <= max_along))
    return top(met, keys, ["score", "poi_id"], k).select(*keys, "poi_id", "dist", "score", "rank")
