"""Queries of the spatial relations over the questions of ``benchmark``, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from terramill.operators import corpus, relations, search
from terramill.session import Scratch, table

ROUND = 3


def _places(spark, d):
    return corpus.pois(table(spark, d, "df_osm"))


def _asked(spark, d, function, *columns):
    rows = corpus.questions(table(spark, d, "benchmark"), function)
    return rows.select("question_id", "category", F.col("anchor_x").alias("x"), F.col("anchor_y").alias("y"), "anchor_index", *columns)


def _with_b(asked, places):
    b = places.where("x IS NOT NULL AND y IS NOT NULL").select(F.col("poi_id").alias("point_b_index"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return asked.join(b, "point_b_index")


def _rounded(rows):
    return rows.withColumn("dist", F.round("dist", ROUND))


def near_topk(spark, d):
    return _rounded(relations.near(_asked(spark, d, "point_near"), _places(spark, d)))


def near_metric(spark, d):
    return _rounded(relations.near_metric(_asked(spark, d, "point_near_metric", "distance"), _places(spark, d)))


def near_cardinal(spark, d):
    return _rounded(relations.near_cardinal(_asked(spark, d, "point_near_cardinal", "direction"), _places(spark, d)))


def towards(spark, d):
    places = _places(spark, d)
    return _rounded(relations.towards(_with_b(_asked(spark, d, "point_towards", "point_b_index"), places), places))


def between(spark, d):
    places = _places(spark, d)
    return _rounded(relations.between(_with_b(_asked(spark, d, "point_between", "point_b_index"), places), places)).drop("along")


def _area_asked(spark, d, function, *columns):
    return corpus.questions(table(spark, d, "benchmark"), function).where("area_index IS NOT NULL").select(F.col("area_index").alias("area_id"), "category", *columns).distinct()


def _area(operator, function, *columns):
    return lambda spark, d: _rounded(operator(_area_asked(spark, d, function, *columns), corpus.areas(table(spark, d, "df_area")), _places(spark, d)))


def street_along(spark, d):
    asked = corpus.questions(table(spark, d, "benchmark"), "street_along").where("street_index IS NOT NULL").select(F.col("street_index").alias("id_street"), "category").distinct()
    return _rounded(relations.along(asked, corpus.streets(table(spark, d, "df_streets")), _places(spark, d)))


def street_touching(spark, d):
    return relations.touching_streets(corpus.streets(table(spark, d, "df_streets"))).withColumn("gap", F.round("gap", ROUND))


def street_cross(spark, d):
    """The nearest places of every category of the corpus for every crossing pair of streets."""
    places, streets = _places(spark, d), corpus.streets(table(spark, d, "df_streets"))
    points = Scratch(spark, "crossings").cut(relations.crossings(streets), "points")
    pairs = points.select("street_a", "street_b").distinct()
    asked = pairs.withColumn("category", F.explode(F.array(*map(F.lit, corpus.categories(places))).cast("array<string>")))
    return _rounded(relations.cross(asked, points, places))


def street_opposite(spark, d):
    """For every street and place at most 40 m off it, the places of the same category across the street."""
    places, streets = _places(spark, d), corpus.streets(table(spark, d, "df_streets"))
    close = relations.along_street_pairs(streets, places, 40.0).select("id_street", F.col("poi_id").alias("poi_y"), "category")
    return _rounded(relations.opposite_side(close, streets, places)).withColumn("score", F.round("score", ROUND))


def radius_neighbours(spark, d):
    """Places of the same category less than 100 m apart, each pair once."""
    places = _places(spark, d)
    asked = places.select(F.col("poi_id").alias("left_id"), "category", "x", "y")
    met = search.radius_join(asked, places, F.lit(100.0)).where("left_id < poi_id")
    return met.select("left_id", F.col("poi_id").alias("right_id"), F.round("gap", ROUND).alias("dist"))


def area_size(spark, d):
    return corpus.areas(table(spark, d, "df_area")).select("area_id", F.round("size", 1).alias("size"), F.round("bounds.x0", 2).alias("x0"), F.round("bounds.y1", 2).alias("y1"))


def street_length(spark, d):
    return corpus.streets(table(spark, d, "df_streets")).select("id_street", F.round("length", ROUND).alias("length"), F.size("parts").alias("n_parts"))


QUERIES = {
    "near_topk": near_topk,
    "near_metric": near_metric,
    "near_cardinal": near_cardinal,
    "towards": towards,
    "between": between,
    "area_inside": _area(relations.inside, "area_inside"),
    "area_outside": _area(relations.outside, "area_outside"),
    "area_border": _area(relations.border, "area_border"),
    "area_direction": _area(relations.direction_in, "area_direction", "direction"),
    "street_along": street_along,
    "street_touching": street_touching,
    "street_cross": street_cross,
    "street_opposite": street_opposite,
    "radius_neighbours": radius_neighbours,
    "area_size": area_size,
    "street_length": street_length,
}

FOLD = "nullif(replace(replace(lower(strip_accents(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'))), ' ', '_'), '-', '_'), '')"


def _double(column: str, first: int) -> str:
    """SQL of the double in bytes ``first`` to ``first`` + 7 of a WKB, either byte order."""
    pairs = [f"substr(h, {2 * (first + i) + 1}, 2)" for i in range(8)]
    digits = f"CASE WHEN substr(h, 1, 2) = '01' THEN {' || '.join(reversed(pairs))} ELSE substr(h, {2 * first + 1}, 16) END"
    head, rest = f"('0x' || substr({digits}, 1, 3))::BIGINT", f"('0x' || substr({digits}, 4, 13))::BIGINT"
    value = f"({rest} + 4503599627370496)::DOUBLE * pow(2.0, ({head} & 2047) - 1075)"
    return f"CASE WHEN {head} >= 2048 THEN -({value}) ELSE {value} END AS {column}"


def _missing(column: str) -> str:
    stripped = f"nullif(regexp_replace({column}, '^\\s+|\\s+$', '', 'g'), '')"
    return f"CASE WHEN lower({stripped}) NOT IN ('nan', 'none') THEN {stripped} END AS {column}"


POI = f"""
raw AS (
  SELECT *, {_double("gx", 5)}, {_double("gy", 13)} FROM (SELECT *, hex(geometry) AS h FROM df_osm WHERE poi_id IS NOT NULL)
), poi AS (
  SELECT poi_id, max(poi_name) AS poi_name, max({FOLD.format("category")}) AS category, max(cooking_type) AS cooking_type, max(indoor_seating) AS indoor_seating,
         max(outdoor_seating) AS outdoor_seating, min(lx) AS x, min(ly) AS y
  FROM (
    SELECT poi_id, poi_name, category, {_missing("cooking_type")}, {_missing("indoor_seating")}, {_missing("outdoor_seating")},
           CASE WHEN h IS NOT NULL THEN gx WHEN x IS NOT NULL AND y IS NOT NULL AND NOT (x = 0 AND y = 0) THEN x END AS lx,
           CASE WHEN h IS NOT NULL THEN gy WHEN x IS NOT NULL AND y IS NOT NULL AND NOT (x = 0 AND y = 0) THEN y END AS ly
    FROM raw
  ) GROUP BY poi_id
)"""

ASKED = f"""
q AS (
  SELECT question_id, any_value(function) AS function, any_value({FOLD.format("category_query")}) AS category, any_value(anchor_x) AS x, any_value(anchor_y) AS y,
         any_value(anchor_index) AS anchor_index, any_value(point_b_index) AS point_b_index, any_value(distance) AS distance, any_value(direction) AS direction,
         any_value(area_index) AS area_id, any_value(street_index) AS id_street
  FROM benchmark GROUP BY question_id
)"""

_MET = """
m AS (
  SELECT q.*, p.poi_id, p.x AS px, p.y AS py, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS gap
  FROM q JOIN poi p USING (category) WHERE q.function = '{function}' AND p.poi_id IS DISTINCT FROM q.anchor_index AND p.poi_id IS DISTINCT FROM q.point_b_index
)"""


def _point(function: str, where: str, extra: str = "", anchors_b: bool = False) -> str:
    met = _MET.format(function=function)
    if not anchors_b:
        met = met.replace(" AND p.poi_id IS DISTINCT FROM q.point_b_index", "")
    return f"""WITH {POI}, {ASKED}, {met}{extra}
SELECT question_id, poi_id, round(gap, 3) AS dist, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY gap, poi_id) AS rank FROM m WHERE gap IS NOT NULL AND {where}
) WHERE rank <= 100"""


_AZ = "((degrees(atan2({0}, {1})) + 360) % 360)"
_SECTOR = "abs((" + _AZ + " - {2} + 540) % 360 - 180) <= 70"
_CENTER = "(CASE direction WHEN 'north' THEN 0.0 WHEN 'east' THEN 90.0 WHEN 'south' THEN 180.0 WHEN 'west' THEN 270.0 END)"

SEGMENTS = """
ring AS (
  SELECT area_id, unnest(rings) AS r FROM (SELECT area_id, max(rings) AS rings FROM df_area WHERE rings IS NOT NULL GROUP BY area_id)
), seg AS (
  SELECT area_id, r[i].x AS ax, r[i].y AS ay, r[CASE WHEN i = len(r) THEN 1 ELSE i + 1 END].x AS bx, r[CASE WHEN i = len(r) THEN 1 ELSE i + 1 END].y AS by
  FROM (SELECT area_id, r, unnest(range(1, len(r) + 1)) AS i FROM ring)
)"""

STREET_SEGMENTS = """
part AS (
  SELECT id_street, unnest(parts) AS r FROM (SELECT id_street, max(parts) AS parts FROM df_streets WHERE parts IS NOT NULL GROUP BY id_street)
), seg AS (
  SELECT id_street, r[i].x AS ax, r[i].y AS ay, r[i + 1].x AS bx, r[i + 1].y AS by FROM (SELECT id_street, r, unnest(range(1, len(r))) AS i FROM part)
)"""

_T = "least(1.0, greatest(0.0, coalesce(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / nullif((bx - ax) * (bx - ax) + (by - ay) * (by - ay), 0), 0.0)))"
_SEG_DIST = f"sqrt(pow(px - (ax + {_T} * (bx - ax)), 2) + pow(py - (ay + {_T} * (by - ay)), 2))"
_ODD = "sum(CASE WHEN (ay > py) <> (by > py) AND px < ax + (py - ay) * (bx - ax) / nullif(by - ay, 0) THEN 1 ELSE 0 END) % 2 = 1"


def _area_sql(function: str, where: str, dist: str, order: str, limit: str = "", keys: str = "area_id, category", extra: str = "") -> str:
    return f"""WITH {POI}, {ASKED}, {SEGMENTS},
a AS (SELECT DISTINCT {keys} FROM q WHERE function = '{function}' AND category IS NOT NULL AND area_id IS NOT NULL{extra}),
b AS (SELECT area_id, least(min(ax), min(bx)) AS x0, least(min(ay), min(by)) AS y0, greatest(max(ax), max(bx)) AS x1, greatest(max(ay), max(by)) AS y1 FROM seg GROUP BY area_id),
c AS (SELECT DISTINCT area_id, category FROM a),
g AS (
  SELECT area_id, category, poi_id, px, py, min({_SEG_DIST}) AS gap, {_ODD} AS odd
  FROM c JOIN (SELECT poi_id, category, x AS px, y AS py FROM poi WHERE x IS NOT NULL) USING (category) JOIN seg USING (area_id) GROUP BY ALL
)
SELECT {keys}, poi_id, round(dist, 3) AS dist, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rank
  FROM (SELECT *, {dist} AS dist FROM a JOIN g USING (area_id, category) JOIN b USING (area_id) WHERE {where})
) {limit}"""


_PAIR_SQL = f"""
s AS (SELECT *, row_number() OVER () AS sid FROM seg),
sp AS (SELECT a.id_street AS street_a, b.id_street AS street_b, a.ax AS ax1, a.ay AS ay1, a.bx AS bx1, a.by AS by1, b.ax AS ax2, b.ay AS ay2, b.bx AS bx2, b.by AS by2,
              (a.bx - a.ax) * (b.by - b.ay) - (a.by - a.ay) * (b.bx - b.ax) AS det
       FROM s a JOIN s b ON a.id_street < b.id_street
         AND least(a.ax, a.bx) - 1 <= greatest(b.ax, b.bx) AND least(b.ax, b.bx) - 1 <= greatest(a.ax, a.bx)
         AND least(a.ay, a.by) - 1 <= greatest(b.ay, b.by) AND least(b.ay, b.by) - 1 <= greatest(a.ay, a.by)),
uv AS (SELECT *, ((ax2 - ax1) * (by2 - ay2) - (ay2 - ay1) * (bx2 - ax2)) / nullif(det, 0) AS u, ((ax2 - ax1) * (by1 - ay1) - (ay2 - ay1) * (bx1 - ax1)) / nullif(det, 0) AS v FROM sp),
e AS (
  SELECT *, coalesce(u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1, false) AS proper, {{ends}} AS ends FROM uv
)"""


def _end_distance(px: str, py: str, n: int) -> str:
    out = _SEG_DIST
    for c in ("ax", "ay", "bx", "by"):
        out = out.replace(f"{c} ", f"{c}{n} ").replace(f"{c})", f"{c}{n})")
    return out.replace("px", px).replace("py", py)


_ENDS = "least(" + ", ".join(_end_distance(f"{c}x{m}", f"{c}y{m}", 3 - m) for m in (1, 2) for c in ("a", "b")) + ")"

SQL = {
    "near_topk": _point("point_near", "true"),
    "near_metric": _point("point_near_metric", "gap < distance"),
    "near_cardinal": _point("point_near_cardinal", _SECTOR.format("px - x", "py - y", _CENTER)),
    "towards": _point("point_towards", _SECTOR.format("px - x", "py - y", _AZ.format("bx - x", "by - y")), anchors_b=True).replace(
        "SELECT *, row_number()", "SELECT m.*, row_number()"
    ).replace("FROM m WHERE", "FROM m JOIN (SELECT poi_id AS point_b_index, x AS bx, y AS by FROM poi) b USING (point_b_index) WHERE"),
    "between": f"""WITH {POI}, {ASKED}, {_MET.format(function="point_between")},
n AS (
  SELECT m.question_id, m.poi_id, sqrt((bx - x) * (bx - x) + (by - y) * (by - y)) AS ab,
         ((px - x) * (bx - x) + (py - y) * (by - y)) / nullif(sqrt((bx - x) * (bx - x) + (by - y) * (by - y)), 0) AS along,
         abs((px - x) * (by - y) - (py - y) * (bx - x)) / nullif(sqrt((bx - x) * (bx - x) + (by - y) * (by - y)), 0) AS off
  FROM m JOIN (SELECT poi_id AS point_b_index, x AS bx, y AS by FROM poi) b USING (point_b_index)
)
SELECT question_id, poi_id, round(off, 3) AS dist, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY off, along, poi_id) AS rank FROM n WHERE along BETWEEN 0 AND ab AND off <= 200
) WHERE rank <= 100""",
    "area_inside": _area_sql("area_inside", "odd AND gap > 0", "0.0", "poi_id"),
    "area_outside": _area_sql("area_outside", "NOT (odd AND gap > 0)", "gap", "gap, poi_id", "WHERE rank <= 100"),
    "area_border": _area_sql("area_border", "true", "gap", "gap, poi_id", "WHERE rank <= 100"),
    "area_direction": _area_sql(
        "area_direction", "odd AND gap > 0", "CASE direction WHEN 'north' THEN y1 - py WHEN 'south' THEN py - y0 WHEN 'east' THEN x1 - px ELSE px - x0 END", "dist, poi_id",
        keys="area_id, category, direction", extra=" AND direction IN ('north', 'east', 'south', 'west')",
    ),
    "street_along": f"""WITH {POI}, {ASKED}, {STREET_SEGMENTS},
a AS (SELECT DISTINCT id_street, category FROM q WHERE function = 'street_along' AND category IS NOT NULL AND id_street IS NOT NULL),
g AS (
  SELECT id_street, category, poi_id, min({_SEG_DIST}) AS gap
  FROM a JOIN (SELECT poi_id, category, x AS px, y AS py FROM poi WHERE x IS NOT NULL) USING (category) JOIN seg USING (id_street) GROUP BY ALL
)
SELECT id_street, category, poi_id, round(gap, 3) AS dist, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY id_street, category ORDER BY gap, poi_id) AS rank FROM g
) WHERE rank <= 100""",
    "street_touching": f"""WITH {STREET_SEGMENTS}, {_PAIR_SQL.format(ends=_ENDS)}
SELECT street_a, street_b, round(min(CASE WHEN proper THEN 0.0 ELSE ends END), 3) AS gap FROM e WHERE proper OR ends <= 1.0 GROUP BY ALL""",
    "radius_neighbours": f"""WITH {POI}
SELECT a.poi_id AS left_id, b.poi_id AS right_id, round(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), 3) AS dist
FROM poi a JOIN poi b ON a.category = b.category AND a.poi_id < b.poi_id
WHERE b.x BETWEEN a.x - 100 AND a.x + 100 AND sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) < 100""",
    "area_size": f"""WITH {SEGMENTS.replace("unnest(rings) AS r", "unnest(rings) AS r, unnest(range(1, len(rings) + 1)) AS n").replace("SELECT area_id, r[i].x", "SELECT area_id, n, r[i].x").replace("SELECT area_id, r, unnest", "SELECT area_id, n, r, unnest")},
one AS (SELECT area_id, n, abs(sum(ax * by - bx * ay)) / 2 AS a FROM seg GROUP BY ALL),
box AS (SELECT area_id, least(min(ax), min(bx)) AS x0, greatest(max(ay), max(by)) AS y1, count(*) AS k FROM seg GROUP BY area_id)
SELECT area_id, round(sum(CASE WHEN n = 1 THEN a ELSE -a END), 1) AS size, round(x0, 2) AS x0, round(y1, 2) AS y1
FROM one JOIN box USING (area_id) WHERE k >= 3 GROUP BY area_id, x0, y1""",
    "street_length": f"""WITH {STREET_SEGMENTS}
SELECT id_street, round(sum(sqrt(pow(bx - ax, 2) + pow(by - ay, 2))), 3) AS length, (SELECT max(len(parts)) FROM df_streets s WHERE s.id_street = seg.id_street)::INT AS n_parts
FROM seg GROUP BY id_street""",
}

# the end of a segment is (ex, ey) in SQL, where "by" is a keyword
SQL = {name: re.sub(r"\bby\b", "ey", re.sub(r"\bbx\b", "ex", sql)) for name, sql in SQL.items()}
