"""Queries of the twelve generators over all categories of the corpus, and their SQL, which answers every candidate."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from terramill.operators import corpus, generators
from terramill.plans import spatial
from terramill.session import Scratch, table

ASKED = 110


def world(spark, d, needs: tuple[str, ...] = ("areas", "streets")) -> generators.World:
    """The tables of a world, of areas and streets those needed."""
    scratch = Scratch(spark, "world")
    places = scratch.cut(corpus.pois(table(spark, d, "df_osm")), "places")
    shapes = {"areas": lambda: corpus.areas(table(spark, d, "df_area")), "streets": lambda: corpus.streets(table(spark, d, "df_streets"))}
    return generators.World(places, **{name: scratch.cut(shapes[name](), name) for name in needs})


def listed(rows):
    """Questions with their answers as text."""
    n = F.size("results_poi_id")
    ids, names, ranks = (F.array_join(F.col(f"results_poi_{c}").cast("array<string>"), ",") for c in ("id", "name", "rank"))
    dist = lambda i: F.round(F.get("results_poi_dist", i), 3)
    return rows.select("query", "category_query", "function", n.alias("n_answers"), ids.alias("poi_ids"), names.alias("poi_names"), ranks.alias("ranks"), dist(F.lit(0)).alias("first_dist"), dist(n - 1).alias("last_dist"))


def _generated(name):
    return lambda spark, d: listed(generators.TEMPLATES[name].generate(world(spark, d, generators.TEMPLATES[name].needs), ASKED))


def union_all_templates(spark, d):
    """Questions and answers of the union, and what each template could not make of the questions asked for."""
    rows = generators.all_templates(world(spark, d))
    counts = rows.groupBy("function").agg(F.sum(F.size("results_poi_id")).alias("n_answers"))
    missing = generators.shortfall(rows, 100).select("function", F.col("produced").alias("n_questions"), "missing")
    return missing.join(counts, "function", "left")


QUERIES = {
    **{f"gen_{name}": _generated(name) for name in generators.TEMPLATES},
    "union_all_templates": union_all_templates,
}

_BASE = f"""{spatial.POI},
spot AS (SELECT poi_id, poi_name, category, x AS px, y AS py FROM poi WHERE x IS NOT NULL AND y IS NOT NULL AND category IS NOT NULL),
named AS (SELECT poi_id, poi_name, category, px AS x, py AS y FROM spot WHERE poi_name IS NOT NULL),
cats AS (SELECT category, (row_number() OVER (ORDER BY min(poi_id), category) - 1)::INT AS i, (count(*) OVER ())::INT AS n FROM poi WHERE category IS NOT NULL GROUP BY category)"""

_CELLS = """
anchor AS (SELECT poi_id AS a, poi_name AS a_name, category AS a_cat, x AS ax, y AS ay, row_number() OVER (PARTITION BY category ORDER BY md5('42:' || poi_id), poi_id) AS place FROM named),
cell AS (SELECT anchor.*, c.category, ((c.i - o.i + c.n) % c.n) * c.n + o.i AS cell FROM anchor JOIN cats o ON a_cat = o.category CROSS JOIN cats c)"""


def _chosen(strata: str) -> str:
    """The first ASKED of ``ok`` (stratum, place), spread over the strata."""
    return f"""
turned AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY place) AS turn FROM ok),
chosen AS (
  SELECT turned.* FROM turned, (SELECT {strata} AS s FROM cats LIMIT 1)
  ORDER BY turn > {ASKED} // s + CASE WHEN stratum < {ASKED} % s THEN 1 ELSE 0 END, turn, stratum LIMIT {ASKED}
)"""


def _listed(function: str, text: str, keys: str, order: str, limit: bool = True) -> str:
    """The answers ``met`` (keys, poi_id, poi_name, dist) of the chosen questions, as lists."""
    return f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rank FROM met)
SELECT any_value({text}) AS query, any_value(category) AS category_query, '{function}' AS function, count(*)::INT AS n_answers, string_agg(poi_id::VARCHAR, ',' ORDER BY rank) AS poi_ids,
       coalesce(string_agg(poi_name, ',' ORDER BY rank), '') AS poi_names, string_agg(rank::VARCHAR, ',' ORDER BY rank) AS ranks, round(arg_min(dist, rank), 3) AS first_dist, round(arg_max(dist, rank), 3) AS last_dist
FROM ranked {"WHERE rank <= 100" if limit else ""} GROUP BY {keys}"""


_GAP = "sqrt((px - ax) * (px - ax) + (py - ay) * (py - ay))"
_AZ = "((degrees(atan2({0}, {1})) + 360) % 360)"
_SECTOR = "abs((" + _AZ.format("px - ax", "py - ay") + " - {0} + 540) % 360 - 180) <= 70"
_CENTERS = {"north": 0.0, "east": 90.0, "south": 180.0, "west": 270.0}


def _anchored(function: str, ok: str, strata: str, where: str, text: str, keys: str = "a, category", before: str = "") -> str:
    return f"""WITH {_BASE}, {_CELLS}, {before}
ok AS ({ok}), {_chosen(strata)},
met AS (SELECT c.*, s.poi_id, s.poi_name, px, py, {_GAP} AS dist FROM chosen c JOIN spot s USING (category) WHERE s.poi_id <> a AND {where}),
{_listed(function, text, keys, "dist, poi_id")}"""


_SEGMENTS = re.sub(r"\bby\b", "ey", re.sub(r"\bbx\b", "ex", spatial.SEGMENTS))
_SEG_DIST = re.sub(r"\bby\b", "ey", re.sub(r"\bbx\b", "ex", spatial._SEG_DIST))
_ODD = re.sub(r"\bby\b", "ey", re.sub(r"\bbx\b", "ex", spatial._ODD))

_AREAS = f"""{_SEGMENTS.replace("unnest(rings) AS r", "unnest(rings) AS r, unnest(range(1, len(rings) + 1)) AS ring").replace("SELECT area_id, r[i].x", "SELECT area_id, ring, r[i].x").replace("SELECT area_id, r, unnest", "SELECT area_id, ring, r, unnest")},
one AS (SELECT area_id, ring, abs(sum(ax * ey - ex * ay)) / 2 AS part, count(*) AS k, least(min(ax), min(ex)) AS x0, least(min(ay), min(ey)) AS y0, greatest(max(ax), max(ex)) AS x1, greatest(max(ay), max(ey)) AS y1 FROM seg GROUP BY ALL),
area AS (
  SELECT area_id, area_name, x0, y0, x1, y1 FROM (
    SELECT area_id, sum(CASE WHEN ring = 1 THEN part ELSE -part END) AS size, sum(k) AS k, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM one GROUP BY area_id
  ) JOIN (SELECT area_id, max(area_name) AS area_name FROM df_area WHERE rings IS NOT NULL GROUP BY area_id) USING (area_id) WHERE k >= 3 AND size > 1000 AND area_name IS NOT NULL
), g AS (
  SELECT area_id, poi_id, poi_name, category, px, py, min({_SEG_DIST}) AS gap, {_ODD} AS odd FROM area CROSS JOIN spot JOIN seg USING (area_id) GROUP BY ALL
)"""


def _area(function: str, where: str, dist: str, order: str, text: str, limit: bool = True, directions: bool = False) -> str:
    keys = "area_id, category, direction" if directions else "area_id, category"
    candidate = "(SELECT area_id, direction FROM area, (SELECT unnest(['north', 'east', 'south', 'west']) AS direction))" if directions else "area"
    order_of = "md5('42:' || area_id || ':' || direction), area_id, direction" if directions else "md5('42:' || area_id), area_id"
    return f"""WITH {_BASE}, {_AREAS},
candidate AS (SELECT area_id{", direction" if directions else ""}, row_number() OVER (ORDER BY {order_of}) AS place FROM {candidate}),
fits AS (SELECT * FROM g WHERE {where}),
ok AS (SELECT DISTINCT {keys}, i AS stratum, place FROM fits JOIN candidate USING (area_id) JOIN cats USING (category)), {_chosen("n")},
met AS (SELECT c.*, poi_id, poi_name, area_name, gap, {dist} AS dist FROM chosen c JOIN fits USING (area_id, category) JOIN area USING (area_id)),
{_listed(function, text, keys, order, limit)}"""


_STREETS = f"""
part AS (
  SELECT id_street, unnest(parts) AS r, unnest(range(len(parts))) AS p FROM (SELECT id_street, max(parts) AS parts FROM df_streets WHERE parts IS NOT NULL GROUP BY id_street)
), seg AS (
  SELECT *, sum(size) OVER (PARTITION BY id_street ORDER BY p, i) - size AS start, row_number() OVER (ORDER BY id_street, p, i) AS sid
  FROM (SELECT *, sqrt((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)) AS size FROM (
    SELECT id_street, p, i, r[i].x AS ax, r[i].y AS ay, r[i + 1].x AS ex, r[i + 1].y AS ey FROM (SELECT id_street, p, r, unnest(range(1, len(r))) AS i FROM part)))
), street AS (
  SELECT id_street, street_name, length FROM (SELECT id_street, sum(size) AS length FROM seg GROUP BY id_street)
  JOIN (SELECT id_street, max(street_name) AS street_name FROM df_streets WHERE parts IS NOT NULL GROUP BY id_street) USING (id_street)
)"""

#: Points in which segments of two streets cross.
_POINTS = """
pair AS (
  SELECT a.id_street AS low, b.id_street AS high, a.ax, a.ay, a.ex - a.ax AS rx, a.ey - a.ay AS ry, b.ax - a.ax AS qx, b.ay - a.ay AS qy, b.ex - b.ax AS sx, b.ey - b.ay AS sy
  FROM seg a JOIN seg b ON a.id_street < b.id_street
    AND least(a.ax, a.ex) - 1 <= greatest(b.ax, b.ex) AND least(b.ax, b.ex) - 1 <= greatest(a.ax, a.ex) AND least(a.ay, a.ey) - 1 <= greatest(b.ay, b.ey) AND least(b.ay, b.ey) - 1 <= greatest(a.ay, a.ey)
), solved AS (SELECT *, (qx * sy - qy * sx) / nullif(rx * sy - ry * sx, 0) AS u, (qx * ry - qy * rx) / nullif(rx * sy - ry * sx, 0) AS v FROM pair),
point AS (SELECT DISTINCT low, high, round(ax + u * rx, 3) AS x, round(ay + u * ry, 3) AS y FROM solved WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1)"""

_CROSSED = "SELECT low, high, category, poi_id, any_value(poi_name) AS poi_name, min(sqrt((px - x) * (px - x) + (py - y) * (py - y))) AS dist FROM {0} JOIN spot USING (category) GROUP BY low, high, category, poi_id"

#: Where every place within 40 m of a street is along it: distance, way from its start, side.
_T = re.sub(r"\bby\b", "ey", re.sub(r"\bbx\b", "ex", spatial._T))
_LOCATED = f"""
located AS (
  SELECT id_street, poi_id, poi_name, category, best.d AS d, best.along AS along, best.side AS side FROM (
    SELECT id_street, poi_id, any_value(poi_name) AS poi_name, any_value(category) AS category, min(struct_pack(d := {_SEG_DIST}, along := start + {_T} * size, side := CASE WHEN (ex - ax) * (py - ay) - (ey - ay) * (px - ax) >= 0 THEN 1 ELSE -1 END)) AS best
    FROM seg CROSS JOIN spot GROUP BY id_street, poi_id
  ) WHERE best.d <= 40
)"""

SQL = {
    "gen_point_near": _anchored(
        "point_near", "SELECT cell.*, cell AS stratum FROM cell JOIN (SELECT category, count(*) AS k FROM spot GROUP BY category) USING (category) WHERE k > CASE WHEN a_cat = category THEN 1 ELSE 0 END", "n * n", "true",
        "category || ' near ' || a_name",
    ),
    "gen_point_near_metric": _anchored(
        "point_near_metric", """SELECT cell.*, distance, cell * 4 + v AS stratum FROM cell JOIN least_gap USING (a, category), (SELECT unnest([100, 300, 500, 1000]) AS distance, unnest([0, 1, 2, 3]) AS v) WHERE gap < distance""",
        "n * n * 4", f"{_GAP} < distance", "category || ' at less than ' || distance || ' meters from ' || a_name", "a, category, distance",
        f"least_gap AS (SELECT a, s.category, min({_GAP}) AS gap FROM anchor, spot s WHERE poi_id <> a GROUP BY ALL),",
    ),
    "gen_point_near_cardinal": _anchored(
        "point_near_cardinal", "SELECT cell.*, direction, center, cell * 4 + v AS stratum FROM cell JOIN seen USING (a, category) JOIN (SELECT unnest(['north', 'east', 'south', 'west']) AS direction, unnest([0.0, 90.0, 180.0, 270.0]) AS center, unnest([0, 1, 2, 3]) AS v) USING (direction)",
        "n * n * 4", _SECTOR.format("center"), "category || ' to the ' || direction || ' of ' || a_name", "a, category, direction",
        "seen AS (" + " UNION ALL ".join(f"SELECT a, s.category, '{d}' AS direction FROM anchor, spot s WHERE poi_id <> a AND {_SECTOR.format(c)} GROUP BY a, s.category" for d, c in _CENTERS.items()) + "),",
    ),
    "gen_point_towards": _anchored(
        "point_towards", f"SELECT * FROM q SEMI JOIN (SELECT a, category FROM q JOIN spot s USING (category) WHERE s.poi_id <> a AND s.poi_id <> b AND {_SECTOR.format('center')} GROUP BY a, category) USING (a, category)", "n * n",
        f"s.poi_id <> b AND {_SECTOR.format('center')}", "category || ' near ' || a_name || ' towards ' || b_name", "a, category",
        """reached AS (SELECT a, poi_id AS b, poi_name AS b_name, x AS tx, y AS ty FROM anchor JOIN named ON poi_id <> a AND sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)) < 1000),
drawn AS (SELECT a, category, arg_min(b, md5('42:' || md5(a || '|' || category) || ':' || b)) AS b FROM cell JOIN reached USING (a) GROUP BY a, category),
q AS (SELECT cell.*, cell AS stratum, b, b_name, """ + _AZ.format("tx - ax", "ty - ay") + """ AS center FROM cell JOIN drawn USING (a, category) JOIN reached USING (a, b)),""",
    ),
    "gen_point_between": f"""WITH {_BASE},
target AS (SELECT poi_id AS t, category, x AS tx, y AS ty, row_number() OVER (PARTITION BY category ORDER BY md5('42:' || poi_id), poi_id) AS place FROM named),
one AS (SELECT t, arg_min(poi_id, md5('42:' || t || ':' || poi_id)) AS a FROM target JOIN named ON poi_id <> t AND sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) < 1000 GROUP BY t),
first AS (SELECT target.*, a, poi_name AS a_name, x AS ax, y AS ay, 2 * tx - x AS mx, 2 * ty - y AS my FROM target JOIN one USING (t) JOIN named ON poi_id = a),
two AS (SELECT t, arg_min(poi_id, md5('42:' || t || ':' || poi_id)) AS b FROM first JOIN named ON poi_id <> t AND poi_id <> a AND sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) < 400 GROUP BY t),
both_ends AS (SELECT first.*, b, poi_name AS b_name, x - ax AS vx, y - ay AS vy, sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)) AS ab FROM first JOIN two USING (t) JOIN named ON poi_id = b),
every AS (
  SELECT e.*, s.poi_id, s.poi_name, ((px - ax) * vx + (py - ay) * vy) / nullif(ab, 0) AS along, abs((px - ax) * vy - (py - ay) * vx) / nullif(ab, 0) AS dist
  FROM both_ends e JOIN spot s USING (category) WHERE s.poi_id <> a AND s.poi_id <> b
), fits AS (SELECT * FROM every WHERE along BETWEEN 0 AND ab AND dist <= 200),
ok AS (SELECT DISTINCT t, i AS stratum, place FROM fits JOIN cats USING (category)), {_chosen("n")},
met AS (SELECT fits.* FROM fits JOIN chosen USING (t)),
{_listed("point_between", "category || ' between ' || a_name || ' and ' || b_name", "t", "dist, along, poi_id")}""",
    "gen_area_inside": _area("area_inside", "odd AND gap > 0", "0.0", "poi_id", "category || ' inside ' || area_name", False),
    "gen_area_outside": _area("area_outside", "NOT (odd AND gap > 0)", "gap", "gap, poi_id", "category || ' outside ' || area_name"),
    "gen_area_border": _area("area_border", "true", "gap", "gap, poi_id", "category || ' at the border of ' || area_name"),
    "gen_area_direction": _area(
        "area_direction", "odd AND gap > 0", "CASE c.direction WHEN 'north' THEN y1 - py WHEN 'south' THEN py - y0 WHEN 'east' THEN x1 - px ELSE px - x0 END", "dist, poi_id",
        "category || ' at the ' || direction || ' of ' || area_name", False, True,
    ),
    "gen_street_along": f"""WITH {_BASE}, {_STREETS},
candidate AS (SELECT id_street, street_name, row_number() OVER (ORDER BY md5('42:' || id_street), id_street) AS place FROM street WHERE street_name IS NOT NULL AND length > 500),
g AS (SELECT id_street, poi_id, poi_name, category, min({_SEG_DIST}) AS dist FROM candidate JOIN seg USING (id_street) CROSS JOIN spot GROUP BY ALL),
ok AS (SELECT DISTINCT id_street, category, street_name, i AS stratum, place FROM g JOIN candidate USING (id_street) JOIN cats USING (category)), {_chosen("n")},
met AS (SELECT c.*, poi_id, poi_name, dist FROM chosen c JOIN g USING (id_street, category)),
{_listed("street_along", "category || ' following ' || street_name", "id_street, category", "dist, poi_id")}""",
    "gen_street_cross": f"""WITH {_BASE}, {_STREETS}, {_POINTS},
p AS (SELECT point.* FROM point JOIN street a ON low = a.id_street JOIN street b ON high = b.id_street WHERE a.street_name IS NOT NULL AND b.street_name IS NOT NULL),
both_ways AS (SELECT DISTINCT low, high, low AS sa, high AS sb FROM p UNION SELECT DISTINCT low, high, high, low FROM p),
candidate AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || sa || ':' || sb), sa, sb) AS place FROM both_ways),
ok AS (SELECT DISTINCT low, high, sa, sb, category, i AS stratum, place FROM candidate CROSS JOIN cats JOIN (SELECT DISTINCT category FROM spot) USING (category)), {_chosen("n")},
near AS ({_CROSSED.format("(SELECT DISTINCT low, high, category, x, y FROM chosen JOIN p USING (low, high))")}),
met AS (SELECT c.*, poi_id, near.poi_name, dist, a.street_name AS a_name, b.street_name AS b_name FROM chosen c JOIN near USING (low, high, category) JOIN street a ON sa = a.id_street JOIN street b ON sb = b.id_street),
{_listed("street_cross", "category || ' at the intersection of  ' || a_name || ' and ' || b_name", "sa, sb, category", "dist, poi_id")}""",
    "gen_street_opposite_side": f"""WITH {_BASE}, {_STREETS}, {_LOCATED},
candidate AS (
  SELECT id_street, street_name, poi_id AS y, poi_name AS y_name, along AS y_along, side AS y_side, row_number() OVER (ORDER BY md5('42:' || id_street || ':' || poi_id), id_street, poi_id) AS place
  FROM located JOIN street USING (id_street) WHERE street_name IS NOT NULL AND poi_name IS NOT NULL
), fits AS (
  SELECT c.*, poi_id, poi_name, category, d AS dist, abs(along - y_along) AS score FROM candidate c JOIN located USING (id_street) WHERE poi_id <> y AND side <> y_side AND abs(along - y_along) <= 80
), ok AS (SELECT DISTINCT id_street, y, category, i AS stratum, place FROM fits JOIN cats USING (category)), {_chosen("n")},
met AS (SELECT fits.* FROM fits JOIN chosen USING (id_street, y, category)),
{_listed("street_opposite_side", "category || ' across ' || street_name || ' from ' || y_name", "id_street, y, category", "score, poi_id")}""",
    "street_cross": f"""WITH {_BASE}, {_STREETS}, {_POINTS},
near AS ({_CROSSED.format("(SELECT low, high, category, x, y FROM point CROSS JOIN cats)")})
SELECT low AS street_a, high AS street_b, category, poi_id, round(dist, 3) AS dist, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY low, high, category ORDER BY dist, poi_id) AS rank FROM near) WHERE rank <= 100""",
    "street_opposite": f"""WITH {_BASE}, {_STREETS}, {_LOCATED},
met AS (
  SELECT a.id_street, a.poi_id AS poi_y, category, b.poi_id, b.d AS dist, abs(b.along - a.along) AS score FROM located a JOIN located b USING (id_street, category)
  WHERE a.poi_id <> b.poi_id AND a.side <> b.side AND abs(b.along - a.along) <= 80
)
SELECT id_street, poi_y, category, poi_id, round(dist, 3) AS dist, round(score, 3) AS score, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY id_street, poi_y, category ORDER BY score, poi_id) AS rank FROM met) WHERE rank <= 100""",
}
_COUNTED = " UNION ALL ".join(f"SELECT function, n_answers FROM ({sql})" for name, sql in SQL.items() if name.startswith("gen_"))
SQL["union_all_templates"] = "SELECT function, count(*) AS n_questions, 100 - count(*) AS missing, sum(n_answers)::BIGINT AS n_answers FROM (" + _COUNTED.replace(str(ASKED), "100") + ") GROUP BY function"
