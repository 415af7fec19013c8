"""Queries of the general data operators and their SQL."""

from __future__ import annotations


import re

from terramill.operators import orphans, proximity
from terramill.plans.spatial import POI, SEGMENTS
from terramill.session import table


def _p7(spark, d):
    return orphans.orphans_found(table(spark, d, "benchmark"), table(spark, d, "df_osm"))


QUERIES = {
    "p5_found": lambda spark, d: proximity.proximity_found(table(spark, d, "df_osm"), table(spark, d, "df_area")),
    "p7_found": lambda spark, d: _p7(spark, d).select("question_id", "field", "poi_id").distinct(),
    "p7_report": lambda spark, d: orphans.orphans_report(_p7(spark, d)),
}

_ORPHANS = """
WITH r AS (
  SELECT DISTINCT question_id, created_at, 'anchor_index' AS field, anchor_index AS poi_id FROM benchmark WHERE anchor_index IS NOT NULL
  UNION
  SELECT question_id, created_at, 'results_poi_id', unnest(results_poi_id) FROM benchmark
), o AS (
  SELECT * FROM r WHERE poi_id IS NOT NULL AND NOT EXISTS (
    FROM df_osm p WHERE p.poi_id = r.poi_id AND p.loaded_at <= r.created_at AND (p.deleted_at IS NULL OR p.deleted_at > r.created_at))
)"""

SQL = {
    # distances, and odd crossings of each area's segments
    "p5_found": re.sub(r"\bby\b", "ey", re.sub(r"\bbx\b", "ex", f"""WITH {POI}, {SEGMENTS},
spot AS (SELECT poi_id, x, y FROM poi WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT 'near' AS kind, a.poi_id AS left_id, b.poi_id AS right_id FROM spot a JOIN spot b
  ON b.x BETWEEN a.x - 25 AND a.x + 25 AND a.poi_id < b.poi_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 25
UNION ALL
SELECT 'inside', poi_id, area_id FROM spot JOIN seg ON (ay > y) <> (by > y) AND x < ax + (y - ay) * (bx - ax) / (by - ay) GROUP BY poi_id, area_id HAVING count(*) % 2 = 1""")),
    "p7_found": _ORPHANS + " SELECT DISTINCT question_id, field, poi_id FROM o",
    "p7_report": _ORPHANS + " SELECT field, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_orphans, count(DISTINCT question_id) AS n_questions FROM o GROUP BY ALL",
}
