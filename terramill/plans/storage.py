"""Queries of sources and sinks over the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terramill.operators import corpus, semantic, validate
from terramill.plans.attributes import _FRAGMENTS
from terramill.plans.attributes import SQL as ATTRIBUTES
from terramill.plans.spatial import POI
from terramill.session import Scratch, table
from terramill.sources import extracts, question_sets

#: A box in degrees around the inner part of the tables' places.
INNER = (-1.92, 43.245, -1.87, 43.275)
SERVED = ["bar", "cafe", "hotel", "park", "pub", "restaurant", "station"]


def _elements(spark, d):
    """df_osm as the elements of a map extract, one for each POI."""
    rows = table(spark, d, "df_osm").where("poi_id IS NOT NULL").groupBy(F.col("poi_id").alias("osm_id"))
    return rows.agg(F.max("lon").alias("lon"), F.max("lat").alias("lat"), F.max("poi_name").alias("name"), F.max("category").alias("amenity"), F.max("cooking_type").alias("cuisine"))


def source_places(spark, d):
    """Places of an extract in a box, by the listed tags."""
    rows = extracts.places(_elements(spark, d), {"amenity": SERVED}, bbox=INNER)
    return rows.select("poi_id", "poi_name", "category", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


def source_listing(spark, d):
    """Open places of a JSON listing in a box."""
    rows = table(spark, d, "df_osm").where("poi_id IS NOT NULL").groupBy("poi_id").agg(F.max("lon").alias("longitude"), F.max("lat").alias("latitude"), F.max(F.col("deleted_at").isNotNull()).alias("permanently_closed"))
    path = Scratch(spark, "listing").path("listing")
    rows.write.mode("overwrite").json(path)
    found = extracts.listed_places(spark, path, INNER, ["poi_id"])
    return found.select("poi_id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


def _questions(spark, d):
    return table(spark, d, "benchmark").where("question_id IS NOT NULL").dropDuplicates(["question_id"])


def stored_questions(spark, d):
    """All questions written as a question set and read back."""
    path = question_sets.save(_questions(spark, d), Scratch(spark, "stored").path("set"), validate=None)
    rows = question_sets.load(spark, path)
    ids = F.array_join(F.col("results_poi_id").cast("array<string>"), ",", "null")
    return rows.select("question_id", "query", "function", F.size("results_poi_id").alias("n_answers"), ids.alias("poi_ids"), F.col("area_geometry").isNotNull().alias("has_area"))


def stored_counts(spark, d):
    """Counts by template in the sidecar of a stored set."""
    path = question_sets.save(_questions(spark, d), Scratch(spark, "counted").path("set"), validate=None)
    _, meta = question_sets.load(spark, path, with_meta=True)
    return spark.createDataFrame([(k, v) for k, v in sorted(meta["questions_by_function"].items())], "function string, n long")


def redrawn_answers(spark, d):
    """Batches with three drawn answers for each question that the corpus can answer."""
    long = semantic.question_places(corpus.pois(table(spark, d, "df_osm")))
    batches = table(spark, d, "batches").where("batch_id IS NOT NULL AND questions IS NOT NULL AND poi_ids IS NOT NULL").dropDuplicates(["batch_id"])
    batches = batches.withColumn("questions", F.transform(F.filter("questions", lambda q: q.isNotNull()), lambda q: F.array_sort(q)))
    rows = semantic.redraw_answers(batches, long, 3)
    return rows.select("batch_id", F.array_join(F.col("poi_ids").cast("array<string>"), ",").alias("poi_ids"))


def violation_examples(spark, d):
    """The first five questions of every check."""
    places = corpus.pois(table(spark, d, "df_osm")).select("poi_id", "poi_name", "category")
    return validate.examples(validate.violations(_questions(spark, d), places), 5)


QUERIES = {
    "source_places": source_places,
    "source_listing": source_listing,
    "stored_questions": stored_questions,
    "stored_counts": stored_counts,
    "redrawn_answers": redrawn_answers,
    "violation_examples": violation_examples,
}

_PROJECT = """exp(-0.7256077650532670 * (ln((1 + sin(phi)) / (1 - sin(phi))) / 2 - 0.0818191910428158 / 2 * ln((1 + 0.0818191910428158 * sin(phi)) / (1 - 0.0818191910428158 * sin(phi))))) * 11754255.426096 AS r,
  0.7256077650532670 * radians(lon - 3.0) AS t"""


def _projected(rows: str) -> str:
    return f"SELECT *, 700000.0 + r * sin(t) AS x, 12655612.049876 - r * cos(t) AS y FROM (SELECT *, {_PROJECT} FROM (SELECT *, radians(lat) AS phi FROM {rows}))"


_W, _S, _E, _N = INNER
_ONE = "b AS (SELECT DISTINCT ON (question_id) * FROM benchmark WHERE question_id IS NOT NULL)"

SQL = {
    "source_places": f"""
WITH e AS (SELECT poi_id, max(lon) AS lon, max(lat) AS lat, max(poi_name) AS poi_name, max(category) AS tag FROM df_osm WHERE poi_id IS NOT NULL GROUP BY poi_id),
p AS ({_projected("e")}), corner AS ({_projected(f"(SELECT * FROM (VALUES ({_W}, {_S}), ({_E}, {_N})) v(lon, lat))")}),
box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM corner)
SELECT poi_id, poi_name, CASE WHEN tag IN ({", ".join(f"'{c}'" for c in SERVED)}) THEN tag ELSE 'unknown' END AS category, round(x, 2) AS x, round(y, 2) AS y
FROM p, box WHERE poi_name IS NOT NULL AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""",
    "source_listing": f"""
WITH e AS (SELECT poi_id, max(lon) AS lon, max(lat) AS lat, bool_or(deleted_at IS NOT NULL) AS closed FROM df_osm WHERE poi_id IS NOT NULL GROUP BY poi_id), p AS ({_projected("e")})
SELECT poi_id, round(x, 2) AS x, round(y, 2) AS y FROM p WHERE NOT closed AND lon BETWEEN {_W} AND {_E} AND lat BETWEEN {_S} AND {_N}""",
    "stored_questions": f"""
WITH {_ONE} SELECT question_id, query, function, coalesce(len(results_poi_id), 0)::INT AS n_answers, coalesce(array_to_string(list_transform(results_poi_id, lambda i: coalesce(i::VARCHAR, 'null')), ','), '') AS poi_ids, area_geometry IS NOT NULL AS has_area FROM b""",
    "stored_counts": f"WITH {_ONE} SELECT function, count(*) AS n FROM b GROUP BY function",
    "redrawn_answers": f"""WITH {POI}, {_FRAGMENTS},
num AS (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY text) AS k, count(*) OVER (PARTITION BY poi_id) AS m FROM frag),
sub AS (SELECT n.poi_id, mask, string_agg(text, '|' ORDER BY text) AS question FROM num n, (SELECT unnest(range(1, 16)) AS mask) WHERE mask < (1 << m) AND (mask >> (k - 1)::INT) & 1 = 1 GROUP BY n.poi_id, mask),
b AS (SELECT DISTINCT ON (batch_id) batch_id, questions, poi_ids FROM batches WHERE batch_id IS NOT NULL AND questions IS NOT NULL AND poi_ids IS NOT NULL),
asked AS (SELECT DISTINCT batch_id, array_to_string(list_sort(q), '|') AS question FROM (SELECT batch_id, unnest(questions) AS q FROM b) WHERE q IS NOT NULL AND len(list_filter(q, lambda f: f IS NULL)) = 0),
met AS (SELECT DISTINCT batch_id, question, poi_id FROM asked JOIN sub USING (question)),
drawn AS (SELECT DISTINCT batch_id, poi_id, 0 AS place FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, question ORDER BY md5('42:' || md5(question) || ':' || poi_id), poi_id) AS k FROM met) WHERE k <= 3),
old AS (SELECT batch_id, poi_id, min(i) AS place FROM (SELECT batch_id, unnest(poi_ids) AS poi_id, unnest(range(1, len(poi_ids) + 1)) AS i FROM b) o WHERE poi_id IS NOT NULL AND NOT EXISTS (FROM met WHERE met.batch_id = o.batch_id AND met.poi_id = o.poi_id) GROUP BY ALL)
SELECT batch_id, string_agg(poi_id::VARCHAR, ',' ORDER BY place, poi_id) AS poi_ids FROM (SELECT * FROM drawn UNION ALL SELECT * FROM old) GROUP BY batch_id""",
    "violation_examples": f"""
SELECT question_id, "check", n FROM (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY question_id) AS k FROM ({ATTRIBUTES["validate_violations"]})) WHERE k <= 5""",
}
