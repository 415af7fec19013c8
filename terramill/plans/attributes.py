"""Queries of cleaning, sampling, attribute questions, validation and generators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terramill.functions import cuisine, features
from terramill.functions import geometry as G
from terramill.operators import corpus, sampling, semantic, validate
from terramill.plans.spatial import ASKED, FOLD, POI
from terramill.session import Scratch, table


def _places(spark, d):
    return corpus.pois(table(spark, d, "df_osm"))


def _raw(spark, d):
    return table(spark, d, "df_osm").where("poi_id IS NOT NULL").groupBy("poi_id").agg(F.max("cooking_type").alias("cuisine"))


def cuisine_tokens(spark, d):
    tokens = F.posexplode(cuisine.split_tags(F.col("cuisine"))).alias("pos", "token")
    return _raw(spark, d).select("poi_id", tokens).withColumn("facet", cuisine.facet_of(F.col("token")))


def cuisine_pick(spark, d):
    return cuisine.classify_cuisine(_raw(spark, d)).select("poi_id", "cuisine", F.size("cuisine_facets").alias("n_facets"))


def bow_serialize(spark, d):
    rows = _places(spark, d)
    return rows.select("poi_id", features.serialize([f.column for f in features.FEATURES], rows.columns, address=False).alias("bow"))


def feature_fragments(spark, d):
    return _places(spark, d).select("poi_id", F.explode(features.fragments()).alias("f")).select("poi_id", "f.text", "f.name", "f.value")


def lambert(spark, d):
    rows = table(spark, d, "df_osm").where("lon IS NOT NULL AND lat IS NOT NULL").groupBy("poi_id").agg(F.max("lon").alias("lon"), F.max("lat").alias("lat"))
    return rows.select("poi_id", G.lambert93(F.col("lon"), F.col("lat")).alias("p")).select("poi_id", F.round("p.x", 2).alias("x"), F.round("p.y", 2).alias("y"))


def allocation(spark, d):
    """10,000 questions over the categories in proportion to their places."""
    weights = _places(spark, d).where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))
    return sampling.allocate_table(weights, 10_000, "category", "n")


def train_test_split(spark, d):
    ids = table(spark, d, "benchmark").where("question_id IS NOT NULL").select("question_id").distinct()
    return sampling.exact_split(ids, "question_id", 0.1)


SHARES = {"restaurant": 0.4, "cafe": 0.3, "bar": 0.2, "library": 0.1}


def stratified(spark, d):
    return sampling.stratify(_places(spark, d).select("poi_id", "category"), "category", SHARES, "poi_id")


def semantic_questions(spark, d):
    rows = semantic.questions(_places(spark, d))
    return rows.select(F.array_join("question", "|").alias("question"), "nb_feature", "nb_answer", "first_poi")


def hard_negatives(spark, d):
    """Hard negatives of every question: how many, the first and the last; one of a single attribute has all places that don't match it."""
    scratch = Scratch(spark, "hard")
    places = scratch.cut(_places(spark, d), "places")
    long = scratch.cut(semantic.question_places(places).select("question_id", "poi_id"), "long")
    asked = scratch.cut(semantic.questions(places), "asked")
    found = semantic.hard_negatives(asked, long, places)
    return found.join(asked.select("question_id", F.array_join("question", "|").alias("question")), "question_id").select("question", "n_hard", "first_poi", "last_poi")


def train_test_sets(spark, d):
    """Questions of the training and test sets with their positives and hard negatives: how many, and the first positive."""
    places = Scratch(spark, "sets").cut(_places(spark, d), "places")
    rows = semantic.train_test(places)
    return rows.groupBy("question_id", "is_test", "kind").agg(F.count("*").alias("n_rows"), F.min(F.when(F.col("kind") == "positive", F.col("poi_id"))).alias("first_positive"))


def attribute_groups(spark, d):
    rows = _places(spark, d).withColumn("rank", F.col("poi_id"))
    out = semantic.attribute_groups(rows, ["category", "cooking_type", "outdoor_seating", "indoor_seating"], 2, lists=False)
    return out.select(F.array_join("features", "|").alias("features"), F.array_join("values", "|").alias("values"), "size", "first_poi")


def _answers(spark, d):
    asked = table(spark, d, "benchmark").where("question_id IS NOT NULL AND results_poi_id IS NOT NULL AND category_query IS NOT NULL AND query IS NOT NULL").dropDuplicates(["question_id"])
    ranked = asked.select("question_id", F.posexplode("results_poi_id").alias("rank", "poi_id")).where("poi_id IS NOT NULL")
    answers = ranked.join(_places(spark, d).select("poi_id", "cooking_type", "outdoor_seating", "indoor_seating"), "poi_id")
    return asked.select("question_id", "query", "category_query"), answers


def composite(spark, d):
    """Every question narrowed by at most two groups of one and one group of two attributes of its answers."""
    asked, answers = _answers(spark, d)
    rows = semantic.composite(asked, answers, ["cooking_type", "outdoor_seating", "indoor_seating"], {1: 2, 2: 1})
    return rows.select("question_id", "query", "n", "size", F.array_join("features", "|").alias("features"), F.array_join("values", "|").alias("values"), F.array_join(F.col("poi_ids").cast("array<string>"), ",").alias("poi_ids"))


def validate_violations(spark, d):
    rows = table(spark, d, "benchmark").where("question_id IS NOT NULL").dropDuplicates(["question_id"])
    return validate.violations(rows, _places(spark, d).select("poi_id", "poi_name", "category"))


def answer_stats(spark, d):
    return validate.answer_stats(table(spark, d, "benchmark").where("question_id IS NOT NULL").dropDuplicates(["question_id"]))


def function_frequencies(spark, d):
    return validate.frequencies(table(spark, d, "benchmark").where("question_id IS NOT NULL").dropDuplicates(["question_id"]), "function")


def direction_correlation(spark, d):
    """Of every directional area question, how well its ranking follows the coordinate."""
    rows = corpus.questions(table(spark, d, "benchmark"), "area_direction").where(F.col("direction").isin(list(G.CARDINAL)))
    ranked = rows.select("question_id", "direction", F.posexplode("results_poi_id").alias("rank", "poi_id")).where("poi_id IS NOT NULL")
    at = ranked.join(_places(spark, d).where("x IS NOT NULL").select("poi_id", "x", "y"), "poi_id")
    signed = F.when(F.col("direction") == "north", F.col("y")).when(F.col("direction") == "south", -F.col("y")).when(F.col("direction") == "east", F.col("x")).otherwise(-F.col("x"))
    out = validate.direction_correlation(at.withColumn("coordinate", signed), ["question_id"])
    return out.select("question_id", "n", F.round("rho", 6).alias("rho"))


QUERIES = {
    "cuisine_tokens": cuisine_tokens,
    "cuisine_pick": cuisine_pick,
    "cuisine_unknown_report": lambda spark, d: cuisine.unknown_report(_raw(spark, d)),
    "cuisine_coverage": lambda spark, d: cuisine.coverage_report(_raw(spark, d)),
    "cuisine_closest": lambda spark, d: cuisine.closest_known(cuisine.unknown_report(_raw(spark, d))),
    "bow_serialize": bow_serialize,
    "feature_fragments": feature_fragments,
    "lambert93": lambert,
    "allocate": allocation,
    "train_test_split": train_test_split,
    "stratify": stratified,
    "semantic_questions": semantic_questions,
    "hard_negatives": hard_negatives,
    "train_test_sets": train_test_sets,
    "attr_groups": attribute_groups,
    "composite": composite,
    "validate_violations": validate_violations,
    "answer_stats": answer_stats,
    "function_frequencies": function_frequencies,
    "spearman_direction": direction_correlation,
}


def _strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _sql_map(entries: dict[str, str]) -> str:
    return f"MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in entries.items())}}}"


_FACET = "CASE " + " ".join(f"WHEN {{0}} IN ({_strings(tokens)}) THEN '{name}'" for name, tokens in cuisine.FACETS.items()) + " ELSE 'unknown' END"
_NORMAL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(regexp_replace(p, '^\\s+|\\s+$', '', 'g'))), '[\\s-]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"
_CUT = f"regexp_replace(t0, '^(.+?)(?:{'|'.join(cuisine.SUFFIXES)})$', '\\1')"
TOKENS = f"""
raw_c AS (SELECT poi_id, max(cooking_type) AS c FROM df_osm WHERE poi_id IS NOT NULL GROUP BY poi_id),
bits AS (SELECT poi_id, unnest(regexp_split_to_array(c, '{cuisine.SEPARATORS}')) AS p, unnest(range(len(regexp_split_to_array(c, '{cuisine.SEPARATORS}')))) AS i FROM raw_c WHERE c IS NOT NULL),
norm AS (SELECT poi_id, i, coalesce({_sql_map(cuisine.SYNONYMS)}[t1], t1) AS token FROM (SELECT *, {_CUT} AS t1 FROM (SELECT *, {_NORMAL} AS t0 FROM bits))),
tok AS (SELECT poi_id, (row_number() OVER (PARTITION BY poi_id ORDER BY i) - 1)::INT AS pos, token, {_FACET.format("token")} AS facet
        FROM (SELECT poi_id, token, min(i) AS i FROM norm WHERE token <> '' GROUP BY ALL))"""

_FRAGMENTS = """
frag AS (
  SELECT poi_id, 'category ' || category AS text, 'category' AS name, category AS value FROM poi WHERE category IS NOT NULL
  UNION ALL SELECT poi_id, 'cooking_type ' || cooking_type, 'cooking_type', cooking_type FROM poi WHERE cooking_type IS NOT NULL
  UNION ALL SELECT poi_id, CASE outdoor_seating WHEN 'yes' THEN 'with outdoor seating' ELSE 'without outdoor seating' END, 'outdoor_seating', outdoor_seating FROM poi WHERE outdoor_seating IN ('yes', 'no')
  UNION ALL SELECT poi_id, CASE indoor_seating WHEN 'yes' THEN 'with indoor seating' ELSE 'without indoor seating' END, 'indoor_seating', indoor_seating FROM poi WHERE indoor_seating IN ('yes', 'no')
)"""

_QUESTIONS = """
num AS (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY text) AS k, count(*) OVER (PARTITION BY poi_id) AS m FROM frag),
sub AS (
  SELECT n.poi_id, mask, string_agg(text, '|' ORDER BY text) AS question, count(*)::INT AS nb_feature, list(name || '=' || value) AS pairs
  FROM num n, (SELECT unnest(range(1, 16)) AS mask) WHERE mask < (1 << m) AND (mask >> (k - 1)::INT) & 1 = 1 GROUP BY n.poi_id, mask
),
ask AS (SELECT question, nb_feature, count(*) AS nb_answer, min(poi_id) AS first_poi, any_value(pairs) AS pairs FROM sub GROUP BY question, nb_feature)"""

_HARD = """
have AS (
  SELECT poi_id, 'category=' || category AS pair FROM poi WHERE category IS NOT NULL UNION ALL SELECT poi_id, 'cooking_type=' || cooking_type FROM poi WHERE cooking_type IS NOT NULL
  UNION ALL SELECT poi_id, 'outdoor_seating=' || outdoor_seating FROM poi WHERE outdoor_seating IS NOT NULL UNION ALL SELECT poi_id, 'indoor_seating=' || indoor_seating FROM poi WHERE indoor_seating IS NOT NULL
),
want AS (SELECT question, nb_feature AS n, unnest(pairs) AS pair FROM ask),
met AS (SELECT question, n, poi_id, count(*) AS m FROM want JOIN have USING (pair) GROUP BY ALL),
hard AS (
  SELECT question, count(*) AS n_hard, min(poi_id) AS first_poi, max(poi_id) AS last_poi FROM met WHERE m = n - 1 AND n > 1 GROUP BY question
  UNION ALL SELECT question, count(*), min(poi_id), max(poi_id) FROM (SELECT question FROM ask WHERE nb_feature = 1) CROSS JOIN (SELECT DISTINCT poi_id FROM poi) ANTI JOIN met USING (question, poi_id) GROUP BY question
)"""

_CLEAN = "nullif(regexp_replace(regexp_replace({0}, '[_;\\s]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '')"

_ONE = "b AS (SELECT DISTINCT ON (question_id) * FROM benchmark WHERE question_id IS NOT NULL)"

SQL = {
    "cuisine_tokens": f"WITH {TOKENS} SELECT poi_id, pos, token, facet FROM tok",
    "cuisine_pick": f"""WITH {TOKENS},
best AS (SELECT poi_id, arg_min(token, CASE facet WHEN 'regional' THEN 0 ELSE 1000000 END + pos) AS token FROM tok WHERE facet IN ('regional', 'dish') GROUP BY poi_id),
n AS (SELECT poi_id, count(DISTINCT facet) AS n FROM tok GROUP BY poi_id)
SELECT poi_id, replace(token, '_', '') AS cuisine, coalesce(n, 0)::INT AS n_facets FROM raw_c LEFT JOIN best USING (poi_id) LEFT JOIN n USING (poi_id)""",
    "cuisine_unknown_report": f"WITH {TOKENS} SELECT token, count(*) AS count FROM tok WHERE facet = 'unknown' GROUP BY token",
    "cuisine_coverage": f"""WITH {TOKENS}, hit AS (SELECT DISTINCT poi_id FROM tok WHERE facet IN ('regional', 'dish'))
SELECT count(*) AS n_pois, count(h.poi_id) AS with_cuisine, count(*) - count(h.poi_id) AS without_cuisine, round(count(h.poi_id) / count(*), 3) AS coverage
FROM raw_c LEFT JOIN hit h USING (poi_id)""",
    "bow_serialize": f"""WITH {POI}, c AS (
  SELECT poi_id, {_CLEAN.format("category")} AS a, {_CLEAN.format("cooking_type")} AS b, {_CLEAN.format("outdoor_seating")} AS o, {_CLEAN.format("indoor_seating")} AS i FROM poi
)
SELECT poi_id, lower(array_to_string(list_filter([
  CASE WHEN a = 'yes' THEN 'category' WHEN a <> 'no' THEN a END, CASE WHEN b = 'yes' THEN 'cooking type' WHEN b <> 'no' AND b IS DISTINCT FROM a THEN b END,
  CASE WHEN o = 'yes' THEN 'outdoor seating' WHEN o <> 'no' AND o IS DISTINCT FROM a AND o IS DISTINCT FROM b THEN o END,
  CASE WHEN i = 'yes' THEN 'indoor seating' WHEN i <> 'no' AND i IS DISTINCT FROM a AND i IS DISTINCT FROM b AND i IS DISTINCT FROM o THEN i END], lambda v: v IS NOT NULL), ' ')) AS bow FROM c""",
    "feature_fragments": f"WITH {POI}, {_FRAGMENTS} SELECT poi_id, text, name, value FROM frag",
    "lambert93": """
WITH p AS (SELECT poi_id, max(lon) AS lon, radians(max(lat)) AS phi FROM df_osm WHERE lon IS NOT NULL AND lat IS NOT NULL GROUP BY poi_id),
q AS (SELECT *, exp(-0.7256077650532670 * (ln((1 + sin(phi)) / (1 - sin(phi))) / 2 - 0.0818191910428158 / 2 * ln((1 + 0.0818191910428158 * sin(phi)) / (1 - 0.0818191910428158 * sin(phi))))) * 11754255.426096 AS r,
      0.7256077650532670 * radians(lon - 3.0) AS t FROM p)
SELECT poi_id, round(700000.0 + r * sin(t), 2) AS x, round(12655612.049876 - r * cos(t), 2) AS y FROM q""",
    "allocate": f"""WITH {POI}, w AS (SELECT category, count(*) AS n FROM poi WHERE category IS NOT NULL GROUP BY category),
e AS (SELECT category, 10000.0::DOUBLE * n / sum(n) OVER () AS exact FROM w),
f AS (SELECT *, floor(exact) AS low, row_number() OVER (ORDER BY exact - floor(exact) DESC, category) AS place FROM e)
SELECT category, (low + CASE WHEN place <= 10000 - sum(low) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM f""",
    "train_test_split": """
WITH q AS (SELECT DISTINCT question_id FROM benchmark WHERE question_id IS NOT NULL)
SELECT question_id, row_number() OVER (ORDER BY md5('42:' || question_id), question_id) <= floor(count(*) OVER () * 0.1) AS is_test FROM q""",
    "stratify": f"""WITH {POI}, s AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in SHARES.items())}) t(category, share)),
n AS (SELECT category, share, count(poi_id) AS n FROM s LEFT JOIN poi USING (category) GROUP BY ALL),
t AS (SELECT min(n / share) AS total FROM n),
r AS (SELECT poi_id, category, share, row_number() OVER (PARTITION BY category ORDER BY md5('42:' || poi_id), poi_id) AS k FROM poi JOIN s USING (category))
SELECT poi_id, category FROM r, t WHERE k <= floor(total * share + 1e-9)""",
    "semantic_questions": f"WITH {POI}, {_FRAGMENTS}, {_QUESTIONS} SELECT question, nb_feature, nb_answer, first_poi FROM ask",
    "hard_negatives": f"""WITH {POI}, {_FRAGMENTS}, {_QUESTIONS}, {_HARD}
SELECT question, n_hard, first_poi, last_poi FROM hard""",
    "train_test_sets": f"""WITH {POI}, {_FRAGMENTS}, {_QUESTIONS}, {_HARD},
split AS (SELECT question, md5(question) AS question_id, nb_answer, first_poi, row_number() OVER (ORDER BY md5('42:' || md5(question)), md5(question)) <= floor(count(*) OVER () * 0.1) AS is_test FROM ask)
SELECT question_id, is_test, 'positive' AS kind, nb_answer AS n_rows, first_poi AS first_positive FROM split
UNION ALL SELECT question_id, false, 'hard', least(20, n_hard), NULL FROM split JOIN hard USING (question) WHERE NOT is_test""",
    "spearman_direction": f"""WITH {POI}, q AS (
  SELECT DISTINCT ON (question_id) question_id, direction, results_poi_id FROM benchmark
  WHERE question_id IS NOT NULL AND function = 'area_direction' AND direction IN ('north', 'south', 'east', 'west') AND nullif({FOLD.format("category_query")}, '') IS NOT NULL
), r AS (SELECT question_id, direction, unnest(results_poi_id) AS poi_id, unnest(range(len(results_poi_id))) AS rank FROM q),
c AS (SELECT question_id, -rank AS a, CASE direction WHEN 'north' THEN y WHEN 'south' THEN -y WHEN 'east' THEN x ELSE -x END AS b FROM r JOIN poi USING (poi_id) WHERE x IS NOT NULL),
k AS (
  SELECT question_id, rank() OVER (PARTITION BY question_id ORDER BY a) + (count(*) OVER (PARTITION BY question_id, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY question_id ORDER BY b) + (count(*) OVER (PARTITION BY question_id, b) - 1) / 2 AS rb FROM c
), v AS (
  SELECT question_id, count(*) AS n, sum((ra - ma) * (rb - mb)) AS sab, sum((ra - ma) * (ra - ma)) AS saa, sum((rb - mb) * (rb - mb)) AS sbb
  FROM (SELECT *, avg(ra) OVER (PARTITION BY question_id) AS ma, avg(rb) OVER (PARTITION BY question_id) AS mb FROM k) GROUP BY question_id
)
SELECT question_id, n, round(CASE WHEN saa > 0 AND sbb > 0 THEN sab / sqrt(saa * sbb) END, 6) AS rho FROM v""",
    "attr_groups": f"""WITH {POI}, v AS (
  SELECT poi_id, 'category' AS f, 1 AS o, category AS v FROM poi UNION ALL SELECT poi_id, 'cooking_type', 2, cooking_type FROM poi
  UNION ALL SELECT poi_id, 'outdoor_seating', 3, outdoor_seating FROM poi UNION ALL SELECT poi_id, 'indoor_seating', 4, indoor_seating FROM poi
)
SELECT a.f || '|' || b.f AS features, a.v || '|' || b.v AS values, count(*) AS size, min(a.poi_id) AS first_poi
FROM v a JOIN v b ON a.poi_id = b.poi_id AND a.o < b.o WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL""",
    "composite": f"""WITH {POI}, b AS (
  SELECT DISTINCT ON (question_id) question_id, query, category_query, results_poi_id FROM benchmark
  WHERE question_id IS NOT NULL AND results_poi_id IS NOT NULL AND category_query IS NOT NULL AND query IS NOT NULL
), a AS (
  SELECT question_id, rank, poi_id, cooking_type AS c1, outdoor_seating AS c2, indoor_seating AS c3
  FROM (SELECT question_id, unnest(results_poi_id) AS poi_id, unnest(range(len(results_poi_id))) AS rank FROM b) JOIN poi USING (poi_id)
), g AS (
  SELECT question_id, rank, poi_id, 1 AS n, 'cooking_type' AS features, c1 AS values, ' cooking_type=' || c1 AS added FROM a WHERE c1 IS NOT NULL
  UNION ALL SELECT question_id, rank, poi_id, 1, 'outdoor_seating', c2, ' outdoor_seating=' || c2 FROM a WHERE c2 IS NOT NULL
  UNION ALL SELECT question_id, rank, poi_id, 1, 'indoor_seating', c3, ' indoor_seating=' || c3 FROM a WHERE c3 IS NOT NULL
  UNION ALL SELECT question_id, rank, poi_id, 2, 'cooking_type|outdoor_seating', c1 || '|' || c2, ' cooking_type=' || c1 || ' outdoor_seating=' || c2 FROM a WHERE c1 IS NOT NULL AND c2 IS NOT NULL
  UNION ALL SELECT question_id, rank, poi_id, 2, 'cooking_type|indoor_seating', c1 || '|' || c3, ' cooking_type=' || c1 || ' indoor_seating=' || c3 FROM a WHERE c1 IS NOT NULL AND c3 IS NOT NULL
  UNION ALL SELECT question_id, rank, poi_id, 2, 'outdoor_seating|indoor_seating', c2 || '|' || c3, ' outdoor_seating=' || c2 || ' indoor_seating=' || c3 FROM a WHERE c2 IS NOT NULL AND c3 IS NOT NULL
), h AS (
  SELECT question_id, n, features, values, added, count(*) AS size, string_agg(poi_id::VARCHAR, ',' ORDER BY rank) AS poi_ids FROM g GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY question_id, n ORDER BY md5('42:' || question_id || ':' || features || '|' || values), features || '|' || values) AS k FROM h
)
SELECT question_id, category_query || added || substr(query, length(category_query) + 1) AS query, n, size, features, values, poi_ids
FROM r JOIN b USING (question_id) WHERE k <= CASE n WHEN 1 THEN 2 ELSE 1 END""",
    "answer_stats": f"""WITH {_ONE}, s AS (SELECT coalesce(len(results_poi_id), 0)::INT AS n FROM b)
SELECT count(*) AS n_questions, min(n) AS min, max(n) AS max, round(avg(n), 2) AS mean, quantile_cont(n::DOUBLE, 0.5) AS median, count(*) FILTER (n = 0) AS empty FROM s""",
    "function_frequencies": f"WITH {_ONE} SELECT function AS value, count(*) AS n FROM b GROUP BY function",
    "validate_violations": f"""WITH {POI}, {_ONE}, s AS (
  SELECT *, coalesce(results_poi_id, []) AS ids, coalesce(len(results_poi_id), 0) AS n FROM b
), t AS (
  SELECT *, n > 0 AND coalesce(len(results_poi_name), 0) = n AND coalesce(len(results_poi_dist), 0) = n AND coalesce(len(results_poi_rank), 0) = n AS usable,
         len(list_filter(results_poi_dist, lambda v: v IS NULL OR isnan(v) OR isinf(v))) > 0 AS broken, len(list_filter(results_poi_dist, lambda v: v < 0)) > 0 AS negative FROM s
), a AS (
  SELECT question_id, category_query, unnest(ids) AS poi_id, unnest(results_poi_name) AS name FROM t WHERE usable
), l AS (
  SELECT question_id, count(*) FILTER (p.poi_id IS NULL) AS unknown, count(*) FILTER (p.poi_id IS NOT NULL AND name IS DISTINCT FROM p.poi_name) AS wrong_name,
         count(*) FILTER (p.poi_id IS NOT NULL AND category_query IS DISTINCT FROM p.category) AS wrong_category
  FROM a LEFT JOIN poi p ON a.poi_id = p.poi_id GROUP BY question_id
)
SELECT question_id, 'empty_answer' AS check, 1::BIGINT AS n FROM t WHERE n = 0
UNION ALL SELECT question_id, 'not_parallel', 1 FROM t WHERE n > 0 AND NOT usable
UNION ALL SELECT question_id, 'duplicate_ids', 1 FROM t WHERE usable AND (SELECT count(DISTINCT coalesce(i, -1)) FROM (SELECT unnest(ids) AS i)) <> n
UNION ALL SELECT question_id, 'bad_rank', 1 FROM t WHERE usable AND NOT coalesce(results_poi_rank = list_transform(range(1, n + 1), lambda i: i::INT), false)
UNION ALL SELECT question_id, 'bad_distance', 1 FROM t WHERE usable AND broken
UNION ALL SELECT question_id, 'negative_distance', 1 FROM t WHERE usable AND NOT broken AND negative
UNION ALL SELECT question_id, 'falling_distance', 1 FROM t WHERE usable AND NOT broken AND NOT negative AND results_poi_dist <> list_sort(results_poi_dist)
UNION ALL SELECT question_id, 'anchor_index_in_answer', 1 FROM t WHERE usable AND list_contains(ids, anchor_index)
UNION ALL SELECT question_id, 'point_b_index_in_answer', 1 FROM t WHERE usable AND list_contains(ids, point_b_index)
UNION ALL SELECT question_id, 'blank_query', 1 FROM t WHERE usable AND (query IS NULL OR trim(query) = '')
UNION ALL SELECT question_id, 'query_without_category', 1 FROM t WHERE usable AND NOT (query IS NULL OR trim(query) = '') AND NOT coalesce(contains(query, category_query), false)
UNION ALL SELECT question_id, 'unknown_poi', unknown FROM l WHERE unknown > 0
UNION ALL SELECT question_id, 'wrong_name', wrong_name FROM l WHERE unknown = 0 AND wrong_name > 0
UNION ALL SELECT question_id, 'wrong_category', wrong_category FROM l WHERE unknown = 0 AND wrong_category > 0""",
}
