"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terramill.llm import bpe, components, mixing, overlap, quota, stable, topn, truncation
from terramill.session import table


def _p2_splits(spark, d):
    return components.group_splits(table(spark, d, "batches"), table(spark, d, "benchmark_config"))


def _quota(operator):
    return lambda spark, d: operator(table(spark, d, "df_osm"), table(spark, d, "benchmark"), table(spark, d, "benchmark_config"))


def _mix(operator):
    return lambda spark, d: operator(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def _p2_kept(spark, d):
    """Of each configuration the batches that have a split, those that have several, and the groups that are in several splits."""
    batches, configs = table(spark, d, "batches"), table(spark, d, "benchmark_config")
    splits = components.group_splits(batches, configs)
    per_batch = splits.groupBy("config_id", "batch_id").agg(F.countDistinct("split").alias("n"), F.min("split").alias("split"))
    groups = per_batch.join(components.linked_groups(batches), "batch_id", "left").groupBy("config_id", F.coalesce("group_id", "batch_id").alias("group_id"))
    groups = groups.agg(F.count("*").alias("n"), F.count_if(F.col("n") > 1).alias("several"), F.countDistinct("split").alias("splits"))
    return groups.groupBy("config_id").agg(F.sum("n").alias("n_batches"), F.sum("several").alias("n_in_several"), F.count_if(F.col("splits") > 1).alias("n_split_groups"))


def _p3_sizes(spark, d):
    """Records drawn for each configuration, and how many of them are repeated or of another category."""
    osm, asked, configs = (table(spark, d, n) for n in ("df_osm", "benchmark", "benchmark_config"))
    drawn = quota.quota_sample(osm, asked, configs)
    known = quota.population(osm, asked).select("population", "id", F.col("category").alias("own")).distinct()
    met = drawn.join(known, ["population", "id"]).groupBy("config_id", "population", "category", "id").agg(F.max((F.col("category") == quota.ALL) | (F.col("own") == F.col("category"))).alias("fits"))
    return met.groupBy("config_id").agg(F.count("*").alias("n_drawn"), F.countDistinct("id").alias("n_ids"), F.count_if(~F.coalesce("fits", F.lit(False))).alias("n_misplaced"))


QUERIES = {
    "p1_found": lambda spark, d: overlap.overlap_found(table(spark, d, "batches")),
    "p1_report": lambda spark, d: overlap.overlap_report(table(spark, d, "batches")),
    "p2_found": lambda spark, d: components.linked_groups(table(spark, d, "batches")),
    "p2_splits": _p2_splits,
    "p2_kept": _p2_kept,
    "p2_report": lambda spark, d: components.split_report(_p2_splits(spark, d), table(spark, d, "benchmark_config")),
    "p3_found": _quota(quota.quota_gaps),
    "p3_sample": _quota(quota.quota_sample),
    "p3_sizes": _p3_sizes,
    "p3_report": _quota(quota.quota_report),
    "p4_found": lambda spark, d: topn.topn_found(table(spark, d, "benchmark")),
    "p6_sample": lambda spark, d: stable.config_samples(table(spark, d, "df_osm"), table(spark, d, "benchmark_config")),
    "p8_ids": lambda spark, d: bpe.encode_documents(table(spark, d, "documents")),
    "p9_mix": _mix(mixing.mix_documents),
    "p9_report": _mix(mixing.mix_report),
    "p9_temperature": _mix(mixing.temperature_report),
    "p9_temperature_mix": _mix(mixing.temperature_documents),
    "p10_found": lambda spark, d: truncation.truncated_found(table(spark, d, "documents")),
    "p10_report": lambda spark, d: truncation.truncation_report(table(spark, d, "documents")),
}

_FOLD = "replace(replace(lower(strip_accents(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'))), ' ', '_'), '-', '_')"

_TEXT = "regexp_extract_all(strip_accents(lower(array_to_string(flatten(list_filter(questions, lambda q: q IS NOT NULL)), ' '))), '[\\p{L}\\p{N}]+')"
_WORDS = f"list_distinct({_TEXT})"

SQL = {
    "p1_found": f"""
WITH b AS (
  SELECT DISTINCT batch_id, nullif(lower(trim(split)), '') AS split, list_sort(list_distinct(poi_ids)) AS pois, list_sort({_WORDS}) AS words
  FROM batches WHERE questions IS NOT NULL AND poi_ids IS NOT NULL
), p AS (SELECT DISTINCT batch_id, split, pois, words, unnest(pois) AS poi FROM b WHERE len(pois) > 0 AND len(words) > 0),
c AS (
  SELECT e.batch_id AS e, t.batch_id AS t, any_value(e.words) AS ew, any_value(t.words) AS tw, count(DISTINCT e.poi) AS common,
         any_value(len(e.pois)) AS en, any_value(len(t.pois)) AS tn
  FROM p e JOIN p t USING (poi) WHERE e.split IN ('validation', 'test') AND t.split = 'train' GROUP BY e.batch_id, t.batch_id
)
SELECT least(e, t) AS batch_id_a, greatest(e, t) AS batch_id_b FROM c
WHERE common >= 0.7 * (en + tn - common) - 1e-9
  AND len(list_intersect(ew, tw)) >= 0.7 * (len(ew) + len(tw) - len(list_intersect(ew, tw))) - 1e-9""",
    "p1_report": f"""
WITH b AS (
  SELECT DISTINCT batch_id, nullif(lower(trim(split)), '') AS split, nullif(lower(trim(source)), '') AS source, list_sort(list_distinct(poi_ids)) AS pois, {_TEXT} AS text
  FROM batches WHERE batch_id IS NOT NULL AND questions IS NOT NULL AND poi_ids IS NOT NULL
), r AS (SELECT *, list_distinct(text) AS words, row_number() OVER () AS n FROM b WHERE len(pois) > 0 AND len(text) > 0),
e AS (SELECT * FROM r WHERE split IN ('validation', 'test')), t AS (SELECT * FROM r WHERE split = 'train'),
ew AS (SELECT n, i, text[i : i + 4] AS passage FROM (SELECT n, text, unnest(range(1, greatest(1, len(text) - 4) + 1)) AS i FROM e)),
tw AS (SELECT DISTINCT text[i : i + k - 1] AS passage FROM (SELECT text, k, unnest(range(1, len(text) - k + 2)) AS i FROM t, (SELECT DISTINCT len(passage) AS k FROM ew) WHERE len(text) >= k)),
c AS (SELECT n, count(DISTINCT j) AS covered FROM (SELECT n, unnest(range(i, i + len(passage))) AS j FROM ew SEMI JOIN tw USING (passage)) GROUP BY n),
g AS (SELECT split, source, batch_id, max(coalesce(covered, 0) / len(text)) AS coverage FROM e LEFT JOIN c USING (n) GROUP BY ALL),
ep AS (SELECT n, unnest(pois) AS poi FROM e), tp AS (SELECT n, unnest(pois) AS poi FROM t),
s AS (SELECT ep.n AS a, tp.n AS b, count(*) AS common FROM ep JOIN tp USING (poi) GROUP BY ALL),
o AS (SELECT e.split, e.source, e.batch_id, t.batch_id AS train_id, common / (len(e.pois) + len(t.pois) - common) AS p,
             len(list_intersect(e.words, t.words)) / (len(e.words) + len(t.words) - len(list_intersect(e.words, t.words))) AS w
      FROM s JOIN e ON e.n = a JOIN t ON t.n = b WHERE e.batch_id <> t.batch_id),
h AS (SELECT split, source, batch_id, train_id, max(least(p, w)) AS best FROM o WHERE p >= 0.7 - 1e-12 AND w >= 0.7 - 1e-12 GROUP BY ALL),
k AS (SELECT split, source, batch_id, count(*) AS n_pairs, max(best) AS best FROM h GROUP BY ALL)
SELECT g.split, g.source, count(*) AS n_batches, count(k.batch_id) AS n_overlapping, count(*) FILTER (best >= 1) AS n_exact, coalesce(sum(n_pairs), 0)::BIGINT AS n_pairs, round(avg(coverage), 6) AS mean_coverage
FROM g LEFT JOIN k ON g.batch_id = k.batch_id AND g.split = k.split AND g.source IS NOT DISTINCT FROM k.source GROUP BY g.split, g.source""",
    "p2_kept": """
SELECT DISTINCT config_id, (SELECT count(DISTINCT batch_id) FROM batches) AS n_batches, 0::BIGINT AS n_in_several, 0::BIGINT AS n_split_groups FROM benchmark_config WHERE config_id IS NOT NULL""",
    "p2_found": """
WITH RECURSIVE k AS (
  SELECT DISTINCT batch_id, 'p' || p AS key FROM (SELECT batch_id, unnest(poi_ids) AS p FROM batches) WHERE p IS NOT NULL
  UNION SELECT batch_id, 'a' || lower(trim(author)) FROM batches WHERE trim(author) <> ''
), h AS (SELECT key, min(batch_id) AS hub FROM k GROUP BY key),
e AS (SELECT DISTINCT hub AS u, batch_id AS v FROM k JOIN h USING (key) WHERE hub <> batch_id),
both_ways AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT u AS batch_id, u AS other FROM both_ways UNION SELECT r.batch_id, b.v FROM reach r JOIN both_ways b ON r.other = b.u)
SELECT batch_id, min(other) AS group_id FROM reach GROUP BY batch_id""",
    "p3_found": f"""
WITH s AS (
  SELECT config_id, population, sample_size, min_per_category, unnest(map_entries(ratio_category)) AS e FROM benchmark_config
), f AS (
  SELECT config_id, population, sample_size, min_per_category, {_FOLD.format("e.key")} AS category, sum(e.value) AS share
  FROM s WHERE e.value > 0 GROUP BY ALL
), n AS (
  SELECT 'df_osm' AS population, {_FOLD.format("category")} AS category, count(DISTINCT poi_id) AS n FROM df_osm GROUP BY ALL
  UNION ALL
  SELECT 'benchmark', {_FOLD.format("category_query")}, count(DISTINCT question_id) FROM benchmark GROUP BY ALL
)
SELECT config_id, category FROM f LEFT JOIN n USING (population, category)
WHERE coalesce(n, 0) < greatest(floor(share * sample_size + 0.5 + 1e-9), min_per_category)""",
    # every floor that can be kept, and the whole size wherever there are as many records
    "p3_sizes": f"""
WITH c AS (SELECT DISTINCT config_id, population, coalesce(sample_size, 0) AS size, coalesce(min_per_category, 0) AS least, ratio_category FROM benchmark_config),
r AS (
  SELECT 'df_osm' AS population, {_FOLD.format("category")} AS category, poi_id AS id FROM df_osm WHERE poi_id IS NOT NULL
  UNION SELECT 'benchmark', {_FOLD.format("category_query")}, question_id FROM benchmark WHERE question_id IS NOT NULL
), n AS (SELECT population, category, count(DISTINCT id) AS n FROM r GROUP BY ALL UNION ALL SELECT population, '*', count(DISTINCT id) FROM r WHERE category IS NOT NULL GROUP BY ALL),
f AS (
  SELECT DISTINCT config_id, population, size, least, {_FOLD.format("e.key")} AS category FROM (SELECT config_id, population, size, least, unnest(map_entries(ratio_category)) AS e FROM c) WHERE e.value > 0
  UNION ALL SELECT config_id, population, size, 0, '*' FROM c WHERE ratio_category IS NULL OR cardinality(ratio_category) = 0
), t AS (SELECT config_id, any_value(size) AS size, sum(coalesce(n, 0)) AS there, sum(least(coalesce(n, 0), least)) AS floors FROM f LEFT JOIN n USING (population, category) GROUP BY config_id)
SELECT config_id, greatest(floors, least(size, there))::BIGINT AS n_drawn, greatest(floors, least(size, there))::BIGINT AS n_ids, 0::BIGINT AS n_misplaced FROM t WHERE greatest(floors, least(size, there)) > 0""",
    "p4_found": f"""
WITH e AS (
  SELECT {_FOLD.format("category_query")} AS category_query, anchor_index, unnest(results_poi_id) AS poi_id,
         unnest(list_resize(results_poi_dist, len(results_poi_id))) AS dist, unnest(list_resize(results_poi_rank, len(results_poi_id))) AS rnk
  FROM benchmark WHERE category_query IS NOT NULL AND anchor_index IS NOT NULL AND results_poi_dist IS NOT NULL AND len(results_poi_id) > 0
), g AS (
  SELECT category_query, anchor_index, poi_id, dist, coalesce(rnk, 2147483647) AS rnk FROM e
  WHERE poi_id IS NOT NULL AND dist IS NOT NULL AND NOT isnan(dist) AND dist >= 0
), u AS (
  SELECT *, row_number() OVER (PARTITION BY category_query, anchor_index, poi_id ORDER BY dist, rnk) AS k FROM g
), r AS (
  SELECT *, row_number() OVER (PARTITION BY category_query, anchor_index ORDER BY dist, rnk, poi_id) AS place FROM u WHERE k = 1
)
SELECT category_query, anchor_index, poi_id FROM r WHERE place <= 5""",
    "p6_sample": f"""
WITH s AS (
  SELECT poi_id, loaded_at, coalesce(nullif({_FOLD.format("category")}, ''), '(none)') AS stratum FROM df_osm WHERE poi_id IS NOT NULL
), f AS (
  SELECT poi_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY loaded_at NULLS LAST, stratum) AS k FROM s) WHERE k = 1
), c AS (
  SELECT DISTINCT config_id, coalesce(seed, 0) AS seed, round(least(1, greatest(0, coalesce(ratio_test, 0))) * 4294967296) AS bound FROM benchmark_config
)
SELECT config_id, stratum, poi_id FROM f, c
WHERE ('0x' || substr(md5(seed || ':' || poi_id), 1, 8))::BIGINT < bound""",
}
