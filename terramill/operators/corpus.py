"""The POI, area and street tables in the form the relations take."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terramill.functions import geometry as G
from terramill.functions.text import blank_to_null, fold_category
from terramill.functions.wkb import RINGS, point_xy


def missing_to_null(column: str):
    """The three spellings of a missing value (null, 'nan', 'None' in any case; also blank) as null."""
    text = blank_to_null(F.col(column))
    return F.when(~F.lower(text).isin("nan", "none"), text)


def pois(df_osm: DataFrame) -> DataFrame:
    """One row per poi_id: name, folded category, attributes without spellings of missing, location (null if there is none)."""
    decoded = df_osm.where("poi_id IS NOT NULL").withColumn("decoded", point_xy("geometry"))
    finite = [F.when(~F.isnan(c) & (F.abs(F.col(c)) < 1e300), F.col(c)) for c in ("x", "y")]
    usable = finite[0].isNotNull() & finite[1].isNotNull() & ~((finite[0] == 0) & (finite[1] == 0))
    at = F.when(F.col("decoded.x").isNotNull() & F.col("decoded.y").isNotNull(), F.col("decoded")).when(usable, F.struct(finite[0].alias("x"), finite[1].alias("y")))
    rows = decoded.select(
        F.col("poi_id").cast("long").alias("poi_id"), "poi_name", F.nullif(fold_category(F.col("category")), F.lit("")).alias("category"),
        *[missing_to_null(c).alias(c) for c in ("cooking_type", "indoor_seating", "outdoor_seating")], at.alias("at"),
    )
    names = ["poi_name", "category", "cooking_type", "indoor_seating", "outdoor_seating"]
    return rows.groupBy("poi_id").agg(*[F.max(c).alias(c) for c in names], F.min("at").alias("at")).select("poi_id", *names, "at.x", "at.y")


def categories(places: DataFrame) -> list[str]:
    """The different categories of ``pois``, each where its smallest poi_id puts it."""
    rows = places.where("category IS NOT NULL").groupBy("category").agg(F.min("poi_id").alias("first")).orderBy("first", "category")
    return [r["category"] for r in rows.collect()]


def areas(df_area: DataFrame) -> DataFrame:
    """One row per area_id with rings: segments, bounds, area in square metres."""
    rows = df_area.where("area_id IS NOT NULL AND rings IS NOT NULL").groupBy(F.col("area_id").cast("long").alias("area_id"))
    rows = rows.agg(F.max("area_name").alias("area_name"), F.max("category").alias("category"), F.max(F.col("rings").cast(RINGS)).alias("rings"))
    rows = rows.withColumn("segments", G.ring_segments(F.col("rings"))).where(F.size("segments") >= 3)
    return rows.withColumn("bounds", G.bounds(F.col("segments"))).withColumn("size", G.area(F.col("rings")))


def streets(df_streets: DataFrame) -> DataFrame:
    """One row per id_street with parts: segments (with the way from the start, ``at``), bounds, length in metres."""
    rows = df_streets.where("id_street IS NOT NULL AND parts IS NOT NULL").groupBy(F.col("id_street").cast("long").alias("id_street"))
    rows = rows.agg(F.max("street_name").alias("street_name"), F.max(F.col("parts").cast(RINGS)).alias("parts"))
    rows = rows.withColumn("segments", G.part_segments(F.col("parts"))).where(F.size("segments") >= 1)
    each = rows.select("id_street", F.posexplode("segments").alias("pos", "g")).select("id_street", "pos", "g.*")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    before = Window.partitionBy("id_street").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("at", F.coalesce(F.sum(F.sqrt(dx * dx + dy * dy)).over(before), F.lit(0.0)))
    segments = each.groupBy("id_street").agg(F.array_sort(F.collect_list(F.struct("pos", "ax", "ay", "bx", "by", "at"))).alias("segments"))
    rows = rows.drop("segments").join(segments, "id_street")
    return rows.withColumn("bounds", G.bounds(F.col("segments"))).withColumn("length", G.length(F.col("segments")))


def questions(benchmark: DataFrame, function: str) -> DataFrame:
    """Each question of a template once, its category folded; without a category it can't be answered."""
    rows = benchmark.where((F.col("function") == function) & F.col("question_id").isNotNull()).dropDuplicates(["question_id"])
    return rows.withColumn("category", F.nullif(fold_category(F.col("category_query")), F.lit(""))).where("category IS NOT NULL")
