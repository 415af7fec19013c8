"""Map extracts to corpus tables: places, areas and streets.

Sources are tables of map elements as any extract tool writes them (Parquet or
JSON lines, one row per element, tags as columns); fetching them from a web
service is left to such tools.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terramill import settings
from terramill.functions import cuisine, features
from terramill.functions import geometry as G
from terramill.functions.wkb import RINGS
from terramill.operators.relations import touching_streets
from terramill.session import Scratch


def bbox_to_lambert(spark: SparkSession, bbox: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """The box (west, south, east, north) spanned by the projected corners."""
    west, south, east, north = bbox
    low, high = spark.range(1).select(G.lambert93(F.lit(west), F.lit(south)).alias("a"), G.lambert93(F.lit(east), F.lit(north)).alias("b")).first()
    return low["x"], low["y"], high["x"], high["y"]


def bbox_to_polygon(bbox: tuple[float, float, float, float]) -> list[list[tuple[float, float]]]:
    """The box (west, south, east, north) as the closed ring of a polygon, counter-clockwise from its south-west corner."""
    west, south, east, north = bbox
    return [[(west, south), (east, south), (east, north), (west, north), (west, south)]]


def in_box(box: tuple[float, float, float, float], x: str = "x", y: str = "y") -> Column:
    return F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3])


def read_elements(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Elements of a Parquet or JSON-lines extract."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path) if path.rstrip("/").endswith(".parquet") else reader.json(path)


def places(elements: DataFrame, tags: dict | None = None, excluded: list[str] | None = None, bbox=None) -> DataFrame:
    """Corpus of places from elements (osm_id, lon, lat, name, tag columns): projected, categorised, with cuisine and text.

    Elements without a name, outside the box or of an excluded category are
    dropped. The key is the element's own id, so it is stable. ``bbox`` is a box
    in degrees or the name of one in ``settings.BOXES``.
    """
    bbox = settings.BOXES[bbox] if isinstance(bbox, str) else bbox
    tags = {c: v for c, v in (tags or settings.CATEGORIES).items() if c in elements.columns}
    rows = elements.where("name IS NOT NULL").withColumn("at", G.lambert93(F.col("lon"), F.col("lat")))
    rows = rows.withColumn("category", features.first_tag(tags)).where(~F.col("category").isin(excluded or settings.EXCLUDED))
    rows = rows.select(F.col("osm_id").cast("long").alias("poi_id"), F.col("name").alias("poi_name"), "category", *[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("cuisine", "indoor_seating", "outdoor_seating")], "lat", "lon", "at.x", "at.y")
    if bbox:
        rows = rows.where(in_box(bbox_to_lambert(elements.sparkSession, bbox)))
    rows = cuisine.classify_cuisine(rows).drop("cuisine_tokens", "cuisine_facets").withColumnRenamed("cuisine", "cooking_type")
    return rows.withColumn("bow_poi", features.serialize([f.column for f in features.FEATURES], rows.columns, address=False))


def element_text(elements: DataFrame, columns: list[str] | None = None, context: str | None = None) -> DataFrame:
    """(osm_id, text) of elements by all their name, category and address tags."""
    text = features.serialize(columns or [f.column for f in features.FEATURES], elements.columns, name_tags=settings.NAME_TAGS, category_tags=settings.CATEGORY_TAGS, context=context)
    return elements.select(F.col("osm_id").cast("long").alias("osm_id"), text.alias("text"))


def listed_places(spark: SparkSession, path: str, bbox, columns: list[str] | None = None) -> DataFrame:
    """Open places of a JSON-lines listing (latitude, longitude, permanently_closed, ...) in a box in degrees, projected."""
    west, south, east, north = bbox
    rows = spark.read.json(path).withColumnsRenamed({"latitude": "lat", "longitude": "lon"})
    rows = rows.where(F.col("lon").between(west, east) & F.col("lat").between(south, north) & ~F.col("permanently_closed"))
    rows = rows.withColumn("at", G.lambert93(F.col("lon"), F.col("lat")))
    return rows.select(*(columns or [c for c in rows.columns if c != "at"]), "at.x", "at.y")


def named_areas(elements: DataFrame, tags: dict | None = None) -> DataFrame:
    """Areas from polygon elements (osm_id, name, admin_level, rings, tag columns): one per name, the least id.

    Administrative levels under 9 are left out; levels that are no number count as none.
    """
    tags = {c: v for c, v in (tags or settings.AREA_TAGS).items() if c in elements.columns}
    level = F.col("admin_level").try_cast("double")
    rows = elements.where("name IS NOT NULL AND rings IS NOT NULL").where(level.isNull() | (level >= 9)).withColumn("category", features.first_tag(tags))
    first = F.row_number().over(Window.partitionBy("name").orderBy("osm_id"))
    rows = rows.withColumn("__rn", first).where("__rn = 1")
    return rows.select(F.col("osm_id").alias("area_id"), F.col("name").alias("area_name"), "category", "admin_level", F.col("rings").cast(RINGS).alias("rings"))


def join_lines(lines: list[np.ndarray]) -> list[np.ndarray]:
    """Lines merged where the ends of exactly two meet."""
    lines = [x for x in lines if len(x) > 1]
    while True:
        ends: dict[tuple, list[int]] = {}
        for i, line in enumerate(lines):
            for end in {tuple(line[0]), tuple(line[-1])}:
                ends.setdefault(end, []).append(i)
        pair = next(((e, ij) for e, ij in sorted(ends.items()) if len(ij) == 2), None)
        if pair is None:
            return lines
        end, (i, j) = pair
        a = lines[i] if tuple(lines[i][-1]) == end else lines[i][::-1]
        b = lines[j] if tuple(lines[j][0]) == end else lines[j][::-1]
        lines = [x for k, x in enumerate(lines) if k not in (i, j)] + [np.vstack([a, b[1:]])]


def connected(vertices: DataFrame, edges: DataFrame, scratch: Scratch, limit: int = 100) -> DataFrame:
    """(id, root): the least vertex of each vertex's component, by taking the least root of all neighbours and jumping to its root, until nothing moves."""
    both = scratch.cut(edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other"))).distinct(), "edges")
    roots = scratch.cut(vertices.select("id", F.col("id").alias("root")), "roots0")
    for turn in range(limit):
        near = both.join(roots.select(F.col("id").alias("other"), "root"), "other").groupBy("id").agg(F.min("root").alias("near"))
        hooked = roots.join(near, "id", "left").select("id", "root", F.least("root", "near").alias("to"))
        ahead = roots.select(F.col("id").alias("to"), F.col("root").alias("far"))
        moved = scratch.cut(hooked.join(ahead, "to").select("id", "root", F.col("far").alias("next")), f"roots{turn + 1}")
        if moved.where("root <> next").isEmpty():
            return moved.select("id", "root")
        roots = moved.select("id", F.col("next").alias("root"))
    raise RuntimeError(f"components still move after {limit} rounds")


def named_streets(elements: DataFrame, tags: dict | None = None, reach: float = 100.0) -> DataFrame:
    """Streets (id_street, street_name, parts) from line elements (osm_id, name, parts, tag columns).

    One row for each name and cluster of its lines: lines at most ``reach``
    apart belong together, as buffers of half that width would touch. Nameless
    lines are dropped. The id is the least element id of the cluster. Lines meet
    in grid cells; a task joins the lines of one cluster.
    """
    tags = {c: v for c, v in (tags or settings.STREETS_TAGS).items() if c in elements.columns}
    scratch = Scratch(elements.sparkSession, "streets")
    rows = elements.where("name IS NOT NULL AND parts IS NOT NULL")
    if tags:
        rows = rows.where(features.first_tag(tags) != "unknown")
    rows = rows.select("name", F.col("osm_id").cast("long").alias("osm_id"), F.posexplode("parts").alias("part", "line")).where(F.size("line") > 1)
    lines = scratch.cut(rows.select(F.monotonically_increasing_id().alias("id"), "*"), "lines")
    segments = F.transform(G.part_segments(F.array("line")), lambda g, i: F.struct(i.alias("pos"), g["ax"].alias("ax"), g["ay"].alias("ay"), g["bx"].alias("bx"), g["by"].alias("by")))
    close = touching_streets(lines.select(F.col("id").alias("id_street"), "name", segments.alias("segments")), reach, ["name"])
    roots = connected(lines, close.select(F.col("street_a").alias("a"), F.col("street_b").alias("b")), scratch)
    flat = lines.join(roots, "id").select("name", "root", "osm_id", "part", F.col("line.x").alias("xs"), F.col("line.y").alias("ys"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["osm_id", "part"])
        merged = join_lines([np.column_stack([x, y]) for x, y in zip(frame["xs"], frame["ys"])])
        return pd.DataFrame([(int(frame["osm_id"].iloc[0]), frame["name"].iloc[0], [x[:, 0].tolist() for x in merged], [x[:, 1].tolist() for x in merged])], columns=["id_street", "street_name", "xs", "ys"])

    built = flat.groupBy("name", "root").applyInPandas(build, "id_street long, street_name string, xs array<array<double>>, ys array<array<double>>")
    point = lambda p, q: F.struct(p.alias("x"), q.alias("y"))
    return built.select("id_street", "street_name", F.zip_with("xs", "ys", lambda a, b: F.zip_with(a, b, point)).alias("parts"))


def storable(rows: DataFrame) -> DataFrame:
    """Columns that Parquet can't hold (void and variant types) as strings."""
    odd = [f.name for f in rows.schema if f.dataType.simpleString() in ("void", "variant", "interval")]
    return rows.withColumns({c: F.col(c).cast("string") for c in odd}) if odd else rows

