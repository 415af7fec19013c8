"""Points near other points, and the regions that contain points.

Regions are triangulated by ear clipping; the triangles are sorted along a
space-filling curve into leaves of a bounding-volume hierarchy whose levels
are tables. Points descend level by level through equi-joins on the node, so
that no level must fit into memory: levels are written tables, and the planner
broadcasts those below its size threshold. Only the topmost boxes, whose number
is bounded by the number of partitions of the build, are held by the driver.

Near points meet in grid cells as wide as the distance. Cells with many points
are salted by their real counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terramill.functions.wkb import RINGS, point_xy
from terramill.operators.triangulate import even_odd, triangulate
from terramill.session import Scratch, parallelism

#: Triangles in a leaf and children of a node, both powers of two.
LEAF, FAN = 32, 32
#: Topmost boxes at most, so many partitions may build the hierarchy.
TOP = 256
#: Points in a cell from which the cell is split.
CELL_LIMIT = 4096


def located(df_osm: DataFrame) -> DataFrame:
    """(poi_id, x, y) of every POI that has a location, once per poi_id.

    The location is the geometry where it decodes to a point, else (x, y)
    where both are numbers and not both 0. A poi_id whose rows disagree has
    the least location.
    """
    finite = [F.when(~F.isnan(c) & (F.abs(F.col(c)) < 1e300), F.col(c)) for c in ("x", "y")]
    fallback = finite[0].isNotNull() & finite[1].isNotNull() & ~((finite[0] == 0) & (finite[1] == 0))
    rows = df_osm.where("poi_id IS NOT NULL").select(
        F.col("poi_id").cast("long").alias("poi_id"),
        F.when(fallback, F.struct(finite[0].alias("x"), finite[1].alias("y"))).alias("fallback"),
        point_xy("geometry").alias("decoded"),
    )
    rows = rows.select("poi_id", F.when(F.col("decoded.x").isNotNull() & F.col("decoded.y").isNotNull(), F.col("decoded")).otherwise(F.col("fallback")).alias("at"))
    return rows.where("at IS NOT NULL").groupBy("poi_id").agg(F.min("at").alias("at")).select("poi_id", "at.x", "at.y")


def near_pairs(points: DataFrame, distance: float, id_col: str = "poi_id") -> DataFrame:
    """(left_id, right_id): every pair of points less than ``distance`` apart, smaller id first.

    Points have unique ids and finite x, y. Each pair is found once: a point
    asks its own cell and four of the eight around it. One side of a cell with
    more than CELL_LIMIT points is split and the other repeated as often, so
    that no task gets more than its share of a crowded cell.
    """
    scratch = Scratch(points.sparkSession, "near")
    cells = {"cx": F.floor(F.col("x") / distance), "cy": F.floor(F.col("y") / distance)}
    points = scratch.cut(points.select(F.col(id_col).alias("id"), "x", "y", *[c.alias(n) for n, c in cells.items()]), "points")
    crowded = points.groupBy("cx", "cy").count().where(F.col("count") > CELL_LIMIT)
    crowded = scratch.cut(crowded.select("cx", "cy", F.ceil(F.col("count") / CELL_LIMIT).cast("int").alias("parts")), "crowded")
    around = [(0, 0), (1, -1), (1, 0), (1, 1), (0, 1)]
    asking = points.select(
        F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"),
        F.inline(F.array(*[F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy"), F.lit(dx == dy == 0).alias("own")) for dx, dy in around])),
    )
    one = F.coalesce(F.col("parts"), F.lit(1))
    asking = asking.join(crowded, ["cx", "cy"], "left").withColumn("salt", F.pmod(F.xxhash64("a"), one).cast("int")).drop("parts")
    asked = points.join(crowded, ["cx", "cy"], "left").select("cx", "cy", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(F.sequence(F.lit(0), one - 1)).alias("salt"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    pairs = asking.join(asked, ["cx", "cy", "salt"]).where((F.sqrt(dx * dx + dy * dy) < distance) & (~F.col("own") | (F.col("a") < F.col("b"))))
    return pairs.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))


def _interleave(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint64) & np.uint64(0xFFFFFFFF)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


TRIANGLE = "area_id long, plain boolean, ax double, ay double, bx double, by double, cx double, cy double, z long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for area_id, rings in zip(batch["area_id"].to_pylist(), batch["rings"].to_pylist()):
            triangles, plain = triangulate(rings)
            rows += [(area_id, plain, *a, *b, *c) for a, b, c in triangles]
        out = pd.DataFrame(rows, columns=["area_id", "plain", "ax", "ay", "bx", "by", "cx", "cy"])
        mid = [np.clip(out[[f"a{k}", f"b{k}", f"c{k}"]].to_numpy(float).sum(axis=1) / 3, -1e9, 1e9) + 2.0**31 for k in "xy"]
        out["z"] = ((_interleave(mid[0]) << np.uint64(1)) | _interleave(mid[1])).view(np.int64)
        if len(out):
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)


def _leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = 0
    for frame in frames:
        frame["leaf"] = (frame["part"].to_numpy(np.int64) << 40) + (np.arange(seen, seen + len(frame)) // LEAF)
        seen += len(frame)
        yield frame.drop(columns=["part", "z"])


class Hierarchy:
    """The tables of a bounding-volume hierarchy over the triangles of all areas."""

    def __init__(self, areas: DataFrame, area_id: str = "area_id", rings: str = "rings"):
        spark = areas.sparkSession
        self.scratch = Scratch(spark, "hierarchy")
        parts = min(parallelism(spark), TOP)
        self.areas = areas.where(F.col(area_id).isNotNull() & F.col(rings).isNotNull()).groupBy(F.col(area_id).cast("long").alias("area_id")).agg(F.max(F.col(rings).cast(RINGS)).alias("rings"))
        triangles = self.scratch.cut(self.areas.repartition(parts, "area_id").mapInArrow(_cut, TRIANGLE), "triangles")
        count, self.all_plain = triangles.agg(F.count("*"), F.coalesce(F.min("plain"), F.lit(True))).first()
        parts = max(1, min(parts, -(-count // (LEAF * FAN))))
        ranged = triangles.repartitionByRange(parts, "z").sortWithinPartitions("z", "area_id").withColumn("part", F.spark_partition_id())
        schema = ranged.drop("part", "z").schema.simpleString()[7:-1].replace(",", ", ").replace(":", " ")
        self.leaves = self.scratch.cut(ranged.mapInPandas(_leaves, schema + ", leaf long"), "leaves")
        corner = lambda f, k: f(*[F.col(f"{v}{k}") for v in "abc"])
        boxes = self.leaves.select(F.col("leaf").alias("node"), corner(F.least, "x").alias("x0"), corner(F.least, "y").alias("y0"), corner(F.greatest, "x").alias("x1"), corner(F.greatest, "y").alias("y1"))
        shift, width = FAN.bit_length() - 1, LEAF
        self.levels: list[DataFrame] = []
        while True:
            level = boxes.groupBy("node").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
            level = level.withColumn("parent", F.shiftright("node", shift))
            # a partition's nodes share the high bits; at the top its local part is gone
            self.levels.append(boxes := self.scratch.cut(level, f"level{len(self.levels)}"))
            if count <= width * parts or boxes.count() <= TOP:
                break
            boxes = boxes.drop("node").withColumnRenamed("parent", "node")
            width *= FAN
        top = self.levels.pop()
        if (n := top.count()) > TOP + 2 * parts:
            raise RuntimeError(f"{n} boxes at the top of the hierarchy")
        self.top = top.collect()

    def containing(self, points: DataFrame, id_col: str = "poi_id") -> DataFrame:
        """(id, area_id) once for each point in a triangle of the area, borders of areas and holes included."""
        if not self.top:
            return points.select(F.col(id_col), F.lit(None).cast("long").alias("area_id")).limit(0)
        x, y = F.col("x"), F.col("y")
        inside = lambda b: (x >= b["x0"]) & (x <= b["x1"]) & (y >= b["y0"]) & (y <= b["y1"])
        boxes = F.array(*[F.struct(*[F.lit(row[c]).alias(c) for c in ("node", "x0", "y0", "x1", "y1")]) for row in self.top])
        at = points.select(F.col(id_col), "x", "y", F.explode(F.filter(boxes, inside)["node"]).alias("at"))
        for level in reversed(self.levels):
            at = at.join(level, (F.col("at") == F.col("parent")) & (x >= F.col("x0")) & (x <= F.col("x1")) & (y >= F.col("y0")) & (y <= F.col("y1"))).select(id_col, "x", "y", F.col("node").alias("at"))
        edges = [self._left(*e) for e in (("ax", "ay", "bx", "by"), ("bx", "by", "cx", "cy"), ("cx", "cy", "ax", "ay"))]
        hit = at.join(self.leaves, (F.col("at") == F.col("leaf")) & edges[0] & edges[1] & edges[2])
        # a point on a diagonal is in two triangles of one area
        hit = hit.groupBy(id_col, "area_id").agg(F.max("plain").alias("plain"), F.first("x").alias("x"), F.first("y").alias("y"))
        if self.all_plain:
            return hit.select(id_col, "area_id")
        sure = hit.where("plain").select(id_col, "area_id")
        doubtful = hit.where("NOT plain").join(self.areas, "area_id")
        return sure.unionByName(doubtful.where(_within("rings", "x", "y")).select(id_col, "area_id"))

    @staticmethod
    def _left(ax: str, ay: str, bx: str, by: str) -> Column:
        """The point is left of or on the edge; both triangles of an edge compute the very same number for it."""
        ax_, ay_, bx_, by_, x, y = (F.col(c) for c in (ax, ay, bx, by, "x", "y"))
        swap = (ax_ > bx_) | ((ax_ == bx_) & (ay_ > by_))
        return F.when(swap, (ax_ - bx_) * (y - by_) - (ay_ - by_) * (x - bx_) <= 0).otherwise((bx_ - ax_) * (y - ay_) - (by_ - ay_) * (x - ax_) >= 0)


@F.arrow_udf(T.BooleanType())
def _within(rings: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    return pa.array([even_odd(r, a, b) for r, a, b in zip(rings.to_pylist(), x.to_pylist(), y.to_pylist())], pa.bool_())


def proximity_found(df_osm: DataFrame, df_area: DataFrame, distance: float = 25.0) -> DataFrame:
    """p5_found (kind, left_id, right_id): pairs of POIs less than ``distance`` metres apart, and the areas containing each POI.

    POIs without a location and areas without rings are in no pair. Repeated
    rows count once. A point on the border of an area or of a hole counts as
    contained. Crossing rings are taken by the even-odd rule. Empty tables
    give no rows; further columns are ignored.
    """
    points = Scratch(df_osm.sparkSession, "points").cut(located(df_osm), "points")
    near = near_pairs(points, distance).select(F.lit("near").alias("kind"), "left_id", "right_id")
    inside = Hierarchy(df_area).containing(points)
    return near.unionByName(inside.select(F.lit("inside").alias("kind"), F.col("poi_id").alias("left_id"), F.col("area_id").alias("right_id")))
