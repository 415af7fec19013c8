"""Planar geometry on arrays of structs, as column expressions.

Polygons are ``rings ARRAY<ARRAY<STRUCT<x,y>>>`` (outer ring, then holes),
lines ``parts`` of the same type. All distances are Euclidean in the unit of
the coordinates. Segments of no length and null points do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _good(points: Column) -> Column:
    return F.filter(points, lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull())


def _segment(p: Column, q: Column) -> Column:
    return F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by"))


def ring_segments(rings: Column) -> Column:
    """Segments (ax, ay, bx, by) of all rings, open rings closed by their first point."""
    return F.flatten(F.transform(F.filter(rings, lambda r: r.isNotNull()), lambda r: F.transform(_good(r), lambda p, i: _segment(p, F.coalesce(F.get(_good(r), i + 1), F.get(_good(r), F.lit(0)))))))


def part_segments(parts: Column) -> Column:
    """Segments (ax, ay, bx, by) of all parts of a line."""
    return F.flatten(F.transform(F.filter(parts, lambda r: r.isNotNull()), lambda r: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(_good(r)), F.lit(1))), lambda i: i < F.size(_good(r))), lambda i: _segment(F.get(_good(r), i - 1), F.get(_good(r), i)))))


def length(segments: Column) -> Column:
    return F.aggregate(segments, F.lit(0.0), lambda s, g: s + F.hypot(g["bx"] - g["ax"], g["by"] - g["ay"]))


def area(rings: Column) -> Column:
    """Area of a polygon: the outer ring's without its holes'."""
    shoelace = lambda r: F.abs(F.aggregate(ring_segments(F.array(r)), F.lit(0.0), lambda s, g: s + (g["ax"] * g["by"] - g["bx"] * g["ay"]))) / 2
    return F.aggregate(F.transform(rings, lambda r, i: F.when(i == 0, shoelace(r)).otherwise(-shoelace(r))), F.lit(0.0), lambda s, a: s + a)


def _along(g: Column, x: Column, y: Column) -> Column:
    """Position of the nearest point of a segment, from 0 to 1."""
    dx, dy = g["bx"] - g["ax"], g["by"] - g["ay"]
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide((x - g["ax"]) * dx + (y - g["ay"]) * dy, dx * dx + dy * dy), F.lit(0.0))))


def segment_distance(g: Column, x: Column, y: Column) -> Column:
    t = _along(g, x, y)
    ex, ey = x - (g["ax"] + t * (g["bx"] - g["ax"])), y - (g["ay"] + t * (g["by"] - g["ay"]))
    return F.sqrt(ex * ex + ey * ey)


def distance_to(segments: Column, x: Column, y: Column) -> Column:
    """Least distance of a point to the segments; null without any."""
    return F.array_min(F.transform(segments, lambda g: segment_distance(g, x, y)))


def crosses_odd(segments: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the right crosses the segments an odd number of times."""
    hit = lambda g: F.coalesce(((g["ay"] > y) != (g["by"] > y)) & (x < g["ax"] + F.try_divide((y - g["ay"]) * (g["bx"] - g["ax"]), g["by"] - g["ay"])), F.lit(False))
    return F.size(F.filter(segments, hit)) % 2 == 1


def within(segments: Column, x: Column, y: Column) -> Column:
    """Strictly inside: odd crossings, and not on the boundary."""
    return crosses_odd(segments, x, y) & (distance_to(segments, x, y) > 0)


def bounds(segments: Column) -> Column:
    """STRUCT<x0, y0, x1, y1> of the segments; nulls without any."""
    ends = lambda k: F.concat(F.transform(segments, lambda g: g[f"a{k}"]), F.transform(segments, lambda g: g[f"b{k}"]))
    return F.struct(*[f(ends(k)).alias(f"{k}{i}") for i, f in ((0, F.array_min), (1, F.array_max)) for k in "xy"])


def locate(segments: Column, x: Column, y: Column) -> Column:
    """STRUCT<dist, along, side> of the nearest segment: distance, abscissa from the line's start, +1 left or on and -1 right of it. Segments know where they start (``at``)."""
    side = lambda g: F.when((g["bx"] - g["ax"]) * (y - g["ay"]) - (g["by"] - g["ay"]) * (x - g["ax"]) >= 0, 1).otherwise(-1)
    size = lambda g: F.sqrt((g["bx"] - g["ax"]) * (g["bx"] - g["ax"]) + (g["by"] - g["ay"]) * (g["by"] - g["ay"]))
    return F.array_min(F.transform(segments, lambda g: F.struct(segment_distance(g, x, y).alias("dist"), (g["at"] + _along(g, x, y) * size(g)).alias("along"), side(g).alias("side"))))


def azimuth(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, from 0 up to but not 360; 0 for no movement."""
    return (F.degrees(F.atan2(dx, dy)) + 360) % 360


def in_sector(angle: Column, center: Column, half_width: float) -> Column:
    """Whether an azimuth is within half_width degrees of a center, inclusive."""
    return F.abs((angle - center + 540) % 360 - 180) <= half_width


#: Centres of the cardinal directions in degrees.
CARDINAL = {"north": 0.0, "east": 90.0, "south": 180.0, "west": 270.0}


def lambert93(lon: Column, lat: Column) -> Column:
    """STRUCT<x, y> in EPSG:2154 of degrees: Lambert conformal conic with two standard parallels, closed form."""
    # Parameters of EPSG:2154 on GRS80 (projection constant n, radius factor c, false easting, y of the pole, eccentricity).
    n, c, easting, pole, e = 0.7256077650532670, 11754255.426096, 700000.0, 12655612.049876, 0.0818191910428158
    phi = F.radians(lat)
    s = F.sin(phi) * e
    q = F.log((1 + F.sin(phi)) / (1 - F.sin(phi))) / 2 - F.log((1 + s) / (1 - s)) * (e / 2)
    r, angle = F.exp(q * -n) * c, F.radians(lon - 3.0) * n
    return F.struct((F.sin(angle) * r + easting).alias("x"), (F.lit(pole) - F.cos(angle) * r).alias("y"))
