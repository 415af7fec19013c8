"""Well-known binary in and out of Spark without a geometry library.

Points are decoded a batch at once by reinterpreting their bytes; polygons and
lines one by one, at the I/O edge only.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RINGS = T.ArrayType(T.ArrayType(XY))


def _points(wkb: list[bytes | None]) -> np.ndarray:
    """One row (x, y) for each WKB point; NaN where it is none."""
    out = np.full((len(wkb), 2), np.nan)
    for width, skip in ((21, 5), (25, 9)):
        rows = np.array([i for i, b in enumerate(wkb) if b is not None and len(b) == width], dtype=np.int64)
        if not len(rows):
            continue
        raw = np.frombuffer(b"".join(wkb[i] for i in rows), np.uint8).reshape(-1, width)
        for order, end in ((0, ">"), (1, "<")):
            kind = np.ascontiguousarray(raw[:, 1:5]).view(f"{end}u4")[:, 0]
            at = np.flatnonzero((raw[:, 0] == order) & (kind == (1 if width == 21 else 0x20000001)))
            out[rows[at]] = np.ascontiguousarray(raw[at, skip:]).view(f"{end}f8")
    return out


@F.pandas_udf(XY)
def point_xy(wkb: pd.Series) -> pd.DataFrame:
    """STRUCT<x, y> of a WKB point of either byte order, with or without SRID; x and y are null if it is none, empty or infinite."""
    xy = _points([None if b is None else bytes(b) for b in wkb])
    xy[~np.isfinite(xy).all(axis=1)] = np.nan
    return pd.DataFrame({"x": pd.array(xy[:, 0], dtype="Float64"), "y": pd.array(xy[:, 1], dtype="Float64")}).where(~np.isnan(xy), pd.NA)


def _lines(data: bytes) -> list[list[dict]] | None:
    """Rings of a polygon, parts of a (multi)line; polygons of a multipolygon one after the other."""

    def at(pos: int) -> tuple[list[list[dict]], int]:
        order = "<" if data[pos] == 1 else ">"
        kind = struct.unpack_from(order + "I", data, pos + 1)[0]
        pos += 5
        if kind & 0x20000000:
            pos += 4
        kind &= 0xFF
        count = 1 if kind == 2 else struct.unpack_from(order + "I", data, pos)[0]
        pos += 0 if kind == 2 else 4
        out: list[list[dict]] = []
        for _ in range(count):
            if kind in (2, 3):
                n = struct.unpack_from(order + "I", data, pos)[0]
                flat = struct.unpack_from(f"{order}{2 * n}d", data, pos + 4)
                pos += 4 + 16 * n
                out.append([{"x": flat[2 * i], "y": flat[2 * i + 1]} for i in range(n)])
            elif kind in (5, 6):
                more, pos = at(pos)
                out += more
            else:
                raise ValueError("not a polygon or line")
        return out, pos

    try:
        return at(0)[0]
    except (ValueError, struct.error, IndexError):
        return None


_RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


@F.arrow_udf(RINGS)
def wkb_to_rings(wkb: pa.Array) -> pa.Array:
    return pa.array([None if b is None else _lines(b) for b in wkb.to_pylist()], _RINGS)


def encode(parts, kind: str) -> bytes | None:
    """Little-endian WKB of point, line or polygon given as lists of (x, y)."""
    if parts is None:
        return None
    if kind == "point":
        return struct.pack("<BI2d", 1, 1, *parts)
    body = [struct.pack("<I", len(p)) + struct.pack(f"<{2 * len(p)}d", *[v for q in p for v in (q["x"], q["y"])]) for p in parts]
    if kind == "polygon":
        return struct.pack("<BII", 1, 3, len(body)) + b"".join(body)
    lines = [struct.pack("<BI", 1, 2) + b for b in body]
    return lines[0] if len(lines) == 1 else struct.pack("<BII", 1, 5, len(lines)) + b"".join(lines)


@F.arrow_udf(T.BinaryType())
def rings_to_wkb(rings: pa.Array) -> pa.Array:
    return pa.array([encode(r, "polygon") if r else None for r in rings.to_pylist()], pa.binary())


@F.arrow_udf(T.BinaryType())
def parts_to_wkb(parts: pa.Array) -> pa.Array:
    return pa.array([encode(p, "line") if p else None for p in parts.to_pylist()], pa.binary())


@F.arrow_udf(T.BinaryType())
def xy_to_wkb(x: pa.Array, y: pa.Array) -> pa.Array:
    return pa.array([None if a is None or b is None else encode((a, b), "point") for a, b in zip(x.to_pylist(), y.to_pylist())], pa.binary())
