"""Polygons with holes cut into triangles by ear clipping."""

from __future__ import annotations

import math

import numpy as np

Point = tuple[float, float]


def clean_ring(ring) -> list[Point]:
    """Vertices of a ring without nulls, repeats in a row and the closing vertex; [] if fewer than three remain."""
    out: list[Point] = []
    for p in ring if ring is not None else []:
        if p is None or p["x"] is None or p["y"] is None or not (math.isfinite(p["x"]) and math.isfinite(p["y"])):
            continue
        q = (float(p["x"]), float(p["y"]))
        if not out or out[-1] != q:
            out.append(q)
    while len(out) > 1 and out[0] == out[-1]:
        out.pop()
    return out if len(set(out)) >= 3 else []


def signed_area(ring: list[Point]) -> float:
    ox, oy = ring[0]
    return 0.5 * sum((ax - ox) * (by - oy) - (bx - ox) * (ay - oy) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]))


def turn(a: Point, b: Point, c: Point) -> float:
    """Positive if a, b, c turn left. The edge's ends are taken in one fixed order, so that both its sides get exactly opposite signs."""
    if a > b:
        return -((a[0] - b[0]) * (c[1] - b[1]) - (a[1] - b[1]) * (c[0] - b[0]))
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _bridge(outer: list[Point], hole: list[Point]) -> list[Point] | None:
    """The hole spliced into the outer boundary along a visible segment to the right of its rightmost vertex."""
    start = max(range(len(hole)), key=lambda i: hole[i])
    mx, my = hole[start]
    best, at = math.inf, -1
    for i, (a, b) in enumerate(zip(outer, outer[1:] + outer[:1])):
        if a[1] == b[1]:
            if a[1] == my and max(a[0], b[0]) >= mx:
                x = min(v for v in (a[0], b[0]) if v >= mx)
            else:
                continue
        elif min(a[1], b[1]) <= my <= max(a[1], b[1]):
            x = a[0] + (my - a[1]) * (b[0] - a[0]) / (b[1] - a[1])
        else:
            continue
        if mx <= x < best:
            end = i if a[0] > b[0] else (i + 1) % len(outer)
            best, at = x, i if a[1] == my and a[0] == x else (i + 1) % len(outer) if b[1] == my and b[0] == x else end
    if at < 0:
        return None
    if outer[at] != (best, my):
        corner, hit, m = outer[at], (best, my), (mx, my)
        tri = (m, hit, corner) if turn(m, hit, corner) > 0 else (m, corner, hit)
        inside = [
            i for i, p in enumerate(outer)
            if p != corner and p != m and all(turn(tri[k], tri[(k + 1) % 3], p) >= 0 for k in range(3))
        ]
        if inside:
            at = min(inside, key=lambda i: (abs(math.atan2(outer[i][1] - my, outer[i][0] - mx)), math.dist(outer[i], m)))
    # of several copies of the corner, the one whose interior angle faces the hole
    same = [i for i, p in enumerate(outer) if p == outer[at]]
    for i in same:
        a, b, c = outer[i - 1], outer[i], outer[(i + 1) % len(outer)]
        left_in, left_out = turn(a, b, (mx, my)) > 0, turn(b, c, (mx, my)) > 0
        if (left_in and left_out) if turn(a, b, c) > 0 else (left_in or left_out):
            at = i
            break
    return outer[: at + 1] + hole[start:] + hole[: start + 1] + outer[at:]


def _clip(ring: list[Point]) -> list[tuple[Point, Point, Point]] | None:
    """Ears cut off one after the other; None if none is found, which only happens to rings that cross themselves."""
    n = len(ring)
    xy = np.array(ring)
    after, before = [(i + 1) % n for i in range(n)], [i - 1 for i in range(n)]
    before[0] = n - 1
    alive = np.ones(n, bool)
    bend = [turn(ring[before[i]], ring[i], ring[after[i]]) for i in range(n)]
    reflex = np.array([b < 0 for b in bend])
    out: list[tuple[Point, Point, Point]] = []
    i, left, idle = 0, n, 0
    while left > 3:
        p, q = before[i], after[i]
        a, b, c = ring[p], ring[i], ring[q]
        ear = bend[i] >= 0
        if bend[i] > 0:
            lo, hi = np.minimum(np.minimum(xy[p], xy[i]), xy[q]), np.maximum(np.maximum(xy[p], xy[i]), xy[q])
            near = np.flatnonzero(alive & reflex & (xy >= lo).all(1) & (xy <= hi).all(1))
            for k in near:
                v = ring[k]
                if v != a and v != b and v != c and turn(a, b, v) >= 0 and turn(b, c, v) >= 0 and turn(c, a, v) >= 0:
                    ear = False
                    break
        if ear:
            if bend[i] > 0:
                out.append((a, b, c))
            alive[i] = False
            after[p], before[q] = q, p
            left -= 1
            for k in (p, q):
                bend[k] = turn(ring[before[k]], ring[k], ring[after[k]])
                reflex[k] = bend[k] < 0
            i, idle = q, 0
        else:
            i, idle = q, idle + 1
            if idle > left:
                return None
    a, b, c = ring[before[i]], ring[i], ring[after[i]]
    if turn(a, b, c) > 0:
        out.append((a, b, c))
    return out


def triangulate(rings) -> tuple[list[tuple[Point, Point, Point]], bool]:
    """Counter-clockwise triangles of a polygon, first the outer ring, then holes; and whether they need no check.

    Null, empty and degenerate rings (under three different vertices) are left
    out; without an outer ring there are no triangles. Rings may be open, of
    either orientation, with repeated vertices. Where ears can't be found or
    the triangles' area isn't the polygon's, the rings cross or overlap: two
    triangles over the bounding box come back with False, and a point in them
    must be tested against the rings.
    """
    if rings is None or len(rings) == 0:
        return [], True
    outer = clean_ring(rings[0])
    if not outer:
        return [], True
    holes = [h for h in map(clean_ring, rings[1:]) if h]
    area = abs(signed_area(outer)) - sum(abs(signed_area(h)) for h in holes)
    ring: list[Point] | None = outer if signed_area(outer) > 0 else outer[::-1]
    for hole in sorted(([h if signed_area(h) < 0 else h[::-1] for h in holes]), key=max, reverse=True):
        ring = _bridge(ring, hole) if ring else None
    out = _clip(ring) if ring else None
    if out is not None and out and abs(sum(turn(*t) for t in out) / 2 - area) <= 1e-6 * max(1.0, abs(area)):
        return out, True
    (x0, y0), (x1, y1) = np.min(outer, axis=0), np.max(outer, axis=0)
    return [((x0, y0), (x1, y0), (x1, y1)), ((x0, y0), (x1, y1), (x0, y1))], False


def even_odd(rings, x: float, y: float) -> bool:
    """Whether a ray from the point crosses the rings an odd number of times; points on a ring count as inside."""
    inside = False
    for ring in map(clean_ring, rings):
        for a, b in zip(ring, ring[1:] + ring[:1]):
            t = turn(a, b, (x, y))
            if t == 0 and min(a[0], b[0]) <= x <= max(a[0], b[0]) and min(a[1], b[1]) <= y <= max(a[1], b[1]):
                return True
            if (a[1] > y) != (b[1] > y) and (t > 0) == (b[1] > a[1]):
                inside = not inside
    return inside
