"""Distances and nearest places between any two geometries, vectorised over their segments."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G
from . import measures as M
from .kernels import made, parts_of, place, rings_of

#: Segments of the first geometry that are compared with all of the second at once.
BLOCK = 512


def _segments(g) -> np.ndarray:
    """Rows ax, ay, bx, by; a single vertex is a segment without length."""
    out = []
    for r in rings_of(g):
        out += [(*a, *b) for a, b in zip(r, r[1:])] if len(r) > 1 else [(*r[0], *r[0])] if r else []
    return np.array(out, float).reshape(-1, 4)


def _foot(px, py, s):
    """(squared distance, x, y) of the nearest place on segments s to points."""
    ax, ay, bx, by = s[..., 0], s[..., 1], s[..., 2], s[..., 3]
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = np.clip(np.where(n > 0, ((px - ax) * dx + (py - ay) * dy) / np.where(n > 0, n, 1), 0), 0, 1)
    x, y = ax + t * dx, ay + t * dy
    return (px - x) ** 2 + (py - y) ** 2, x, y


def closest(g, h) -> tuple[float, tuple[float, float], tuple[float, float]] | None:
    """(distance, place on g, place on h), the first of equally near ones; None if either is empty."""
    if g is None or h is None:
        return None
    s, t = _segments(g), _segments(h)
    if not len(s) or not len(t):
        return None
    for a, b, flip in ((g, t, False), (h, s, True)):
        if a["kind"] in (3, 6):
            for p in {(x, y) for x, y in b[:, :2].tolist()} if len(b) < 4 else [tuple(b[0, :2].tolist())]:
                if place(p, parts_of(a)) >= 0:
                    return 0.0, p, p
    best = (math.inf, (0.0, 0.0), (0.0, 0.0))
    for k in range(0, len(s), BLOCK):
        u, v = s[k : k + BLOCK, None, :], t[None, :, :]
        turn = lambda a, b, px, py: (b[0] - a[0]) * (py - a[1]) - (b[1] - a[1]) * (px - a[0])
        ua, ub, va, vb = (u[..., 0], u[..., 1]), (u[..., 2], u[..., 3]), (v[..., 0], v[..., 1]), (v[..., 2], v[..., 3])
        d1, d2, d3, d4 = turn(va, vb, *ua), turn(va, vb, *ub), turn(ua, ub, *va), turn(ua, ub, *vb)
        cross = (d1 * d2 < 0) & (d3 * d4 < 0)
        if cross.any():
            i, j = np.argwhere(cross)[0]
            r = d1[i, j] / (d1[i, j] - d2[i, j])
            a = s[k + i]
            p = (float(a[0] + r * (a[2] - a[0])), float(a[1] + r * (a[3] - a[1])))
            return 0.0, p, p
        for end, flip in ((ua, False), (ub, False), (va, True), (vb, True)):
            d, x, y = _foot(*end, v if not flip else u)
            i, j = np.unravel_index(np.argmin(d), d.shape)
            if d[i, j] < best[0]:
                mine = tuple(float(np.broadcast_to(c, d.shape)[i, j]) for c in end)
                other = (float(x[i, j]), float(y[i, j]))
                best = (float(d[i, j]), other, mine) if flip else (float(d[i, j]), mine, other)
    return math.sqrt(best[0]), best[1], best[2]


def _vertices3(g) -> list[np.ndarray]:
    return [np.array([(v["x"], v["y"], v["z"] or 0.0) for v in r]) for p in g["parts"] for r in p if r]


def distance_3d_of(g, h) -> float | None:
    """Between the vertices and edges of two geometries in space; a missing z is 0, and insides don't count."""
    if g is None or h is None:
        return None
    best = math.inf
    cut = lambda r: (r[:-1], r[1:]) if len(r) > 1 else (r, r)
    for r in _vertices3(g):
        for q in _vertices3(h):
            (p1, q1), (p2, q2) = cut(r), cut(q)
            d1, d2, w = (q1 - p1)[:, None], (q2 - p2)[None], p1[:, None] - p2[None]
            a, e, f = (d1 * d1).sum(-1), (d2 * d2).sum(-1), (d2 * w).sum(-1)
            c, b = (d1 * w).sum(-1), (d1 * d2).sum(-1)
            den = a * e - b * b
            safe = lambda x: np.where(x > 0, x, 1)
            s = np.where(den > 1e-300, np.clip((b * f - c * e) / safe(den), 0, 1), 0.0)
            t = np.where(e > 0, (b * s + f) / safe(e), 0.0)
            s = np.where(t < 0, np.clip(np.where(a > 0, -c / safe(a), 0), 0, 1), np.where(t > 1, np.clip(np.where(a > 0, (b - c) / safe(a), 0), 0, 1), s))
            t = np.clip(t, 0, 1)
            gap = w + s[..., None] * d1 - t[..., None] * d2
            best = min(best, float(np.sqrt((gap * gap).sum(-1)).min()))
    return None if best == math.inf else best


def clearance(g) -> tuple[float, tuple[float, float], tuple[float, float]] | None:
    """The least distance between two different vertices, or a vertex and an edge that it isn't an end of."""
    if g is None:
        return None
    points = sorted({v for r in rings_of(g) for v in r})
    if len(points) < 2:
        return None
    p, best = np.array(points), (math.inf, None, None)
    for i in range(len(p) - 1):
        d = ((p[i + 1 :] - p[i]) ** 2).sum(1)
        j = int(np.argmin(d))
        if d[j] < best[0]:
            best = (float(d[j]), points[i], points[i + 1 + j])
    s = _segments(g)
    s = s[(s[:, 0] != s[:, 2]) | (s[:, 1] != s[:, 3])]
    for x, y in points:
        other = s[~(((s[:, 0] == x) & (s[:, 1] == y)) | ((s[:, 2] == x) & (s[:, 3] == y)))]
        if len(other):
            d, fx, fy = _foot(x, y, other)
            j = int(np.argmin(d))
            if d[j] < best[0]:
                best = (float(d[j]), (x, y), (float(fx[j]), float(fy[j])))
    return math.sqrt(best[0]), best[1], best[2]


# --- columns -----------------------------------------------------------------------------------


def _udf(f, kind: str):
    return F.udf(f, kind, useArrow=True)


def distance(g, h) -> Column:
    """Planar distance of any two geometries; null if either is missing or empty."""
    return _udf(lambda a, b: (m := closest(a, b)) and m[0], "double")(G.col(g), G.col(h))


def distance_3d(g, h) -> Column:
    return _udf(distance_3d_of, "double")(G.col(g), G.col(h))


def dwithin(g, h, limit: float) -> Column:
    return F.coalesce(distance(g, h) <= limit, F.lit(False))


def shortest_line(g, h, *, left_kind: str | None = None) -> Column:
    """The line from the nearest place of one geometry to that of the other; in columns if g is said to hold points."""
    if left_kind == "point":
        near = M.nearest_xy(h, G.x(g), G.y(g))
        return G.let(near, lambda n: F.when(n.isNotNull() & G.x(g).isNotNull(), G.line_string(F.array(G.vertex(G.x(g), G.y(g)), G.vertex(n["x"], n["y"])))))
    return _udf(lambda a, b: (m := closest(a, b)) and made(2, [[[m[1], m[2]]]]), G.GEOMETRY)(G.col(g), G.col(h))


def nearest_points(g, h, *, left_kind: str | None = None) -> Column:
    """Struct a, b of the nearest places as points; in columns if g is said to hold points."""
    if left_kind == "point":
        near = M.nearest_xy(h, G.x(g), G.y(g))
        return G.let(near, lambda n: F.when(n.isNotNull() & G.x(g).isNotNull(), F.struct(G.point(G.x(g), G.y(g)).alias("a"), G.point(n["x"], n["y"]).alias("b"))))
    return _udf(lambda a, b: (m := closest(a, b)) and {"a": made(1, [[[m[1]]]]), "b": made(1, [[[m[2]]]])}, f"struct<a:{G.GEOMETRY},b:{G.GEOMETRY}>")(G.col(g), G.col(h))


def minimum_clearance(g) -> Column:
    return _udf(lambda a: (m := clearance(a)) and m[0], "double")(G.col(g))


def minimum_clearance_line(g) -> Column:
    return _udf(lambda a: (m := clearance(a)) and made(2, [[[m[1], m[2]]]]), G.GEOMETRY)(G.col(g))


def length_3d(g) -> Column:
    """Length of lines with their heights; a missing z is 0."""
    z = lambda v: F.coalesce(v["z"], F.lit(0.0))
    step = lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]) + (z(a) - z(b)) * (z(a) - z(b)))
    return F.when(G.dimension(g) == 1, G.total(F.transform(G.rings(g), lambda r: G.total(G.pairs(r, step))))).otherwise(F.when(G.col(g).isNotNull(), 0.0))


def equals_exact(g, h, tolerance: float = 0.0, *, z: bool = True, m: bool = True) -> Column:
    """Whether two geometries have the same kind and structure, and vertices within a tolerance in the same order."""

    def same(a, b):
        near = lambda k: F.when(a[k].isNull() | b[k].isNull(), a[k].isNull() & b[k].isNull()).otherwise(F.abs(a[k] - b[k]) <= tolerance)
        return near("x") & near("y") & (near("z") if z else F.lit(True)) & (near("m") if m else F.lit(True))

    every = lambda f: lambda a, b: (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, f), lambda k: F.coalesce(k, F.lit(False)))
    g, h = G.col(g), G.col(h)
    return F.coalesce((G.kind(g) == G.kind(h)) & every(every(every(same)))(G.parts(g), G.parts(h)), F.lit(False))


def equals_identical(g, h) -> Column:
    """Whether two geometries are the same value; two missing ones are."""
    return G.col(g).eqNullSafe(G.col(h))
