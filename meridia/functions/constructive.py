"""Affine maps and per-vertex constructions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G
from . import measures as M


def affine(g, a, b, d, e, xoff=0.0, yoff=0.0) -> Column:
    """x' = a x + b y + xoff, y' = d x + e y + yoff; z and m stay."""
    a, b, d, e, p, q = map(G.number, (a, b, d, e, xoff, yoff))
    return G.map_vertices(g, lambda v: G.moved(v, a * v["x"] + b * v["y"] + p, d * v["x"] + e * v["y"] + q))


def translate(g, dx=0.0, dy=0.0, dz=0.0) -> Column:
    dx, dy, dz = map(G.number, (dx, dy, dz))
    return G.map_vertices(g, lambda v: G.moved(v, v["x"] + dx, v["y"] + dy, v["z"] + dz))


def origin_of(g, origin) -> tuple[Column, Column]:
    """`center` of the bounds, `centroid`, or a pair."""
    if origin == "center":
        b = G.bounds(g)
        return (b["minx"] + b["maxx"]) / 2, (b["miny"] + b["maxy"]) / 2
    if origin == "centroid":
        c = M.centroid(g)
        return G.x(c), G.y(c)
    return G.number(origin[0]), G.number(origin[1])


def _about(g, origin, a, b, d, e) -> Column:
    x0, y0 = origin_of(g, origin)
    return affine(g, a, b, d, e, x0 - G.number(a) * x0 - G.number(b) * y0, y0 - G.number(d) * x0 - G.number(e) * y0)


def rotate(g, degrees, origin="center") -> Column:
    """Counter-clockwise."""
    t = F.radians(G.number(degrees))
    return _about(g, origin, F.cos(t), -F.sin(t), F.sin(t), F.cos(t))


def scale(g, sx=1.0, sy=1.0, origin="center") -> Column:
    return _about(g, origin, sx, 0.0, 0.0, sy)


def skew(g, degrees_x=0.0, degrees_y=0.0, origin="center") -> Column:
    return _about(g, origin, 1.0, F.tan(F.radians(G.number(degrees_x))), F.tan(F.radians(G.number(degrees_y))), 1.0)


def quantize(g, decimals: int) -> Column:
    """Coordinates rounded to 0 to 15 decimals, halves away from zero; vertices stay."""
    if not 0 <= decimals <= 15:
        raise ValueError("decimals must be 0 to 15")
    return G.map_vertices(g, lambda v: G.moved(v, *[F.round(v[k] * float(10**decimals)) / float(10**decimals) for k in "xy"]))


def without_repeats(r: Column) -> Column:
    """A ring or line without vertices equal in x and y to the one before."""
    keep = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: (i == 0) | (F.get(r, i)["x"] != F.get(r, i - 1)["x"]) | (F.get(r, i)["y"] != F.get(r, i - 1)["y"]))
    return F.when(F.size(r) == 0, r).otherwise(F.transform(keep, lambda i: F.get(r, i)))


def remove_repeated_points(g) -> Column:
    return _without_degenerate(G.map_rings(g, without_repeats))


def _without_degenerate(g: Column) -> Column:
    """Drops lines under two vertices and rings under four; parts that lose their shell go."""
    need = F.when(G.dimension(g) == 2, 4).when(G.dimension(g) == 1, 2).otherwise(1)
    kept = F.filter(G.parts(g), lambda p: F.size(F.element_at(p, 1)) >= need)
    return F.when(g.isNotNull(), F.struct(G.kind(g).alias("kind"), F.transform(kept, lambda p: F.filter(p, lambda r: F.size(r) >= need)).alias("parts")))


def snap_to_grid(g, size, origin=(0.0, 0.0)) -> Column:
    """Vertices to the nearest origin + k size; repeats collapse and degenerate parts go."""
    s, x0, y0 = G.number(size), G.number(origin[0]), G.number(origin[1])
    near = lambda c, o: F.rint((c - o) / s) * s + o
    return remove_repeated_points(G.map_vertices(g, lambda v: G.moved(v, near(v["x"], x0), near(v["y"], y0))))


def segmentize(g, longest) -> Column:
    """Splits every segment into ceil(length / longest) equal ones."""
    longest = G.number(longest)

    def split(r):
        def cut(a, b):
            n = F.greatest(F.lit(1), F.ceil(F.hypot(b["x"] - a["x"], b["y"] - a["y"]) / longest)).cast("int")
            at = lambda k, i: a[k] + (b[k] - a[k]) * i / n
            return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == 0, a).otherwise(F.struct(*[at(k, i).alias(k) for k in "xyzm"])))

        return F.when(F.size(r) < 2, r).otherwise(F.concat(F.flatten(G.pairs(r, cut)), F.array(F.element_at(r, -1))))

    return G.map_rings(g, split)


def chaikin(g, iterations: int = 1, *, keep_endpoints: bool = True) -> Column:
    """Cuts corners at a quarter and three quarters of every edge; rings are cyclic, open lines keep their ends."""
    mid = lambda a, b, t: F.struct(*[(a[k] + (b[k] - a[k]) * t).alias(k) for k in "xyzm"])
    area = G.dimension(g) == 2

    def once(r):
        inner = F.flatten(G.pairs(r, lambda a, b: F.array(mid(a, b, 0.25), mid(a, b, 0.75))))
        ends = F.concat(F.array(F.element_at(r, 1)), inner, F.array(F.element_at(r, -1))) if keep_endpoints else inner
        return F.when(F.size(r) < 3, r).when(area, F.concat(inner, F.array(F.element_at(inner, 1)))).otherwise(ends)

    out = G.col(g)
    for _ in range(iterations):
        out = F.when(G.dimension(g) == 0, out).otherwise(G.map_rings(out, once))
    return out


def _once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def clip_by_box(g, minx, miny, maxx, maxy) -> Column:
    """Polygons and points cut to a box (Sutherland-Hodgman: exact for convex rings; others keep bridging edges on the box)."""
    a, b, c, d = map(G.number, (minx, miny, maxx, maxy))

    def half(r, inside, where):
        def step(p, q):
            none = F.slice(F.array(q), 1, 0)
            return F.concat(F.when(inside(p) != inside(q), F.array(where(p, q))).otherwise(none), F.when(inside(q), F.array(q)).otherwise(none))

        return _once(_once(r, lambda r: F.flatten(G.pairs(r, step))), G.closed)

    def at_x(x):
        return lambda p, q: G.moved(p, x, p["y"] + (q["y"] - p["y"]) * (x - p["x"]) / (q["x"] - p["x"]))

    def at_y(y):
        return lambda p, q: G.moved(p, p["x"] + (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]), y)

    def clip(r):
        r = half(r, lambda v: v["x"] >= a, at_x(a))
        r = half(r, lambda v: v["x"] <= c, at_x(c))
        r = half(r, lambda v: v["y"] >= b, at_y(b))
        return half(r, lambda v: v["y"] <= d, at_y(d))

    dots = F.filter(G.parts(g), lambda p: (p[0][0]["x"] >= a) & (p[0][0]["x"] <= c) & (p[0][0]["y"] >= b) & (p[0][0]["y"] <= d))
    points = F.when(G.col(g).isNotNull(), F.struct(G.kind(g).alias("kind"), dots.alias("parts")))
    return F.when(G.dimension(g) == 0, points).otherwise(_once(G.map_rings(g, clip), _without_degenerate))


def regular_polygon(x, y, radius, corners, turn=0.0) -> Column:
    """A closed n-gon around a point, counter-clockwise from `turn` degrees."""
    x, y, radius, turn = map(G.number, (x, y, radius, turn))
    n = G.col(corners).cast("int")
    at = lambda i: G.vertex(x + radius * F.cos(F.radians(turn) + 2 * math.pi * i / n), y + radius * F.sin(F.radians(turn) + 2 * math.pi * i / n))
    return G.polygon(F.transform(F.sequence(F.lit(0), n - 1), at))


def buffer_point(g, radius, segments: int = 8) -> Column:
    """A circle of 4 x segments corners around a point."""
    return regular_polygon(G.x(g), G.y(g), radius, F.lit(4 * segments))


def orient(g, *, ccw: bool = True) -> Column:
    """Shells counter-clockwise and holes clockwise, or the other way round."""
    want = lambda r, left: F.when((M.ring_area(r) > 0) == left, r).otherwise(F.reverse(r))
    g = G.col(g)
    fixed = F.transform(g["parts"], lambda p: F.transform(p, lambda r, i: F.when(i == 0, want(r, F.lit(ccw))).otherwise(want(r, F.lit(not ccw)))))
    return F.when(G.dimension(g) == 2, F.struct(g["kind"].alias("kind"), fixed.alias("parts"))).otherwise(g)


def boundary(g) -> Column:
    """Rings of polygons, ends of lines that occur an odd number of times, nothing for points."""
    loops = F.when(F.size(G.rings(g)) == 1, G.geometry(G.LINE, F.array(F.array(F.get(G.rings(g), F.lit(0)))))).otherwise(G.multi_line_string(G.rings(g)))
    flat = lambda v: G.vertex(v["x"], v["y"])
    ends = F.flatten(F.transform(G.rings(g), lambda r: F.array(flat(F.element_at(r, 1)), flat(F.element_at(r, -1)))))
    odd = F.filter(F.array_distinct(ends), lambda e: F.size(F.filter(ends, lambda o: (o["x"] == e["x"]) & (o["y"] == e["y"]))) % 2 == 1)
    return F.when(G.dimension(g) == 2, loops).when(G.dimension(g) == 1, G.multi_point(odd)).when(G.col(g).isNotNull(), G.empty(G.MULTIPOINT))
