"""Planar measures and predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G


def _hypot(a: Column, b: Column) -> Column:
    return F.hypot(b["x"] - a["x"], b["y"] - a["y"])


def ring_length(r: Column) -> Column:
    return G.total(G.pairs(r, _hypot))


def ring_area(r: Column) -> Column:
    """Signed, positive for counter-clockwise; taken from the first vertex, which saves digits."""
    o = F.element_at(r, 1)
    cross = lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])
    return G.total(G.pairs(r, cross)) / 2


def length(g) -> Column:
    """Length of lines; 0 for other kinds."""
    return F.when(G.dimension(g) == 1, G.total(F.transform(G.rings(g), ring_length))).otherwise(F.when(G.col(g).isNotNull(), 0.0))


def perimeter(g) -> Column:
    return F.when(G.dimension(g) == 2, G.total(F.transform(G.rings(g), ring_length))).otherwise(F.when(G.col(g).isNotNull(), 0.0))


def _part_area(p: Column) -> Column:
    return 2 * F.abs(ring_area(F.element_at(p, 1))) - G.total(F.transform(p, lambda r: F.abs(ring_area(r))))


def area(g) -> Column:
    return F.when(G.dimension(g) == 2, G.total(F.transform(G.parts(g), _part_area))).otherwise(F.when(G.col(g).isNotNull(), 0.0))


def signed_area(g) -> Column:
    return F.when(G.kind(g) == G.POLYGON, ring_area(F.get(G.rings(g), F.lit(0))))


def is_ccw(g) -> Column:
    """Of a closed line or a polygon's shell."""
    return ring_area(F.get(G.rings(g), F.lit(0))) > 0


def is_convex(g) -> Column:
    """Whether a polygon without holes turns one way only."""

    def ring(r):
        n = F.size(r) - 1
        at = lambda i: F.get(r, F.pmod(i, n).cast("int"))

        def turn(i):
            a, b, c = at(i), at(i + 1), at(i + 2)
            return (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])

        return G.let(F.transform(F.sequence(F.lit(0), n - 1), turn), lambda turns: F.forall(turns, lambda t: t >= 0) | F.forall(turns, lambda t: t <= 0))

    return G.let(G.rings(g), lambda rings: (F.size(rings) == 1) & G.let(F.get(rings, F.lit(0)), ring))


def centroid(g) -> Column:
    """Of the parts of the highest dimension, weighted by area, length or number."""
    add = lambda values: F.aggregate(values, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), lambda a, v: F.zip_with(a, v, lambda p, q: p + q))

    def of(g):
        o = F.get(G.vertices(g), F.lit(0))

        def triangle(a, b):
            ax, ay, bx, by = a["x"] - o["x"], a["y"] - o["y"], b["x"] - o["x"], b["y"] - o["y"]
            return G.let(ax * by - bx * ay, lambda c: F.array((ax + bx) * c / 3, (ay + by) * c / 3, c))

        # shells count positive and holes negative, whatever their direction
        ring = lambda r, sign: G.let(add(G.pairs(r, triangle)), lambda s: F.transform(s, lambda v: v * sign * F.signum(F.element_at(s, 3))))
        polygons = add(F.flatten(F.transform(G.parts(g), lambda p: F.transform(p, lambda r, i: ring(r, F.when(i == 0, 1.0).otherwise(-1.0))))))
        middle = lambda a, b: G.let(_hypot(a, b), lambda n: F.array((a["x"] + b["x"] - 2 * o["x"]) / 2 * n, (a["y"] + b["y"] - 2 * o["y"]) / 2 * n, n))
        lines = add(F.flatten(F.transform(G.rings(g), lambda r: G.pairs(r, middle))))
        points = add(F.transform(G.vertices(g), lambda v: F.array(v["x"] - o["x"], v["y"] - o["y"], F.lit(1.0))))
        usable = lambda s: F.when(F.element_at(s, 3) != 0, s)
        best = F.coalesce(F.when(G.dimension(g) == 2, G.let(polygons, usable)), F.when(G.dimension(g) >= 1, G.let(lines, usable)), points)
        return G.let(best, lambda s: G.point(o["x"] + F.element_at(s, 1) / F.element_at(s, 3), o["y"] + F.element_at(s, 2) / F.element_at(s, 3)))

    return F.when(G.is_empty(g), G.empty(G.POINT)).otherwise(G.let(G.col(g), of))


def segment_distance(px: Column, py: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    d = dx * dx + dy * dy
    t = F.when(d == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - a["x"]) * dx + (py - a["y"]) * dy) / d)))
    return F.hypot(px - a["x"] - t * dx, py - a["y"] - t * dy)


def location(g, px, py) -> Column:
    """1 inside, 0 on the boundary, -1 outside of a polygon, by exact sign tests on doubles."""
    px, py = G.number(px), G.number(py)
    side = lambda a, b: (b["x"] - a["x"]) * (py - a["y"]) - (px - a["x"]) * (b["y"] - a["y"])
    on = lambda a, b: (side(a, b) == 0) & (px >= F.least(a["x"], b["x"])) & (px <= F.greatest(a["x"], b["x"])) & (py >= F.least(a["y"], b["y"])) & (py <= F.greatest(a["y"], b["y"]))
    crosses = lambda a, b: F.when((a["y"] <= py) & (b["y"] > py) & (side(a, b) > 0), 1).when((b["y"] <= py) & (a["y"] > py) & (side(a, b) < 0), 1).otherwise(0)
    edge = F.exists(G.rings(g), lambda r: F.exists(G.pairs(r, on), lambda t: t))
    count = F.aggregate(F.flatten(F.transform(G.rings(g), lambda r: G.pairs(r, crosses))), F.lit(0), lambda a, c: a + c)
    return F.when(edge, 0).when(count % 2 == 1, 1).otherwise(-1)


def contains_xy(g, px, py) -> Column:
    """Strictly inside; points on the boundary are not contained."""
    return F.coalesce((G.dimension(g) == 2) & (location(g, px, py) == 1), F.lit(False))


def intersects_xy(g, px, py) -> Column:
    """Inside or on the boundary of polygons, on a line, or at a point."""
    qx, qy = G.number(px), G.number(py)
    near = F.exists(G.rings(g), lambda r: F.exists(G.pairs(r, lambda a, b: segment_distance(qx, qy, a, b)), lambda d: d == 0))
    same = F.exists(G.vertices(g), lambda v: (v["x"] == qx) & (v["y"] == qy))
    return F.coalesce(F.when(G.dimension(g) == 2, location(g, px, py) >= 0).when(G.dimension(g) == 1, near).otherwise(same), F.lit(False))


covers_xy = intersects_xy


def distance_xy(g, px, py) -> Column:
    """From a point to a geometry; 0 inside polygons."""
    qx, qy = G.number(px), G.number(py)
    edges = F.array_min(F.flatten(F.transform(G.rings(g), lambda r: G.pairs(r, lambda a, b: segment_distance(qx, qy, a, b)))))
    dots = F.array_min(F.transform(G.vertices(g), lambda v: F.hypot(v["x"] - qx, v["y"] - qy)))
    return F.when((G.dimension(g) == 2) & (location(g, px, py) >= 0), 0.0).when(G.dimension(g) >= 1, edges).otherwise(dots)


def nearest_xy(g, px, py) -> Column:
    """Struct d, x, y: the nearest place of a geometry to a point, and its distance; the point itself inside polygons."""
    qx, qy = G.number(px), G.number(py)

    def on(a, b):
        def at(p):
            t = F.when(p["n"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), p["t"] / p["n"]))).otherwise(0.0)
            return G.let(t, lambda t: G.let(F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y")), there))

        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        return G.let(F.struct(((qx - a["x"]) * dx + (qy - a["y"]) * dy).alias("t"), (dx * dx + dy * dy).alias("n")), at)

    there = lambda v: F.struct(F.hypot(v["x"] - qx, v["y"] - qy).alias("d"), v["x"].alias("x"), v["y"].alias("y"))
    edges = F.array_min(F.flatten(F.transform(G.rings(g), lambda r: G.pairs(r, on))))
    own = F.struct(F.lit(0.0).alias("d"), qx.alias("x"), qy.alias("y"))
    return F.when((G.dimension(g) == 2) & (location(g, px, py) >= 0), own).when(G.dimension(g) >= 1, edges).otherwise(F.array_min(F.transform(G.vertices(g), there)))


def bounds_intersect(a: Column, b: Column) -> Column:
    return (a["minx"] <= b["maxx"]) & (b["minx"] <= a["maxx"]) & (a["miny"] <= b["maxy"]) & (b["miny"] <= a["maxy"])


def box_relation(a: Column, b: Column) -> Column:
    """disjoint, touches, equals, contains, within, covers, covered_by or overlaps, of two boxes as bounds."""
    apart = ~bounds_intersect(a, b)
    touch = (a["minx"] == b["maxx"]) | (b["minx"] == a["maxx"]) | (a["miny"] == b["maxy"]) | (b["miny"] == a["maxy"])
    same = (a["minx"] == b["minx"]) & (a["maxx"] == b["maxx"]) & (a["miny"] == b["miny"]) & (a["maxy"] == b["maxy"])
    inside = lambda p, q: (p["minx"] >= q["minx"]) & (p["maxx"] <= q["maxx"]) & (p["miny"] >= q["miny"]) & (p["maxy"] <= q["maxy"])
    return F.when(apart, "disjoint").when(touch, "touches").when(same, "equals").when(inside(b, a), "contains").when(inside(a, b), "within").otherwise("overlaps")


def box_intersection(a: Column, b: Column) -> Column:
    """Bounds of the common part; null if there is none."""
    made = F.struct(F.greatest(a["minx"], b["minx"]).alias("minx"), F.greatest(a["miny"], b["miny"]).alias("miny"), F.least(a["maxx"], b["maxx"]).alias("maxx"), F.least(a["maxy"], b["maxy"]).alias("maxy"))
    return F.when(bounds_intersect(a, b), made)


def hausdorff_points(g, h) -> Column:
    """Hausdorff distance of two point sets."""
    one = lambda p, q: F.array_max(F.transform(G.vertices(p), lambda u: F.array_min(F.transform(G.vertices(q), lambda v: _hypot(u, v)))))
    return F.greatest(one(g, h), one(h, g))


def minimum_clearance_points(g) -> Column:
    """Least distance of two different vertices of a point set."""
    v = G.vertices(g)
    return F.array_min(F.flatten(F.transform(v, lambda a: F.transform(F.filter(v, lambda b: (a["x"] != b["x"]) | (a["y"] != b["y"])), lambda b: _hypot(a, b)))))
