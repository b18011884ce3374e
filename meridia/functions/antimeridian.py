"""Geometries in degrees that reach over the 180th meridian, split there.

Neighbouring vertices are joined the short way around. Where that leads over the meridian a chain of
vertices ends on one side and the next begins on the other. The chains of polygons are joined again
along the meridian: of the places where chains meet it on a side, from south to north, the first and
second, third and fourth ... are joined, as what lies between them is inside.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _over(a: Column, b: Column) -> Column:
    return F.abs(b["x"] - a["x"]) > 180


def _normal(v: Column) -> Column:
    """A vertex with its longitude within 180 degrees."""
    x = v["x"]
    return F.when((x >= -180) & (x <= 180), _xy(x, v["y"])).otherwise(_xy(F.pmod(x + 180, F.lit(360.0)) - 180, v["y"]))


def _seam(a: Column, b: Column) -> Column:
    """Struct out, into: where the way from a to b leaves one side and enters the other."""
    side = F.when(a["x"] > 0, 180.0).otherwise(-180.0)
    left = 180 - F.abs(a["x"])
    t = F.when(left + 180 - F.abs(b["x"]) > 0, left / (left + 180 - F.abs(b["x"]))).otherwise(0.5)
    return G.let(a["y"] + t * (b["y"] - a["y"]), lambda y: F.struct(_xy(side, y).alias("out"), _xy(-side, y).alias("into")))


def _chains(v: Column) -> Column:
    """The chains of an open line, one array of vertices each."""

    def go(p):
        n = F.size(p["v"])
        breaks = F.filter(F.sequence(F.lit(0), n - 2), lambda i: _over(F.get(p["v"], i), F.get(p["v"], i + 1)))

        def cut(b):
            def one(j):
                first, last = F.when(j == 0, 0).otherwise(F.get(b, j - 1) + 1), F.coalesce(F.get(b, j), n - 1)
                middle = F.slice(p["v"], first + 1, last - first + 1)
                head = F.when(j > 0, F.array(_seam(F.get(p["v"], first - 1), F.get(p["v"], first))["into"])).otherwise(F.slice(p["v"], 1, 0))
                tail = F.when(j < F.size(b), F.array(_seam(F.get(p["v"], last), F.get(p["v"], last + 1))["out"])).otherwise(F.slice(p["v"], 1, 0))
                return F.concat(head, middle, tail)

            return F.transform(F.sequence(F.lit(0), F.size(b)), one)

        return F.when(n < 2, F.array(p["v"])).otherwise(G.let(breaks, cut))

    return G.let(F.struct(F.transform(v, _normal).alias("v")), go)


def _ring_chains(ring: Column) -> Column:
    """The chains of a closed ring: that of its first vertex is whole, and one more leads along the pole if the ring goes around it."""
    chains = _chains(ring)

    def whole(c):
        k = F.size(c)
        closed = F.concat(F.slice(c, 2, F.greatest(k - 2, F.lit(0))), F.array(F.concat(F.get(c, k - 1), F.slice(F.get(c, F.lit(0)), 2, F.greatest(F.size(F.get(c, F.lit(0))) - 1, F.lit(0))))))

        def polar(d):
            y = F.when(F.aggregate(F.flatten(d), F.lit(0.0), lambda s, v: s + v["y"]) >= 0, 90.0).otherwise(-90.0)
            # as many chains begin on one side as end on the other, but for one
            east = F.size(F.filter(d, lambda x: F.element_at(x, -1)["x"] > 0)) - F.size(F.filter(d, lambda x: x[0]["x"] > 0))
            cap = F.when(east > 0, F.array(_xy(F.lit(180.0), y), _xy(F.lit(-180.0), y))).otherwise(F.array(_xy(F.lit(-180.0), y), _xy(F.lit(180.0), y)))
            return F.when(F.size(d) % 2 == 1, F.concat(d, F.array(cap))).otherwise(d)

        return F.when(k == 1, c).otherwise(G.let(closed, polar))

    return G.let(chains, whole)


def _joined(chains: Column) -> Column:
    """Rings of the chains of a polygon's rings that meet the meridian, joined along it."""

    def go(c):
        k = F.size(c)
        numbers = F.sequence(F.lit(0), k - 1)
        ends = F.flatten(F.transform(numbers, lambda i: F.array(*[F.struct((v["x"] > 0).alias("east"), v["y"].alias("y"), i.alias("chain"), F.lit(start).alias("start")) for v, start in ((F.get(c, i)[0], True), (F.element_at(F.get(c, i), -1), False))])))

        def paired(side):
            # on the side where it ends, the chain that begins at the other end of the stretch that is inside
            return F.transform(side, lambda e, i: F.struct(e["chain"].alias("chain"), e["start"].alias("start"), F.get(side, i.bitwiseXOR(F.lit(1))).alias("to")))

        def follow(e):
            sides = F.concat(*[G.let(F.array_sort(F.filter(e, lambda x: x["east"] if east else ~x["east"])), paired) for east in (False, True)])

            def walk(links):
                after = F.transform(numbers, lambda i: F.coalesce(F.get(F.transform(F.filter(links, lambda x: (x["chain"] == i) & ~x["start"]), lambda x: F.when(x["to"]["start"], x["to"]["chain"])), F.lit(0)), i))

                def loops(nxt):
                    def loop(i):
                        step = lambda s, _: F.when(s["done"] | (F.get(nxt, s["at"]) == i), F.struct(s["at"].alias("at"), s["least"].alias("least"), s["v"].alias("v"), F.lit(True).alias("done"))).otherwise(F.struct(F.get(nxt, s["at"]).alias("at"), F.least(s["least"], F.get(nxt, s["at"])).alias("least"), F.concat(s["v"], F.get(c, F.get(nxt, s["at"]))).alias("v"), F.lit(False).alias("done")))
                        start = F.struct(i.alias("at"), i.alias("least"), F.get(c, i).alias("v"), F.lit(False).alias("done"))
                        return F.aggregate(numbers, start, step, lambda s: F.when(s["least"] == i, s["v"]))

                    return F.filter(F.transform(numbers, loop), lambda v: v.isNotNull())

                return G.let(after, loops)

            return G.let(sides, walk)

        return F.when(k == 0, F.array().cast("array<array<struct<x:double,y:double>>>")).otherwise(G.let(ends, follow))

    return G.let(chains, go)


def _turned(ring: Column, shell: Column) -> Column:
    """The ring against the clock if it is a shell, else with it, so that what is inside lies on the left; around a pole, that side."""

    def go(d):
        wind, twist = F.aggregate(d, F.lit(0.0), lambda s, k: s + k["x"]), F.aggregate(d, F.lit(0.0), lambda s, k: s + k["x"] * k["y"])
        pole = F.signum(F.aggregate(ring, F.lit(0.0), lambda s, v: s + v["y"]) + 1e-9)
        left = F.when(F.abs(wind) > 180, wind * pole > 0).otherwise(twist <= 0)
        return F.when(left == shell, ring).otherwise(F.reverse(ring))

    step = lambda a, b: F.struct((b["x"] - a["x"] - 360 * F.round((b["x"] - a["x"]) / 360)).alias("x"), (a["y"] + b["y"]).alias("y"))
    return G.let(G.pairs(ring, step), go)


def _plain(ring: Column) -> Column:
    """x, y, z and m of vertices; closed, and none twice in a row."""
    ring = F.filter(ring, lambda v, i: (i == 0) | (v != F.get(ring, i - 1)))
    closed = F.when((F.element_at(ring, 1)["x"] == F.element_at(ring, -1)["x"]) & (F.element_at(ring, 1)["y"] == F.element_at(ring, -1)["y"]), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    return F.transform(closed, lambda v: G.vertex(v["x"], v["y"]))


def split_antimeridian(g) -> Column:
    """Lines and polygons with no part over the 180th meridian: multi-part where they reach over it.

    A polygon's rings may be any simple ones, and may go around a pole, that of the hemisphere in which
    their vertices lie on average: then the polygon runs along it. Holes that don't meet the meridian
    stay with the first part that has their first vertex in its bounds' longitudes. Points stay, with
    their longitudes within 180 degrees; z and m are dropped. Null stays null.
    """
    g = G.col(g)
    bare = lambda r: F.transform(r, lambda v: _xy(v["x"], v["y"]))
    lines = F.flatten(F.transform(G.rings(g), lambda r: _chains(bare(r))))
    line = G.multi_line_string(F.transform(F.filter(lines, lambda c: F.size(c) > 1), lambda c: F.transform(c, lambda v: G.vertex(v["x"], v["y"]))))

    def part(rings):
        def go(each):
            cut = F.flatten(F.filter(each, lambda c: (F.size(c) > 1)))
            kept = F.transform(F.filter(each, lambda c: F.size(c) == 1), lambda c: c[0])
            shell_cut = F.size(F.get(each, F.lit(0))) > 1

            def built(shells):
                def own(s, i):
                    low, high = F.array_min(F.transform(s, lambda v: v["x"])), F.array_max(F.transform(s, lambda v: v["x"]))
                    holes = F.filter(kept, lambda h: (h[0]["x"] >= low) & (h[0]["x"] <= high) & (F.array_position(F.transform(shells, lambda t: (h[0]["x"] >= F.array_min(F.transform(t, lambda v: v["x"]))) & (h[0]["x"] <= F.array_max(F.transform(t, lambda v: v["x"])))), F.lit(True)) == i + 1))
                    return F.concat(F.array(_plain(s)), F.transform(holes, _plain))

                return F.transform(shells, own)

            return F.when(shell_cut, G.let(_joined(cut), built)).otherwise(F.array(F.transform(kept, _plain)))

        return G.let(F.transform(rings, lambda r, i: G.let(bare(r), lambda b: G.let(_turned(b, i == 0), _ring_chains))), go)

    polygons = G.geometry(G.MULTIPOLYGON, F.flatten(F.transform(G.parts(g), part)))
    points = G.multi_point(F.transform(G.vertices(g), lambda v: G.let(_normal(v), lambda p: G.vertex(p["x"], p["y"]))))
    single = lambda made, kind: F.when(F.size(G.parts(made)) == 1, G.geometry(kind, G.parts(made))).otherwise(made)
    return F.when(g.isNull() | G.is_empty(g), g).when(G.dimension(g) == 2, G.let(polygons, lambda m: single(m, G.POLYGON))).when(G.dimension(g) == 1, G.let(line, lambda m: single(m, G.LINE))).otherwise(G.let(points, lambda m: single(m, G.POINT)))
