"""The geometry column, its constructors and accessors, as plain column expressions.

A geometry is a struct of a kind and nested parts: polygons of rings of vertices. Points and lines use
the same nesting with one ring a part, so one expression serves every kind. SQL NULL is a missing
row; an empty geometry has no parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

VERTEX = "struct<x:double,y:double,z:double,m:double>"
PARTS = f"array<array<array<{VERTEX}>>>"
GEOMETRY = f"struct<kind:int,parts:{PARTS}>"
#: Numbers and names of the kinds, as in well-known binary.
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = KINDS


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def number(c) -> Column:
    return col(c).cast("double")


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def total(values: Column) -> Column:
    """Sum of an array of doubles; 0 if empty."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def pairs(vertices: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of each two neighbouring vertices."""
    n = F.greatest(F.size(vertices) - 1, F.lit(0))
    return F.zip_with(F.slice(vertices, F.lit(1), n), F.slice(vertices, F.lit(2), n), f)


# --- constructors ------------------------------------------------------------------------------


def vertex(x, y, z=None, m=None) -> Column:
    other = lambda c: F.lit(None).cast("double") if c is None else number(c)
    return F.struct(number(x).alias("x"), number(y).alias("y"), other(z).alias("z"), other(m).alias("m"))


def geometry(kind: int, parts: Column) -> Column:
    return F.when(parts.isNotNull(), F.struct(F.lit(kind).alias("kind"), parts.cast(PARTS).alias("parts"))).cast(GEOMETRY)


def empty(kind: int) -> Column:
    return geometry(kind, F.array().cast(PARTS))


def point(x, y, z=None, m=None) -> Column:
    """A point; missing if x or y is, empty if both are NaN."""
    x, y = number(x), number(y)
    made = geometry(POINT, F.array(F.array(F.array(vertex(x, y, z, m)))))
    return F.when(F.isnan(x) & F.isnan(y), empty(POINT)).when(x.isNotNull() & y.isNotNull(), made)


def line_string(vertices) -> Column:
    v = col(vertices)
    bad = F.raise_error(F.lit("a line needs two vertices or none")).cast(GEOMETRY)
    return F.when(F.size(v) == 1, bad).when(F.size(v) == 0, empty(LINE)).otherwise(geometry(LINE, F.array(F.array(v))))


def closed(ring: Column) -> Column:
    """The ring with its first vertex again at its end, unless it is there."""

    def close(ring):
        a, b = F.element_at(ring, 1), F.element_at(ring, -1)
        return F.when(F.size(ring) == 0, ring).when((a["x"] == b["x"]) & (a["y"] == b["y"]), ring).otherwise(F.concat(ring, F.array(a)))

    return let(ring, close)


def polygon(shell, holes=None) -> Column:
    rings = F.array(closed(col(shell)))
    if holes is not None:
        rings = F.concat(rings, F.transform(col(holes), closed))
    bad = F.raise_error(F.lit("a ring needs at least four vertices, first and last equal")).cast(GEOMETRY)
    return let(rings, lambda made: F.when(F.exists(made, lambda r: F.size(r) < 4), bad).otherwise(geometry(POLYGON, F.array(made))))


def multi_point(vertices) -> Column:
    return geometry(MULTIPOINT, F.transform(col(vertices), lambda v: F.array(F.array(v))))


def multi_line_string(lines) -> Column:
    return geometry(MULTILINE, F.transform(col(lines), lambda v: F.array(v)))


def multi_polygon(polygons) -> Column:
    return geometry(MULTIPOLYGON, F.transform(col(polygons), lambda rings: F.transform(rings, closed)))


def box(minx, miny, maxx, maxy, *, ccw: bool = True) -> Column:
    a, b, c, d = map(number, (minx, miny, maxx, maxy))
    ring = [vertex(a, b), vertex(c, b), vertex(c, d), vertex(a, d), vertex(a, b)]
    return geometry(POLYGON, F.array(F.array(F.array(*(ring if ccw else ring[::-1])))))


def line_from_rows(order, x, y, z=None, m=None) -> Column:
    """Aggregate: a line through the group's vertices in the order given."""
    sort = F.sort_array(F.collect_list(F.struct(col(order).alias("o"), vertex(x, y, z, m).alias("v"))))
    return line_string(F.transform(sort, lambda s: s["v"]))


# --- accessors ---------------------------------------------------------------------------------


def kind(g) -> Column:
    return col(g)["kind"]


def geometry_type(g) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), kind(g))


def parts(g) -> Column:
    return col(g)["parts"]


def rings(g) -> Column:
    return F.flatten(parts(g))


def vertices(g) -> Column:
    """All vertices, closing ones too."""
    return F.flatten(rings(g))


def is_empty(g) -> Column:
    return F.size(vertices(g)) == 0


def dimension(g) -> Column:
    """0, 1 or 2."""
    return F.when(kind(g).isin(POINT, MULTIPOINT), 0).when(kind(g).isin(LINE, MULTILINE), 1).otherwise(2)


def num_geometries(g) -> Column:
    return F.size(parts(g))


def num_coordinates(g) -> Column:
    return F.size(vertices(g))


def num_rings(g) -> Column:
    return F.when(dimension(g) == 2, F.size(rings(g))).otherwise(0)


def num_interior_rings(g) -> Column:
    return F.when(dimension(g) == 2, F.size(rings(g)) - F.size(parts(g))).otherwise(0)


def _first(g) -> Column:
    return F.get(vertices(g), F.lit(0))


def x(g) -> Column:
    return F.when(kind(g) == POINT, _first(g)["x"])


def y(g) -> Column:
    return F.when(kind(g) == POINT, _first(g)["y"])


def z(g) -> Column:
    return F.when(kind(g) == POINT, _first(g)["z"])


def m(g) -> Column:
    return F.when(kind(g) == POINT, _first(g)["m"])


def has_z(g) -> Column:
    return F.coalesce(_first(g)["z"].isNotNull(), F.lit(False))


def has_m(g) -> Column:
    return F.coalesce(_first(g)["m"].isNotNull(), F.lit(False))


def _point_of(v: Column) -> Column:
    return F.when(v.isNotNull(), geometry(POINT, F.array(F.array(F.array(v)))))


def start_point(g) -> Column:
    return F.when(kind(g) == LINE, _point_of(_first(g)))


def end_point(g) -> Column:
    return F.when(kind(g) == LINE, _point_of(F.get(vertices(g), F.size(vertices(g)) - 1)))


def point_n(g, n) -> Column:
    """The vertex of number n of a line, from 0, as a point; from the end if negative; null beyond."""
    n, v = col(n), vertices(g)
    return F.when(kind(g) == LINE, _point_of(F.get(v, F.when(n < 0, F.size(v) + n).otherwise(n))))


def exterior_ring(g) -> Column:
    return F.when(kind(g) == POLYGON, geometry(LINE, F.array(F.array(F.get(rings(g), F.lit(0))))))


def interior_rings(g) -> Column:
    """An array of closed lines."""
    return F.when(kind(g) == POLYGON, F.transform(F.slice(rings(g), 2, F.greatest(F.size(rings(g)) - 1, F.lit(0))), lambda r: geometry(LINE, F.array(F.array(r)))))


def geometries(g) -> Column:
    """The parts as single geometries."""
    one = F.when(kind(g) > 3, kind(g) - 3).otherwise(kind(g))
    return F.transform(parts(g), lambda p: F.struct(one.cast("int").alias("kind"), F.array(p).alias("parts")))


def is_closed(g) -> Column:
    """Whether every part's first and last vertex agree; points are closed."""
    same = lambda r: (F.element_at(r, 1)["x"] == F.element_at(r, -1)["x"]) & (F.element_at(r, 1)["y"] == F.element_at(r, -1)["y"])
    return ~is_empty(g) & F.forall(rings(g), same)


def bounds(g) -> Column:
    """minx, miny, maxx, maxy; null fields for an empty geometry."""
    v = vertices(g)
    low, high = (lambda k: F.array_min(F.transform(v, lambda p: p[k]))), (lambda k: F.array_max(F.transform(v, lambda p: p[k])))
    return F.when(col(g).isNotNull(), F.struct(low("x").alias("minx"), low("y").alias("miny"), high("x").alias("maxx"), high("y").alias("maxy")))


def value_range(g, axis: str) -> Column:
    """Struct min, max of z or m."""
    v = F.filter(F.transform(vertices(g), lambda p: p[axis]), lambda c: c.isNotNull())
    return F.struct(F.array_min(v).alias("min"), F.array_max(v).alias("max"))


def envelope(g) -> Column:
    b = bounds(g)
    return F.when(is_empty(g), empty(POLYGON)).otherwise(box(b["minx"], b["miny"], b["maxx"], b["maxy"]))


def unique_points(g) -> Column:
    return multi_point(F.array_distinct(vertices(g)))


def reverse(g) -> Column:
    return map_rings(g, F.reverse)


def map_rings(g, f: Callable[[Column], Column]) -> Column:
    g = col(g)
    return F.when(g.isNotNull(), F.struct(g["kind"].alias("kind"), F.transform(g["parts"], lambda p: F.transform(p, f)).alias("parts"))).cast(GEOMETRY)


def map_vertices(g, f: Callable[[Column], Column]) -> Column:
    return map_rings(g, lambda r: F.transform(r, f))


def moved(v: Column, x: Column, y: Column, z: Column | None = None) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), (v["z"] if z is None else z).alias("z"), v["m"].alias("m"))


def force_2d(g) -> Column:
    return map_vertices(g, lambda v: vertex(v["x"], v["y"]))


def force_z(g, value=0.0) -> Column:
    return map_vertices(g, lambda v: vertex(v["x"], v["y"], F.coalesce(v["z"], number(value)), v["m"]))


def force_m(g, value=0.0) -> Column:
    return map_vertices(g, lambda v: vertex(v["x"], v["y"], v["z"], F.coalesce(v["m"], number(value))))


def swap_xy(g) -> Column:
    return map_vertices(g, lambda v: moved(v, v["y"], v["x"]))


def to_multi(g) -> Column:
    g = col(g)
    return F.when(g.isNotNull(), F.struct(F.when(g["kind"] <= 3, g["kind"] + 3).otherwise(g["kind"]).cast("int").alias("kind"), g["parts"].alias("parts")))


# --- missing rows, ordinates and copies of them -------------------------------------------------


def coordinate_axes(g) -> Column:
    """XY, XYZ, XYM or XYZM."""
    return F.when(col(g).isNotNull(), F.concat(F.lit("XY"), F.when(has_z(g), "Z").otherwise(""), F.when(has_m(g), "M").otherwise("")))


def is_missing(g) -> Column:
    return col(g).isNull()


def fill_missing(g, value) -> Column:
    return F.coalesce(col(g), col(value))


def nbytes(g) -> Column:
    """Bytes of the ordinates that a geometry has, 8 each."""
    return num_coordinates(g) * 8 * (2 + has_z(g).cast("int") + has_m(g).cast("int"))


def bounds_3d(g) -> Column:
    """Struct minx, miny, minz, maxx, maxy, maxz; null z where no vertex has one."""
    b, z = bounds(g), value_range(g, "z")
    return F.struct(b["minx"].alias("minx"), b["miny"].alias("miny"), z["min"].alias("minz"), b["maxx"].alias("maxx"), b["maxy"].alias("maxy"), z["max"].alias("maxz"))


def set_z(g, z) -> Column:
    """Every vertex with this height."""
    return map_vertices(g, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), number(z).alias("z"), v["m"].alias("m")))


def set_m(g, m) -> Column:
    """Every vertex with this measure."""
    return map_vertices(g, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), v["z"].alias("z"), number(m).alias("m")))


def coordinates(g, axes: str = "XY") -> Column:
    """Array of arrays of the ordinates asked for, vertex by vertex; NaN where a vertex has none."""
    nan = F.lit(float("nan"))
    return F.transform(vertices(g), lambda v: F.array(*[F.coalesce(v[a.lower()], nan) for a in axes]))


def set_coordinates(g, xy) -> Column:
    """The same structure with the vertices of an array of (x, y), in order; raises if their numbers differ."""
    g, xy = col(g), col(xy)
    bad = F.raise_error(F.lit("as many coordinates as vertices are needed")).cast(GEOMETRY)

    def go(k):
        ring_starts = F.transform(F.sequence(F.lit(0), F.size(k["r"]) - 1), lambda i: F.aggregate(F.slice(k["r"], F.lit(1), i), F.lit(0), lambda a, r: a + F.size(r)))
        part_starts = F.transform(F.sequence(F.lit(0), F.size(k["p"]) - 1), lambda i: F.aggregate(F.slice(k["p"], F.lit(1), i), F.lit(0), lambda a, p: a + F.size(p)))
        new = lambda v, at: F.struct(F.get(k["xy"], at)[0].alias("x"), F.get(k["xy"], at)[1].alias("y"), v["z"].alias("z"), v["m"].alias("m"))
        return F.transform(k["p"], lambda p, i: F.transform(p, lambda r, j: F.transform(r, lambda v, n: new(v, F.get(ring_starts, F.get(part_starts, i) + j) + n))))

    parts_ = let(F.struct(parts(g).alias("p"), rings(g).alias("r"), xy.alias("xy")), go)
    made = F.struct(g["kind"].alias("kind"), parts_.alias("parts")).cast(GEOMETRY)
    return F.when(g.isNull(), F.lit(None).cast(GEOMETRY)).when(is_empty(g), g).when(F.size(xy) != num_coordinates(g), bad).otherwise(made)


def crosses_antimeridian(g) -> Column:
    """Whether two neighbouring vertices in degrees are nearer to each other over 180."""
    return F.coalesce(F.exists(rings(g), lambda r: F.exists(pairs(r, lambda a, b: F.abs(a["x"] - b["x"]) > 180), lambda k: k)), F.lit(False))
