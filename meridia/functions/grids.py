"""Spherical cells on a cube, covers of geometries by cells, and sets of cells of any grid."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cells as C
from . import geometry as G
from . import measures as M

#: The order of quarters along the curve on a face of the cube by its orientation, and how each turns it.
PLACE = ((0, 1, 3, 2), (0, 3, 1, 2), (2, 3, 1, 0), (2, 1, 3, 0))
QUARTER = ((0, 1, 3, 2), (0, 2, 3, 1), (3, 2, 0, 1), (3, 1, 0, 2))
TURN = (1, 0, 0, 3)
#: Mean radius of the Earth in metres, and cells along an edge of a face at the finest level.
RADIUS, SIDE = 6371008.771415, 1 << 30


def _pick(table, row: Column, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for r in table for v in r]), (row * 4 + at).cast("int"))


def _curve(u: Column) -> Column:
    """Place on a face's edge, 0 to 1, of a tangent."""
    return F.when(u >= 0, 0.5 * F.sqrt(1 + 3 * u)).otherwise(1 - 0.5 * F.sqrt(1 - 3 * u))


def _tangent(s: Column) -> Column:
    return F.when(s >= 0.5, (4 * s * s - 1) / 3).otherwise((1 - 4 * (1 - s) * (1 - s)) / 3)


def _face_of(x: Column, y: Column, z: Column) -> Column:
    """Struct f, u, v of a direction."""

    def go(p):
        ax, ay, az = F.abs(p["x"]), F.abs(p["y"]), F.abs(p["z"])
        axis = F.when((ax > ay) & (ax > az), 0).when(ay > az, 1).otherwise(2)
        lead = F.when(axis == 0, p["x"]).when(axis == 1, p["y"]).otherwise(p["z"])
        f = axis + F.when(lead < 0, 3).otherwise(0)
        u = F.when(f == 0, p["y"] / p["x"]).when(f == 1, -p["x"] / p["y"]).when(f == 2, -p["x"] / p["z"]).when(f == 3, p["z"] / p["x"]).when(f == 4, p["z"] / p["y"]).otherwise(-p["y"] / p["z"])
        v = F.when(f == 0, p["z"] / p["x"]).when(f == 1, p["z"] / p["y"]).when(f == 2, -p["y"] / p["z"]).when(f == 3, p["y"] / p["x"]).when(f == 4, -p["x"] / p["y"]).otherwise(-p["x"] / p["z"])
        return F.struct(f.alias("f"), u.alias("u"), v.alias("v"))

    return G.let(F.struct(x.alias("x"), y.alias("y"), z.alias("z")), go)


def _direction(f: Column, u: Column, v: Column) -> Column:
    """Struct x, y, z of a place on the cube."""
    one = F.lit(1.0)
    x = F.when(f == 0, one).when(f == 1, -u).when(f == 2, -u).when(f == 3, -one).when(f == 4, v).otherwise(v)
    y = F.when(f == 0, u).when(f == 1, one).when(f == 2, -v).when(f == 3, -v).when(f == 4, -one).otherwise(u)
    z = F.when(f == 0, v).when(f == 1, v).when(f == 2, one).when(f == 3, -u).when(f == 4, -u).otherwise(-one)
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def _lonlat(p: Column) -> Column:
    return F.struct(F.degrees(F.atan2(p["y"], p["x"])).alias("lon"), F.degrees(F.atan2(p["z"], F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]))).alias("lat"))


def _grid(s: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(SIDE - 1), F.floor(s * float(SIDE)))).cast("long")


def _leaf(f: Column, i: Column, j: Column) -> Column:
    """Number of the finest cell at a place of a face."""

    def go(a, k):
        bit = lambda v: F.call_function("shiftright", v, k).bitwiseAND(F.lit(1).cast("long"))
        at = _pick(PLACE, a["o"], bit(a["i"]) * 2 + bit(a["j"]))
        return F.struct(a["i"].alias("i"), a["j"].alias("j"), a["o"].bitwiseXOR(F.get(F.array(*map(F.lit, TURN)), at)).alias("o"), F.shiftleft(a["v"], 2).bitwiseOR(at.cast("long")).alias("v"))

    start = F.struct(i.alias("i"), j.alias("j"), f.bitwiseAND(F.lit(1)).cast("int").alias("o"), f.cast("long").alias("v"))
    return F.aggregate(F.sequence(F.lit(29), F.lit(0), F.lit(-1)), start, go, lambda a: F.shiftleft(a["v"], 1).bitwiseOR(F.lit(1).cast("long")))


def s2_cell(lon, lat, level: int = 30) -> Column:
    """The number of the cell of a level that holds a point; null beyond the poles."""
    x, y = F.radians(G.number(lon)), F.radians(G.number(lat))
    face = _face_of(F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y))
    leaf = G.let(face, lambda p: _leaf(p["f"], _grid(_curve(p["u"])), _grid(_curve(p["v"]))))
    return F.when(F.abs(G.number(lat)) <= 90, s2_parent(leaf, level) if level < 30 else leaf)


def s2_lsb(c) -> Column:
    c = G.col(c)
    return c.bitwiseAND(-c)


def s2_level(c) -> Column:
    return (30 - F.bit_count(s2_lsb(c) - 1) / 2).cast("int")


def s2_parent(c, level) -> Column:
    """The cell of a coarser level around a cell; null if it isn't coarser."""
    c, low = G.col(c), F.call_function("shiftleft", F.lit(1).cast("long"), (30 - G.col(level)).cast("int") * 2)
    return F.when(low >= s2_lsb(c), c.bitwiseAND(-low).bitwiseOR(low)) if not isinstance(level, int) or level > 0 else c.bitwiseAND(-low).bitwiseOR(low)


def s2_children(c) -> Column:
    """The four cells of the next level, along the curve."""
    return G.let(F.struct(G.col(c).alias("c"), s2_lsb(c).alias("l")), lambda p: F.when(p["l"] > 1, F.array(*[p["c"] - p["l"] + (2 * k + 1) * F.shiftright(p["l"], 2) for k in range(4)])))


def s2_token(c) -> Column:
    return F.when(G.col(c) == 0, "X").otherwise(F.rtrim(F.lower(F.lpad(F.hex(G.col(c)), 16, "0")), F.lit("0")))


def s2_from_token(token) -> Column:
    return F.conv(F.rpad(G.col(token), 16, "0"), 16, -10).cast("long")


def s2_parts(c) -> Column:
    """Struct f, i, j, size: the face, and the lower corner and side of the cell in finest cells."""

    def go(a, k):
        at = F.call_function("shiftright", a["c"], 2 * k + 1).bitwiseAND(F.lit(3).cast("long")).cast("int")
        ij = _pick(QUARTER, a["o"], at)
        inside = k >= a["stop"]
        return F.struct(a["c"].alias("c"), a["stop"].alias("stop"), a["o"].bitwiseXOR(F.get(F.array(*map(F.lit, TURN)), at)).alias("o"), (a["i"] * 2 + F.when(inside, F.shiftright(ij, 1)).otherwise(0)).cast("long").alias("i"), (a["j"] * 2 + F.when(inside, ij.bitwiseAND(F.lit(1))).otherwise(0)).cast("long").alias("j"))

    c = G.col(c)
    f = F.shiftrightunsigned(c, 61).cast("int")
    zero = F.lit(0).cast("long")
    start = F.struct(c.alias("c"), (30 - s2_level(c)).alias("stop"), f.bitwiseAND(F.lit(1)).alias("o"), zero.alias("i"), zero.alias("j"))
    return F.aggregate(F.sequence(F.lit(29), F.lit(0), F.lit(-1)), start, go, lambda a: F.struct(f.alias("f"), a["i"].alias("i"), a["j"].alias("j"), F.call_function("shiftleft", F.lit(1).cast("long"), a["stop"]).alias("size")))


def _corner(p: Column, di: float, dj: float) -> Column:
    at = lambda v, d: _tangent((v + p["size"] * d) / float(SIDE))
    return _direction(p["f"], at(p["i"], di), at(p["j"], dj))


def s2_center(c) -> Column:
    """Struct lon, lat."""
    return G.let(G.let(s2_parts(c), lambda p: _corner(p, 0.5, 0.5)), _lonlat)


def s2_polygon(c) -> Column:
    """The cell's four corners as a polygon in degrees; a cell over the seam or a pole has corners on both sides."""
    corners = G.let(s2_parts(c), lambda p: F.array(*[G.let(_corner(p, i, j), _lonlat) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))]))
    return G.polygon(F.transform(corners, lambda k: G.vertex(k["lon"], k["lat"])))


def s2_area(c) -> Column:
    """Square metres on the sphere, of two triangles."""

    def side(a, b):
        return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]) + (a["z"] - b["z"]) * (a["z"] - b["z"]))

    def unit(p):
        n = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"])
        return F.struct((p["x"] / n).alias("x"), (p["y"] / n).alias("y"), (p["z"] / n).alias("z"))

    def triangle(a, b, c_):
        def go(s):
            half = (s["a"] + s["b"] + s["c"]) / 2
            t = F.tan(half / 2) * F.tan((half - s["a"]) / 2) * F.tan((half - s["b"]) / 2) * F.tan((half - s["c"]) / 2)
            return 4 * F.atan(F.sqrt(F.greatest(t, F.lit(0.0))))

        arc = lambda p, q: 2 * F.asin(F.least(F.lit(1.0), side(p, q) / 2))
        return G.let(F.struct(arc(a, b).alias("a"), arc(b, c_).alias("b"), arc(c_, a).alias("c")), go)

    corners = G.let(s2_parts(c), lambda p: F.array(*[G.let(_corner(p, i, j), unit) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))]))
    return G.let(corners, lambda k: (triangle(k[0], k[1], k[2]) + triangle(k[0], k[2], k[3])) * RADIUS * RADIUS)


def s2_neighbors(c) -> Column:
    """The four cells across the edges, of the same level."""

    def around(p):
        half = p["size"] / 2

        def cell(di, dj):
            # the middle of the neighbour, a little over the edge of the face where it lies on another one; all by straight lines, as only the cell counts
            place = lambda v, d: F.greatest(F.lit(-1.0 - 1e-9), F.least(F.lit(1.0 + 1e-9), 2 * (v + half + p["size"] * d) / float(SIDE) - 1))
            at = G.let(_direction(p["f"], place(p["i"], di), place(p["j"], dj)), lambda q: _face_of(q["x"], q["y"], q["z"]))
            return G.let(at, lambda k: _leaf(k["f"], _grid((k["u"] + 1) / 2), _grid((k["v"] + 1) / 2)))

        return F.array(*[cell(di, dj) for di, dj in ((0, -1), (1, 0), (0, 1), (-1, 0))])

    level = s2_level(c)
    return F.transform(G.let(s2_parts(c), around), lambda k: s2_parent(k, level))


def s2_contains(a, b) -> Column:
    a, b = G.col(a), G.col(b)
    # numbers above 2^63 are negative: compared with the sign bit turned
    flip = lambda v: v.bitwiseXOR(F.lit(-(1 << 63)))
    return (flip(b) >= flip(a - (s2_lsb(a) - 1))) & (flip(b) <= flip(a + (s2_lsb(a) - 1)))


def s2_intersects(a, b) -> Column:
    return s2_contains(a, b) | s2_contains(b, a)


# --- tiles and geohash -------------------------------------------------------------------------


def _meets(a: Column, b: Column, box: Column, open_: bool) -> Column:
    """Whether a segment meets a box, or with open_ its inside."""
    turn = lambda x, y: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
    turns = F.array(*[turn(box[x], box[y]) for x in ("minx", "maxx") for y in ("miny", "maxy")])
    less = (lambda p, q: p < q) if open_ else (lambda p, q: p <= q)
    apart = lambda k: less(F.least(a[k], b[k]), box[f"max{k}"]) & less(box[f"min{k}"], F.greatest(a[k], b[k]))
    flat = (lambda k: (a[k] == b[k]) & (a[k] > box[f"min{k}"]) & (a[k] < box[f"max{k}"])) if open_ else None
    near = (apart("x") | flat("x")) & (apart("y") | flat("y")) if open_ else apart("x") & apart("y")
    return near & less(F.array_min(turns), F.lit(0.0)) & less(F.lit(0.0), F.array_max(turns))


def keeps(g, box: Column, rule: str) -> Column:
    """Whether a cell's box belongs to a geometry's cover: bbox, overlap (any common point), center, or within."""
    g, dimension = G.col(g), G.dimension(g)
    edges = F.flatten(F.transform(G.rings(g), lambda r: G.pairs(r, lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    cx, cy = (box["minx"] + box["maxx"]) / 2, (box["miny"] + box["maxy"]) / 2
    middle = M.contains_xy(g, cx, cy)
    inside = lambda v: (v["x"] >= box["minx"]) & (v["x"] <= box["maxx"]) & (v["y"] >= box["miny"]) & (v["y"] <= box["maxy"])
    if rule == "bbox":
        return F.lit(True)
    if rule == "overlap":
        return F.when(dimension == 0, F.exists(G.vertices(g), inside)).otherwise(F.exists(edges, lambda e: _meets(e["a"], e["b"], box, False)) | ((dimension == 2) & middle))
    if rule == "center":
        return (dimension == 2) & middle
    if rule == "within":
        return (dimension == 2) & middle & ~F.exists(edges, lambda e: _meets(e["a"], e["b"], box, True))
    raise ValueError("rule is bbox, overlap, center or within")


def tile_cover(g, zoom: int, *, rule: str = "overlap", max_cells: int = 1_000_000) -> Column:
    """Array of tile ids that cover a geometry in degrees; raises where its bounds hold more than max_cells."""
    top = math.degrees(math.atan(math.sinh(math.pi)))
    cut = lambda c: F.greatest(F.lit(-top), F.least(F.lit(top), c))
    found = G.let(G.bounds(g), lambda b: C.tile_cover(b["minx"], cut(b["miny"]), b["maxx"], cut(b["maxy"]), zoom, max_cells=max_cells))
    chosen = F.filter(found, lambda t: G.let(C.tile_bounds(t["x"], t["y"], F.lit(zoom)), lambda box: keeps(g, box, rule)))
    return F.transform(chosen, lambda t: C.tile_id(t["x"], t["y"], F.lit(zoom)))


def geohash_cover(g, precision: int, *, rule: str = "overlap", max_cells: int = 1_000_000) -> Column:
    """Array of geohashes that cover a geometry in degrees; raises where its bounds hold more than max_cells."""
    nx, ny = (5 * precision + 1) // 2, 5 * precision // 2
    wide, high = 360.0 / 2**nx, 180.0 / 2**ny
    at = lambda v, low, size, n: F.greatest(F.lit(0), F.least(F.lit(2**n - 1), F.floor((v - low) / size))).cast("long")

    def made(b):
        x0, x1, y0, y1 = at(b["minx"], -180.0, wide, nx), at(b["maxx"], -180.0, wide, nx), at(b["miny"], -90.0, high, ny), at(b["maxy"], -90.0, high, ny)
        all_ = F.flatten(F.transform(F.sequence(x0, x1), lambda x: F.transform(F.sequence(y0, y1), lambda y: F.struct(x.alias("x"), y.alias("y")))))
        return F.when((x1 - x0 + 1) * (y1 - y0 + 1) > max_cells, F.raise_error(F.lit("too many cells")).cast("array<struct<x:bigint,y:bigint>>")).otherwise(all_)

    box = lambda k: F.struct((k["x"] * wide - 180.0).alias("minx"), (k["y"] * high - 90.0).alias("miny"), ((k["x"] + 1) * wide - 180.0).alias("maxx"), ((k["y"] + 1) * high - 90.0).alias("maxy"))
    chosen = F.filter(G.let(G.bounds(g), made), lambda k: G.let(box(k), lambda q: keeps(g, q, rule)))
    return F.transform(chosen, lambda k: C.geohash((k["x"] + 0.5) * wide - 180.0, (k["y"] + 0.5) * high - 90.0, precision))


def box_polygon(b: Column) -> Column:
    return G.box(b["minx"], b["miny"], b["maxx"], b["maxy"])


def tile_polygon(tile) -> Column:
    return G.let(C.tile_parts(tile), lambda p: G.let(C.tile_bounds(p["x"], p["y"], p["z"]), box_polygon))


def geohash_polygon(code) -> Column:
    return G.let(C.geohash_bounds(code), box_polygon)


def box_center(b: Column) -> Column:
    return F.struct(((b["minx"] + b["maxx"]) / 2).alias("lon"), ((b["miny"] + b["maxy"]) / 2).alias("lat"))


def geohash_center(code) -> Column:
    return G.let(C.geohash_bounds(code), box_center)


def tile_center(tile) -> Column:
    """The middle of a tile on the map, so by its rows' middle and not by the mean of its latitudes."""
    return G.let(C.tile_parts(tile), lambda p: G.let(C.tile_bounds(p["x"] + 0.5, p["y"] + 0.5, p["z"]), lambda b: F.struct(b["minx"].alias("lon"), b["maxy"].alias("lat"))))


def box_area(b: Column) -> Column:
    """Square metres on the sphere of a box in degrees."""
    return RADIUS * RADIUS * F.radians(b["maxx"] - b["minx"]) * (F.sin(F.radians(b["maxy"])) - F.sin(F.radians(b["miny"])))


def geohash_bounding_cell(g) -> Column:
    """The finest geohash that holds a geometry; empty if only the world does, null for missing and empty ones."""

    def common(b):
        low, high = C.geohash(b["minx"], b["miny"]), C.geohash(b["maxx"], b["maxy"])
        same = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, i: F.struct((a["n"] + F.when(a["on"] & (F.substring(low, i, F.lit(1)) == F.substring(high, i, F.lit(1))), 1).otherwise(0)).alias("n"), (a["on"] & (F.substring(low, i, F.lit(1)) == F.substring(high, i, F.lit(1)))).alias("on")), lambda a: a["n"])
        return F.when(b["minx"].isNotNull(), F.substring(low, F.lit(1), same))

    return G.let(G.bounds(g), common)


def tile_bounding_cell(g, *, zoom: int = 29) -> Column:
    """The id of the deepest tile, to `zoom`, that holds a geometry; null for missing, empty and too polar ones."""

    def common(b):
        x0, x1, y0, y1 = C.tile_x(b["minx"], zoom), C.tile_x(b["maxx"], zoom), C.tile_y(b["maxy"], zoom), C.tile_y(b["miny"], zoom)
        bits = lambda p, q: F.length(F.regexp_replace(F.bin(p.bitwiseXOR(q)), "^0+", ""))
        up = F.greatest(bits(x0, x1), bits(y0, y1))
        return C.tile_id(F.call_function("shiftright", x0, up), F.call_function("shiftright", y0, up), F.lit(zoom) - up)

    return G.let(G.bounds(g), common)


# --- sets of cells -----------------------------------------------------------------------------


class Grid:
    """What sets need to know of a grid: a cell's parent (None at the top) and its children."""

    def __init__(self, type: str, parent: Callable, children: Callable):
        self.type, self.parent, self.children = type, parent, children


def _s2_up(c: int) -> int | None:
    low = c & -c
    if low >= 1 << 60:
        return None
    out = ((c & (1 << 64) - 1) & -(low << 2)) | (low << 2)
    return out - (1 << 64) if out >= 1 << 63 else out


def _s2_down(c: int) -> list[int]:
    low = c & -c
    return [c - low + (2 * k + 1) * (low >> 2) for k in range(4)] if low > 1 else []


def _tile_up(t: int) -> int | None:
    z = t >> 58
    return ((z - 1) << 58) | ((t & (1 << 58) - 1) >> 2) if z else None


def _tile_down(t: int) -> list[int]:
    z = t >> 58
    return [((z + 1) << 58) | ((t & (1 << 58) - 1) << 2 | k) for k in range(4)]


GEOHASH = Grid("string", lambda c: c[:-1] if len(c) > 1 else None, lambda c: [c + k for k in C.GEOHASH])
TILE = Grid("bigint", _tile_up, _tile_down)
S2 = Grid("bigint", _s2_up, _s2_down)


def _above(grid: Grid, c):
    while (c := grid.parent(c)) is not None:
        yield c


def compact_cells(grid: Grid, cells) -> list:
    """The same area by the fewest cells: none within another, and complete families as their parent."""
    have = set(cells)
    have = {c for c in have if not any(p in have for p in _above(grid, c))}
    while True:
        full = {p for p in {grid.parent(c) for c in have} - {None} if all(k in have for k in grid.children(p))}
        if not full:
            return sorted(have)
        have = {c for c in have if grid.parent(c) not in full} | full


def _level(grid: Grid, c) -> int:
    return sum(1 for _ in _above(grid, c))


def expand_cells(grid: Grid, cells, level: int) -> list:
    """Cells of one level in place of coarser ones; those that are finer stay."""
    out, todo = set(), list(set(cells))
    while todo:
        c = todo.pop()
        if _level(grid, c) >= level:
            out.add(c)
        else:
            todo += grid.children(c)
    return sorted(out)


def combine_cells(grid: Grid, a, b, how: str) -> list:
    a, b = set(a), set(b)
    if how == "union":
        return compact_cells(grid, a | b)
    within = lambda c, s: c in s or any(p in s for p in _above(grid, c))
    if how == "intersection":
        return compact_cells(grid, {c for c in a if within(c, b)} | {c for c in b if within(c, a)})
    over = {p for c in b for p in _above(grid, c)}  # cells that hold something of b
    out, todo = set(), [c for c in a if not within(c, b)]
    while todo:
        c = todo.pop()
        if c in b:
            continue
        if c in over:
            todo += grid.children(c)
        else:
            out.add(c)
    return compact_cells(grid, out)


def _sets(grid: Grid, f: Callable, *columns) -> Column:
    """f over arrays of cells, in Arrow batches; null if any array is null, null cells left out."""
    made = F.udf(lambda *sets: None if any(s is None for s in sets) else f(*[[c for c in s if c is not None] for s in sets]), f"array<{grid.type}>", useArrow=True)
    return made(*map(G.col, columns))


def cell_union(grid: Grid, a, b) -> Column:
    return _sets(grid, lambda x, y: combine_cells(grid, x, y, "union"), a, b)


def cell_intersection(grid: Grid, a, b) -> Column:
    return _sets(grid, lambda x, y: combine_cells(grid, x, y, "intersection"), a, b)


def cell_difference(grid: Grid, a, b) -> Column:
    return _sets(grid, lambda x, y: combine_cells(grid, x, y, "difference"), a, b)


def compact(grid: Grid, cells) -> Column:
    return _sets(grid, lambda x: compact_cells(grid, x), cells)


def uncompact(grid: Grid, cells, level: int) -> Column:
    """Cells of a level; levels count from the coarsest, geohashes of one letter or the whole world's tile being 0."""
    return _sets(grid, lambda x: expand_cells(grid, x, level), cells)


def geohash_contains(a, b) -> Column:
    return G.col(b).startswith(G.col(a))


def tile_contains(a, b) -> Column:
    return G.let(F.struct(C.tile_parts(a).alias("a"), C.tile_parts(b).alias("b")), lambda p: (p["a"]["z"] <= p["b"]["z"]) & (F.call_function("shiftright", p["b"]["x"], F.greatest(p["b"]["z"] - p["a"]["z"], F.lit(0))) == p["a"]["x"]) & (F.call_function("shiftright", p["b"]["y"], F.greatest(p["b"]["z"] - p["a"]["z"], F.lit(0))) == p["a"]["y"]))
