"""Discrete cells and point codes: tiles, quadkeys, geohash, curves, plus codes, short links."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G

#: Alphabets of the codes.
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"
PLUS = "23456789CFGHJMPQRVWX"
LINK = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_~"
#: Masks that spread 32 bits to the even places of 64.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _long(c) -> Column:
    return G.col(c).cast("long")


def _widen(shift: int, mask: int):
    return lambda v: v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))


def _narrow(shift: int, mask: int):
    return lambda v: v.bitwiseOR(F.shiftrightunsigned(v, shift)).bitwiseAND(F.lit(mask))


def spread_bits(c: Column) -> Column:
    for shift, mask in SPREAD:
        c = G.let(c, _widen(shift, mask))
    return c


def gather_bits(c: Column) -> Column:
    c = c.bitwiseAND(F.lit(SPREAD[-1][1]))
    for (shift, _), mask in zip(SPREAD[::-1], [m for _, m in SPREAD[-2::-1]] + [0xFFFFFFFF]):
        c = G.let(c, _narrow(shift, mask))
    return c


def morton(x: Column, y: Column) -> Column:
    """Interleaved bits, x in the even places."""
    return spread_bits(_long(x)).bitwiseOR(F.shiftleft(spread_bits(_long(y)), 1))


def hilbert(x: Column, y: Column, order: int) -> Column:
    """Index on the Hilbert curve of 2^order cells a side."""

    def go(acc, i):
        s = F.pow(F.lit(2.0), i).cast("long")
        rx, ry = (acc["x"].bitwiseAND(s) > 0).cast("long"), (acc["y"].bitwiseAND(s) > 0).cast("long")
        d = acc["d"] + s * s * (3 * rx).bitwiseXOR(ry)
        flip = (ry == 0) & (rx == 1)
        mx, my = acc["x"].bitwiseAND(s - 1), acc["y"].bitwiseAND(s - 1)
        fx, fy = F.when(flip, s - 1 - mx).otherwise(mx), F.when(flip, s - 1 - my).otherwise(my)
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    start = F.struct(_long(x).alias("x"), _long(y).alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.sequence(F.lit(order - 1), F.lit(0), F.lit(-1)), start, go, lambda acc: acc["d"])


def curve_cell(v: Column, low, high, level: int) -> Column:
    """Cell of a value on an axis that has 2^level of them."""
    top = float(2**level - 1)
    low, high = G.number(low), G.number(high)
    t = (v / 2 - low / 2) / (high / 2 - low / 2) * top
    return F.when(high == low, 0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(top), t))).cast("long")


def spatial_key(g, minx, miny, maxx, maxy, *, level: int = 16, curve: str = "hilbert") -> Column:
    """Curve index of the middle of the bounds, within a frame; null for empty geometries."""
    b = G.bounds(g)
    x, y = curve_cell((b["minx"] + b["maxx"]) / 2, minx, maxx, level), curve_cell((b["miny"] + b["maxy"]) / 2, miny, maxy, level)
    return morton(x, y) if curve == "morton" else hilbert(x, y, level)


# --- tiles -------------------------------------------------------------------------------------


def tile_x(lon, zoom: int) -> Column:
    n = 2**zoom
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((G.number(lon) + 180.0) / 360.0 * n))).cast("long")


def tile_y(lat, zoom: int) -> Column:
    """Null beyond the square world's latitudes."""
    n, y = 2**zoom, G.number(lat)
    t = (1.0 - F.log(F.tan(math.pi / 4 + F.radians(y) / 2)) / math.pi) / 2.0
    return F.when(F.abs(y) <= 85.0511287798066, F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(t * n)))).cast("long")


def tile_id(x, y, zoom) -> Column:
    """Zoom above, then x and y bits interleaved; one number for a tile of any zoom to 29."""
    return F.shiftleft(_long(zoom), 58).bitwiseOR(morton(x, y))


def tile_parts(tile) -> Column:
    low = lambda t: t.bitwiseAND(F.lit((1 << 58) - 1))
    return G.let(_long(tile), lambda t: F.struct(F.shiftrightunsigned(t, 58).cast("int").alias("z"), gather_bits(low(t)).alias("x"), gather_bits(F.shiftrightunsigned(low(t), 1)).alias("y")))


def tile_parent(tile) -> Column:
    return G.let(tile_parts(tile), lambda p: F.when(p["z"] > 0, tile_id(F.shiftright(p["x"], 1), F.shiftright(p["y"], 1), p["z"] - 1)))


def tile_children(tile) -> Column:
    return G.let(tile_parts(tile), lambda p: F.array(*[tile_id(p["x"] * 2 + i, p["y"] * 2 + j, p["z"] + 1) for j in (0, 1) for i in (0, 1)]))


def tile_neighbors(tile) -> Column:
    """Up to eight; x wraps around the world, y ends at its edges."""

    def around(p):
        n = F.pow(F.lit(2.0), p["z"]).cast("long")
        near = F.array(*[F.struct(F.pmod(p["x"] + i, n).alias("x"), (p["y"] + j).alias("y")) for j in (-1, 0, 1) for i in (-1, 0, 1) if i or j])
        near = F.filter(near, lambda q: (q["y"] >= 0) & (q["y"] < n) & ((q["x"] != p["x"]) | (q["y"] != p["y"])))
        return F.array_distinct(F.transform(near, lambda q: tile_id(q["x"], q["y"], p["z"])))

    return G.let(tile_parts(tile), around)


def tile_bounds(x, y, zoom) -> Column:
    n = F.pow(F.lit(2.0), G.number(zoom))
    lon = lambda c: c / n * 360.0 - 180.0
    lat = lambda c: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * c / n))))
    x, y = G.number(x), G.number(y)
    return F.struct(lon(x).alias("minx"), lat(y + 1).alias("miny"), lon(x + 1).alias("maxx"), lat(y).alias("maxy"))


def quadkey(x, y, zoom: int) -> Column:
    x, y = _long(x), _long(y)
    digit = lambda i: (F.shiftright(x, i).bitwiseAND(F.lit(1)) + 2 * F.shiftright(y, i).bitwiseAND(F.lit(1))).cast("string")
    return F.concat(F.lit(""), *[digit(i) for i in range(zoom - 1, -1, -1)])


def tile_cover(minx, miny, maxx, maxy, zoom: int, *, max_cells: int = 1_000_000) -> Column:
    """Array of struct x, y of the tiles that a box meets; raises beyond max_cells."""
    x0, x1, y0, y1 = tile_x(minx, zoom), tile_x(maxx, zoom), tile_y(maxy, zoom), tile_y(miny, zoom)
    made = F.flatten(F.transform(F.sequence(x0, x1), lambda x: F.transform(F.sequence(y0, y1), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return F.when((x1 - x0 + 1) * (y1 - y0 + 1) > max_cells, F.raise_error(F.lit("too many cells")).cast("array<struct<x:bigint,y:bigint>>")).otherwise(made)


# --- geohash -----------------------------------------------------------------------------------


def geohash(lon, lat, precision: int = 12) -> Column:
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    axis = lambda v, low, span, n: F.greatest(F.lit(0), F.least(F.lit(2**n - 1), F.floor((G.number(v) - low) / span * float(2**n)))).cast("long")
    x, y = axis(lon, -180.0, 360.0, nx), axis(lat, -90.0, 180.0, ny)
    # the first bit is one of x; with an odd number of bits x is in the even places from below
    code = morton(x, y) if bits % 2 else morton(y, x)
    return G.let(code, lambda v: F.concat(*[F.substring(F.lit(GEOHASH), F.shiftrightunsigned(v, bits - 5 * (i + 1)).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(precision)]))


def geohash_bounds(code) -> Column:
    """minx, miny, maxx, maxy of a geohash of at most 12 characters."""
    c = G.col(code)
    n = F.length(c) * 5
    long = F.lit(0).cast("long")
    value = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.instr(F.lit(GEOHASH), F.substring(c, i, F.lit(1))) - 1), long, lambda a, x: a * 32 + x)
    # of the bits from above, those at even places are of x
    axis = lambda v, at: F.aggregate(F.filter(F.sequence(F.lit(0), n - 1), lambda i: i % 2 == at), long, lambda a, i: a * 2 + F.call_function("shiftright", v, n - 1 - i).bitwiseAND(F.lit(1)))
    wide, high = 360.0 / F.pow(F.lit(2.0), F.ceil(n / 2)), 180.0 / F.pow(F.lit(2.0), F.floor(n / 2))
    cell = G.let(value, lambda v: F.struct(axis(v, 0).alias("x"), axis(v, 1).alias("y")))
    box = lambda k: F.struct((k["x"] * wide - 180.0).alias("minx"), (k["y"] * high - 90.0).alias("miny"), ((k["x"] + 1) * wide - 180.0).alias("maxx"), ((k["y"] + 1) * high - 90.0).alias("maxy"))
    return F.when(F.length(c) > 0, G.let(cell, box))


def geohash_parent(code) -> Column:
    c = G.col(code)
    return F.when(F.length(c) > 1, F.substring(c, F.lit(1), F.length(c) - 1))


def geohash_children(code) -> Column:
    return F.transform(F.array(*map(F.lit, GEOHASH)), lambda ch: F.concat(G.col(code), ch))


# --- codes -------------------------------------------------------------------------------------


def plus_code(lon, lat, length: int = 10) -> Column:
    """An open location code of 10 or 11 digits."""
    y = F.greatest(F.lit(0), F.least(F.lit(180 * 25_000_000 - 1), F.floor(F.round((G.number(lat) + 90) * 25_000_000, 6)))).cast("long")
    x = F.pmod(F.floor(F.round((G.number(lon) + 180) * 8_192_000, 6)), F.lit(360 * 8_192_000)).cast("long")
    digit = lambda v: F.substring(F.lit(PLUS), F.pmod(v, F.lit(20)).cast("int") + 1, F.lit(1))
    out = []
    for i in range(5):
        py, px = F.floor(y / (3125 * 20 ** (4 - i))), F.floor(x / (1024 * 20 ** (4 - i)))
        out += [digit(py), digit(px)] + ([F.lit("+")] if i == 3 else [])
    if length > 10:
        row, column = F.floor((y % 3125) / 625), F.floor((x % 1024) / 256)
        out.append(F.substring(F.lit(PLUS), (row * 4 + column).cast("int") + 1, F.lit(1)))
    return F.concat(*out)


def short_link(lon, lat, zoom: int) -> Column:
    """The map short link of a point: interleaved bits by six, then dashes for the rest of the zoom."""
    axis = lambda v, span: F.floor(v * (2.0**32 / span)).cast("long")
    x = F.pmod(axis(G.number(lon) + 180.0, 360.0), F.lit(1 << 32))
    y = F.least(F.lit((1 << 32) - 1), F.greatest(F.lit(0), axis(G.number(lat) + 90.0, 180.0)))
    code = F.shiftleft(spread_bits(x), 1).bitwiseOR(spread_bits(y))
    n = -(-(zoom + 8) // 3)
    return G.let(code, lambda v: F.concat(*[F.substring(F.lit(LINK), F.shiftrightunsigned(v, 58 - 6 * i).bitwiseAND(F.lit(63)).cast("int") + 1, F.lit(1)) for i in range(n)], F.lit("-" * ((zoom + 8) % 3))))


def _plus_digits(code: Column) -> Column:
    """A full code's digits without plus sign and padding."""
    return F.rtrim(F.replace(F.upper(code), F.lit("+"), F.lit("")), F.lit("0"))


def plus_code_bounds(code) -> Column:
    """Struct minx, miny, maxx, maxy of a full code of 2 to 15 digits, padded ones too; null for others."""
    def box(d):
        n = F.length(d)
        value = lambda i: F.instr(F.lit(PLUS), F.substring(d, i, F.lit(1))) - 1
        each = F.transform(F.sequence(F.lit(1), n), lambda i: value(i).cast("long"))
        paired = F.least(n, F.lit(10))
        # in units of the finest cell: 1 / 25,000,000 degree up, 1 / 8,192,000 degree across
        step = lambda i, last: F.pow(F.lit(20.0), 4 - F.floor((i - 1) / 2)) * float(last)
        up = F.aggregate(F.sequence(F.lit(1), paired), F.lit(0.0), lambda a, i: a + F.when(i % 2 == 1, F.get(each, i - 1) * step(i, 3125)).otherwise(0.0))
        across = F.aggregate(F.sequence(F.lit(1), paired), F.lit(0.0), lambda a, i: a + F.when(i % 2 == 0, F.get(each, i - 1) * step(i, 1024)).otherwise(0.0))
        fine = lambda a, i, size, part: a + F.when(i > 10, part(F.get(each, i - 1)) * float(size) / F.pow(F.lit(5.0 if size == 3125 else 4.0), i - 10)).otherwise(0.0)
        up = F.aggregate(F.sequence(F.lit(1), n), up, lambda a, i: fine(a, i, 3125, lambda v: F.floor(v / 4)))
        across = F.aggregate(F.sequence(F.lit(1), n), across, lambda a, i: fine(a, i, 1024, lambda v: v % 4))
        high = F.when(n > 10, 3125.0 / F.pow(F.lit(5.0), n - 10)).otherwise(3125.0 * F.pow(F.lit(20.0), 5 - F.ceil(n / 2)))
        wide = F.when(n > 10, 1024.0 / F.pow(F.lit(4.0), n - 10)).otherwise(1024.0 * F.pow(F.lit(20.0), 5 - F.ceil(n / 2)))
        x, y = (lambda v: v / 8_192_000 - 180), (lambda v: v / 25_000_000 - 90)
        return F.struct(x(across).alias("minx"), y(up).alias("miny"), x(across + wide).alias("maxx"), y(up + high).alias("maxy"))

    full = lambda c: c.rlike(r"^(?i)[2-9CFGHJMPQRVWX]{2,8}0*\+[2-9CFGHJMPQRVWX]*$") & (F.instr(c, "+") == 9)
    return G.let(G.col(code), lambda c: F.when(full(c), G.let(_plus_digits(c), box)))


def plus_code_shorten(code, lon, lat) -> Column:
    """A full code of at least 8 digits without the pairs that a point nearby tells."""

    def cut(k):
        box, c = k["b"], k["c"]
        out = c
        for pairs in (1, 2, 3, 4):  # 0.3 of the size of the area that the pairs left away span
            out = F.when(k["apart"] < 20.0 ** (2 - pairs) * 0.3, F.substring(c, F.lit(2 * pairs + 1), F.length(c))).otherwise(out)
        return F.when(~c.contains("0") & box.isNotNull(), out)

    apart = lambda k: F.greatest(F.abs((k["b"]["minx"] + k["b"]["maxx"]) / 2 - k["x"]), F.abs((k["b"]["miny"] + k["b"]["maxy"]) / 2 - k["y"]))
    at = G.let(F.upper(G.col(code)), lambda c: F.struct(c.alias("c"), plus_code_bounds(c).alias("b"), G.number(lon).alias("x"), G.number(lat).alias("y")))
    return G.let(G.let(at, lambda k: F.struct(k["c"].alias("c"), k["b"].alias("b"), apart(k).alias("apart"))), cut)


def plus_code_recover(code, lon, lat) -> Column:
    """The full code nearest to a point that a shortened one stands for; a full code as it is."""

    def near(k):
        size = F.pow(F.lit(20.0), 2 - k["missing"] / 2)
        x, y = (k["b"]["minx"] + k["b"]["maxx"]) / 2, (k["b"]["miny"] + k["b"]["maxy"]) / 2
        dy = F.when((k["y"] + size / 2 < y) & (y - size >= -90), -size).when((k["y"] - size / 2 > y) & (y + size <= 90), size).otherwise(0.0)
        dx = F.when(k["x"] + size / 2 < x, -size).when(k["x"] - size / 2 > x, size).otherwise(0.0)
        moved = G.let(F.struct((x + dx).alias("x"), (y + dy).alias("y")), lambda p: plus_code(p["x"], p["y"], 11))
        return F.when(k["missing"] <= 0, k["c"]).when(k["missing"] <= 8, F.substring(moved, F.lit(1), F.length(k["c"]) - 1 + k["missing"] + 1))

    start = G.let(F.upper(G.col(code)), lambda c: F.struct(c.alias("c"), (F.lit(9) - F.instr(c, "+")).alias("missing"), G.number(lon).alias("x"), F.greatest(F.lit(-90.0), F.least(F.lit(90.0), G.number(lat))).alias("y")))
    full = lambda k: F.concat(F.substring(plus_code(k["x"], k["y"]), F.lit(1), k["missing"]), k["c"])
    return G.let(G.let(start, lambda k: F.struct(k["c"].alias("c"), k["missing"].alias("missing"), k["x"].alias("x"), k["y"].alias("y"), plus_code_bounds(full(k)).alias("b"))), near)


def short_link_point(code) -> Column:
    """Struct lon, lat, zoom of a map short link; the old letter @ counts as ~. Null for other text."""
    c = F.replace(G.col(code), F.lit("@"), F.lit("~"))
    letters = F.regexp_extract(c, r"^([A-Za-z0-9_~]{3,10})(-{0,2})$", 1)
    n, dashes = F.length(letters), F.length(F.regexp_extract(c, r"^([A-Za-z0-9_~]{3,10})(-{0,2})$", 2))
    each = F.transform(F.sequence(F.lit(1), n), lambda i: (F.instr(F.lit(LINK), F.substring(letters, i, F.lit(1))) - 1).cast("long"))
    value = F.aggregate(each, F.struct(F.lit(0).cast("long").alias("v"), F.lit(58).alias("s")), lambda a, d: F.struct(F.when(a["s"] >= 0, a["v"].bitwiseOR(F.call_function("shiftleft", d, F.greatest(a["s"], F.lit(0))))).otherwise(a["v"].bitwiseOR(F.call_function("shiftright", d, F.greatest(-a["s"], F.lit(0))))).alias("v"), (a["s"] - 6).alias("s")), lambda a: a["v"])
    axis = lambda v, span: gather_bits(v) * (span / 2.0**32) - span / 2
    zoom = n * 3 - 8 - F.when(dashes > 0, F.lit(3) - dashes).otherwise(0)
    return F.when(n > 0, G.let(value, lambda v: F.struct(axis(F.shiftrightunsigned(v, 1), 360.0).alias("lon"), axis(v, 180.0).alias("lat"), zoom.cast("int").alias("zoom"))))
