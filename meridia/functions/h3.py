"""Hexagonal cells on an icosahedron.

Every face carries a plane with a lattice of hexagons; complex numbers 1, w, w^2 of angles 0, 120 and
240 degrees are its axes, and a place is (a, b) for a + b w. Planes go over into each other by turns
about shared edges, and a cell's number is its base cell and the digits of the way down to it. The
tables of faces, base cells and turns come from the geometry when the module is loaded.
"""

from __future__ import annotations

import cmath
import math

import numpy as np
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import geometry as G

# Centres of the faces (latitude, longitude) and azimuths of their first axes, in radians.
FACES = (
    (0.803582649718989942, 1.248397419617396099, 5.619958268523939882), (1.307747883455638156, 2.536945009877921159, 5.760339081714187279),
    (1.054751253523952054, -1.347517358900396623, 0.780213654393430055), (0.600191595538186799, -0.450603909469755746, 0.430469363979999913),
    (0.491715428198773866, 0.401988202911306943, 6.130269123335111400), (0.172745327415618701, 1.678146885280433686, 2.692877706530642877),
    (0.605929321571350690, 2.953923329812411617, 2.982963003477243874), (0.427370518328979641, -1.888876200336285401, 3.532912002790141181),
    (-0.079066118549212831, -0.733429513380867741, 3.494305004259568154), (-0.230961644455383637, 0.506495587332349035, 3.003214169499538391),
    (0.079066118549212831, 2.408163140208925497, 5.930472956509811562), (0.230961644455383637, -2.635097066257444203, 0.138378484090254847),
    (-0.172745327415618701, -1.463445768309359553, 0.448714947059150361), (-0.605929321571350690, -0.187669323777381622, 0.158629650112549365),
    (-0.427370518328979641, 1.252716453253507838, 5.891865957979238535), (-0.600191595538186799, 2.690988744120037492, 2.711123289609793325),
    (-0.491715428198773866, -2.739604450678486295, 3.294508837434268316), (-0.803582649718989942, -1.893195233972397139, 3.804819692245439833),
    (-1.307747883455638156, -0.604647643711872080, 3.664438879055192436), (-1.054751253523952054, 1.794075294689396615, 2.361378999196363184),
)
# For each base cell, by number, its home face and its place there along the three axes.
HOMES = (
    "1:100 2:110 1:000 2:100 0:200 1:110 1:001 2:000 0:100 2:010 1:010 1:011 3:100 3:110 11:200 4:100 0:000 6:010 0:001 2:011 7:001 2:001 0:110 6:001 10:200 "
    "6:000 3:000 11:100 4:110 3:010 0:011 4:000 5:010 0:010 7:010 11:110 7:000 10:100 12:200 6:101 7:101 4:001 3:001 3:011 4:010 6:100 11:000 8:001 5:001 14:200 "
    "5:000 12:100 10:110 4:011 12:110 7:100 11:010 10:000 13:200 10:001 11:001 9:010 8:010 6:200 8:000 9:001 14:100 5:101 16:011 8:101 5:100 12:000 7:200 12:010 10:010 "
    "9:000 13:100 16:001 15:011 15:010 16:010 14:110 13:110 5:200 8:100 14:000 9:101 14:001 17:001 12:001 16:000 17:011 15:001 16:101 9:100 15:000 13:000 8:200 13:010 17:101 "
    "19:010 14:010 19:011 17:010 13:001 17:000 16:100 9:200 15:101 15:100 18:011 18:001 19:001 17:100 19:000 18:010 18:101 19:200 19:100 18:000 19:101 18:100"
).split()
# The distance of neighbouring base cells on a face's plane, as a tangent, and the Earth's mean radius in metres.
UNIT, RADIUS = 0.38196601125010500003, 6371007.180918475
#: By how much a finer lattice is turned against the next one.
TILT = math.asin(math.sqrt(3 / 28))
FINEST = 15
#: Digits 0 to 7 by (a, b) of the step, from (-1, -1) on; steps by digit; digits by angle, from 0 degrees on.
STEP_DIGIT, STEP_A, STEP_B, AROUND = "137502746", (0, -1, 0, -1, 1, 0, 1), (0, -1, 1, 0, 0, -1, 1), "462315"
SIXTH = cmath.exp(1j * math.pi / 3)

# --- tables ------------------------------------------------------------------------------------


def _plane(lat: float, lon: float, azimuth: float) -> tuple:
    """A face's centre, and its axes at angles 0 and 90 degrees, as directions."""
    centre = (math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat))
    north = (-math.sin(lat) * math.cos(lon), -math.sin(lat) * math.sin(lon), math.cos(lat))
    east = (-math.sin(lon), math.cos(lon), 0.0)
    c, s = math.cos(azimuth), math.sin(azimuth)
    return centre, tuple(c * n + s * e for n, e in zip(north, east)), tuple(s * n - c * e for n, e in zip(north, east))


_PLANES = [_plane(*f) for f in FACES]


def _sphere(face: int, z: complex) -> tuple:
    c, x, y = _PLANES[face]
    v = [c[i] + UNIT * (z.real * x[i] + z.imag * y[i]) for i in range(3)]
    n = math.sqrt(sum(t * t for t in v))
    return tuple(t / n for t in v)


def _near(p: tuple, q: tuple) -> bool:
    return sum((a - b) ** 2 for a, b in zip(p, q)) < 1e-12


def _turns() -> list[list[tuple[int, complex, complex]]]:
    """For each face and each edge (across the first and second axis, second and third, third and first): the face beyond, and u, t, so that z lies at u z + t on it."""
    corners = [SIXTH**0 * 2, SIXTH**2 * 2, SIXTH**4 * 2]
    at = [[_sphere(f, z) for z in corners] for f in range(20)]
    out = []
    for f in range(20):
        row = []
        for i, j in ((0, 1), (1, 2), (2, 0)):
            g, k, m = next((g, k, m) for g in range(20) if g != f for k in range(3) for m in range(3) if _near(at[f][i], at[g][k]) and _near(at[f][j], at[g][m]))
            u = (corners[k] - corners[m]) / (corners[i] - corners[j])
            row.append((g, u, corners[k] - u * corners[i]))
        out.append(row)
    return out


_TURNS = _turns()
#: Directions across a face's three edges.
_OUT = (SIXTH, SIXTH**3, SIXTH**5)


def _beyond(z: complex) -> int | None:
    """The edge that z lies furthest beyond."""
    over = [(z * w.conjugate()).real for w in _OUT]
    return max(range(3), key=lambda e: over[e]) if max(over) > 1 + 1e-9 else None


def _settle(face: int, z: complex) -> tuple[int, complex, complex]:
    """(face, place, turn) where a place of a face's plane lies."""
    turn = 1 + 0j
    while (e := _beyond(z)) is not None:
        face, u, t = _TURNS[face][e]
        z, turn = u * z + t, turn * u
    return face, z, turn


def _place(i: int, j: int, k: int) -> complex:
    return i + j * SIXTH**2 + k * SIXTH**4


_HOME = [(int(h.split(":")[0]), *map(int, h.split(":")[1])) for h in HOMES]
_PENTAGON = [h[1:] == (2, 0, 0) for h in _HOME]
#: Numbers of the twelve base cells with five neighbours.
PENTAGONS = tuple(n for n, five in enumerate(_PENTAGON) if five)


def _sixths(u: complex) -> int:
    return round(cmath.phase(u) / (math.pi / 3)) % 6


def _bases() -> list[int]:
    """For each face and place (i, j, k up to 2) of it: 32 times the base cell there, 4 times the turns of the digits, 2 if a deleted leading digit turns back, 1 if the cell has five neighbours."""
    centre = [_sphere(h[0], _place(*h[1:])) for h in _HOME]
    out = []
    for f in range(20):
        for n in range(27):
            i, j, k = n // 9, n // 3 % 3, n % 3
            if min(i, j, k):
                out.append(-1)
                continue
            face, z, turn = _settle(f, _place(i, j, k))
            at = _sphere(face, z)
            base = next(b for b in range(122) if _near(centre[b], at))
            home = _HOME[base][0]
            if not _PENTAGON[base]:
                if face != home:  # on the edge of the two
                    turn *= next(u for g, u, _ in _TURNS[face] if g == home)
                out.append(base << 5 | _sixths(turn) << 2)
                continue
            # faces around the corner, against the clock from the home face on
            c, x, y = _PLANES[home]
            up = centre[base]
            ring = [g for g in range(20) if any(_near(_sphere(g, SIXTH ** (2 * m) * 2), up) for m in range(3))]
            first = [p - q for p, q in zip(c, up)]
            side = (up[1] * first[2] - up[2] * first[1], up[2] * first[0] - up[0] * first[2], up[0] * first[1] - up[1] * first[0])
            angle = lambda g: (1e-6 + math.atan2(sum((p - q) * s for p, q, s in zip(_PLANES[g][0], up, side)), sum((p - q) * s for p, q, s in zip(_PLANES[g][0], up, first)))) % (2 * math.pi)  # noqa: E731, B023
            m = sorted(ring, key=angle).index(f)
            axis = (i, j, k).index(2)
            out.append(base << 5 | (m - (0, 1, 3)[axis]) % 5 << 2 | (axis == 1) << 1 | 1)
    return out


_CONSTANTS: dict = {}


def _const(values, kind: str) -> Column:
    """A constant array, one literal from the start; kept, as it is made number by number."""
    key = (id(SparkContext._active_spark_context), kind, tuple(values))
    if key not in _CONSTANTS:
        _CONSTANTS[key] = F.lit(np.array(values, {"int": np.int32, "double": np.float64}[kind]))
    return _CONSTANTS[key]


_FLAT = [v for plane in _PLANES for axis in plane for v in axis]
_TURN_FLAT = [v for row in _TURNS for g, u, t in row for v in (float(g), u.real, u.imag, t.real, t.imag)]
_HOME_FLAT = [v for h in _HOME for v in (h[0], h[1] - h[3], h[2] - h[3])]
_BASES = _bases()
#: Digits 1 to 6 after turns by 0 to 5 sixths against the clock.
_TURNED = ["".join(AROUND[(AROUND.index(d) + n) % 6] for d in "123456") for n in range(6)]

# --- numbers -----------------------------------------------------------------------------------


def _long(v) -> Column:
    return F.lit(v).cast("long")


def _bits(c: Column, shift: int, mask: int) -> Column:
    return F.shiftright(c, shift).bitwiseAND(_long(mask))


def h3_resolution(c) -> Column:
    return _bits(G.col(c), 52, 15).cast("int")


def h3_base_cell(c) -> Column:
    """0 to 121."""
    return _bits(G.col(c), 45, 127).cast("int")


def h3_token(c) -> Column:
    return F.lower(F.hex(G.col(c)))


def h3_from_token(token) -> Column:
    return F.conv(G.col(token), 16, 10).cast("long")


def _digits(c: Column) -> Column:
    """All 15 digits as text, 7 beyond the resolution."""
    return F.lpad(F.conv(c.bitwiseAND(_long((1 << 45) - 1)).cast("string"), 10, 8), 15, "0")


def h3_digits(c) -> Column:
    """The digits down to the cell as text, one a resolution."""
    c = G.col(c)
    return F.substring(_digits(c), F.lit(1), h3_resolution(c))


def _pack(base: Column, digits: Column) -> Column:
    n = F.length(digits).cast("long")
    return _long(1 << 59) + F.shiftleft(n, 52) + F.shiftleft(base.cast("long"), 45) + F.conv(F.rpad(digits, 15, "7"), 8, 10).cast("long")


def _five(base: Column) -> Column:
    return base.isin(list(PENTAGONS))


def _sevens(level) -> Column:
    """The digits beyond a resolution, all 7."""
    return F.call_function("shiftleft", _long(1), (45 - 3 * G.col(level)).cast("int")) - _long(1)


def h3_is_pentagon(c) -> Column:
    c = G.col(c)
    return _five(h3_base_cell(c)) & (c.bitwiseAND(_long((1 << 45) - 1)) == _sevens(h3_resolution(c)))


def h3_is_valid(c) -> Column:
    """Whether a number is a cell's."""
    c = G.col(c)

    def good(d):
        inside = (F.length(F.rtrim(d, F.lit("7"))) == h3_resolution(c)) & (F.instr(F.rtrim(d, F.lit("7")), "7") == 0)
        return inside & ~(_five(h3_base_cell(c)) & F.ltrim(d, F.lit("0")).startswith("1"))

    return (_bits(c, 56, 255) == 8) & (h3_base_cell(c) < 122) & G.let(_digits(c), good)


def h3_parent(c, level) -> Column:
    """The cell of a coarser resolution that a cell descends from; null if it isn't coarser or its own."""
    c, level = G.col(c), G.col(level)
    return F.when((level >= 0) & (level <= h3_resolution(c)), (c - F.shiftleft((h3_resolution(c) - level).cast("long"), 52)).bitwiseOR(_sevens(level)))


def h3_center_child(c, level) -> Column:
    c, level = G.col(c), G.col(level)
    return F.when((level <= FINEST) & (level >= h3_resolution(c)), c + F.shiftleft((level - h3_resolution(c)).cast("long"), 52) - _sevens(h3_resolution(c)) + _sevens(level))


def h3_children_count(c, level) -> Column:
    """How many cells of a resolution descend from a cell."""
    c = G.col(c)
    return G.let(F.pow(F.lit(7.0), G.col(level) - h3_resolution(c)), lambda n: F.when(h3_is_pentagon(c), 1 + 5 * (n - 1) / 6).otherwise(n)).cast("long")


def h3_children(c, level=None) -> Column:
    """The cells of a resolution, by default the next one, that descend from a cell, in order; array, so for few levels."""
    c = G.col(c)
    to = h3_resolution(c) + 1 if level is None else G.col(level)
    more = F.greatest(to.cast("int") - h3_resolution(c), F.lit(0))

    def next_(k, n):
        """Children of a cell of resolution n - 1."""
        shift = (45 - 3 * n).cast("int")
        first = k + _long(1 << 52) - F.call_function("shiftleft", _long(7), shift)
        digits = F.when(h3_is_pentagon(k), _const((0, 2, 3, 4, 5, 6), "int")).otherwise(_const(range(7), "int"))
        return F.transform(digits, lambda d: first + F.call_function("shiftleft", d.cast("long"), shift))

    down = lambda p: F.aggregate(F.sequence(F.lit(1), p["more"]), F.array(p["c"]), lambda cells, n: F.flatten(F.transform(cells, lambda k: next_(k, p["r"] + n))))
    made = F.when(more == 0, F.array(c)).otherwise(G.let(F.struct(c.alias("c"), h3_resolution(c).alias("r"), more.alias("more")), down))
    return F.when(to <= FINEST, made)


def _size_below(levels: Column, five: Column) -> Column:
    n = F.pow(F.lit(7.0), levels)
    return F.when(five, 1 + 5 * (n - 1) / 6).otherwise(n).cast("long")


def h3_child_position(c, level) -> Column:
    """A cell's place, from 0, among those of its resolution that descend from its parent of a coarser one."""
    c, level = G.col(c), G.col(level).cast("int")
    start = F.struct(h3_is_pentagon(h3_parent(c, level)).alias("five"), _long(0).alias("n"))

    def go(d, top):
        def step(a, r):
            digit = F.substring(d, r, F.lit(1)).cast("int")
            below = top - r
            whole, pent = F.pow(F.lit(7.0), below).cast("long"), _size_below(below, F.lit(True))
            # under a cell with five neighbours the first child is such a cell and the second is missing
            before = F.when(a["five"], F.when(digit == 0, _long(0)).otherwise(pent + (digit - 2) * whole)).otherwise(digit * whole)
            return F.struct((a["five"] & (digit == 0)).alias("five"), (a["n"] + before).alias("n"))

        return F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(FINEST)), lambda r: (r > level) & (r <= top)), start, step, lambda a: a["n"])

    return F.when(level <= h3_resolution(c), G.let(F.struct(h3_digits(c).alias("d"), h3_resolution(c).alias("r")), lambda p: go(p["d"], p["r"])))


def h3_child_at(c, position, level) -> Column:
    """The cell of a finer resolution at a place among those that descend from a cell; null beyond the last."""
    c, position, level = G.col(c), G.col(position).cast("long"), G.col(level).cast("int")
    start = F.struct(h3_is_pentagon(c).alias("five"), position.alias("n"), h3_digits(c).alias("d"))

    def step(a, r):
        below = level - r
        whole, pent = F.pow(F.lit(7.0), below).cast("long"), _size_below(below, F.lit(True))
        late = a["five"] & (a["n"] >= pent)
        digit = F.when(a["five"], F.when(a["n"] < pent, _long(0)).otherwise(F.floor((a["n"] - pent) / whole) + 2)).otherwise(F.floor(a["n"] / whole))
        left = F.when(late, F.pmod(a["n"] - pent, whole)).when(a["five"], a["n"]).otherwise(F.pmod(a["n"], whole))
        return F.struct((a["five"] & ~late).alias("five"), left.alias("n"), F.concat(a["d"], digit.cast("string")).alias("d"))

    ways = F.filter(F.sequence(F.lit(1), F.lit(FINEST)), lambda r: (r > h3_resolution(c)) & (r <= level))
    made = F.aggregate(ways, start, step, lambda a: _pack(h3_base_cell(c), a["d"]))
    return F.when((level >= h3_resolution(c)) & (level <= FINEST) & (position >= 0) & (position < h3_children_count(c, level)), made)


def h3_contains(a, b) -> Column:
    """Whether b is a or descends from it."""
    a, b = G.col(a), G.col(b)
    return (h3_base_cell(a) == h3_base_cell(b)) & h3_digits(b).startswith(h3_digits(a))


def h3_intersects(a, b) -> Column:
    return h3_contains(a, b) | h3_contains(b, a)


# --- places ------------------------------------------------------------------------------------


def _direction(lon: Column, lat: Column) -> Column:
    return F.struct((F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))


def _face_place(p: Column) -> Column:
    """Struct f, x, y: the face that a direction goes through, and where on its plane."""
    t = _const(_FLAT, "double")

    def dot(f, k):
        at = f * 9 + k
        return F.get(t, at) * p["x"] + F.get(t, at + 1) * p["y"] + F.get(t, at + 2) * p["z"]

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda f: F.struct(dot(f, 0).alias("d"), (-f).alias("f"))))
    return G.let(best, lambda b: F.struct((-b["f"]).alias("f"), (dot(-b["f"], 3) / (b["d"] * UNIT)).alias("x"), (dot(-b["f"], 6) / (b["d"] * UNIT)).alias("y")))


def _lattice(x: Column, y: Column, odd: bool, scale: float) -> Column:
    """Struct a, b: the hexagon of a resolution's lattice around a place."""
    if odd:
        x, y = x * math.cos(TILT) + y * math.sin(TILT), y * math.cos(TILT) - x * math.sin(TILT)
    x, y = x * scale, y * scale
    b = y / math.sqrt(0.75)
    a = x + b / 2

    def rounded(p):
        off = lambda k: F.abs(p["r" + k] - p[k])
        q = F.when((off("q") > off("r")) & (off("q") > off("s")), -p["rr"] - p["rs"]).otherwise(p["rq"])
        r = F.when((off("q") > off("r")) & (off("q") > off("s")), p["rr"]).when(off("r") > off("s"), -p["rq"] - p["rs"]).otherwise(p["rr"])
        return F.struct((q + r).cast("long").alias("a"), r.cast("long").alias("b"))

    return G.let(F.struct(a.alias("a"), b.alias("b")), lambda p: G.let(F.struct((p["a"] - p["b"]).alias("q"), p["b"].alias("r"), (-p["a"]).alias("s"), F.rint(p["a"] - p["b"]).alias("rq"), F.rint(p["b"]).alias("rr"), F.rint(-p["a"]).alias("rs")), rounded))


def _named(face: Column, a: Column, b: Column, level: int) -> Column:
    """The cell at a place of a face's lattice."""

    def step(s, r):
        odd = r % 2 == 1
        up_a = F.floor((F.when(odd, 3 * s["a"] - s["b"]).otherwise(2 * s["a"] + s["b"]) + 3) / 7)
        up_b = F.floor((F.when(odd, s["a"] + 2 * s["b"]).otherwise(3 * s["b"] - s["a"]) + 3) / 7)

        def down(u):
            da = s["a"] - F.when(odd, 2 * u["a"] + u["b"]).otherwise(3 * u["a"] - u["b"])
            db = s["b"] - F.when(odd, 3 * u["b"] - u["a"]).otherwise(u["a"] + 2 * u["b"])
            return F.struct(u["a"].alias("a"), u["b"].alias("b"), F.concat(F.substring(F.lit(STEP_DIGIT), ((da + 1) * 3 + db + 2).cast("int"), F.lit(1)), s["d"]).alias("d"))

        return G.let(F.struct(up_a.alias("a"), up_b.alias("b")), down)

    def finish(s):
        low = F.least(s["a"], s["b"], _long(0))
        at = ((face * 3 + (s["a"] - low)) * 3 + (s["b"] - low)) * 3 - low
        return G.let(F.struct(F.get(_const(_BASES, "int"), at.cast("int")).alias("k"), s["d"].alias("d")), _turned)

    def _turned(p):
        base, turns, back, five = F.shiftright(p["k"], 5), F.shiftright(p["k"], 2).bitwiseAND(F.lit(7)), F.shiftright(p["k"], 1).bitwiseAND(F.lit(1)), p["k"].bitwiseAND(F.lit(1)) == 1
        first = F.substring(F.ltrim(p["d"], F.lit("0")), 1, 1)
        # the missing direction turns to one of its sides; then turns count five directions, and skip it
        side = F.when(first != "1", F.lit(0)).when(back == 1, F.lit(5)).otherwise(F.lit(1))
        lead = F.when(first != "1", first).when(back == 1, F.lit("3")).otherwise(F.lit("5"))
        skipped = F.when(F.instr(F.lit("54623"), lead) - 1 + turns >= 5, 1).otherwise(0)
        total = F.when(first == "", 0).when(five, F.pmod(side + turns + skipped, F.lit(6))).otherwise(turns)
        return _pack(base, F.call_function("translate", p["d"], F.lit("123456"), F.get(F.array(*map(F.lit, _TURNED)), total)))

    start = F.struct(a.alias("a"), b.alias("b"), F.lit("").alias("d"))
    if not level:
        return G.let(start, finish)
    return F.aggregate(F.sequence(F.lit(level), F.lit(1), F.lit(-1)), start, step, finish)


def _cell_of(direction: Column, level: int) -> Column:
    return G.let(_face_place(direction), lambda p: G.let(_lattice(p["x"], p["y"], level % 2 == 1, 7 ** (level / 2)), lambda q: _named(p["f"], q["a"], q["b"], level)))


def h3_cell(lon, lat, level: int) -> Column:
    """The number of the cell of a resolution, 0 to 15, that holds a point; null beyond the poles and for what isn't finite."""
    if not 0 <= level <= FINEST:
        raise ValueError("a resolution is 0 to 15")
    lon, lat = G.number(lon), G.number(lat)
    good = (F.abs(lat) <= 90) & (F.abs(lon) < float("inf"))
    return F.when(good, G.let(_direction(F.radians(lon), F.radians(lat)), lambda p: _cell_of(p, level)))


def _home_place(c: Column) -> Column:
    """Struct f, a, b, r, cut, lean: the home face of a cell, its place on the lattice there, resolution, whether its digits were turned back over the missing direction, and the edge by which to leave the face first."""
    base, d = h3_base_cell(c), h3_digits(c)
    first = F.substring(F.ltrim(d, F.lit("0")), 1, 1)
    cut = _five(base) & first.isin("4", "5")
    turned = F.when(cut, F.translate(d, "123456", _TURNED[5])).otherwise(d)
    home = _const(_HOME_FLAT, "int")

    def go(p):
        def step(s, r):
            k = F.substring(p["d"], r, F.lit(1)).cast("int")
            odd = r % 2 == 1
            a = F.when(odd, 2 * s["a"] + s["b"]).otherwise(3 * s["a"] - s["b"]) + F.get(F.array(*map(_long, STEP_A)), k)
            b = F.when(odd, 3 * s["b"] - s["a"]).otherwise(s["a"] + 2 * s["b"]) + F.get(F.array(*map(_long, STEP_B)), k)
            return F.struct(a.alias("a"), b.alias("b"))

        start = F.struct(F.get(home, p["b"] * 3 + 1).cast("long").alias("a"), F.get(home, p["b"] * 3 + 2).cast("long").alias("b"))
        ways = F.filter(F.sequence(F.lit(1), F.lit(FINEST)), lambda r: r <= p["r"])
        return F.aggregate(ways, start, step, lambda s: F.struct(F.get(home, p["b"] * 3).alias("f"), s["a"].alias("a"), s["b"].alias("b"), p["r"].alias("r"), p["cut"].alias("cut"), F.when(p["cut"], 2).when(_five(p["b"]), 0).otherwise(-1).alias("lean")))

    return G.let(F.struct(base.alias("b"), turned.alias("d"), h3_resolution(c).alias("r"), cut.alias("cut")), go)


def _on_plane(f: Column, a: Column, b: Column, r: Column) -> Column:
    """Struct f, x, y of a place on the lattice of a resolution; a and b may lie between hexagons."""

    def go(p):
        odd = p["r"] % 2 == 1
        x = F.when(odd, p["x"] * math.cos(TILT) - p["y"] * math.sin(TILT)).otherwise(p["x"])
        y = F.when(odd, p["x"] * math.sin(TILT) + p["y"] * math.cos(TILT)).otherwise(p["y"])
        n = F.pow(F.lit(7.0), p["r"] / 2)
        return F.struct(p["f"].alias("f"), (x / n).alias("x"), (y / n).alias("y"))

    return G.let(F.struct(f.alias("f"), r.alias("r"), (a - b / 2).cast("double").alias("x"), (b * math.sqrt(0.75)).cast("double").alias("y")), go)


def _over(x: Column, y: Column, e: int) -> Column:
    return x * _OUT[e].real + y * _OUT[e].imag


def _settled(p: Column, lean: Column | None = None) -> Column:
    """Struct f, x, y where a place of a plane lies, over up to five edges; first over the edge `lean` if it lies beyond that, as around a corner where five faces meet there are two ways."""
    t, out_x, out_y = _const(_TURN_FLAT, "double"), _const([w.real for w in _OUT], "double"), _const([w.imag for w in _OUT], "double")

    def step(s, i):
        def across(o):
            def turn(k):
                at = lambda i: F.get(t, k + i)
                return F.struct(at(0).cast("int").alias("f"), (at(1) * s["x"] - at(2) * s["y"] + at(3)).alias("x"), (at(2) * s["x"] + at(1) * s["y"] + at(4)).alias("y"))

            edge = F.when((o[0] >= o[1]) & (o[0] >= o[2]), 0).when(o[1] >= o[2], 1).otherwise(2)
            same = F.struct(s["f"].alias("f"), s["x"].alias("x"), s["y"].alias("y"))
            if lean is not None:
                edge = F.when((i == 0) & (F.get(o, lean) > 1 + 1e-12), lean).otherwise(edge)
            return F.when(F.array_max(o) > 1 + 1e-12, G.let((s["f"] * 3 + edge) * 5, turn)).otherwise(same)

        return G.let(F.zip_with(out_x, out_y, lambda a, b: s["x"] * a + s["y"] * b), across)

    return F.aggregate(F.sequence(F.lit(0), F.lit(4)), F.struct(p["f"].alias("f"), p["x"].alias("x"), p["y"].alias("y")), step)


def _to_sphere(p: Column) -> Column:
    """Direction x, y, z of a settled place; not of length 1."""
    t = _const(_FLAT, "double")
    at = lambda k: F.get(t, p["f"] * 9 + k) + UNIT * (p["x"] * F.get(t, p["f"] * 9 + 3 + k) + p["y"] * F.get(t, p["f"] * 9 + 6 + k))
    return F.struct(*[at(k).alias(n) for k, n in enumerate("xyz")])


def _unit(p: Column) -> Column:
    return G.let(F.sqrt(p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"]), lambda n: F.struct(*[(p[k] / n).alias(k) for k in "xyz"]))


def _lonlat(p: Column) -> Column:
    return F.struct(F.degrees(F.atan2(p["y"], p["x"])).alias("lon"), F.degrees(F.atan2(p["z"], F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]))).alias("lat"))


def _place_to_sphere(f: Column, a: Column, b: Column, r: Column, lean: Column) -> Column:
    return G.let(G.let(_on_plane(f, a, b, r), lambda p: _settled(p, lean)), _to_sphere)


def _center(c: Column) -> Column:
    return G.let(_home_place(c), lambda p: _place_to_sphere(p["f"], p["a"], p["b"], p["r"], p["lean"]))


def h3_center(c) -> Column:
    """Struct lon, lat."""
    return G.let(_center(G.col(c)), _lonlat)


# --- outlines ----------------------------------------------------------------------------------


def _corner_places() -> tuple[list[float], list[float]]:
    """Places (a, b) of the six corners around a hexagon, against the clock."""
    out = []
    for m in range(6):
        z = SIXTH**m * cmath.exp(1j * math.pi / 6) / math.sqrt(3)
        b = z.imag / math.sqrt(0.75)
        out.append((z.real + b / 2, b))
    return [p[0] for p in out], [p[1] for p in out]


_CORNER_A, _CORNER_B = _corner_places()


def _hexagon(p: Column, parts: int) -> Column:
    """Directions around a cell of six neighbours: corners, points between them, and where its sides bend at an edge of a face."""

    ca, cb = _const(_CORNER_A, "double"), _const(_CORNER_B, "double")
    beyond = _const([g for row in _TURNS for g, _, _ in row], "int")
    corner = lambda k: _on_plane(p["f"], p["a"] + F.get(ca, k % 6), p["b"] + F.get(cb, k % 6), p["r"])
    even = _const([i / parts for i in range(parts)], "double")

    def bend(s):
        """How far along a side it crosses an edge between two faces; null if it doesn't."""
        to = lambda one, other: F.aggregate(F.sequence(F.lit(0), F.lit(2)), F.lit(0.0), lambda d, e: F.when(F.get(beyond, one["f"] * 3 + e) == other["f"], 1 - one["x"] * F.get(_const([w.real for w in _OUT], "double"), e) - one["y"] * F.get(_const([w.imag for w in _OUT], "double"), e)).otherwise(d))
        at = lambda d: F.when((d["u"] > 1e-9) & (d["v"] > 1e-9), d["u"] / (d["u"] + d["v"]))
        return F.when(s["u"]["f"] != s["v"]["f"], G.let(F.struct(to(s["u"], s["v"]).alias("u"), to(s["v"], s["u"]).alias("v")), at))

    def side(q):
        on = lambda t: F.struct(q["u"]["f"].alias("f"), (q["u"]["x"] + t * (q["v"]["x"] - q["u"]["x"])).alias("x"), (q["u"]["y"] + t * (q["v"]["y"] - q["u"]["y"])).alias("y"))
        t = G.let(F.struct(_settled(q["u"], p["lean"]).alias("u"), _settled(q["v"], p["lean"]).alias("v")), bend)
        places = G.let(t, lambda x: F.when(x.isNull(), even).otherwise(F.array_sort(F.concat(even, F.array(x)))))
        return F.transform(places, lambda x: G.let(G.let(on(x), lambda z: _settled(z, p["lean"])), _to_sphere))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: G.let(F.struct(corner(k).alias("u"), corner(k + 1).alias("v")), side)))


def pentagon_ring(odd: bool) -> list[complex]:
    """Corners of a cell of five neighbours about the corner of a face that it lies on, and bends of its sides, before its resolution makes them small."""
    tilt = math.degrees(TILT) if odd else 0.0
    corners = [a for a in (30 + 60 * m + tilt for m in range(7)) if 30.001 < a < 330.001]
    bends = [90.0 + 60 * m for m in range(5)] if odd else []
    angles = sorted({round(a, 9) for a in [*corners, *bends]})
    out = []
    for a in angles:
        mid = min((c + 30 for c in [corners[0] - 60, *corners]), key=lambda m: abs(m - a))
        out.append(cmath.rect(math.cos(math.pi / 6) / math.sqrt(3) / math.cos(math.radians(a - mid)), math.radians(a)))
    return out


def _pentagon(p: Column, parts: int) -> Column:
    """Directions around a cell of five neighbours, at angles about its corner of the icosahedron."""

    def at(odd: bool):
        n = F.pow(F.lit(7.0), p["r"] / 2)
        z = pentagon_ring(odd)
        place = lambda i: F.struct(p["f"].alias("f"), (F.get(_const([c.real for c in z], "double"), i) / n + 2.0).alias("x"), (F.get(_const([c.imag for c in z], "double"), i) / n).alias("y"))
        return F.transform(F.sequence(F.lit(0), F.lit(len(z) - 1)), lambda i: G.let(G.let(place(i), _settled), _to_sphere))

    def between(points: Column) -> Column:
        if parts == 1:
            return points
        k = F.size(points)
        mix = lambda u, v, t: F.struct(*[(u[c] * (1 - t) + v[c] * t).alias(c) for c in "xyz"])
        return F.flatten(F.transform(points, lambda u, i: G.let(F.get(points, (i + 1) % k), lambda v: F.array(*[mix(_unit(u), _unit(v), t / parts) for t in range(parts)]))))

    return G.let(F.when(p["r"] % 2 == 1, at(True)).otherwise(at(False)), between)


def _outline(c: Column, parts: int = 1) -> Column:
    return G.let(_home_place(c), lambda p: F.when(h3_is_pentagon(c), _pentagon(p, parts)).otherwise(_hexagon(p, parts)))


def h3_boundary(c, parts: int = 1) -> Column:
    """Array of struct lon, lat against the clock, the first not repeated; each side in so many parts."""
    return F.transform(_outline(G.col(c), parts), _lonlat)


def h3_polygon(c) -> Column:
    """The cell as a polygon in degrees; over the seam or a pole it has corners on both sides."""
    return G.polygon(F.transform(h3_boundary(c), lambda k: G.vertex(k["lon"], k["lat"])))


def _turn_area(a: Column, b: Column, c: Column) -> Column:
    """Signed angle excess of a triangle of directions of length 1."""
    det = a["x"] * (b["y"] * c["z"] - b["z"] * c["y"]) - a["y"] * (b["x"] * c["z"] - b["z"] * c["x"]) + a["z"] * (b["x"] * c["y"] - b["y"] * c["x"])
    dot = lambda p, q: p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"]
    return 2 * F.atan2(det, 1 + dot(a, b) + dot(b, c) + dot(c, a))


def h3_area(c) -> Column:
    """Square metres on the sphere."""
    c = G.col(c)

    def fan(p):
        k = F.size(p["o"])
        return G.total(F.transform(p["o"], lambda u, i: _turn_area(p["m"], u, F.get(p["o"], (i + 1) % k)))) * (RADIUS * RADIUS)

    return G.let(F.struct(G.let(_center(c), _unit).alias("m"), F.transform(_outline(c), _unit).alias("o")), fan)


# --- neighbours --------------------------------------------------------------------------------


def _neighbor(p: Column, k: Column, level: int) -> Column:
    """The neighbour that digit k leads to from a place and whether it has five."""
    turned = [0, *map(int, _TURNED[5])]
    cut = p["h"]["cut"] | (p["five"] & k.isin(4, 5))
    step = lambda values: F.when(cut, F.get(_const([values[t] for t in turned], "int"), k)).otherwise(F.get(_const(values, "int"), k))
    at = _place_to_sphere(p["h"]["f"], p["h"]["a"] + step(STEP_A), p["h"]["b"] + step(STEP_B), p["h"]["r"], p["h"]["lean"])
    return F.when(~(p["five"] & (k == 1)), G.let(G.let(at, _unit), lambda u: _cell_of(u, level)))


def _whereabouts(c: Column) -> Column:
    return F.struct(_home_place(c).alias("h"), h3_is_pentagon(c).alias("five"))


def h3_neighbors(c, level: int) -> Column:
    """Array of the six neighbours of a cell of a resolution, by digits 1 to 6; null in place of the one that a cell of five lacks."""
    return G.let(_whereabouts(G.col(c)), lambda p: F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: _neighbor(p, k, level)))


def h3_is_neighbor(a, b, level: int) -> Column:
    return F.array_contains(F.array_compact(h3_neighbors(a, level)), G.col(b))


def _seen_from(a: Column, b: Column) -> Column:
    """Struct a, b: the place of cell b on the lattice of cell a's home face; null where neither the same face nor one beyond an edge of it has b."""
    turns = _const(_TURN_FLAT, "double")

    def go(p):
        def across(e):
            k = (p["f"] * 3 + e) * 5
            at = lambda i: F.get(turns, k + i)
            dx, dy = p["g"]["x"] - at(3), p["g"]["y"] - at(4)
            return F.when(at(0).cast("int") == p["g"]["f"], F.struct((at(1) * dx + at(2) * dy).alias("x"), (at(1) * dy - at(2) * dx).alias("y")))

        same = F.when(p["f"] == p["g"]["f"], F.struct(p["g"]["x"].alias("x"), p["g"]["y"].alias("y")))
        return F.coalesce(same, *[across(e) for e in range(3)])

    place = G.let(_home_place(b), lambda h: G.let(_on_plane(h["f"], h["a"], h["b"], h["r"]), lambda q: _settled(q, h["lean"])))
    seen = G.let(F.struct(F.get(_const(_HOME_FLAT, "int"), h3_base_cell(a) * 3).alias("f"), place.alias("g")), go)

    def lattice(p):
        odd = p["r"] % 2 == 1
        n = F.pow(F.lit(7.0), p["r"] / 2)
        x = F.when(odd, p["s"]["x"] * math.cos(TILT) + p["s"]["y"] * math.sin(TILT)).otherwise(p["s"]["x"]) * n
        y = F.when(odd, p["s"]["y"] * math.cos(TILT) - p["s"]["x"] * math.sin(TILT)).otherwise(p["s"]["y"]) * n
        b_ = y / math.sqrt(0.75)
        return F.when(p["s"].isNotNull(), F.struct(F.rint(x + b_ / 2).cast("long").alias("a"), F.rint(b_).cast("long").alias("b")))

    return G.let(F.struct(seen.alias("s"), h3_resolution(a).alias("r")), lattice)


def h3_local_ij(c, origin) -> Column:
    """Struct i, j: where a cell lies on the lattice of the origin's resolution, about the origin's base cell; null for another resolution, too far away, or with a base cell of five neighbours on either side."""
    c, origin = G.col(c), G.col(origin)

    def rest(p):
        top = F.filter(F.sequence(F.lit(1), F.lit(FINEST)), lambda r: r <= h3_resolution(origin))
        home = _const(_HOME_FLAT, "int")
        start = F.struct(F.get(home, h3_base_cell(origin) * 3 + 1).cast("long").alias("a"), F.get(home, h3_base_cell(origin) * 3 + 2).cast("long").alias("b"))
        down = lambda s, r: F.struct(F.when(r % 2 == 1, 2 * s["a"] + s["b"]).otherwise(3 * s["a"] - s["b"]).alias("a"), F.when(r % 2 == 1, 3 * s["b"] - s["a"]).otherwise(s["a"] + 2 * s["b"]).alias("b"))
        return G.let(F.aggregate(top, start, down), lambda z: F.when(p.isNotNull(), F.struct((p["a"] - z["a"]).alias("i"), (p["b"] - z["b"]).alias("j"))))

    able = (h3_resolution(c) == h3_resolution(origin)) & ~_five(h3_base_cell(c)) & ~_five(h3_base_cell(origin))
    return F.when(able, G.let(_seen_from(origin, c), rest))


def h3_from_local_ij(origin, i, j, level: int) -> Column:
    """The cell of a resolution at a place about the origin's base cell: the inverse of h3_local_ij."""
    origin, i, j = G.col(origin), G.col(i).cast("long"), G.col(j).cast("long")
    base = _pack(h3_base_cell(origin), F.rpad(F.lit(""), level, "0") if level else F.lit(""))
    return G.let(G.let(_home_place(base), lambda p: _place_to_sphere(p["f"], p["a"] + i, p["b"] + j, F.lit(level), p["lean"])), lambda q: G.let(_unit(q), lambda u: _cell_of(u, level)))


def _steps(i: Column, j: Column) -> Column:
    """Steps on the lattice over (i, j)."""
    return F.greatest(F.abs(i), F.abs(j), F.abs(i - j))


def h3_grid_distance(a, b) -> Column:
    """Steps between two cells of a resolution; null where h3_local_ij is, but 0 for a cell itself."""
    a, b = G.col(a), G.col(b)
    return F.when(a == b, _long(0)).otherwise(G.let(F.struct(h3_local_ij(a, a).alias("u"), h3_local_ij(b, a).alias("v")), lambda p: F.when(p["v"].isNotNull(), _steps(p["v"]["i"] - p["u"]["i"], p["v"]["j"] - p["u"]["j"]))))


def h3_grid_path(a, b, level: int) -> Column:
    """Array of the cells on a straight way from a to b, both of a resolution, ends included; null where there is no distance."""
    a, b = G.col(a), G.col(b)

    def way(p):
        n = _steps(p["v"]["i"] - p["u"]["i"], p["v"]["j"] - p["u"]["j"])

        def at(k):
            t = F.when(n == 0, F.lit(0.0)).otherwise(k / n)
            i, j = p["u"]["i"] + t * (p["v"]["i"] - p["u"]["i"]), p["u"]["j"] + t * (p["v"]["j"] - p["u"]["j"])
            # a little off the middle, so that no place lies between two hexagons
            x, y = (i - j / 2) + 1e-6, j * math.sqrt(0.75) + 2e-6
            return G.let(_lattice(x, y, False, 1.0), lambda z: h3_from_local_ij(a, z["a"], z["b"], level))

        return F.when(p["v"].isNotNull(), F.transform(F.sequence(_long(0), n), at))

    return F.when(a == b, F.array(a)).otherwise(G.let(F.struct(h3_local_ij(a, a).alias("u"), h3_local_ij(b, a).alias("v")), way))


# --- directed edges ----------------------------------------------------------------------------


def h3_edges(c) -> Column:
    """Numbers of the directed edges that leave a cell: six, or five."""
    c = G.col(c)
    base = c - _long(1 << 59) + _long(2 << 59)
    return F.when(h3_is_pentagon(c), F.array(*[base + _long(k << 56) for k in range(2, 7)])).otherwise(F.array(*[base + _long(k << 56) for k in range(1, 7)]))


def h3_edge_origin(e) -> Column:
    e = G.col(e)
    return e.bitwiseAND(_long((1 << 56) - 1)) + _long(1 << 59)


def h3_edge_digit(e) -> Column:
    return _bits(G.col(e), 56, 7).cast("int")


def h3_edge_destination(e, level: int) -> Column:
    return G.let(F.struct(_whereabouts(h3_edge_origin(e)).alias("p"), h3_edge_digit(e).alias("k")), lambda q: _neighbor(q["p"], q["k"], level))


def h3_edge(a, b, level: int) -> Column:
    """The directed edge from a to its neighbour b; null if it is none."""
    a = G.col(a)
    return G.let(F.array_position(h3_neighbors(a, level), G.col(b)), lambda k: F.when(k > 0, a - _long(1 << 59) + _long(2 << 59) + F.shiftleft(k, 56)))


def h3_edge_reverse(e, level: int) -> Column:
    return G.let(h3_edge_destination(e, level), lambda to: h3_edge(to, h3_edge_origin(e), level))


def h3_edge_line(e, level: int) -> Column:
    """Array of struct lon, lat along the side that two neighbours share, as the origin has it, against the clock."""
    middle = lambda c: G.let(_center(c), _unit)

    def shared(p):
        k = F.size(p["o"])
        far = lambda u, v: (u["x"] - v["x"]) * (u["x"] - v["x"]) + (u["y"] - v["y"]) * (u["y"] - v["y"]) + (u["z"] - v["z"]) * (u["z"] - v["z"])
        # points as far from one centre as from the other, to a tenth of the way between them
        on = F.transform(p["o"], lambda u: F.abs(F.sqrt(far(u, p["a"])) - F.sqrt(far(u, p["b"]))) < 0.12 * F.sqrt(far(p["a"], p["b"])))
        first = lambda on: F.array_position(F.transform(on, lambda x, i: x & ~F.get(on, (i + k - 1) % k)), F.lit(True)) - 1
        n = lambda on: F.size(F.filter(on, lambda x: x))
        return G.let(G.let(on, lambda on: F.struct(first(on).cast("int").alias("s"), n(on).alias("n"))), lambda q: F.transform(F.sequence(F.lit(0), q["n"] - 1), lambda i: _lonlat(F.get(p["o"], (q["s"] + i) % k))))

    return G.let(F.struct(F.transform(_outline(h3_edge_origin(e)), _unit).alias("o"), middle(h3_edge_origin(e)).alias("a"), middle(h3_edge_destination(e, level)).alias("b")), shared)


def h3_edge_length(e, level: int) -> Column:
    """Metres on the sphere along an edge."""

    def arc(a, b):
        s = lambda v: F.sin(F.radians(v) / 2)
        h = s(b["lat"] - a["lat"]) * s(b["lat"] - a["lat"]) + F.cos(F.radians(a["lat"])) * F.cos(F.radians(b["lat"])) * s(b["lon"] - a["lon"]) * s(b["lon"] - a["lon"])
        return 2 * RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))

    return G.let(h3_edge_line(e, level), lambda v: G.total(G.pairs(v, arc)))


# --- whole sets --------------------------------------------------------------------------------


def h3_base_cells(spark: SparkSession) -> DataFrame:
    """(cell) of the 122 cells of resolution 0."""
    return spark.range(122).select(_pack(F.col("id"), F.lit("")).alias("cell"))


def h3_pentagons(spark: SparkSession, level: int) -> DataFrame:
    """(cell) of the twelve cells of a resolution with five neighbours."""
    return h3_base_cells(spark).where(_five(h3_base_cell("cell"))).select(h3_center_child("cell", level).alias("cell"))
