"""Hexagonal cells of many numbers at once, in numpy: what h3.py has as column expressions, by the same steps.

Directions are arrays whose last axis is x, y, z. Outlines are filled up to the same number of places,
with the number of those that count.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G
from . import h3

_FLAT, _TURN_FLAT = np.array(h3._FLAT).reshape(20, 3, 3), np.array(h3._TURN_FLAT).reshape(60, 5)
_HOME_FLAT, _BASES = np.array(h3._HOME_FLAT, np.int64).reshape(122, 3), np.array(h3._BASES, np.int64)
_BEYOND = np.array([g for row in h3._TURNS for g, _, _ in row])
_OUT_X, _OUT_Y = np.array([w.real for w in h3._OUT]), np.array([w.imag for w in h3._OUT])
_STEP_A, _STEP_B = np.array(h3.STEP_A), np.array(h3.STEP_B)
_STEP_DIGIT = np.array([int(d) for d in h3.STEP_DIGIT])
_FIVE = np.isin(np.arange(128), h3.PENTAGONS)
#: Digits 0 to 7 after turns.
_TURNED = np.array([[0, *map(int, t), 7] for t in h3._TURNED])
#: Places of the leads 0 to 7 among those of a cell of five neighbours.
_LEAD = np.array(["54623".find(str(d)) for d in range(8)])

# --- numbers -----------------------------------------------------------------------------------


def resolution(c: np.ndarray) -> np.ndarray:
    return c >> 52 & 15


def _digits(c: np.ndarray) -> np.ndarray:
    return c[:, None] >> np.arange(42, -1, -3) & 7


def _first(digits: np.ndarray, r) -> np.ndarray:
    """The first digit that isn't 0, or 0, down to a resolution."""
    led = (digits > 0) & (np.arange(digits.shape[1]) < np.reshape(r, (-1, 1)))
    at = led.argmax(1)[:, None]
    return np.where(led.any(1), np.take_along_axis(digits, at, 1)[:, 0], 0)


def is_pentagon(c: np.ndarray) -> np.ndarray:
    return _FIVE[c >> 45 & 127] & (c & (1 << 45) - 1 == (1 << 45 - 3 * resolution(c)) - 1)


def base_cells() -> np.ndarray:
    return (1 << 59) + (np.arange(122) << 45) + (1 << 45) - 1


def children(c: np.ndarray) -> np.ndarray:
    """A row of seven children for each cell; -1 in place of the one that a cell of five neighbours lacks."""
    shift = 42 - 3 * resolution(c)
    out = (c + (1 << 52) - (7 << shift))[:, None] + (np.arange(7) << shift[:, None])
    out[is_pentagon(c), 1] = -1
    return out


# --- places ------------------------------------------------------------------------------------


def direction(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    lon, lat = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], -1)


def _unit(p: np.ndarray) -> np.ndarray:
    return p / np.sqrt(p[..., :1] * p[..., :1] + p[..., 1:2] * p[..., 1:2] + p[..., 2:] * p[..., 2:])


def lonlat(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, y, z = p[..., 0], p[..., 1], p[..., 2]
    return np.degrees(np.arctan2(y, x)), np.degrees(np.arctan2(z, np.sqrt(x * x + y * y)))


def _named(face: np.ndarray, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """The cells at places of faces' lattices."""
    digits = np.full((len(face), 15), 7)
    for r in range(level, 0, -1):
        odd = r % 2 == 1
        up_a, up_b = ((3 * a - b if odd else 2 * a + b) + 3) // 7, ((a + 2 * b if odd else 3 * b - a) + 3) // 7
        da = a - (2 * up_a + up_b if odd else 3 * up_a - up_b)
        db = b - (3 * up_b - up_a if odd else up_a + 2 * up_b)
        digits[:, r - 1] = _STEP_DIGIT[(da + 1) * 3 + db + 1]
        a, b = up_a, up_b
    low = np.minimum(np.minimum(a, b), 0)
    k = _BASES[((face * 3 + (a - low)) * 3 + (b - low)) * 3 - low]
    base, turns, back, five = k >> 5, k >> 2 & 7, k >> 1 & 1, k & 1 == 1
    first = _first(digits, level)
    # the missing direction turns to one of its sides; then turns count five directions, and skip it
    side = np.where(first != 1, 0, np.where(back == 1, 5, 1))
    lead = np.where(first != 1, first, np.where(back == 1, 3, 5))
    skipped = _LEAD[lead] + turns >= 5
    total = np.where(first == 0, 0, np.where(five, (side + turns + skipped) % 6, turns))
    digits = _TURNED[total[:, None], digits]
    return (1 << 59) + (level << 52) + (base << 45) + (digits << np.arange(42, -1, -3)).sum(1)


def cell_of(p: np.ndarray, level: int) -> np.ndarray:
    """The cell of a resolution around each direction."""
    dots = p[:, 0, None] * _FLAT[:, 0, 0] + p[:, 1, None] * _FLAT[:, 0, 1] + p[:, 2, None] * _FLAT[:, 0, 2]
    f = dots.argmax(1)
    on = lambda k: (_FLAT[f, k, 0] * p[:, 0] + _FLAT[f, k, 1] * p[:, 1] + _FLAT[f, k, 2] * p[:, 2]) / (dots[np.arange(len(f)), f] * h3.UNIT)
    x, y = on(1), on(2)
    if level % 2:
        x, y = x * math.cos(h3.TILT) + y * math.sin(h3.TILT), y * math.cos(h3.TILT) - x * math.sin(h3.TILT)
    x, y = x * 7 ** (level / 2), y * 7 ** (level / 2)
    b = y / math.sqrt(0.75)
    a = x + b / 2
    q, r, s = a - b, b, -a
    rq, rr, rs = np.rint(q), np.rint(r), np.rint(s)
    off_q, off_r, off_s = np.abs(rq - q), np.abs(rr - r), np.abs(rs - s)
    worst = (off_q > off_r) & (off_q > off_s)
    new_q = np.where(worst, -rr - rs, rq)
    new_r = np.where(worst, rr, np.where(off_r > off_s, -rq - rs, rr))
    return _named(f, (new_q + new_r).astype(np.int64), new_r.astype(np.int64), level)


def cell_or_none(lon: np.ndarray, lat: np.ndarray, level: int) -> np.ndarray:
    """The cells of a resolution that hold points; -1 beyond the poles and for what isn't finite."""
    good = (np.abs(lat) <= 90) & (np.abs(lon) < np.inf)
    return np.where(good, cell_of(direction(np.where(good, lon, 0.0), np.where(good, lat, 0.0)), level), -1)


class Home:
    """Home faces of cells, their places on the lattices there, resolutions, whether digits were turned back over the missing direction, and the edges by which to leave the faces first, or -1."""

    def __init__(self, c: np.ndarray):
        base, d, self.r = c >> 45 & 127, _digits(c), resolution(c)
        first = _first(d, self.r)
        self.cut = _FIVE[base] & ((first == 4) | (first == 5))
        d = np.where(self.cut[:, None], _TURNED[5][d], d)
        self.f, a, b = _HOME_FLAT[base].T
        for r in range(1, int(self.r.max(initial=0)) + 1):
            k = np.minimum(d[:, r - 1], 6)
            na, nb = ((2 * a + b, 3 * b - a) if r % 2 else (3 * a - b, a + 2 * b))
            a, b = np.where(self.r >= r, na + _STEP_A[k], a), np.where(self.r >= r, nb + _STEP_B[k], b)
        self.a, self.b = a, b
        self.lean = np.where(self.cut, 2, np.where(_FIVE[base], 0, -1))

    def take(self, rows: np.ndarray) -> Home:
        out = object.__new__(Home)
        for k, v in vars(self).items():
            setattr(out, k, v[rows])
        return out


def _on_plane(a, b, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places on the lattices of resolutions; a and b may lie between hexagons."""
    x, y, odd = a - b / 2, b * math.sqrt(0.75), r % 2 == 1
    n = np.power(7.0, r / 2)
    c, s = math.cos(h3.TILT), math.sin(h3.TILT)
    return np.where(odd, x * c - y * s, x) / n, np.where(odd, x * s + y * c, y) / n


def _settled(f, x, y, lean: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(face, x, y) where places of planes lie, over up to five edges; first over the edge `lean` if they lie beyond that."""
    f, x, y = np.array(f), np.array(x), np.array(y)
    for i in range(5):
        o = x[:, None] * _OUT_X + y[:, None] * _OUT_Y
        far = o.max(1) > 1 + 1e-12
        if not far.any():
            break
        at = np.flatnonzero(far)
        edge = o[at].argmax(1)
        if lean is not None and i == 0:
            to = lean[at]
            edge = np.where((to >= 0) & (o[at, to] > 1 + 1e-12), to, edge)
        t, px, py = _TURN_FLAT[f[at] * 3 + edge], x[at], y[at]
        f[at], x[at], y[at] = t[:, 0], t[:, 1] * px - t[:, 2] * py + t[:, 3], t[:, 2] * px + t[:, 1] * py + t[:, 4]
    return f, x, y


def _to_sphere(f, x, y) -> np.ndarray:
    """Directions of settled places; not of length 1."""
    return _FLAT[f, 0] + h3.UNIT * (x[:, None] * _FLAT[f, 1] + y[:, None] * _FLAT[f, 2])


def _place_to_sphere(home: Home, a, b) -> np.ndarray:
    return _to_sphere(*_settled(home.f, *_on_plane(a, b, home.r), home.lean))


def center(c: np.ndarray) -> np.ndarray:
    """Directions; not of length 1."""
    home = Home(c)
    return _place_to_sphere(home, home.a, home.b)


# --- outlines ----------------------------------------------------------------------------------


def _packed(points: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of places with those that are there first, and their numbers."""
    order = np.argsort(~there, axis=1, kind="stable")
    return np.take_along_axis(points, order[:, :, None], 1), there.sum(1)


def _hexagons(home: Home, parts: int) -> tuple[np.ndarray, np.ndarray]:
    n, six = len(home.f), home.take(np.repeat(np.arange(len(home.f)), 6))
    ca, cb = np.tile(h3._CORNER_A, n), np.tile(h3._CORNER_B, n)
    x, y = _on_plane(six.a + ca, six.b + cb, six.r)
    f, sx, sy = _settled(six.f, x, y, six.lean)
    after = (np.arange(6 * n) // 6) * 6 + (np.arange(6 * n) + 1) % 6

    def to(one, other):
        d = np.zeros(6 * n)
        for e in range(3):
            d = np.where(_BEYOND[f[one] * 3 + e] == f[other], 1 - sx[one] * _OUT_X[e] - sy[one] * _OUT_Y[e], d)
        return d

    every = np.arange(6 * n)
    u, v = to(every, after), to(after, every)
    with np.errstate(invalid="ignore", divide="ignore"):
        bend = np.where((f != f[after]) & (u > 1e-9) & (v > 1e-9), u / (u + v), np.nan)
    t = np.sort(np.column_stack([np.tile([i / parts for i in range(parts)], (6 * n, 1)), bend]), axis=1)  # what isn't there comes last
    there = ~np.isnan(t)
    side = np.repeat(every, parts + 1)
    t = np.nan_to_num(t).ravel()
    at = _to_sphere(*_settled(six.f[side], x[side] + t * (x[after][side] - x[side]), y[side] + t * (y[after][side] - y[side]), six.lean[side]))
    return _packed(at.reshape(n, 6 * (parts + 1), 3), there.reshape(n, 6 * (parts + 1)))


def _pentagon(f: int, r: int, parts: int) -> np.ndarray:
    z = np.array(h3.pentagon_ring(r % 2 == 1))
    n = math.pow(7.0, r / 2)
    points = _to_sphere(*_settled(np.full(len(z), f), z.real / n + 2.0, z.imag / n))
    if parts == 1:
        return points
    u, v = _unit(points), _unit(np.roll(points, -1, 0))
    return np.stack([u * (1 - t / parts) + v * (t / parts) for t in range(parts)], 1).reshape(-1, 3)


def outline(c: np.ndarray, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Directions around each cell, against the clock, and how many there are; not of length 1."""
    points, n = _hexagons(Home(c), parts)
    five = np.flatnonzero(is_pentagon(c))
    if len(five):
        home = Home(c[five])
        points = np.concatenate([points, np.zeros((len(c), max(0, 10 * parts - points.shape[1]), 3))], 1)
        for i, f, r in zip(five, home.f, home.r):
            one = _pentagon(int(f), int(r), parts)
            n[i] = len(one)
            points[i, : len(one)] = one
    return points, n


def _next(n: np.ndarray, width: int) -> np.ndarray:
    """For each place of filled-up rows the one after it."""
    return (np.arange(width) + 1) % n[:, None]


def _around(points: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.take_along_axis(points, places[:, :, None], 1)


def area(c: np.ndarray) -> np.ndarray:
    """Square metres on the sphere."""
    points, n = outline(c)
    points[np.arange(points.shape[1]) >= n[:, None]] = 1.0  # of a length
    m, u = _unit(center(c))[:, None], _unit(points)
    v = _around(u, _next(n, u.shape[1]))
    x, y, z = 0, 1, 2
    det = m[..., x] * (u[..., y] * v[..., z] - u[..., z] * v[..., y]) - m[..., y] * (u[..., x] * v[..., z] - u[..., z] * v[..., x]) + m[..., z] * (u[..., x] * v[..., y] - u[..., y] * v[..., x])
    dot = lambda p, q: (p * q).sum(-1)
    turn = 2 * np.arctan2(det, 1 + dot(m, u) + dot(u, v) + dot(v, m))
    return np.where(np.arange(u.shape[1]) < n[:, None], turn, 0.0).sum(1) * (h3.RADIUS * h3.RADIUS)


# --- neighbours and directed edges -------------------------------------------------------------


def neighbors(c: np.ndarray, level: int) -> np.ndarray:
    """A row of the six neighbours, by digits 1 to 6, for each cell of a resolution; -1 in place of the one that a cell of five lacks."""
    five = np.repeat(is_pentagon(c), 6)
    k = np.tile(np.arange(1, 7), len(c))
    home = Home(c).take(np.repeat(np.arange(len(c)), 6))
    step = np.where(home.cut | (five & ((k == 4) | (k == 5))), _TURNED[5][k], k)
    at = _unit(_place_to_sphere(home, home.a + _STEP_A[step], home.b + _STEP_B[step]))
    return np.where(five & (k == 1), -1, cell_of(at, level)).reshape(-1, 6)


def edges(c: np.ndarray) -> np.ndarray:
    """A row of the six directed edges that leave each cell; -1 in place of the one that a cell of five lacks."""
    out = c[:, None] + (1 << 59) + (np.arange(1, 7) << 56)
    out[is_pentagon(c), 0] = -1
    return out


def edge_origin(e: np.ndarray) -> np.ndarray:
    return (e & (1 << 56) - 1) + (1 << 59)


def edge_destination(e: np.ndarray, level: int) -> np.ndarray:
    origin, place = np.unique(edge_origin(e), return_inverse=True)
    return neighbors(origin, level)[place, (e >> 56 & 7) - 1]


def edge(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """The directed edges from cells to their neighbours; -1 where they aren't neighbours."""
    origin, place = np.unique(a, return_inverse=True)
    same = neighbors(origin, level)[place] == b[:, None]
    return np.where(same.any(1), a + (1 << 59) + (same.argmax(1) + 1 << 56), -1)


def edge_length(e: np.ndarray, level: int) -> np.ndarray:
    """Metres on the sphere along edges, as their origins have them."""
    origin, place = np.unique(edge_origin(e), return_inverse=True)
    points, n = outline(origin)
    points[np.arange(points.shape[1]) >= n[:, None]] = 1.0  # of a length
    points, n, k = _unit(points)[place], n[place][:, None], np.arange(points.shape[1])
    a, b = _unit(center(origin))[place], _unit(center(edge_destination(e, level)))
    far = lambda u, v: np.sqrt(((u - v) ** 2).sum(-1))
    # points as far from one centre as from the other, to a tenth of the way between them
    on = (np.abs(far(points, a[:, None]) - far(points, b[:, None])) < 0.12 * far(a, b)[:, None]) & (k < n)
    first = (on & ~np.take_along_axis(on, (k - 1) % n, 1)).argmax(1)[:, None]
    lon, lat = lonlat(_around(points, (first + k) % n))
    s = lambda v: np.sin(np.radians(v) / 2)
    dlat, dlon, cos = s(lat[:, 1:] - lat[:, :-1]), s(lon[:, 1:] - lon[:, :-1]), np.cos(np.radians(lat))
    arc = 2 * h3.RADIUS * np.arcsin(np.minimum(1.0, np.sqrt(dlat * dlat + cos[:, :-1] * cos[:, 1:] * dlon * dlon)))
    return np.where(k[1:] < on.sum(1)[:, None], arc, 0.0).sum(1)


# --- columns -----------------------------------------------------------------------------------


def cells(lon, lat, level: int) -> Column:
    """As h3.h3_cell, for many rows."""

    @F.arrow_udf("long")
    def run(lon: pa.Array, lat: pa.Array) -> pa.Array:
        found = cell_or_none(lon.to_numpy(zero_copy_only=False), lat.to_numpy(zero_copy_only=False), level)
        return pa.array(found, mask=found < 0)

    return run(G.number(lon), G.number(lat))
