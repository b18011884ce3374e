"""Covers of many polygons by few large hexagonal cells: what is known of cells is a table in each process that works, and nothing is shuffled."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.functions import h3_arrays as A

#: The finest resolution whose cells are kept, 41,162 of them.
FINEST = 3
#: Rows that are covered at once, and pairs with an edge or a side that are looked at at once.
ROWS, PAIRS = 2_000, 500_000


class Level:
    """What is known of the cells of a resolution, in order of their numbers: windows of all that descends from them (minx, miny, maxx, maxy), centres, and children as places in the next one or -1."""

    def __init__(self, cells: np.ndarray, level: int):
        from meridia.operators.covers import REACH

        self.cells = cells
        self.lon, self.lat = A.lonlat(A.center(cells))
        reach, lat = REACH / 7 ** (level / 2), np.radians(self.lat)
        wide = np.degrees(np.arcsin(np.minimum(1.0, math.sin(reach) / np.maximum(np.cos(lat), 1e-12))))
        wide, high = np.where(np.abs(lat) + reach >= math.pi / 2, 180.0, wide), math.degrees(reach)
        self.window = np.stack([self.lon - wide, self.lat - high, self.lon + wide, self.lat + high])


class Cells:
    """The levels down to a resolution, that one's outlines and areas, and for each level how many cells of it descend from a cell and their area."""

    def __init__(self, level: int):
        cells, self.levels = A.base_cells(), []
        for at in range(level + 1):
            self.levels.append(Level(cells, at))
            if at < level:
                kids = A.children(cells)
                cells = np.sort(kids[kids >= 0])
                self.levels[-1].children = np.where(kids >= 0, np.searchsorted(cells, kids), -1)
        parts = 4 if level < 3 else 2 if level < 5 else 1  # as in covers
        done = [self._sides(cells[i : i + 4096], parts) for i in range(0, len(cells), 4096)]
        most = max(d.shape[2] for d in done)
        self.sides = np.concatenate([np.pad(d, ((0, 0), (0, 0), (0, most - d.shape[2])), constant_values=np.nan) for d in done], axis=1)
        x, y = self.sides[[0, 2]], self.sides[[1, 3]]
        self.box = np.stack([np.nanmin(x, (0, 2)), np.nanmin(y, (0, 2)), np.nanmax(x, (0, 2)), np.nanmax(y, (0, 2))])
        n, area = np.ones(len(cells)), np.concatenate([A.area(cells[i : i + 4096]) for i in range(0, len(cells), 4096)])
        self.below = [(n, area)]
        for known in self.levels[-2::-1]:
            there = known.children >= 0
            n, area = (np.where(there, v[known.children], 0.0).sum(1) for v in (n, area))
            self.below.insert(0, (n, area))

    @staticmethod
    def _sides(cells: np.ndarray, parts: int) -> np.ndarray:
        """x and y of both ends of the sides, each as short as it is, so beyond the seam where need be; not a number beyond the last."""
        points, n = A.outline(cells, parts)
        lon, lat = A.lonlat(points)
        middle = A.lonlat(A.center(cells))[0]
        near = lambda v, to: v - 360 * np.round((v - to) / 360)
        k = np.arange(lon.shape[1])
        after = (k + 1) % n[:, None]
        ax = near(lon, middle[:, None])
        bx, by = near(np.take_along_axis(lon, after, 1), ax), np.take_along_axis(lat, after, 1)
        return np.where(k < n[:, None], np.stack([ax, lat, bx, by]), np.nan)


#: Kept in a process, as workers take many batches.
known = functools.cache(Cells)


class Shapes:
    """Edges of polygons, by row, and the bounds of their vertices; nothing for missing rows."""

    def __init__(self, parts: pa.Array):
        size = lambda v: pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
        polygons = parts.flatten()
        rings = polygons.flatten()
        vertices = rings.flatten()
        row = np.repeat(np.repeat(np.repeat(np.arange(len(parts)), size(parts)), size(polygons)), n_ring := size(rings))
        ring = np.repeat(np.arange(len(n_ring)), n_ring)
        x, y = (vertices.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y"))
        self.x, self.y, self.row, n = x, y, row, len(parts)
        self.bounds = np.stack([np.full(n, np.inf), np.full(n, np.inf), np.full(n, -np.inf), np.full(n, -np.inf)])
        for to, by, v in zip(self.bounds, (np.minimum, np.minimum, np.maximum, np.maximum), (x, y, x, y)):
            by.at(to, row, v)
        pair = np.flatnonzero(ring[1:] == ring[:-1])
        self.edges = np.stack([x[pair], y[pair], x[pair + 1], y[pair + 1]])
        self.count = np.bincount(row[pair], minlength=n)
        self.start = np.cumsum(self.count) - self.count
        ax, ay, bx, by = self.edges
        self.low_x, self.low_y, self.high_x, self.high_y = np.minimum(ax, bx), np.minimum(ay, by), np.maximum(ax, bx), np.maximum(ay, by)

    def with_edges(self, rows: np.ndarray):
        """Places in `rows` and numbers of edges: each of the rows with each of its edges, some at a time."""
        counts = self.count[rows]
        ends = np.cumsum(counts)
        cut = np.unique([0, *np.searchsorted(ends, np.arange(PAIRS, ends[-1] if len(ends) else 0, PAIRS)), len(rows)])
        for a, b in zip(cut[:-1], cut[1:]):
            n = counts[a:b]
            place = np.repeat(np.arange(a, b), n)
            yield place, self.start[rows[place]] + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)

    def over(self, e: np.ndarray, box: np.ndarray) -> np.ndarray:
        """Whether edges' bounds overlap boxes."""
        return (self.low_x[e] <= box[2]) & (self.high_x[e] >= box[0]) & (self.low_y[e] <= box[3]) & (self.high_y[e] >= box[1])


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def _shifted(box: np.ndarray, by: float) -> np.ndarray:
    return box + np.array([by, 0.0, by, 0.0]).reshape(4, *[1] * (box.ndim - 1))


def _near(bounds: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Whether bounds and boxes overlap, on either side of the seam."""
    return _overlap(bounds, box) | ((box[0] < -180) & _overlap(bounds, _shifted(box, 360.0))) | ((box[2] > 180) & _overlap(bounds, _shifted(box, -360.0)))


def _touches(s: Shapes, i: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Whether edges of rows come into boxes, on either side of the seam."""
    out = np.zeros(len(i), bool)
    shift = np.where(box[0] < -180, 360.0, np.where(box[2] > 180, -360.0, 0.0))
    for sel, moved in ((np.arange(len(i)), box), (at := np.flatnonzero(shift), box[:, at] + np.stack([shift[at], 0 * at, shift[at], 0 * at]))):
        for place, e in s.with_edges(i[sel]):
            b = moved[:, place]
            over = np.flatnonzero(s.over(e, b))
            (ax, ay, bx, by), b, place = s.edges[:, e[over]], b[:, over], place[over]
            turns = [(bx - ax) * (b[y] - ay) - (by - ay) * (b[x] - ax) for x in (0, 2) for y in (1, 3)]
            out[sel[place[(np.minimum.reduce(turns) <= 0) & (np.maximum.reduce(turns) >= 0)]]] = True
    return out


def _inside(s: Shapes, i: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points are strictly inside of rows' polygons."""
    b = s.bounds[:, i]
    sel = np.flatnonzero((x >= b[0]) & (x <= b[2]) & (y >= b[1]) & (y <= b[3]))
    odd, on = np.zeros(len(i), np.int64), np.zeros(len(i), bool)
    for place, e in s.with_edges(i[sel]):
        px, py = x[sel[place]], y[sel[place]]
        level = np.flatnonzero((s.low_y[e] <= py) & (s.high_y[e] >= py))
        e, px, py, place = e[level], px[level], py[level], sel[place[level]]
        ax, ay, bx, by = s.edges[:, e]
        side = (bx - ax) * (py - ay) - (px - ax) * (by - ay)
        on[place[(side == 0) & (px >= s.low_x[e]) & (px <= s.high_x[e])]] = True
        odd += np.bincount(place[((ay <= py) & (by > py) & (side > 0)) | ((by <= py) & (ay > py) & (side < 0))], minlength=len(i))
    return (odd % 2 == 1) & ~on


def _crossed(s: Shapes, i: np.ndarray, j: np.ndarray, c: Cells) -> np.ndarray:
    """Whether edges of rows have a point in common with sides of cells, on either side of the seam."""
    out = np.zeros(len(i), bool)
    for by in (0.0, 360.0, -360.0):
        box = _shifted(c.box[:, j], by)
        sel = np.flatnonzero(~out & _overlap(s.bounds[:, i], box))
        for place, e in s.with_edges(i[sel]):
            over = np.flatnonzero(s.over(e, box[:, sel[place]]))
            for at in np.array_split(over, len(over) * c.sides.shape[2] // PAIRS + 1):
                ax, ay, bx, by_ = s.edges[:, e[at], None]
                cx, cy, dx, dy = c.sides[:, j[sel[place[at]]]]
                cx, dx = cx + by, dx + by
                near = (np.minimum(ax, bx) <= np.maximum(cx, dx)) & (np.minimum(cx, dx) <= np.maximum(ax, bx)) & (np.minimum(ay, by_) <= np.maximum(cy, dy)) & (np.minimum(cy, dy) <= np.maximum(ay, by_))
                p, q = np.nonzero(near)
                ax, ay, bx, by_, cx, cy, dx, dy = ax[p, 0], ay[p, 0], bx[p, 0], by_[p, 0], cx[p, q], cy[p, q], dx[p, q], dy[p, q]
                turn = lambda px, py, qx, qy, rx, ry: np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))
                hit = (turn(ax, ay, bx, by_, cx, cy) * turn(ax, ay, bx, by_, dx, dy) <= 0) & (turn(cx, cy, dx, dy, ax, ay) * turn(cx, cy, dx, dy, bx, by_) <= 0)
                out[sel[place[at[p[hit]]]]] = True
    return out


def cover_sums(parts: pa.Array, level: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row's polygons the number of cells of a resolution that they overlap, and these cells' square metres."""
    c, s = known(level), Shapes(parts)
    rows, n, m2 = len(parts), np.zeros(len(parts)), np.zeros(len(parts))
    own_row, own = s.row, A.cell_or_none(s.x, s.y, level)
    own_row, own = own_row[own >= 0], np.searchsorted(c.levels[level].cells, own[own >= 0])
    own = np.unique(own_row * len(c.levels[level].cells) + own)
    first = c.levels[0].window
    i, j = np.nonzero(_near(s.bounds[:, :, None], first[:, None, :]))
    for at, here in enumerate(c.levels):
        if at:
            j = c.levels[at - 1].children[j]
            i, j = np.repeat(i, 7)[j.ravel() >= 0], j.ravel()[j.ravel() >= 0]
            near = _near(s.bounds[:, i], here.window[:, j])
            i, j = i[near], j[near]
        w, b = here.window[:, j], s.bounds[:, i]
        border = (w[0] <= b[0]) & (w[2] >= b[2]) & (w[1] <= b[1]) & (w[3] >= b[3])
        rest = np.flatnonzero(~border)
        border[rest] = _touches(s, i[rest], w[:, rest])
        rest = np.flatnonzero(~border)
        whole = rest[_inside(s, i[rest], here.lon[j[rest]], here.lat[j[rest]])]
        for out, below in zip((n, m2), c.below[at]):
            out += np.bincount(i[whole], below[j[whole]], rows)
        i, j = i[border], j[border]
    found = np.isin(i * len(here.cells) + j, own)
    rest = np.flatnonzero(~found)
    found[rest] = _inside(s, i[rest], here.lon[j[rest]], here.lat[j[rest]])
    rest = np.flatnonzero(~found)
    found[rest] = _crossed(s, i[rest], j[rest], c)
    for out, below in zip((n, m2), c.below[-1]):
        out += np.bincount(i[found], below[j[found]], rows)
    return n.astype(np.int64), m2


def h3_cover_sums(df: DataFrame, geometry: str, level: int) -> DataFrame:
    """The columns of df but the polygons, n and m2: how many cells of a resolution up to FINEST overlap a row's polygons, and the square metres of those cells.

    The cells are those of covers.h3_cover with the rule overlap, found by the same steps, but a row
    is the work of one task, with some of its pairs of cells and edges held at once. Rows without
    cells are left out.
    """
    if not 0 <= level <= FINEST:
        raise ValueError(f"a resolution is 0 to {FINEST}")
    names = [c for c in df.columns if c != geometry]
    bad = F.raise_error(F.lit("sums of covers are of polygons")).cast(G.PARTS)
    shapes = df.where(F.col(geometry).isNotNull()).select(*names, F.when(G.dimension(geometry) == 2, G.parts(geometry)).otherwise(bad).alias("g_"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                some = batch.slice(a, ROWS)
                n, m2 = cover_sums(some.column(len(names)), level)
                there = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([*(some.column(k).take(pa.array(there)) for k in range(len(names))), pa.array(n[there]), pa.array(m2[there])], names=[*names, "n", "m2"])

    return shapes.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in names), "n long", "m2 double"]))
