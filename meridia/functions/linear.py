"""Linear referencing along single lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G
from . import measures as M


def _line(g) -> Column:
    return F.get(G.rings(g), F.lit(0))


def _steps(r: Column) -> Column:
    return G.pairs(r, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))


def _sum_to(steps: Column, i: Column) -> Column:
    return G.total(F.slice(steps, F.lit(1), i))


def interpolate(g, distance, *, normalized: bool = False) -> Column:
    """The point at a distance along a line, negative from its end, clamped to the line."""
    r, whole = _line(g), M.length(g)
    d = G.number(distance) * (whole if normalized else F.lit(1.0))
    d = F.greatest(F.lit(0.0), F.least(whole, F.when(d < 0, whole + d).otherwise(d)))

    def go(acc, i):
        a, b = F.get(r, i), F.get(r, i + 1)
        n = F.hypot(b["x"] - a["x"], b["y"] - a["y"])
        t = F.when(n == 0, 0.0).otherwise(acc["left"] / n)
        here = F.when(~acc["done"] & (acc["left"] <= n), F.struct(*[(a[k] + (b[k] - a[k]) * t).alias(k) for k in "xyzm"])).otherwise(acc["at"])
        return F.struct(F.when(acc["done"], acc["left"]).otherwise(acc["left"] - n).alias("left"), (acc["done"] | (acc["left"] <= n)).alias("done"), here.alias("at"))

    start = F.struct(d.alias("left"), F.lit(False).alias("done"), F.element_at(r, -1).alias("at"))
    at = F.aggregate(F.sequence(F.lit(0), F.size(r) - 2), start, go, lambda acc: acc["at"])
    return F.when(G.is_empty(g), G.empty(G.POINT)).otherwise(G.geometry(G.POINT, F.array(F.array(F.array(at)))))


def locate(g, px, py, *, normalized: bool = False) -> Column:
    """Distance along the line to its point nearest to (px, py); the first of equal ones."""
    r, px, py = _line(g), G.number(px), G.number(py)
    steps = _steps(r)

    def of(i):
        a, b = F.get(r, i), F.get(r, i + 1)
        n = F.get(steps, i)
        t = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - a["x"]) * (b["x"] - a["x"]) + (py - a["y"]) * (b["y"] - a["y"])) / (n * n))))
        return F.struct(M.segment_distance(px, py, a, b).alias("d"), (_sum_to(steps, i) + t * n).alias("at"))

    best = F.array_min(F.transform(F.sequence(F.lit(0), F.size(r) - 2), of))["at"]
    return best / M.length(g) if normalized else best


def substring(g, start, end) -> Column:
    """The part of a line between two distances along it."""
    r, steps = _line(g), _steps(_line(g))
    a, b = G.number(start), G.number(end)
    inner = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: (_sum_to(steps, i) > a) & (_sum_to(steps, i) < b))
    at = lambda d: F.get(G.vertices(interpolate(g, d)), F.lit(0))
    return G.line_string(F.concat(F.array(at(a)), F.transform(inner, lambda i: F.get(r, i)), F.array(at(b))))


def with_distances(g) -> Column:
    """The line with m set to the distance along it."""
    r, steps = _line(g), _steps(_line(g))
    return G.geometry(G.LINE, F.array(F.transform(r, lambda v, i: G.vertex(v["x"], v["y"], v["z"], _sum_to(steps, i)))))


def interpolate_m(g, value) -> Column:
    """The first point of a line where m has a value; null if there is none."""
    r, m = _line(g), G.number(value)
    at = F.filter(F.sequence(F.lit(0), F.size(r) - 2), lambda i: (F.least(F.get(r, i)["m"], F.get(r, i + 1)["m"]) <= m) & (m <= F.greatest(F.get(r, i)["m"], F.get(r, i + 1)["m"])))
    i = F.get(at, F.lit(0))
    a, b = F.get(r, i), F.get(r, i + 1)
    t = F.when(a["m"] == b["m"], 0.0).otherwise((m - a["m"]) / (b["m"] - a["m"]))
    return F.when(i.isNotNull(), G.point(a["x"] + (b["x"] - a["x"]) * t, a["y"] + (b["y"] - a["y"]) * t, a["z"] + (b["z"] - a["z"]) * t, m))
