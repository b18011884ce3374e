"""Covers of geometries by hexagonal cells, from coarse to fine."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.functions import grids, h3
from meridia.functions import measures as M
from meridia.operators.saved import MOST_ROWS, saved, spread, tasks

#: A cell and all that descend from it lie within so many radians of its centre at resolution 0; each finer one within 1 / sqrt(7) of that.
REACH = 0.62 * h3.UNIT
RULES = ("overlap", "center", "within", "bbox")
#: Outlines of cells that are broadcast, of about 600 bytes each.
MOST_OUTLINES = 50_000


def _window(c: Column, level: int) -> Column:
    """Struct of the centre and the bounds in degrees of everything that descends from a cell; all longitudes near a pole."""
    reach = REACH / 7 ** (level / 2)

    def go(m):
        lat = F.radians(m["lat"])
        polar = F.abs(lat) + reach >= math.pi / 2
        wide = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(reach) / F.greatest(F.cos(lat), F.lit(1e-12))))))
        high = math.degrees(reach)
        return F.struct(m["lon"].alias("lon"), m["lat"].alias("lat"), (m["lon"] - wide).alias("minx"), (m["lat"] - high).alias("miny"), (m["lon"] + wide).alias("maxx"), (m["lat"] + high).alias("maxy"))

    return G.let(h3.h3_center(c), go)


def _shifted(box: Column, by: float) -> Column:
    return F.struct((box["minx"] + by).alias("minx"), box["miny"].alias("miny"), (box["maxx"] + by).alias("maxx"), box["maxy"].alias("maxy"))


def _edges(g: Column) -> Column:
    return F.flatten(F.transform(G.rings(g), lambda r: G.pairs(r, lambda a, b: F.struct(a.alias("a"), b.alias("b")))))


def _touches(g: Column, box: Column) -> Column:
    """Whether a geometry's vertices or edges come into a box, on either side of the seam."""

    def at(by):
        b = _shifted(box, by)
        inside = lambda v: (v["x"] >= b["minx"]) & (v["x"] <= b["maxx"]) & (v["y"] >= b["miny"]) & (v["y"] <= b["maxy"])
        return F.exists(G.vertices(g), inside) | F.exists(_edges(g), lambda e: grids._meets(e["a"], e["b"], b, False))

    beyond = F.when(box["minx"] < -180, at(360.0)).when(box["maxx"] > 180, at(-360.0)).otherwise(False)
    return at(0.0) | beyond


def _cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two segments have a point in common."""
    turn = lambda p, q, r: F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))
    near = lambda k: (F.least(a[k], b[k]) <= F.greatest(c[k], d[k])) & (F.least(c[k], d[k]) <= F.greatest(a[k], b[k]))
    return near("x") & near("y") & (turn(a, b, c) * turn(a, b, d) <= 0) & (turn(c, d, a) * turn(c, d, b) <= 0)


def _ring(c: Column, parts: int) -> Column:
    """The sides of a cell as segments in degrees, each as short as it is, so beyond the seam where need be."""

    def near(v, lon):
        return F.struct((v["lon"] - 360 * F.round((v["lon"] - lon) / 360)).alias("x"), v["lat"].alias("y"))

    def go(p):
        k = F.size(p["o"])
        return F.transform(p["o"], lambda v, i: F.struct(near(v, p["m"]["lon"]).alias("a"), near(F.get(p["o"], (i + 1) % k), near(v, p["m"]["lon"])["x"]).alias("b")))

    return G.let(F.struct(h3.h3_boundary(c, parts).alias("o"), h3.h3_center(c).alias("m")), go)


def _overlap(a: Column, b: Column) -> Column:
    return (a["minx"] <= b["maxx"]) & (a["maxx"] >= b["minx"]) & (a["miny"] <= b["maxy"]) & (a["maxy"] >= b["miny"])


def _near(bounds: Column, box: Column) -> Column:
    """Whether bounds and a box overlap, on either side of the seam."""
    return _overlap(bounds, box) | ((box["minx"] < -180) & _overlap(bounds, _shifted(box, 360.0))) | ((box["maxx"] > 180) & _overlap(bounds, _shifted(box, -360.0)))


def _outlines(cells: DataFrame, level: int) -> DataFrame:
    """(cell, m_, ring_, box_) of cells of a resolution: centre, sides and the bounds of these, for each once."""
    parts = 4 if level < 3 else 2 if level < 5 else 1  # sides are arcs: in degrees straight only where they are short
    sides = cells.select("cell", h3.h3_center("cell").alias("m_"), _ring(F.col("cell"), parts).alias("ring_"))
    ends = lambda k: F.concat(F.transform("ring_", lambda s: s["a"][k]), F.transform("ring_", lambda s: s["b"][k]))
    box = F.struct(F.array_min(ends("x")).alias("minx"), F.array_min(ends("y")).alias("miny"), F.array_max(ends("x")).alias("maxx"), F.array_max(ends("y")).alias("maxy"))
    return saved(sides.select("*", box.alias("box_")))


def _leaf(rule: str) -> Column:
    """Whether a cell on a geometry's border belongs to its cover, by the columns of shapes and _outlines."""
    g, ring, box, bounds = map(F.col, ("g_", "ring_", "box_", "b_"))
    inside = M.contains_xy(g, F.col("m_.lon"), F.col("m_.lat"))
    if rule == "center":
        return inside
    shifts = lambda f: f(0.0) | f(360.0) | f(-360.0)
    if rule == "bbox":
        low, high = (lambda k: F.array_min(F.transform(ring, lambda s: s["a"][k]))), (lambda k: F.array_max(F.transform(ring, lambda s: s["a"][k])))
        return shifts(lambda by: (low("x") + by <= bounds["maxx"]) & (high("x") + by >= bounds["minx"]) & (low("y") <= bounds["maxy"]) & (high("y") >= bounds["miny"]))
    moved = lambda v, by: F.struct((v["x"] + by).alias("x"), v["y"].alias("y"))

    def crosses(by):
        b = _shifted(box, by)
        close = F.filter(_edges(g), lambda e: (F.least(e["a"]["x"], e["b"]["x"]) <= b["maxx"]) & (F.greatest(e["a"]["x"], e["b"]["x"]) >= b["minx"]) & (F.least(e["a"]["y"], e["b"]["y"]) <= b["maxy"]) & (F.greatest(e["a"]["y"], e["b"]["y"]) >= b["miny"]))
        found = F.exists(close, lambda e: F.exists(ring, lambda s: _cross(e["a"], e["b"], moved(s["a"], by), moved(s["b"], by))))
        return F.when(_overlap(bounds, b), found).otherwise(False)

    if rule == "within":
        return inside & ~shifts(crosses)
    return F.coalesce(F.array_contains("own_", F.col("cell")), F.lit(False)) | inside | shifts(crosses)


def _joined(pairs: DataFrame, counted: DataFrame, each: int, shapes: DataFrame) -> DataFrame:
    """Pairs (i_, cell) with the columns of their shapes; where a shape has about `each` pairs for a row of `counted`, and many in all, they are the work of many tasks."""
    n = tasks(pairs.sparkSession, each * counted.count())
    many = saved(counted.groupBy("i_").agg(F.ceil(F.count("*") * each / MOST_ROWS).alias("n_")).where("n_ > 1"))  # over a task's rows of pairs each, so few
    part = F.coalesce("n_", F.lit(1).cast("long"))
    left = pairs.join(F.broadcast(many), "i_", "left").withColumn("p_", F.pmod(F.xxhash64("cell"), part)).drop("n_")
    right = shapes.join(F.broadcast(many), "i_", "left").withColumn("p_", F.explode(F.sequence(F.lit(0).cast("long"), part - 1))).drop("n_")
    return left.repartition(n, "i_", "p_").join(right.repartition(n, "i_", "p_").hint("merge"), ["i_", "p_"]).drop("p_")


def h3_cover(df: DataFrame, geometry: str, level: int, *, rule: str = "overlap", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all by default but the geometry) and `cell` for each cell of a resolution that covers a row's geometry, in degrees.

    Rules: overlap (any common point), center (the cell's centre inside a polygon), within (the whole
    cell inside one), bbox (the bounds of both meet). Starts from the base cells and goes down a
    resolution at a time; only cells near a border are tested again, those wholly inside a polygon
    are taken with all that descends from them, so the work follows the border. What is known of a
    cell alone is found once for all rows, and bounds come before shapes. Each resolution is written
    as numbers of rows and cells, and a large geometry is the work of many tasks. Sides of
    a polygon are straight in degrees; a polygon that reaches over the seam must be split there, and
    a pole's cell is none of `within`. Rows of missing and empty geometries have no cells.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    names = [c for c in df.columns if c != geometry] if keep is None else keep
    g, c = F.col("g_"), F.col("cell")
    shapes = df.where(F.col(geometry).isNotNull() & ~G.is_empty(F.col(geometry))).select(F.monotonically_increasing_id().alias("i_"), *names, F.col(geometry).alias("g_"), G.bounds(geometry).alias("b_"))
    if rule == "bbox":  # asks for the geometry's box, and no part of that is inside it for sure
        shapes = shapes.withColumn("g_", grids.box_polygon(F.col("b_")))
    if rule == "overlap":
        shapes = shapes.withColumn("own_", F.array_distinct(F.transform(G.vertices(g), lambda v: h3.h3_cell(v["x"], v["y"], level))))
    shapes = saved(shapes)
    inner = lambda w: (w["minx"] <= F.col("b_")["minx"]) & (w["maxx"] >= F.col("b_")["maxx"]) & (w["miny"] <= F.col("b_")["miny"]) & (w["maxy"] >= F.col("b_")["maxy"])
    border, whole = shapes.select("i_", "b_"), None
    for at in range(level + 1):
        if at:
            kids = spread(saved(border.select("cell").distinct()), "cell").select("cell", F.explode(h3.h3_children(c)).alias("k_"))
            pairs = border.join(saved(kids.select("cell", "k_", _window(F.col("k_"), at).alias("w_"))), "cell")
        else:
            pairs = border.join(F.broadcast(saved(h3.h3_base_cells(df.sparkSession).select(F.col("cell").alias("k_"), _window(c, 0).alias("w_")))), _near(F.col("b_"), F.col("w_")))
        pairs = pairs.where(_near(F.col("b_"), F.col("w_"))).select("i_", F.col("k_").alias("cell"), "w_")
        w = F.col("w_")
        state = F.when(inner(w), 1).when(_touches(g, w), 1).when(M.contains_xy(g, w["lon"], w["lat"]), 2).otherwise(0)
        found = saved(_joined(pairs, border, 4, shapes).select("i_", "b_", "cell", state.alias("s_")).where("s_ > 0"))
        more = found.where("s_ = 2").select("i_", "cell")
        whole = more if whole is None else whole.select("i_", F.explode(h3.h3_children(c)).alias("cell")).union(more)
        border = found.where("s_ = 1").select("i_", "b_", "cell")
    outlines = _outlines(spread(saved(border.select("cell").distinct()), "cell"), level)
    if outlines.count() <= MOST_OUTLINES:
        outlines = F.broadcast(outlines)
    edge = _joined(border.select("i_", "cell"), border, 1, shapes).join(outlines, "cell").where(_leaf(rule)).select(*names, "cell")
    return edge.union(whole.join(shapes.select("i_", *names), "i_").select(*names, "cell"))


def h3_bounding_cell(g) -> Column:
    """The finest cell that all vertices of a geometry and the corners of its bounds descend to; null if they share no base cell."""

    def common(b):
        corners = [h3.h3_cell(b[x], b[y], h3.FINEST) for x in ("minx", "maxx") for y in ("miny", "maxy")]

        def shared(k):
            same = F.aggregate(F.sequence(F.lit(1), F.lit(h3.FINEST)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, i: G.let(a["on"] & (F.size(F.array_distinct(F.transform(k, lambda c: F.substring(h3.h3_digits(c), F.lit(1), i)))) == 1), lambda on: F.struct((a["n"] + on.cast("int")).alias("n"), on.alias("on"))), lambda a: a["n"])
            return F.when(F.size(F.array_distinct(F.transform(k, h3.h3_base_cell))) == 1, G.let(same, lambda n: h3.h3_parent(k[0], n)))

        return F.when(b["minx"].isNotNull(), G.let(F.array(*corners), shared))

    return G.let(G.bounds(g), common)


def h3_disks(cells: DataFrame, cell: str, level: int, k: int) -> DataFrame:
    """(cell, other, steps) for all cells within k steps of each distinct cell of a resolution.

    Rings grow one by one, each written before the next: a step asks the neighbours of the last ring
    only, each cell's once, and leaves out what is in the last two.
    """
    last = saved(cells.where(F.col(cell).isNotNull()).select(F.col(cell).alias(cell)).distinct().select(cell, F.col(cell).alias("other"), F.lit(0).alias("steps")))
    rings, known = [last], None
    for n in range(1, k + 1):
        new = last.select("other").distinct()
        new = saved(new if known is None else new.join(known, "other", "left_anti"))
        new = saved(spread(new, "other").select("other", F.array_compact(h3.h3_neighbors("other", level)).alias("near_")))
        known = new if known is None else known.union(new)
        near = last.join(known, "other").select(cell, F.explode("near_").alias("other")).distinct()
        seen = rings[-1].union(rings[-2]) if n > 1 else rings[-1]
        last = saved(near.join(seen.select(cell, "other"), [cell, "other"], "left_anti").withColumn("steps", F.lit(n)))
        rings.append(last)
    out = rings[0]
    for ring in rings[1:]:
        out = out.union(ring)
    return out


def h3_rings(cells: DataFrame, cell: str, level: int, k: int) -> DataFrame:
    """(cell, other) for the cells exactly k steps away."""
    return h3_disks(cells, cell, level, k).where(F.col("steps") == k).select(cell, "other")
