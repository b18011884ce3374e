"""Spatial joins, nearest neighbours and filters, planned with cells and bounds."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.functions import kernels as K
from meridia.functions import measures as M
from meridia.operators.saved import saved, spread

#: Predicates that hold only where the bounds meet.
PREDICATES = ("intersects", "contains", "within", "covers", "covered_by", "touches", "crosses", "overlaps", "equals", "contains_properly")


def with_bounds(df: DataFrame, geometry: str, prefix: str) -> DataFrame:
    b = G.bounds(F.col(geometry))
    df = df.withColumn(f"{prefix}_b", b)
    return df.select("*", *[F.col(f"{prefix}_b")[k].alias(f"{prefix}_{k}") for k in ("minx", "miny", "maxx", "maxy")]).drop(f"{prefix}_b")


def _meet(grow: float = 0.0) -> Column:
    c = F.col
    return (c("l_minx") - grow <= c("r_maxx")) & (c("r_minx") <= c("l_maxx") + grow) & (c("l_miny") - grow <= c("r_maxy")) & (c("r_miny") <= c("l_maxy") + grow)


def extents(sides: list[tuple[DataFrame, str]], grow: float) -> tuple[float, float]:
    """(size of a grid that boxes of average extent meet in few cells, the largest extent), from one aggregate a side."""
    best, widest = 0.0, 0.0
    for df, p in sides:
        extent = F.greatest(F.col(f"{p}_maxx") - F.col(f"{p}_minx"), F.col(f"{p}_maxy") - F.col(f"{p}_miny"))
        r = df.agg(F.percentile_approx(extent, 0.5).alias("e"), F.max(extent).alias("most"), F.max(f"{p}_maxx").alias("x1"), F.min(f"{p}_minx").alias("x0"), F.count("*").alias("n")).first()
        if r["n"]:
            best = max(best, 2 * ((r["e"] or 0.0) + grow), ((r["x1"] or 0.0) - (r["x0"] or 0.0)) / max(1.0, math.sqrt(r["n"])) / 4)
            widest = max(widest, (r["most"] or 0.0) + 2 * grow)
    return best or 1.0, widest


def _level(p: str, size: float, grow: float) -> Column:
    """0 for extents up to a cell's side, and one more for each four times that."""
    extent = F.greatest(F.col(f"{p}_maxx") - F.col(f"{p}_minx"), F.col(f"{p}_maxy") - F.col(f"{p}_miny")) + 2 * grow
    return F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(extent, F.lit(size)) / size) - 1e-9)).cast("int")


def _cells(p: str, size: float, grow: float, top: int) -> Column:
    """Cells that a box meets, on its own level and all coarser ones: at most four on each."""

    def of(j):
        side = size * F.pow(F.lit(4.0), j)
        at = lambda c, g: F.floor((F.col(f"{p}_{c}") + g) / side)
        return F.flatten(F.transform(F.sequence(at("minx", -grow), at("maxx", grow)), lambda x: F.transform(F.sequence(at("miny", -grow), at("maxy", grow)), lambda y: F.struct(j.alias("j"), x.alias("cx"), y.alias("cy")))))

    return F.flatten(F.transform(F.sequence(F.col(f"{p}_level"), F.lit(top)), of))


#: Bytes that a side may have to be broadcast, at 32 a vertex and 64 a row.
MOST_BYTES = 64 << 20


def small(df: DataFrame, geometry: str, most: int) -> int | None:
    """The bytes of a side of at most `most` rows, counted; None if it is larger than may be broadcast."""
    r = df.limit(most + 1).agg(F.count("*").alias("n"), F.sum(G.num_coordinates(F.col(geometry))).alias("v")).first()
    size = 64 * r["n"] + 32 * (r["v"] or 0)
    return size if r["n"] <= most and size <= MOST_BYTES else None


def candidates(left: DataFrame, right: DataFrame, left_geometry: str, right_geometry: str, *, within: float = 0.0, most_broadcast: int = 20_000, size: float | None = None, test: Column | None = None) -> DataFrame:
    """Pairs of rows whose bounds meet, or come within a distance, each once; columns of both sides.

    A side of at most `most_broadcast` rows and MOST_BYTES (counted), the smaller one if both are, is
    broadcast and compared by bounds, so the larger one streams. Beyond, both sides are dealt over
    grid cells and joined on the cell. Large boxes have coarser cells, so none has more than a few; a
    pair meets on the level of the larger box, in the one cell that holds the lower corner of its
    common bounds, so nothing has to be deduplicated. Missing and empty geometries pair with nothing.
    Column names of the sides must differ. With a `test` of pairs, rows of the left that pass it with
    any row of the right come instead of pairs, some more than once.
    """
    l, r = with_bounds(left, left_geometry, "l").where("l_minx is not null"), with_bounds(right, right_geometry, "r").where("r_minx is not null")
    bytes_r = small(right, right_geometry, most_broadcast)
    bytes_l = small(left, left_geometry, most_broadcast) if bytes_r is None or bytes_r > 1 << 16 else None
    if bytes_l is not None and (bytes_r is None or bytes_l < bytes_r):
        return r.join(F.broadcast(l), _meet(within) if test is None else _meet(within) & test)
    if bytes_r is not None:
        return l.join(F.broadcast(r), _meet(within)) if test is None else l.join(F.broadcast(r), _meet(within) & test, "left_semi")
    found, widest = extents([(l, "l"), (r, "r")], within)
    size = size or found
    top = max(0, math.ceil(math.log(max(widest, size) / size, 4) - 1e-9))
    l, r = l.withColumn("l_level", _level("l", size, within)), r.withColumn("r_level", _level("r", size, 0.0))
    lc, rc = l.withColumn("cell", F.explode(_cells("l", size, within, top))), r.withColumn("cell", F.explode(_cells("r", size, 0.0, top)))
    side = size * F.pow(F.lit(4.0), F.col("cell")["j"])
    home = (F.floor(F.greatest(F.col("l_minx") - within, F.col("r_minx")) / side) == F.col("cell")["cx"]) & (F.floor(F.greatest(F.col("l_miny") - within, F.col("r_miny")) / side) == F.col("cell")["cy"])
    if test is not None:
        rc = rc.withColumnRenamed("cell", "r_cell")
        return lc.join(rc, (F.col("cell") == F.col("r_cell")) & (F.col("cell")["j"] == F.greatest("l_level", "r_level")) & _meet(within) & test, "left_semi")
    return lc.join(rc, "cell").where((F.col("cell")["j"] == F.greatest("l_level", "r_level")) & _meet(within) & home).drop("cell", "l_level", "r_level")


def refine(predicate: str, left: str, right: str, left_kind: str | None, right_kind: str | None) -> Column:
    """The exact test; column expressions where a side is known to hold points, boxes are Python's otherwise."""
    g, h = F.col(left), F.col(right)
    if (left_kind, right_kind) in (("box", "point"), ("point", "box")):
        # candidates carry the bounds of both sides
        p, q = ("r", "l") if right_kind == "point" else ("l", "r")
        x, y, box = F.col(f"{p}_minx"), F.col(f"{p}_miny"), {k: F.col(f"{q}_{k}") for k in ("minx", "miny", "maxx", "maxy")}
        inside = (x > box["minx"]) & (x < box["maxx"]) & (y > box["miny"]) & (y < box["maxy"])
        meets = (x >= box["minx"]) & (x <= box["maxx"]) & (y >= box["miny"]) & (y <= box["maxy"])
        one_way = {"contains", "contains_properly", "covers"} if left_kind == "box" else {"within", "covered_by"}
        tests = {"intersects": meets, "touches": meets & ~inside, **{k: meets if k.startswith("cover") else inside for k in one_way}}
        return tests.get(predicate, F.lit(False))
    if right_kind == "point" and predicate in ("contains", "contains_properly"):
        return M.contains_xy(g, G.x(h), G.y(h))
    if right_kind == "point" and predicate in ("intersects", "covers"):
        return M.intersects_xy(g, G.x(h), G.y(h))
    if left_kind == "point" and predicate == "within":
        return M.contains_xy(h, G.x(g), G.y(g))
    if left_kind == "point" and predicate in ("intersects", "covered_by"):
        return M.intersects_xy(h, G.x(g), G.y(g))
    if left_kind == right_kind == "box":
        a, b = G.bounds(g), G.bounds(h)
        relation = M.box_relation(a, b)
        inside = lambda p, q: (p["minx"] >= q["minx"]) & (p["maxx"] <= q["maxx"]) & (p["miny"] >= q["miny"]) & (p["maxy"] <= q["maxy"])
        return {
            "intersects": F.lit(True), "touches": relation == "touches", "equals": relation == "equals", "contains": inside(b, a), "covers": inside(b, a),
            "within": inside(a, b), "covered_by": inside(a, b), "overlaps": relation == "overlaps", "crosses": F.lit(False), "contains_properly": (b["minx"] > a["minx"]) & (b["maxx"] < a["maxx"]) & (b["miny"] > a["miny"]) & (b["maxy"] < a["maxy"]),
        }[predicate]
    return K.predicate(predicate, g, h)


def spatial_join(left: DataFrame, right: DataFrame, predicate: str, left_geometry: str, right_geometry: str, *, left_kind: str | None = None, right_kind: str | None = None, how: str = "inner", **plan) -> DataFrame:
    """Rows of both sides where predicate(left, right) holds; `how` is inner, left, semi or anti.

    Kinds (`point`, `box`) let the exact test stay in column expressions. Left, semi and anti joins
    need unique rows on the left: they go by a row number made for the purpose.
    """
    if predicate not in PREDICATES:
        raise ValueError(f"unknown predicate {predicate!r}; disjoint has no index, the others are {', '.join(PREDICATES)}")
    test = refine(predicate, left_geometry, right_geometry, left_kind, right_kind)
    return _joined(left, right, lambda l: candidates(l, right, left_geometry, right_geometry, **plan).where(test), how)


def _joined(left: DataFrame, right: DataFrame, match: Callable[[DataFrame], DataFrame], how: str, meets: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`meets`, if there is one, gives the rows of the left that match at all, so that not every pair has to be made."""
    keep = [*left.columns, *right.columns]
    if how == "inner":
        return match(left).select(*keep)
    numbered = saved(left.withColumn("_row", F.monotonically_increasing_id()))  # read twice, and numbers depend on the order of rows
    if how in ("semi", "anti"):
        found = (meets or match)(numbered)
        return numbered.join(found.select("_row").distinct(), "_row", f"left_{how}").select(*left.columns)
    return numbered.join(match(numbered).select("_row", *right.columns), "_row", "left").select(*keep)


def all_points(df: DataFrame, geometry: str) -> bool:
    return not df.where(G.kind(F.col(geometry)) != G.POINT).limit(1).count()


def _distance(right: DataFrame, right_geometry: str) -> Column:
    """From candidates' left points to the right geometries; by the bounds where all of these are points."""
    x, y = F.col("l_minx"), F.col("l_miny")
    if all_points(right, right_geometry):
        dx, dy = F.col("r_minx") - x, F.col("r_miny") - y
        return F.sqrt(dx * dx + dy * dy)
    return M.distance_xy(F.col(right_geometry), x, y)


def dwithin_join(left: DataFrame, right: DataFrame, distance: float, left_geometry: str, right_geometry: str, *, how: str = "inner", **plan) -> DataFrame:
    """Pairs of points and any geometries within a planar distance of each other; left holds points."""
    test = _distance(right, right_geometry) <= distance
    match = lambda l: candidates(l, right, left_geometry, right_geometry, within=distance, **plan).where(test)
    return _joined(left, right, match, how, lambda l: candidates(l, right, left_geometry, right_geometry, within=distance, test=test, **plan))


def self_join(df: DataFrame, predicate: str, geometry: str, id: str, *, kind: str | None = None, **plan) -> DataFrame:
    """Each unordered pair once: columns of the row with the smaller id, and of the other with _2."""
    other = df.select(*[F.col(c).alias(f"{c}_2") for c in df.columns])
    test = refine(predicate, geometry, f"{geometry}_2", kind, kind)
    return candidates(df, other, geometry, f"{geometry}_2", **plan).where((F.col(id) < F.col(f"{id}_2")) & test).select(*df.columns, *other.columns)


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_geometry: str, right_geometry: str, *, k: int = 1, ties: bool = False, start: float | None = None, **plan) -> DataFrame:
    """left_id, right_id, distance and rank of the k nearest right geometries of every left point.

    Searches within a distance and widens it fourfold for the points that have fewer than k there, so
    work follows the density around each point. With ties all at the kth distance come too; otherwise
    smaller right_ids go first.
    """
    l = left.where(~G.is_empty(F.col(left_geometry)) & F.col(left_geometry).isNotNull()).select(left_id, left_geometry)
    r = right.where(~G.is_empty(F.col(right_geometry)) & F.col(right_geometry).isNotNull()).select(right_id, right_geometry)
    most = plan.get("most_broadcast", 20_000)
    points = all_points(r, right_geometry)
    if points and small(r, right_geometry, most) is not None:
        return _nearest_points(l, r, left_id, right_id, left_geometry, right_geometry, k, ties)
    box, n = r.select(G.bounds(F.col(right_geometry)).alias("b")).agg(F.min("b.minx"), F.min("b.miny"), F.max("b.maxx"), F.max("b.maxy")).first(), r.count()
    if not n:
        return l.limit(0).select(left_id).crossJoin(r.limit(0).select(right_id)).select("*", F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
    here = l.select(G.bounds(F.col(left_geometry)).alias("b")).agg(F.min("b.minx"), F.min("b.miny"), F.max("b.maxx"), F.max("b.maxy")).first()
    low = [min(a, b) for a, b in zip(box[:2], here[:2]) if a is not None and b is not None] or list(box[:2])
    high = [max(a, b) for a, b in zip(box[2:], here[2:]) if a is not None and b is not None] or list(box[2:])
    diagonal = math.dist(low, high) or 1.0
    # of points so few lie nearer than this on average; areas are nearer by their extent
    reach = start or diagonal * math.sqrt(k / n) / (1 if points else 8)
    far = _distance(r, right_geometry)
    order = Window.partitionBy(left_id).orderBy("distance", *([] if ties else [right_id]))
    rank = (F.rank() if ties else F.row_number()).over(order)
    out = None
    while True:
        reach = min(reach, diagonal * 1.0000001)
        found = candidates(l, r, left_geometry, right_geometry, within=reach, **plan).select(left_id, right_id, far.alias("distance")).where(F.col("distance") <= reach)
        ranked = found.select(left_id, right_id, "distance", rank.alias("rank"), F.count("*").over(Window.partitionBy(left_id)).alias("seen")).where(F.col("rank") <= k)
        full = ranked.where(F.col("seen") >= min(k, n)) if reach < diagonal else ranked
        full = saved(full)
        out = full if out is None else out.union(full)
        if reach >= diagonal:
            break
        l = saved(l.join(full.select(left_id).distinct(), left_id, "left_anti"))
        if l.limit(1).count() == 0:
            break
        reach *= 4
    return out.select(left_id, right_id, "distance", "rank")


def hausdorff_of_groups(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(a, b, distance) of each two groups of points, a before b: how far at most a point of one lies from the nearest of the other.

    Copies of a point count once, and each group in turn is searched from all others.
    """
    rows = saved(df.where(F.col(group).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(group).alias("group_"), F.col(x).cast("double").alias("x_"), F.col(y).cast("double").alias("y_")).distinct())
    rows = saved(rows.select("group_", F.monotonically_increasing_id().alias("id_"), G.point(F.col("x_"), F.col("y_")).alias("g_")))
    ways = None
    for (of,) in rows.select("group_").distinct().orderBy("group_").collect():
        others, own = rows.where(F.col("group_") != F.lit(of)), rows.where(F.col("group_") == F.lit(of)).select(F.col("id_").alias("to_"), F.col("g_").alias("h_"))
        near = nearest(spread(others, "id_"), own, "id_", "to_", "g_", "h_").select("id_", "distance")
        one = others.select("group_", "id_").join(near, "id_").groupBy("group_").agg(F.max("distance").alias("distance")).select(F.col("group_").alias("p_"), F.lit(of).alias("q_"), "distance")
        ways = saved(one) if ways is None else ways.union(saved(one))
    if ways is None:
        return rows.select(F.col("group_").alias("a"), F.col("group_").alias("b"), F.lit(0.0).alias("distance")).limit(0)
    return ways.groupBy(F.least("p_", "q_").alias("a"), F.greatest("p_", "q_").alias("b")).agg(F.max("distance").alias("distance"))


#: Distances held at once.
DISTANCES = 1 << 21


def _nearest_points(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_geometry: str, right_geometry: str, k: int, ties: bool) -> DataFrame:
    """nearest for points on both sides, the right ones few enough to go to every executor (counted by the caller)."""
    rows = right.select(F.col(right_id), G.x(right_geometry).alias("x"), G.y(right_geometry).alias("y")).orderBy(right_id).toArrow()
    shared = left.sparkSession.sparkContext.broadcast((rows.column("x").to_numpy(), rows.column("y").to_numpy(), rows.column(right_id).combine_chunks()))
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((left, left_id), (right, right_id))}

    def run(batches):
        rx, ry, ids = shared.value
        n = len(rx)
        for batch in batches:
            x, y = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            step = max(1, DISTANCES // max(1, n))
            for a in range(0, len(x) if n else 0, step):
                d = np.sqrt((rx[None, :] - x[a : a + step, None]) ** 2 + (ry[None, :] - y[a : a + step, None]) ** 2)
                limit = np.partition(d, min(k, n) - 1, axis=1)[:, min(k, n) - 1] if n else None
                i, j = np.nonzero(d <= limit[:, None])
                order = np.lexsort((j, d[i, j], i))  # right rows come in the order of their ids
                i, j = i[order], j[order]
                far = d[i, j]
                start = np.searchsorted(i, i)
                place = np.arange(len(i)) - start + 1
                if ties:
                    new = np.concatenate([[True], (i[1:] != i[:-1]) | (far[1:] != far[:-1])])
                    place = place[np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))]
                keep = place <= k
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i[keep] + a)), ids.take(pa.array(j[keep])), pa.array(far[keep]), pa.array(place[keep].astype(np.int32))], names=[left_id, right_id, "distance", "rank"])

    points = left.select(F.col(left_id), G.x(left_geometry).alias("x"), G.y(left_geometry).alias("y"))
    return points.mapInArrow(run, f"`{left_id}` {kinds[left_id]}, `{right_id}` {kinds[right_id]}, distance double, rank int")


def filter_box(df: DataFrame, geometry: str, minx: float, miny: float, maxx: float, maxy: float, *, bounds: tuple[str, str, str, str] | None = None) -> DataFrame:
    """Rows whose bounds meet a box; with stored bounds columns the scan itself skips row groups."""
    if bounds:
        a, b, c, d = map(F.col, bounds)
        return df.where((a <= maxx) & (c >= minx) & (b <= maxy) & (d >= miny))
    b = G.bounds(F.col(geometry))
    return df.where((b["minx"] <= maxx) & (b["maxx"] >= minx) & (b["miny"] <= maxy) & (b["maxy"] >= miny))
