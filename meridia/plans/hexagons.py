"""Registered queries of hexagonal cells, and their SQL twins."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.functions import h3 as H
from meridia.functions import h3_arrays as A
from meridia.operators import coarse, covers
from meridia.plans.catalog import CUST, NATION, r, register
from meridia.operators.saved import saved
from meridia.plans.tables import customers, nations, rings, spread

LEVELS = (3, 6, 9)
#: Cells whose edges are held at once.
CELLS_AT_ONCE = 1_000


def _cells_sql(points: str) -> str:
    """(c_custkey, lon, lat, r, cell) of points at every resolution of LEVELS, by recursion: the nearest face, the nearest hexagon, then parents up to the base cell."""
    faces = ", ".join(f"({f}, {', '.join(repr(v) for axis in H._PLANES[f] for v in axis)})" for f in range(20))
    bases = ", ".join(f"({n // 27}, {n // 9 % 3}, {n // 3 % 3}, {n % 3}, {k >> 5}, {k >> 2 & 7}, {k >> 1 & 1}, {k & 1})" for n, k in enumerate(H._BASES) if k >= 0)
    c, s = math.cos(H.TILT), math.sin(H.TILT)
    turned = " ".join(f"WHEN {n} THEN translate(d, '123456', '{t}')" for n, t in enumerate(H._TURNED))
    return f"""WITH RECURSIVE faces(f, cx, cy, cz, xx, xy, xz, yx, yy, yz) AS (VALUES {faces}), bases(f, i, j, k, base, turns, back, five) AS (VALUES {bases}),
    sphere AS (SELECT *, cos(radians(lat))*cos(radians(lon)) AS px, cos(radians(lat))*sin(radians(lon)) AS py, sin(radians(lat)) AS pz FROM ({points})),
    dots AS (SELECT *, px*cx+py*cy+pz*cz AS dot FROM sphere CROSS JOIN faces),
    best AS (SELECT *, (px*xx+py*xy+pz*xz)/(dot*{H.UNIT!r}) AS x, (px*yx+py*yy+pz*yz)/(dot*{H.UNIT!r}) AS y FROM dots QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY dot DESC, f)=1),
    scaled AS (SELECT c_custkey, lon, lat, f, r, CASE WHEN r%2=1 THEN x*{c!r}+y*{s!r} ELSE x END*power(7.0, r/2.0) AS x, CASE WHEN r%2=1 THEN y*{c!r}-x*{s!r} ELSE y END*power(7.0, r/2.0) AS y FROM best, (VALUES {", ".join(f"({n})" for n in LEVELS)}) v(r)),
    places AS (SELECT *, y/sqrt(0.75) AS b, x+y/sqrt(0.75)/2 AS a FROM scaled),
    around AS (SELECT c_custkey, lon, lat, f, r, CAST(floor(a)+u AS BIGINT) AS ia, CAST(floor(b)+w AS BIGINT) AS ib, power(a-floor(a)-u-(b-floor(b)-w)/2, 2)+0.75*power(b-floor(b)-w, 2) AS far FROM places, (VALUES (0), (1)) t1(u), (VALUES (0), (1)) t2(w)),
    nearest AS (SELECT c_custkey, lon, lat, f, r, ia, ib FROM around QUALIFY row_number() OVER (PARTITION BY c_custkey, r ORDER BY far)=1),
    up(c_custkey, lon, lat, f, r, lvl, a, b, d) AS (SELECT c_custkey, lon, lat, f, r, r, ia, ib, '' FROM nearest UNION ALL
      SELECT c_custkey, lon, lat, f, r, lvl-1, pa, pb, substr('{H.STEP_DIGIT}', CAST((a-CASE WHEN lvl%2=1 THEN 2*pa+pb ELSE 3*pa-pb END+1)*3+(b-CASE WHEN lvl%2=1 THEN 3*pb-pa ELSE pa+2*pb END)+2 AS INTEGER), 1) || d FROM (
        SELECT *, CAST(round(CASE WHEN lvl%2=1 THEN 3*a-b ELSE 2*a+b END/7.0) AS BIGINT) AS pa, CAST(round(CASE WHEN lvl%2=1 THEN a+2*b ELSE 3*b-a END/7.0) AS BIGINT) AS pb FROM up WHERE lvl>0)),
    top AS (SELECT *, a-least(a, b, 0) AS i, b-least(a, b, 0) AS j, -least(a, b, 0) AS k FROM up WHERE lvl=0),
    led AS (SELECT t.*, base, turns, back, five, substr(ltrim(d, '0'), 1, 1) AS first FROM top t JOIN bases USING (f, i, j, k)),
    sides AS (SELECT *, CASE WHEN first<>'1' THEN 0 WHEN back=1 THEN 5 ELSE 1 END AS side, CASE WHEN first<>'1' THEN first WHEN back=1 THEN '3' ELSE '5' END AS lead FROM led),
    total AS (SELECT *, CASE WHEN first='' THEN 0 WHEN five=1 THEN (side+turns+CAST(strpos('54623', lead)-1+turns>=5 AS INTEGER))%6 ELSE turns END AS t FROM sides),
    digits AS (SELECT *, CASE t {turned} END AS e FROM total)
    SELECT c_custkey, lon, lat, r, base, CAST(576460752303423488+r*4503599627370496+base*35184372088832+list_sum(list_transform(range(1, 16), lambda q: CAST(CASE WHEN q<=r THEN substr(e, CAST(q AS INTEGER), 1) ELSE '7' END AS BIGINT)*CAST(power(8, 15-q) AS BIGINT))) AS BIGINT) AS cell FROM digits"""


CELLS = _cells_sql(f"SELECT c_custkey, lon, lat FROM ({CUST})")


def _each_level(f, name: str = "cell"):
    return F.explode(F.array(*[F.struct(F.lit(n).alias("r"), f(n).alias(name)) for n in LEVELS]))


def _cells_once(rows: DataFrame, cell: str, *names: str) -> tuple[DataFrame, DataFrame]:
    """The rows, written, and their cells each once: what is asked of a cell needn't be asked for all rows in it."""
    rows = saved(rows)
    return rows, spread(saved(rows.select(cell, *names).distinct()), cell)


@register(f"SELECT c_custkey, CAST(r AS INTEGER) AS r, cell, lower(printf('%x', cell)) AS token, CAST(base AS INTEGER) AS base FROM ({CELLS})")
def h3_cells_of_points(spark: SparkSession, sf: str) -> DataFrame:
    rows = customers(spark, sf).select("c_custkey", _each_level(lambda n: H.h3_cell("lon", "lat", n)).alias("k")).select("c_custkey", "k.*")
    return rows.select("c_custkey", "r", "cell", H.h3_token("cell").alias("token"), H.h3_base_cell("cell").alias("base"))


@register(f"SELECT base, CAST(r AS INTEGER) AS r, count(*) AS n, count(DISTINCT cell) AS n_cells, min(cell) AS low, max(cell) AS high FROM ({CELLS}) GROUP BY 1, 2")
def h3_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = customers(spark, sf).select(_each_level(lambda n: H.h3_cell("lon", "lat", n)).alias("k")).select("k.*")
    return rows.groupBy(H.h3_base_cell("cell").alias("base"), "r").agg(F.count("*").alias("n"), F.count_distinct("cell").alias("n_cells"), F.min("cell").alias("low"), F.max("cell").alias("high"))


@register(f"SELECT c_custkey, CAST(u.r AS INTEGER) AS r, true AS back, CAST(6-u.r AS BIGINT) AS steps, CASE WHEN u.r=3 THEN 7 ELSE 1 END AS n_children FROM (SELECT c_custkey FROM ({CUST})), (VALUES (3), (6)) u(r)")
def h3_parents(spark: SparkSession, sf: str) -> DataFrame:
    """A cell descends from each of its parents, has its place among their descendants, and the centre child leads back to them."""
    own, cells = _cells_once(customers(spark, sf).select("c_custkey", H.h3_cell("lon", "lat", 6).alias("c")), "c")
    rows = cells.select("*", F.explode(F.array(F.lit(3), F.lit(6))).alias("r")).withColumn("p", H.h3_parent("c", F.col("r")))
    place = H.h3_child_position("c", F.col("r"))
    back = H.h3_contains("p", "c") & (H.h3_child_at("p", place, F.lit(6)) == F.col("c")) & (H.h3_parent(H.h3_center_child("p", F.lit(9)), F.col("r")) == F.col("p")) & (F.array_position(H.h3_children("p", F.lit(6)), F.col("c")) == place + 1)
    n = F.size(F.filter(H.h3_children("p", F.least(F.col("r") + 1, F.lit(6))), lambda k: H.h3_resolution(k) <= 6))
    found = rows.select("c", "r", back.alias("back"), (6 - F.col("r")).cast("long").alias("steps"), F.when(H.h3_is_pentagon("p") & (F.col("r") == 3), n + 1).otherwise(n).alias("n_children"))
    return own.join(found, "c").select("c_custkey", "r", "back", "steps", "n_children")


@register(f"SELECT c_custkey, CAST(r AS INTEGER) AS r, true AS same, true AS near FROM ({CELLS})")
def h3_centers(spark: SparkSession, sf: str) -> DataFrame:
    """A cell's centre lies in it, and no further from the point than its corners reach."""
    from meridia.functions import geodesy as D

    rows = customers(spark, sf).select("c_custkey", "lon", "lat", _each_level(lambda n: H.h3_cell("lon", "lat", n)).alias("k")).select("c_custkey", "lon", "lat", "k.*")
    rows, cells = _cells_once(rows, "cell", "r")
    one = lambda v, name: F.explode(F.array(v)).alias(name)  # noqa: E731 - a step of its own, so that what follows doesn't repeat it
    cells = cells.select("*", one(H.h3_center("cell"), "m"))
    same = F.coalesce(*[F.when(F.col("r") == n, H.h3_cell("m.lon", "m.lat", n) == F.col("cell")) for n in LEVELS])
    reach = F.array_max(F.transform(H.h3_boundary("cell"), lambda v: D.haversine(v["lon"], v["lat"], "m.lon", "m.lat", H.RADIUS)))
    far = D.haversine("lon", "lat", "m.lon", "m.lat", H.RADIUS)
    return rows.join(cells.select("cell", "m", same.alias("same"), reach.alias("reach")), "cell").select("c_custkey", "r", "same", (far <= F.col("reach") * 1.000001).alias("near"))


@register("SELECT CAST(r AS INTEGER) AS r, CAST(2+120*power(7, r) AS BIGINT) AS n, CAST(12 AS BIGINT) AS n_five, round(4*pi()*power(6371007.180918475, 2)/1e6, 3) AS km2, CAST(6*(2+120*power(7, r))-12 AS BIGINT) AS n_sides, CAST(0 AS BIGINT) AS one_way FROM (VALUES (0), (1), (2)) v(r), (SELECT count(*) AS regions FROM region)")
def h3_whole_earth(spark: SparkSession, sf: str) -> DataFrame:
    """All cells of three resolutions: their number, those of five neighbours, their area, and neighbours that don't have each other as one."""
    out = None
    for n in (0, 1, 2):
        cells = H.h3_base_cells(spark).select(F.explode(H.h3_children("cell", F.lit(n))).alias("cell"))
        sums = cells.agg(F.count("*").alias("n"), F.sum(H.h3_is_pentagon("cell").cast("long")).alias("n_five"), F.round(F.sum(H.h3_area("cell")) / 1e6, 3).alias("km2"))
        sides = cells.select("cell", F.explode(F.array_compact(H.h3_neighbors("cell", n))).alias("other"))
        ways = sides.groupBy(F.least("cell", "other").alias("a"), F.greatest("cell", "other").alias("b")).count()
        ways = ways.agg(F.sum("count").alias("n_sides"), F.sum((F.col("count") != 2).cast("long")).alias("one_way"))
        row = sums.join(ways).select(F.lit(n).alias("r"), "*")
        out = row if out is None else out.union(row)
    return out


@register(f"SELECT c_custkey, CAST(k AS INTEGER) AS steps, CAST(CASE WHEN k=0 THEN 1 ELSE 6*k END AS BIGINT) AS n FROM ({CUST}), (VALUES (0), (1), (2), (3)) v(k)")
def h3_disks(spark: SparkSession, sf: str) -> DataFrame:
    """Cells by steps from each customer's; around a cell of five neighbours, where fewer come, as many as a whole ring has."""
    own = saved(customers(spark, sf).select("c_custkey", H.h3_cell("lon", "lat", 5).alias("cell")))
    rings_ = covers.h3_disks(own, "cell", 5, 3)
    counts = rings_.groupBy("cell", "steps").agg(F.count("*").alias("n"), F.max(H.h3_is_pentagon("other")).alias("five"))
    near_five = counts.groupBy("cell").agg(F.max("five").alias("bent"))
    n = F.when(F.col("bent") & (F.col("steps") > 0), 6 * F.col("steps")).otherwise(F.col("n"))
    return own.join(counts.join(near_five, "cell"), "cell").select("c_custkey", "steps", n.cast("long").alias("n"))


@register(f"SELECT n_nationkey, true AS inner_in_center, true AS center_in_overlap, true AS overlap_in_bbox, true AS owners FROM ({NATION})")
def h3_covers(spark: SparkSession, sf: str) -> DataFrame:
    """Covers of all nations by the four rules: each holds the one before, and every customer inside is in a cell of the overlap."""
    g = nations(spark, sf).select("n_nationkey", "nation_box")
    found = None
    for rule in ("within", "center", "overlap", "bbox"):
        one = covers.h3_cover(g, "nation_box", 2, rule=rule).select("n_nationkey", "cell", F.lit(rule).alias("rule"))
        found = one if found is None else found.union(one)
    has = found.groupBy("n_nationkey", "cell").agg(*[F.max((F.col("rule") == x).cast("int")).alias(x) for x in ("within", "center", "overlap", "bbox")])
    at = customers(spark, sf).select(F.col("lon").alias("cx"), F.col("lat").alias("cy"))
    boxes = nations(spark, sf).select("n_nationkey", "x0", "y0")
    inside = at.join(F.broadcast(boxes), (F.col("cx") > F.col("x0")) & (F.col("cx") < F.col("x0") + 72) & (F.col("cy") > F.col("y0")) & (F.col("cy") < F.col("y0") + 34))  # a row a nation
    owner = inside.select("n_nationkey", H.h3_cell("cx", "cy", 2).alias("cell")).distinct().withColumn("owned", F.lit(1))
    every = lambda c: F.min(F.coalesce(c, F.lit(False)).cast("int")) == 1
    both = has.join(owner, ["n_nationkey", "cell"], "full").groupBy("n_nationkey")
    return both.agg(every(F.coalesce(F.col("within") <= F.col("center"), F.lit(True))).alias("inner_in_center"), every(F.coalesce(F.col("center") <= F.col("overlap"), F.lit(True))).alias("center_in_overlap"), every(F.coalesce(F.col("overlap") <= F.col("bbox"), F.lit(True))).alias("overlap_in_bbox"), every(F.col("owned").isNull() | (F.coalesce("overlap", F.lit(0)) == 1)).alias("owners"))


@register()
def h3_ring_covers(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of every customer's ring."""
    one = rings(spark, sf).select("c_custkey", F.explode(F.array("cust_ring")).alias("cust_ring"))  # a step of its own, so that what follows doesn't make the ring again
    found = coarse.h3_cover_sums(one.where(G.bounds("cust_ring")["maxx"] <= 180), "cust_ring", 3)
    return found.groupBy("c_custkey").agg(F.sum("n").alias("n"), r(F.sum("m2") / 1e6, 3).alias("km2"))


def _edges_hold(c: np.ndarray, level: int) -> list[np.ndarray]:
    """Whether all directed edges of each cell, turned around, come back; run from and to the same two cells; and are as long from both sides."""
    e = A.edges(c)
    there = e >= 0
    cell, e = np.repeat(c, 6)[there.ravel()], e[there]
    to = A.edge_destination(e, level)
    back = A.edge(to, cell, level)
    ok = back >= 0
    back_ = np.where(ok, back, e)  # one that isn't there holds nothing
    holds = (A.edge_destination(back_, level) == cell, (A.edge_origin(back_) == to) & (A.edge_origin(e) == cell), np.abs(A.edge_length(e, level) - A.edge_length(back_, level)) < 1e-3)
    owner = np.nonzero(there)[0]
    return [np.bincount(owner[~(h & ok)], minlength=len(c)) == 0 for h in holds]


@register(f"SELECT c_custkey, true AS there_and_back, true AS half, true AS as_long FROM ({CUST})")
def h3_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Directed edges of each customer's cell: turned around they come back, lead to neighbours, and are as long from both sides."""
    own, cells = _cells_once(customers(spark, sf).select("c_custkey", A.cells("lon", "lat", 4).alias("c")).where("c is not null"), "c")

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, CELLS_AT_ONCE):
                c = batch.column(0).slice(a, CELLS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([c, *map(pa.array, _edges_hold(c.to_numpy(zero_copy_only=False), 4))], names=["c", "there_and_back", "half", "as_long"])

    return own.join(cells.mapInArrow(run, "c long, there_and_back boolean, half boolean, as_long boolean"), "c").select("c_custkey", "there_and_back", "half", "as_long")
