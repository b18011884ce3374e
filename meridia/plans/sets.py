"""Registered queries of sets of cells and of coverages, and their SQL twins: areas counted in tiles of one zoom."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import cells as C
from meridia.functions import geometry as G
from meridia.functions import grids, h3
from meridia.functions import measures as M
from meridia.operators import cellsets as K
from meridia.operators import outlines as O
from meridia.operators.saved import saved
from meridia.plans.catalog import CUST, NATION, r, register
from meridia.plans.tables import customers, nations

#: Tiles of zoom 6 around customers, and of zoom 3 around every third one; both by nation.
_XY = "CAST(floor((lon+180)/360*64) AS BIGINT) AS x, CAST(floor((1-ln(tan(pi()/4+radians(lat)/2))/pi())/2*64) AS BIGINT) AS y"
_FINE = f"SELECT DISTINCT c_nationkey, x, y FROM (SELECT c_nationkey, c_custkey, {_XY} FROM ({CUST}))"
_WIDE = f"SELECT DISTINCT c_nationkey, wx*8+i AS x, wy*8+j AS y FROM (SELECT DISTINCT c_nationkey, x//8 AS wx, y//8 AS wy FROM (SELECT c_nationkey, c_custkey, {_XY} FROM ({CUST})) WHERE c_custkey%3=0), (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j)"


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = customers(spark, sf)
    tile = lambda zoom: C.tile_id(C.tile_x("lon", zoom), C.tile_y("lat", zoom), F.lit(zoom)).alias("cell")
    return c.select("c_nationkey", tile(6)), c.where("c_custkey % 3 = 0").select("c_nationkey", tile(3))


def _measured(df: DataFrame) -> DataFrame:
    """Area in tiles of zoom 6, and whether no cell lies within another."""
    n = F.sum(F.pow(F.lit(4.0), 6 - F.shiftrightunsigned("cell", 58))).cast("long").alias("n_fine")
    return df.groupBy("c_nationkey").agg(n, (F.count("*") == F.count_distinct("cell")).alias("once"))


def _twin(how: str) -> str:
    return f"SELECT c_nationkey, count(*) AS n_fine, true AS once FROM (({_FINE}) {how} ({_WIDE})) GROUP BY 1"


@register(_twin("UNION"))
def tile_unions(spark: SparkSession, sf: str) -> DataFrame:
    return _measured(K.union(*_sides(spark, sf), ["c_nationkey"], "cell", K.TILES))


@register(_twin("INTERSECT"))
def tile_intersections(spark: SparkSession, sf: str) -> DataFrame:
    return _measured(K.intersection(*_sides(spark, sf), ["c_nationkey"], "cell", K.TILES))


@register(_twin("EXCEPT"))
def tile_differences(spark: SparkSession, sf: str) -> DataFrame:
    fine, wide = _sides(spark, sf)
    return _measured(K.difference(fine, wide, ["c_nationkey"], "cell", K.TILES))


@register(f"SELECT c_nationkey, count(*) AS n_fine, true AS once FROM (({_WIDE}) EXCEPT ({_FINE})) GROUP BY 1")
def tiles_opened(spark: SparkSession, sf: str) -> DataFrame:
    """The wide tiles less the fine ones within them."""
    fine, wide = _sides(spark, sf)
    return _measured(K.difference(wide, fine, ["c_nationkey"], "cell", K.TILES))


@register(f"SELECT c_nationkey, count(DISTINCT c_custkey) AS n_customers, true AS whole FROM ({CUST}) GROUP BY 1")
def cells_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """Hexagons around every customer with all of the customer's next two parents' cells: compacted they are those parents, and hold every customer."""
    c = saved(customers(spark, sf).select("c_nationkey", "c_custkey", h3.h3_cell("lon", "lat", 6).alias("own"), grids.s2_cell("lon", "lat", 9).alias("square")))
    out = None
    for name, grid, level in (("own", K.H3, 4), ("square", K.S2, 7)):
        top = c.select("c_nationkey", grid.parent(F.col(name), F.lit(level)).alias("cell")).distinct()
        small = K.uncompact(top, ["c_nationkey"], "cell", grid, level + 2)
        again = saved(K.compact(small, ["c_nationkey"], "cell", grid))
        held = c.select("c_nationkey", "c_custkey", F.explode(grid.above(name)).alias("cell")).join(again, ["c_nationkey", "cell"], "left_semi").groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("n"))
        # no finer cell is left, and as few as there may be
        sizes = again.groupBy("c_nationkey").agg(F.max(grid.level(F.col("cell"))).alias("finest"), F.count("*").alias("few")).join(top.groupBy("c_nationkey").agg(F.count("*").alias("many")), "c_nationkey")
        one = held.join(sizes, "c_nationkey").select("c_nationkey", "n", ((F.col("finest") <= level) & (F.col("few") <= F.col("many"))).alias("whole"))
        out = one if out is None else out.join(one.select("c_nationkey", F.col("n").alias("n2"), F.col("whole").alias("whole2")), "c_nationkey").select("c_nationkey", F.least("n", "n2").alias("n_customers"), (F.col("whole") & F.col("whole2")).alias("whole"))
    return out


_GRID = f"SELECT n_nationkey, n_regionkey, n_nationkey%5 AS i, n_nationkey//5 AS j FROM ({NATION})"
_REACH = f"""WITH RECURSIVE g AS ({_GRID}), reach(n_regionkey, i, j, ti, tj) AS (SELECT n_regionkey, i, j, i, j FROM g UNION
    SELECT r.n_regionkey, r.i, r.j, g.i, g.j FROM reach r JOIN g ON g.n_regionkey=r.n_regionkey AND abs(g.i-r.ti)+abs(g.j-r.tj)=1), parts AS (SELECT n_regionkey, i, j, min(ti*5+tj) AS part FROM reach GROUP BY 1, 2, 3)"""


@register(f"{_REACH} SELECT n_regionkey, part, area, sum(area) OVER (PARTITION BY n_regionkey) AS region FROM (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY count(*), min(j*5+i)) AS part, CAST(count(*)*72*34 AS DOUBLE) AS area FROM parts GROUP BY n_regionkey, part)")
def region_outlines(spark: SparkSession, sf: str) -> DataFrame:
    """The polygons of the regions' unions, ordered by area and their lowest box."""
    from pyspark.sql import Window

    u = O.coverage_union(nations(spark, sf), "nation_box", ["n_regionkey"]).select("n_regionkey", M.area("nation_box").alias("area"), F.array_min(F.transform(G.vertices("nation_box"), lambda v: F.struct(v["y"], v["x"]))).alias("low"))
    order, whole = Window.partitionBy("n_regionkey").orderBy("area", "low"), Window.partitionBy("n_regionkey")
    return u.select("n_regionkey", F.row_number().over(order).cast("long").alias("part"), "area", F.sum("area").over(whole).alias("region"))


_BOXES = f"SELECT DISTINCT c_nationkey, CAST(floor((lon+180)/11.25) AS BIGINT) AS i, CAST(floor((lat+90)/5.625) AS BIGINT) AS j FROM ({CUST})"


@register(f"SELECT a.c_nationkey, round(CAST(count(*) AS DOUBLE)*11.25*5.625, 3) AS area, round(CAST(sum((CASE WHEN l.i IS NULL THEN 5.625 ELSE 0 END)+(CASE WHEN r.i IS NULL THEN 5.625 ELSE 0 END)+(CASE WHEN u.i IS NULL THEN 11.25 ELSE 0 END)+(CASE WHEN d.i IS NULL THEN 11.25 ELSE 0 END)) AS DOUBLE), 3) AS outline FROM ({_BOXES}) a LEFT JOIN ({_BOXES}) l ON l.c_nationkey=a.c_nationkey AND l.i=a.i-1 AND l.j=a.j LEFT JOIN ({_BOXES}) r ON r.c_nationkey=a.c_nationkey AND r.i=a.i+1 AND r.j=a.j LEFT JOIN ({_BOXES}) u ON u.c_nationkey=a.c_nationkey AND u.i=a.i AND u.j=a.j+1 LEFT JOIN ({_BOXES}) d ON d.c_nationkey=a.c_nationkey AND d.i=a.i AND d.j=a.j-1 GROUP BY 1")
def geohash_outlines(spark: SparkSession, sf: str) -> DataFrame:
    """Area and length of the outlines, holes too, of each nation's geohashes of two letters."""
    boxes = customers(spark, sf).select("c_nationkey", C.geohash("lon", "lat", 2).alias("code")).distinct().select("c_nationkey", grids.geohash_polygon("code").alias("g"))
    u = O.coverage_union(boxes, "g", ["c_nationkey"])
    return u.groupBy("c_nationkey").agg(r(F.sum(M.area("g")), 3).alias("area"), r(F.sum(M.perimeter("g")), 3).alias("outline"))
