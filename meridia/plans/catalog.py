"""The registered queries and their SQL twins.

The SQL is written from the definitions, for another engine, and shares nothing with the expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import cells as C
from meridia.functions import codecs as X
from meridia.functions import constructive as P
from meridia.functions import geodesy as D
from meridia.functions import geometry as G
from meridia.functions import kernels as K
from meridia.functions import linear as L
from meridia.functions import measures as M
from meridia.operators import aggregates as A
from meridia.operators import joins as J
from meridia.plans.tables import customers, nations, rings, suppliers, table, tracks, trades
from meridia.streaming.geofence import fence_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CUST = "SELECT c_custkey, c_nationkey, c_acctbal, ((c_custkey*7919)%36000)/100.0-180.0 AS lon, ((c_custkey*6971)%17000)/100.0-85.0 AS lat FROM customer"
SUPP = "SELECT s_suppkey, ((s_suppkey*104729)%36000)/100.0-180.0 AS slon, ((s_suppkey*15485863)%17000)/100.0-85.0 AS slat FROM supplier"
NATION = "SELECT n_nationkey, n_regionkey, CAST(-180+72*(n_nationkey%5) AS DOUBLE) AS x0, CAST(-85+34*(n_nationkey//5) AS DOUBLE) AS y0, CAST(-108+72*(n_nationkey%5) AS DOUBLE) AS x1, CAST(-51+34*(n_nationkey//5) AS DOUBLE) AS y1 FROM nation"
RING = f"SELECT c_custkey, lon, lat, i, 4+c_custkey%9 AS n, lon+(1+c_custkey%7)*cos(2*pi()*(i%(4+c_custkey%9))/(4+c_custkey%9)) AS x, lat+(1+c_custkey%7)*sin(2*pi()*(i%(4+c_custkey%9))/(4+c_custkey%9)) AS y FROM (SELECT *, unnest(generate_series(0, 4+c_custkey%9)) AS i FROM ({CUST}))"
EDGE = f"SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM ({RING}) WINDOW w AS (PARTITION BY c_custkey ORDER BY i)"
TRACK = "SELECT user_id, event_id, ts, CAST(event_id%360-180 AS DOUBLE) AS x, value AS y, epoch(ts) AS s FROM events"
STEP = f"SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, row_number() OVER w AS n FROM ({TRACK}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
PAIR = f"SELECT * FROM (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey=o_orderkey) JOIN ({CUST}) ON c_custkey=o_custkey JOIN ({SUPP}) ON s_suppkey=l_suppkey"
HAV = "2*asin(least(1.0, sqrt(power(sin(radians(slat-lat)/2),2)+cos(radians(lat))*cos(radians(slat))*power(sin(radians(slon-lon)/2),2))))"



def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(c, n: int = 6):
    """Rounded; -0 becomes 0."""
    return F.round(c, n) + F.lit(0.0)


@register(f"SELECT n_nationkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM ({CUST}) c JOIN ({NATION}) b ON lon>x0 AND lon<x1 AND lat>y0 AND lat<y1 JOIN orders ON o_custkey=c_custkey GROUP BY 1")
def points_in_boxes(spark: SparkSession, sf: str) -> DataFrame:
    at = J.spatial_join(nations(spark, sf), customers(spark, sf), "contains", "nation_box", "cust_pt", left_kind="box", right_kind="point").select("n_nationkey", "c_custkey")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return at.join(orders, "c_custkey").groupBy("n_nationkey").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@register(f"SELECT n_nationkey, count(*) AS covered, count(*) FILTER (lon>x0 AND lon<x1 AND lat>y0 AND lat<y1) AS contained FROM ({CUST}) JOIN ({NATION}) ON lon>=x0 AND lon<=x1 AND lat>=y0 AND lat<=y1 GROUP BY 1")
def covers_vs_contains(spark: SparkSession, sf: str) -> DataFrame:
    at = J.spatial_join(nations(spark, sf), customers(spark, sf), "covers", "nation_box", "cust_pt", right_kind="point")
    inside = M.contains_xy(F.col("nation_box"), F.col("lon"), F.col("lat"))
    return at.groupBy("n_nationkey").agg(F.count("*").alias("covered"), F.count(F.when(inside, 1)).alias("contained"))


@register(f"SELECT c_custkey, 'POINT (' || regexp_replace(regexp_replace(printf('%.2f', lon), '0+$', ''), '[.]$', '') || ' ' || regexp_replace(regexp_replace(printf('%.2f', lat), '0+$', ''), '[.]$', '') || ')' AS wkt FROM ({CUST})")
def point_wkt(spark: SparkSession, sf: str) -> DataFrame:
    return customers(spark, sf).select("c_custkey", X.to_wkt(F.col("cust_pt"), 2).alias("wkt"))


@register(f"SELECT c_custkey, lon, lat FROM ({CUST})")
def wkt_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    g = X.from_wkt(X.to_wkt(F.col("cust_pt")))
    return customers(spark, sf).select("c_custkey", g.alias("g")).select("c_custkey", G.x("g").alias("lon"), G.y("g").alias("lat"))


@register(f"SELECT n_nationkey, CAST(x0 AS DOUBLE) AS minx, CAST(y0 AS DOUBLE) AS miny, CAST(x1 AS DOUBLE) AS maxx, CAST(y1 AS DOUBLE) AS maxy, 5 AS n FROM ({NATION})")
def wkb_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    g = nations(spark, sf).select("n_nationkey", X.from_wkb(X.to_wkb(F.col("nation_box"))).alias("g"))
    return g.select("n_nationkey", G.bounds("g").alias("b"), G.num_coordinates("g").alias("n")).select("n_nationkey", "b.*", "n")


@register(f"SELECT c_custkey, lon, lat FROM ({CUST})")
def geojson_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    g = X.from_geojson(X.to_geojson(F.col("cust_pt")))
    return customers(spark, sf).select("c_custkey", g.alias("g")).select("c_custkey", G.x("g").alias("lon"), G.y("g").alias("lat"))


@register(f"SELECT c_nationkey, min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy FROM ({CUST}) GROUP BY 1")
def bounds_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    return customers(spark, sf).groupBy("c_nationkey").agg(*A.total_bounds("cust_pt"))


@register(f"SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM ({NATION}) a JOIN ({NATION}) b ON a.n_nationkey<b.n_nationkey AND a.x0<=b.x1 AND b.x0<=a.x1 AND a.y0<=b.y1 AND b.y0<=a.y1")
def box_touches(spark: SparkSession, sf: str) -> DataFrame:
    p = J.self_join(nations(spark, sf).select("n_nationkey", "nation_box"), "touches", "nation_box", "n_nationkey", kind="box")
    return p.select(F.col("n_nationkey").alias("a"), F.col("n_nationkey_2").alias("b"))


@register(f"SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM ({NATION}) a JOIN ({NATION}) b ON a.n_nationkey<b.n_nationkey AND a.x0<=b.x1 AND b.x0<=a.x1 AND a.y0<=b.y1 AND b.y0<=a.y1")
def box_touches_exact(spark: SparkSession, sf: str) -> DataFrame:
    p = J.self_join(nations(spark, sf).select("n_nationkey", "nation_box"), "touches", "nation_box", "n_nationkey")
    return p.select(F.col("n_nationkey").alias("a"), F.col("n_nationkey_2").alias("b"))


@register(f"SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN a.n_nationkey=b.n_nationkey THEN '2FFF1FFF2' WHEN a.x0<=b.x1 AND b.x0<=a.x1 AND a.y0<=b.y1 AND b.y0<=a.y1 THEN CASE WHEN a.x0<>b.x0 AND a.y0<>b.y0 THEN 'FF2F01212' ELSE 'FF2F11212' END ELSE 'FF2FF1212' END AS matrix FROM ({NATION}) a, ({NATION}) b WHERE a.n_nationkey<=b.n_nationkey")
def relate_boxes(spark: SparkSession, sf: str) -> DataFrame:
    n = nations(spark, sf).select(F.col("n_nationkey").alias("a"), F.col("nation_box").alias("g"))
    m = n.select(F.col("a").alias("b"), F.col("g").alias("h"))
    return n.join(m, F.col("a") <= F.col("b")).select("a", "b", K.relate("g", "h").alias("matrix"))


@register(f"SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(greatest(0,least(a.x1+10,b.x1)-greatest(a.x0+10,b.x0))*greatest(0,least(a.y1+5,b.y1)-greatest(a.y0+5,b.y0)),6) AS area FROM ({NATION}) a JOIN ({NATION}) b ON a.x0+10<b.x1 AND b.x0<a.x1+10 AND a.y0+5<b.y1 AND b.y0<a.y1+5")
def intersection_area(spark: SparkSession, sf: str) -> DataFrame:
    n = nations(spark, sf).select(F.col("n_nationkey").alias("a"), P.translate(F.col("nation_box"), 10, 5).alias("g"))
    m = nations(spark, sf).select(F.col("n_nationkey").alias("b"), F.col("nation_box").alias("h"))
    p = J.spatial_join(n, m, "intersects", "g", "h", left_kind="box", right_kind="box")
    return p.select("a", "b", r(M.area(K.overlay("g", "h", "intersection"))).alias("area")).where("area > 0")


@register(f"SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(2*72*34-greatest(0,least(a.x1+10,b.x1)-greatest(a.x0+10,b.x0))*greatest(0,least(a.y1+5,b.y1)-greatest(a.y0+5,b.y0)),6) AS area FROM ({NATION}) a JOIN ({NATION}) b ON a.x0+10<b.x1 AND b.x0<a.x1+10 AND a.y0+5<b.y1 AND b.y0<a.y1+5")
def union_area(spark: SparkSession, sf: str) -> DataFrame:
    n = nations(spark, sf).select(F.col("n_nationkey").alias("a"), P.translate(F.col("nation_box"), 10, 5).alias("g"))
    m = nations(spark, sf).select(F.col("n_nationkey").alias("b"), F.col("nation_box").alias("h"))
    p = J.spatial_join(n, m, "overlaps", "g", "h", left_kind="box", right_kind="box").select("a", "b", r(M.area(K.overlay("g", "h", "union"))).alias("area"))
    return p


@register(f"SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(72*34-(least(a.x1+10,b.x1)-greatest(a.x0+10,b.x0))*(least(a.y1+5,b.y1)-greatest(a.y0+5,b.y0)),6) AS area, round(2*(72*34-(least(a.x1+10,b.x1)-greatest(a.x0+10,b.x0))*(least(a.y1+5,b.y1)-greatest(a.y0+5,b.y0))),6) AS sym FROM ({NATION}) a JOIN ({NATION}) b ON a.x0+10<b.x1 AND b.x0<a.x1+10 AND a.y0+5<b.y1 AND b.y0<a.y1+5")
def difference_area(spark: SparkSession, sf: str) -> DataFrame:
    n = nations(spark, sf).select(F.col("n_nationkey").alias("a"), P.translate(F.col("nation_box"), 10, 5).alias("g"))
    m = nations(spark, sf).select(F.col("n_nationkey").alias("b"), F.col("nation_box").alias("h"))
    p = J.spatial_join(n, m, "overlaps", "g", "h", left_kind="box", right_kind="box")
    return p.select("a", "b", r(M.area(K.overlay("g", "h", "difference"))).alias("area"), r(M.area(K.overlay("g", "h", "symmetric_difference"))).alias("sym"))


@register(f"SELECT c_custkey, round(abs(sum((x-lon)*(y2-lat)-(x2-lon)*(y-lat)))/2, 6) AS area, round(sum(sqrt(power(x2-x,2)+power(y2-y,2))),6) AS perimeter FROM ({EDGE}) WHERE x2 IS NOT NULL GROUP BY 1")
def ring_area(spark: SparkSession, sf: str) -> DataFrame:
    return rings(spark, sf).select("c_custkey", r(M.area("cust_ring")).alias("area"), r(M.perimeter("cust_ring")).alias("perimeter"))


@register(f"SELECT c_custkey, round(lon,6) AS x, round(lat,6) AS y FROM ({CUST})")
def ring_centroid(spark: SparkSession, sf: str) -> DataFrame:
    c = rings(spark, sf).select("c_custkey", M.centroid("cust_ring").alias("c"))
    return c.select("c_custkey", r(G.x("c")).alias("x"), r(G.y("c")).alias("y"))


@register(f"SELECT c_custkey, c_custkey%2=0 AS ccw, 5+c_custkey%9 AS n FROM customer")
def ring_orientation(spark: SparkSession, sf: str) -> DataFrame:
    g = F.when(F.col("c_custkey") % 2 == 0, F.col("cust_ring")).otherwise(G.reverse("cust_ring"))
    return rings(spark, sf).select("c_custkey", M.is_ccw(g).alias("ccw"), G.num_coordinates(g).cast("long").alias("n"))


@register("SELECT c_custkey, c_custkey%3<>0 AND c_custkey%2=0 AS convex, c_custkey%3<>0 AS valid FROM customer")
def ring_convex(spark: SparkSession, sf: str) -> DataFrame:
    """Every third ring has two corners in the wrong order, and of the others each second one a corner beyond the middle."""
    v, k = G.vertices("cust_ring"), F.col("c_custkey")
    at = lambda i: F.get(v, F.lit(i))
    dent = G.vertex(F.col("lon") - 0.2 * (at(0)["x"] - F.col("lon")), F.col("lat") - 0.2 * (at(0)["y"] - F.col("lat")))
    rest = F.slice(v, F.lit(4), F.size(v) - 4)
    swapped = F.concat(F.array(at(0), at(2), at(1)), rest, F.array(at(0)))
    dented = F.concat(F.array(dent, at(1), at(2)), rest, F.array(dent))
    one = lambda c, name: F.explode(F.array(c)).alias(name)  # noqa: E731 - a step of its own, so that what follows doesn't repeat it
    drawn = rings(spark, sf).select("c_custkey", "lon", "lat", one(F.col("cust_ring"), "cust_ring"))
    made = drawn.select("c_custkey", one(G.polygon(F.when(k % 3 == 0, swapped).when(k % 2 == 1, dented).otherwise(v)), "g"))
    return made.select("c_custkey", M.is_convex(P.quantize("g", 9)).alias("convex"), K.is_valid("g").alias("valid"))


@register(f"SELECT c_custkey, round(sum(x+3),4) AS sx, round(sum(y-2),4) AS sy FROM ({RING}) GROUP BY 1")
def affine_translate(spark: SparkSession, sf: str) -> DataFrame:
    v = rings(spark, sf).select("c_custkey", G.vertices(P.translate("cust_ring", 3, -2)).alias("v"))
    return v.select("c_custkey", r(G.total(F.transform("v", lambda p: p["x"])), 4).alias("sx"), r(G.total(F.transform("v", lambda p: p["y"])), 4).alias("sy"))


@register(f"SELECT c_custkey, round(sum(x*2),4) AS sx, round(sum(y*0.5),4) AS sy FROM ({RING}) GROUP BY 1")
def affine_scale(spark: SparkSession, sf: str) -> DataFrame:
    v = rings(spark, sf).select("c_custkey", G.vertices(P.scale("cust_ring", 2, 0.5, (0, 0))).alias("v"))
    return v.select("c_custkey", r(G.total(F.transform("v", lambda p: p["x"])), 4).alias("sx"), r(G.total(F.transform("v", lambda p: p["y"])), 4).alias("sy"))


@register(f"SELECT c_custkey, round(sum(10+(x-10)*cos(radians(30))-(y-20)*sin(radians(30))),4) AS sx, round(sum(20+(x-10)*sin(radians(30))+(y-20)*cos(radians(30))),4) AS sy FROM ({RING}) GROUP BY 1")
def affine_rotate(spark: SparkSession, sf: str) -> DataFrame:
    v = rings(spark, sf).select("c_custkey", G.vertices(P.rotate("cust_ring", 30, (10, 20))).alias("v"))
    return v.select("c_custkey", r(G.total(F.transform("v", lambda p: p["x"])), 4).alias("sx"), r(G.total(F.transform("v", lambda p: p["y"])), 4).alias("sy"))


@register(f"SELECT c_custkey, round(sum(x+tan(radians(15))*y),4) AS sx, round(sum(y),4) AS sy FROM ({RING}) GROUP BY 1")
def affine_skew(spark: SparkSession, sf: str) -> DataFrame:
    v = rings(spark, sf).select("c_custkey", G.vertices(P.skew("cust_ring", 15, 0, (0, 0))).alias("v"))
    return v.select("c_custkey", r(G.total(F.transform("v", lambda p: p["x"])), 4).alias("sx"), r(G.total(F.transform("v", lambda p: p["y"])), 4).alias("sy"))


@register(f"SELECT c_custkey, s_suppkey FROM ({CUST}) JOIN ({SUPP}) ON sqrt(power(slon-lon,2)+power(slat-lat,2))<=5")
def dwithin_planar(spark: SparkSession, sf: str) -> DataFrame:
    return J.dwithin_join(customers(spark, sf), suppliers(spark, sf), 5.0, "cust_pt", "supp_pt").select("c_custkey", "s_suppkey")


@register(f"SELECT c_custkey, s_suppkey FROM ({CUST}) JOIN ({SUPP}) ON sqrt(power(slon-lon,2)+power(slat-lat,2))<=5")
def dwithin_cells(spark: SparkSession, sf: str) -> DataFrame:
    return J.dwithin_join(customers(spark, sf), suppliers(spark, sf), 5.0, "cust_pt", "supp_pt", most_broadcast=0).select("c_custkey", "s_suppkey")


@register(f"SELECT c_custkey, s_suppkey, round({HAV}*6371008.771415,2) AS metres FROM ({PAIR})")
def distance_haversine(spark: SparkSession, sf: str) -> DataFrame:
    p = trades(spark, sf)
    return p.select("c_custkey", "s_suppkey", r(D.haversine(F.col("lon"), F.col("lat"), F.col("slon"), F.col("slat")), 2).alias("metres"))


@register(f"SELECT c_custkey, s_suppkey, round(CASE WHEN b<0 THEN b+360 ELSE b END,6) AS degrees FROM (SELECT *, degrees(atan2(sin(radians(slon-lon))*cos(radians(slat)), cos(radians(lat))*sin(radians(slat))-sin(radians(lat))*cos(radians(slat))*cos(radians(slon-lon)))) AS b FROM ({PAIR}))")
def bearing_degrees(spark: SparkSession, sf: str) -> DataFrame:
    p = trades(spark, sf)
    return p.select("c_custkey", "s_suppkey", r(D.bearing(F.col("lon"), F.col("lat"), F.col("slon"), F.col("slat"))).alias("degrees"))


@register(f"SELECT c_custkey, round(lon2-360*floor((lon2+180)/360),6) AS lon2, round(lat2,6) AS lat2 FROM (SELECT c_custkey, lat2, lon+degrees(atan2(sin(radians(45))*sin(0.1)*cos(radians(lat)), cos(0.1)-sin(radians(lat))*sin(radians(lat2)))) AS lon2 FROM (SELECT *, degrees(asin(sin(radians(lat))*cos(0.1)+cos(radians(lat))*sin(0.1)*cos(radians(45)))) AS lat2 FROM ({CUST})))")
def destination_points(spark: SparkSession, sf: str) -> DataFrame:
    p = customers(spark, sf).select("c_custkey", D.destination(F.col("lon"), F.col("lat"), 45, 0.1 * D.RADIUS).alias("p"))
    return p.select("c_custkey", r("p.lon").alias("lon2"), r("p.lat").alias("lat2"))


@register(f"SELECT c_custkey, round(asin(sin(2*asin(sqrt(power(sin(radians(lat-0)/2),2)+cos(0.0)*cos(radians(lat))*power(sin(radians(lon)/2),2))))*sin(radians(90)-atan2(sin(radians(lon))*cos(radians(lat)), sin(radians(lat)))))*6371008.771415,2) AS metres FROM ({CUST})")
def cross_track(spark: SparkSession, sf: str) -> DataFrame:
    return customers(spark, sf).select("c_custkey", r(D.cross_track(F.col("lon"), F.col("lat"), 0, 0, 90, 0), 2).alias("metres"))


@register(f"SELECT c_custkey, s_suppkey, round(sqrt(power(radians(slat-lat),2)+power(CASE WHEN abs(dp)>1e-12 THEN radians(slat-lat)/dp ELSE cos(radians(lat)) END*dl,2))*6371008.771415,2) AS metres FROM (SELECT *, ln(tan(pi()/4+radians(slat)/2))-ln(tan(pi()/4+radians(lat)/2)) AS dp, CASE WHEN abs(radians(slon-lon))>pi() THEN 2*pi()-abs(radians(slon-lon)) ELSE abs(radians(slon-lon)) END AS dl FROM ({PAIR}))")
def rhumb_lengths(spark: SparkSession, sf: str) -> DataFrame:
    p = trades(spark, sf)
    return p.select("c_custkey", "s_suppkey", r(D.rhumb_distance(F.col("lon"), F.col("lat"), F.col("slon"), F.col("slat")), 2).alias("metres"))


@register(f"SELECT c_custkey, s_suppkey, round(d,6) AS distance, rank FROM (SELECT c_custkey, s_suppkey, d, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS rank FROM (SELECT c_custkey, s_suppkey, sqrt(power(slon-lon,2)+power(slat-lat,2)) AS d FROM ({CUST}) CROSS JOIN ({SUPP}))) WHERE rank<=3")
def knn_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    n = J.nearest(customers(spark, sf), suppliers(spark, sf), "c_custkey", "s_suppkey", "cust_pt", "supp_pt", k=3)
    return n.select("c_custkey", "s_suppkey", r("distance").alias("distance"), F.col("rank").cast("long").alias("rank"))


@register(f"SELECT c_custkey, n_nationkey, rank FROM (SELECT c_custkey, n_nationkey, rank() OVER (PARTITION BY c_custkey ORDER BY d) AS rank FROM (SELECT c_custkey, n_nationkey, sqrt(power(greatest(x0-lon,0,lon-x1),2)+power(greatest(y0-lat,0,lat-y1),2)) AS d FROM ({CUST}) CROSS JOIN ({NATION}))) WHERE rank<=1")
def knn_ties(spark: SparkSession, sf: str) -> DataFrame:
    n = J.nearest(customers(spark, sf), nations(spark, sf), "c_custkey", "n_nationkey", "cust_pt", "nation_box", k=1, ties=True)
    return n.select("c_custkey", "n_nationkey", F.col("rank").cast("long").alias("rank"))


@register(f"SELECT c_custkey FROM ({CUST}) WHERE NOT EXISTS (SELECT 1 FROM ({SUPP}) WHERE sqrt(power(slon-lon,2)+power(slat-lat,2))<=8)")
def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return J.dwithin_join(customers(spark, sf), suppliers(spark, sf), 8.0, "cust_pt", "supp_pt", how="anti").select("c_custkey")


@register(f"SELECT c_custkey FROM ({CUST}) WHERE EXISTS (SELECT 1 FROM ({SUPP}) WHERE sqrt(power(slon-lon,2)+power(slat-lat,2))<=8)")
def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    return J.dwithin_join(customers(spark, sf), suppliers(spark, sf), 8.0, "cust_pt", "supp_pt", how="semi").select("c_custkey")


@register(f"SELECT user_id, round(sum(sqrt(power(x2-x,2)+power(y2-y,2))),4) AS length, count(*) AS n FROM ({STEP}) WHERE x2 IS NOT NULL GROUP BY 1")
def traj_length(spark: SparkSession, sf: str) -> DataFrame:
    return tracks(spark, sf).select("user_id", r(M.length("traj"), 4).alias("length"), (G.num_coordinates("traj") - 1).cast("long").alias("n"))


@register(f"SELECT user_id, max(floor(s))-min(floor(s)) AS seconds FROM ({TRACK}) GROUP BY 1 HAVING count(*)>1")
def traj_m_range(spark: SparkSession, sf: str) -> DataFrame:
    m = G.value_range("traj", "m")
    return tracks(spark, sf).select("user_id", (m["max"] - m["min"]).alias("seconds"))


@register(f"SELECT user_id, round(x+(x2-x)*t,4) AS x, round(y+(y2-y)*t,4) AS y FROM (SELECT *, CASE WHEN d=0 THEN 0 ELSE (half-before)/d END AS t, row_number() OVER (PARTITION BY user_id ORDER BY n) AS k FROM (SELECT *, sqrt(power(x2-x,2)+power(y2-y,2)) AS d, sum(sqrt(power(x2-x,2)+power(y2-y,2))) OVER (PARTITION BY user_id ORDER BY n)-sqrt(power(x2-x,2)+power(y2-y,2)) AS before, sum(sqrt(power(x2-x,2)+power(y2-y,2))) OVER (PARTITION BY user_id)/2 AS half FROM ({STEP}) WHERE x2 IS NOT NULL) WHERE before+d>=half) WHERE k=1")
def traj_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    g = tracks(spark, sf).select("user_id", L.interpolate("traj", 0.5, normalized=True).alias("g"))
    return g.select("user_id", r(G.x("g"), 4).alias("x"), r(G.y("g"), 4).alias("y"))


@register(f"SELECT user_id, sum(greatest(1, ceil(sqrt(power(x2-x,2)+power(y2-y,2))/7)))+1 AS n FROM ({STEP}) WHERE x2 IS NOT NULL GROUP BY 1")
def segmentize_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tracks(spark, sf).select("user_id", G.num_coordinates(P.segmentize("traj", 7.0)).cast("double").alias("n"))


@register(f"SELECT c_custkey, round(lon/7,1)+0.0 AS x, round(lat/7,1)+0.0 AS y FROM ({CUST})")
def quantize_points(spark: SparkSession, sf: str) -> DataFrame:
    g = P.quantize(G.point(F.col("lon") / 7, F.col("lat") / 7), 1)
    return customers(spark, sf).select("c_custkey", r(G.x(g), 1).alias("x"), r(G.y(g), 1).alias("y"))


@register(f"SELECT c_custkey, round(round_even(lon/4,0)*4,6)+0.0 AS x, round(round_even(lat/4,0)*4,6)+0.0 AS y FROM ({CUST})")
def snap_to_grid(spark: SparkSession, sf: str) -> DataFrame:
    g = customers(spark, sf).select("c_custkey", P.snap_to_grid("cust_pt", 4.0).alias("g"))
    return g.select("c_custkey", r(G.x("g")).alias("x"), r(G.y("g")).alias("y"))


@register(f"SELECT CAST(least(1023, greatest(0, floor((lon+180)/360*1024))) AS BIGINT) AS x, CAST(least(1023, greatest(0, floor((1-ln(tan(pi()/4+radians(lat)/2))/pi())/2*1024))) AS BIGINT) AS y, count(*) AS n FROM ({CUST}) GROUP BY 1, 2")
def tile_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf).select(C.tile_x(F.col("lon"), 10).alias("x"), C.tile_y(F.col("lat"), 10).alias("y"))
    return c.groupBy("x", "y").agg(F.count("*").alias("n"))


@register(f"SELECT x//2 AS px, y//2 AS py, count(*) AS n FROM (SELECT CAST(least(1023, greatest(0, floor((lon+180)/360*1024))) AS BIGINT) AS x, CAST(least(1023, greatest(0, floor((1-ln(tan(pi()/4+radians(lat)/2))/pi())/2*1024))) AS BIGINT) AS y FROM ({CUST})) GROUP BY 1, 2")
def tile_parents(spark: SparkSession, sf: str) -> DataFrame:
    t = C.tile_parts(C.tile_parent(C.tile_id(C.tile_x(F.col("lon"), 10), C.tile_y(F.col("lat"), 10), F.lit(10))))
    return customers(spark, sf).select(t.alias("t")).groupBy(F.col("t.x").alias("px"), F.col("t.y").alias("py")).agg(F.count("*").alias("n"))


@register(f"SELECT c_custkey, count(*) AS n, sum((x+i+1024)%1024)::BIGINT AS sx, sum(y+j)::BIGINT AS sy FROM (SELECT c_custkey, CAST(least(1023, greatest(0, floor((lon+180)/360*1024))) AS BIGINT) AS x, CAST(least(1023, greatest(0, floor((1-ln(tan(pi()/4+radians(lat)/2))/pi())/2*1024))) AS BIGINT) AS y FROM ({CUST})), (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j) WHERE (i<>0 OR j<>0) AND y+j BETWEEN 0 AND 1023 GROUP BY 1")
def tile_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    t = C.tile_neighbors(C.tile_id(C.tile_x(F.col("lon"), 10), C.tile_y(F.col("lat"), 10), F.lit(10)))
    near = customers(spark, sf).select("c_custkey", F.explode(t).alias("t")).select("c_custkey", C.tile_parts("t").alias("p"))
    return near.groupBy("c_custkey").agg(F.count("*").alias("n"), F.sum("p.x").alias("sx"), F.sum("p.y").alias("sy"))


@register(f"SELECT c_custkey, x*2 AS cx, y*2 AS cy FROM (SELECT c_custkey, CAST(least(1023, greatest(0, floor((lon+180)/360*1024))) AS BIGINT) AS x, CAST(least(1023, greatest(0, floor((1-ln(tan(pi()/4+radians(lat)/2))/pi())/2*1024))) AS BIGINT) AS y FROM ({CUST}))")
def tile_children(spark: SparkSession, sf: str) -> DataFrame:
    t = F.array_min(C.tile_children(C.tile_id(C.tile_x(F.col("lon"), 10), C.tile_y(F.col("lat"), 10), F.lit(10))))
    return customers(spark, sf).select("c_custkey", C.tile_parts(t).alias("t")).select("c_custkey", F.col("t.x").alias("cx"), F.col("t.y").alias("cy"))


@register(f"SELECT c_custkey, list_aggregate(list_transform(generate_series(0, 9), lambda i: CAST((x//CAST(power(2, 9-i) AS BIGINT))%2+2*((y//CAST(power(2, 9-i) AS BIGINT))%2) AS VARCHAR)), 'string_agg', '') AS key FROM (SELECT c_custkey, CAST(least(1023, greatest(0, floor((lon+180)/360*1024))) AS BIGINT) AS x, CAST(least(1023, greatest(0, floor((1-ln(tan(pi()/4+radians(lat)/2))/pi())/2*1024))) AS BIGINT) AS y FROM ({CUST}))")
def quadkeys(spark: SparkSession, sf: str) -> DataFrame:
    return customers(spark, sf).select("c_custkey", C.quadkey(C.tile_x(F.col("lon"), 10), C.tile_y(F.col("lat"), 10), 10).alias("key"))


@register(f"SELECT n_nationkey, (least(63,floor((x1+180)/360*64))-floor((x0+180)/360*64)+1)*(least(63,floor((1-ln(tan(pi()/4+radians(y0)/2))/pi())/2*64))-floor((1-ln(tan(pi()/4+radians(y1)/2))/pi())/2*64)+1) AS n FROM ({NATION})")
def tile_cover_boxes(spark: SparkSession, sf: str) -> DataFrame:
    c = C.tile_cover(F.col("x0"), F.col("y0"), F.col("x0") + 72, F.col("y0") + 34, 6)
    return nations(spark, sf).select("n_nationkey", F.size(c).cast("double").alias("n"))


@register(f"SELECT c_custkey, list_aggregate(list_transform(generate_series(0, 5), lambda i: substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(list_sum(list_transform(generate_series(0, 4), lambda k: (CASE WHEN (5*i+k)%2=0 THEN (gx//CAST(power(2, 14-(5*i+k)//2) AS BIGINT))%2 ELSE (gy//CAST(power(2, 14-(5*i+k)//2) AS BIGINT))%2 END)*CAST(power(2, 4-k) AS BIGINT))) AS BIGINT)+1, 1)), 'string_agg', '') AS code FROM (SELECT c_custkey, CAST(floor((lon+180)/360*32768) AS BIGINT) AS gx, CAST(floor((lat+90)/180*32768) AS BIGINT) AS gy FROM ({CUST}))")
def geohash_codes(spark: SparkSession, sf: str) -> DataFrame:
    return customers(spark, sf).select("c_custkey", C.geohash(F.col("lon"), F.col("lat"), 6).alias("code"))


@register(f"SELECT substr(list_aggregate(list_transform(generate_series(0, 5), lambda i: substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(list_sum(list_transform(generate_series(0, 4), lambda k: (CASE WHEN (5*i+k)%2=0 THEN (gx//CAST(power(2, 14-(5*i+k)//2) AS BIGINT))%2 ELSE (gy//CAST(power(2, 14-(5*i+k)//2) AS BIGINT))%2 END)*CAST(power(2, 4-k) AS BIGINT))) AS BIGINT)+1, 1)), 'string_agg', ''), 1, 2) AS value, count(*) AS count FROM (SELECT c_custkey, CAST(floor((lon+180)/360*32768) AS BIGINT) AS gx, CAST(floor((lat+90)/180*32768) AS BIGINT) AS gy FROM ({CUST})) GROUP BY 1")
def geohash_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.value_counts(customers(spark, sf).select(C.geohash(F.col("lon"), F.col("lat"), 2).alias("code")), "code")


@register(f"SELECT c_custkey, floor((lon+180)/360*1024)/1024*360-180 AS minx, floor((lat+90)/180*1024)/1024*180-90 AS miny, (floor((lon+180)/360*1024)+1)/1024*360-180 AS maxx, (floor((lat+90)/180*1024)+1)/1024*180-90 AS maxy FROM ({CUST})")
def geohash_bounds(spark: SparkSession, sf: str) -> DataFrame:
    b = C.geohash_bounds(C.geohash(F.col("lon"), F.col("lat"), 4))
    return customers(spark, sf).select("c_custkey", b.alias("b")).select("c_custkey", "b.*")


@register(f"SELECT c_custkey, list_sum(list_transform(generate_series(0, 15), lambda i: ((x//CAST(power(2,i) AS BIGINT))%2)*CAST(power(4,i) AS BIGINT)+((y//CAST(power(2,i) AS BIGINT))%2)*2*CAST(power(4,i) AS BIGINT))) AS key FROM (SELECT c_custkey, CAST(trunc((lon/2+90)/180*65535) AS BIGINT) AS x, CAST(trunc((lat/2+45)/90*65535) AS BIGINT) AS y FROM ({CUST}))")
def morton_keys(spark: SparkSession, sf: str) -> DataFrame:
    return customers(spark, sf).select("c_custkey", C.spatial_key("cust_pt", -180, -90, 180, 90, curve="morton").cast("decimal(38,0)").alias("key"))


@register(f"SELECT c_custkey FROM (SELECT c_custkey, list_sum(list_transform(generate_series(0, 15), lambda i: ((x//CAST(power(2,i) AS BIGINT))%2)*CAST(power(4,i) AS BIGINT)+((y//CAST(power(2,i) AS BIGINT))%2)*2*CAST(power(4,i) AS BIGINT))) AS key FROM (SELECT c_custkey, CAST(trunc((lon/2+90)/180*65535) AS BIGINT) AS x, CAST(trunc((lat/2+45)/90*65535) AS BIGINT) AS y FROM ({CUST}))) ORDER BY key, c_custkey LIMIT 100")
def zorder_topk(spark: SparkSession, sf: str) -> DataFrame:
    key = C.spatial_key("cust_pt", -180, -90, 180, 90, curve="morton")
    return customers(spark, sf).orderBy(key, "c_custkey").limit(100).select("c_custkey")


def _hilbert_sql(level: int = 8) -> str:
    top = 2**level - 1
    cell = f"SELECT c_custkey, CAST(trunc((lon/2+90)/180*{top}) AS BIGINT) AS x, CAST(trunc((lat/2+45)/90*{top}) AS BIGINT) AS y, CAST(0 AS BIGINT) AS d, CAST({2 ** (level - 1)} AS BIGINT) AS s FROM ({CUST})"
    turn = "SELECT c_custkey, CASE WHEN ry=0 THEN CASE WHEN rx=1 THEN s-1-(y%s) ELSE y%s END ELSE x%s END, CASE WHEN ry=0 THEN CASE WHEN rx=1 THEN s-1-(x%s) ELSE x%s END ELSE y%s END, d+s*s*CASE WHEN rx=0 THEN ry ELSE 3-ry END, s//2 FROM (SELECT *, (x//s)%2 AS rx, (y//s)%2 AS ry FROM h WHERE s>0)"
    return f"WITH RECURSIVE h(c_custkey, x, y, d, s) AS ({cell} UNION ALL {turn}) SELECT c_custkey, d AS key FROM h WHERE s=0"


@register(_hilbert_sql())
def hilbert_keys(spark: SparkSession, sf: str) -> DataFrame:
    return customers(spark, sf).select("c_custkey", C.spatial_key("cust_pt", -180, -90, 180, 90, level=8).alias("key"))


def _plus_sql() -> str:
    grid = f"SELECT c_custkey, CAST(floor(round((lat+90)*25000000,6)) AS BIGINT)//3125 AS y, CAST(floor(round((lon+180)*8192000,6)) AS BIGINT)//1024 AS x FROM ({CUST})"
    digit = lambda c, i: f"substr('23456789CFGHJMPQRVWX', CAST(({c}//{20**i})%20 AS INTEGER)+1, 1)"
    pairs = [f"{digit('y', i)}||{digit('x', i)}" for i in range(4, -1, -1)]
    return f"SELECT c_custkey, {'||'.join(pairs[:4])}||'+'||{pairs[4]} AS code FROM ({grid})"


@register(_plus_sql())
def plus_codes(spark: SparkSession, sf: str) -> DataFrame:
    return customers(spark, sf).select("c_custkey", C.plus_code(F.col("lon"), F.col("lat")).alias("code"))


def _short_sql(zoom: int = 12) -> str:
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_~"
    axes = f"SELECT c_custkey, CAST(floor((lon+180)*(4294967296/360.0)) AS BIGINT) AS x, CAST(floor((lat+90)*(4294967296/180.0)) AS BIGINT) AS y FROM ({CUST})"
    bit = lambda c, i: f"(({c}//{2**i})%2)"
    letter = lambda k: "+".join(f"{bit(c, 31 - 3 * k - j)}*{2 ** (5 - 2 * j - (c == 'y'))}" for j in range(3) for c in ("x", "y"))
    n = -(-(zoom + 8) // 3)
    return f"SELECT c_custkey, {'||'.join(f'substr({chr(39)}{alphabet}{chr(39)}, CAST({letter(k)} AS INTEGER)+1, 1)' for k in range(n))}||'{'-' * ((zoom + 8) % 3)}' AS code FROM ({axes})"


@register(_short_sql())
def short_links(spark: SparkSession, sf: str) -> DataFrame:
    return customers(spark, sf).select("c_custkey", C.short_link(F.col("lon"), F.col("lat"), 12).alias("code"))


@register(f"SELECT c_custkey, round(lon,5) AS lon, round(lat,5) AS lat FROM ({CUST})")
def polyline_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    g = customers(spark, sf).select("c_custkey", X.from_polyline(X.to_polyline(F.col("cust_pt"))).alias("g"))
    return g.select("c_custkey", r(G.x("g"), 5).alias("lon"), r(G.y("g"), 5).alias("lat"))


@register(f"SELECT c_custkey, round(radians(lon)*6378137,3) AS x, round(ln(tan(pi()/4+radians(lat)/2))*6378137,3) AS y FROM ({CUST})")
def web_mercator(spark: SparkSession, sf: str) -> DataFrame:
    p = D.to_web_mercator(F.col("lon"), F.col("lat"))
    return customers(spark, sf).select("c_custkey", r(p["x"], 3).alias("x"), r(p["y"], 3).alias("y"))


@register(f"SELECT c_custkey, CAST(CASE WHEN lat>=0 THEN 32600 ELSE 32700 END + least(60, floor((lon+180)/6)+1) AS INTEGER) AS epsg FROM ({CUST})")
def utm_zones(spark: SparkSession, sf: str) -> DataFrame:
    return customers(spark, sf).select("c_custkey", D.utm_zone(F.col("lon"), F.col("lat")).alias("epsg"))


@register(f"SELECT n_regionkey, CAST(count(*)*72*34 AS DOUBLE) AS area FROM ({NATION}) GROUP BY 1")
def dissolve_areas(spark: SparkSession, sf: str) -> DataFrame:
    g = A.dissolve(nations(spark, sf).select("n_regionkey", "nation_box"), ["n_regionkey"], "nation_box")
    return g.select("n_regionkey", r(M.area("nation_box")).alias("area"))


@register(f"SELECT n_regionkey, count(*) AS n FROM (SELECT n_regionkey, x, y, x2, y2 FROM (SELECT n_regionkey, unnest([x0,x0,x0,x1]) AS x, unnest([y0,y1,y0,y0]) AS y, unnest([x1,x1,x0,x1]) AS x2, unnest([y0,y1,y1,y1]) AS y2 FROM ({NATION})) GROUP BY ALL HAVING count(*)=1) GROUP BY 1")
def coverage_outline(spark: SparkSession, sf: str) -> DataFrame:
    e = A.coverage_edges(nations(spark, sf), "nation_box", ["n_regionkey"])
    return e.groupBy("n_regionkey").agg(F.count("*").alias("n"))


def _clip_sql() -> str:
    """Convex rings cut by the four sides of their nation's box, one side after the other, then their areas."""
    rows = f"SELECT c_custkey, i AS o, x, y, x0, y0, x1, y1 FROM ({RING}) JOIN ({NATION}) ON lon>=x0 AND lon<x1 AND lat>=y0 AND lat<y1 WHERE i<n"
    step = "SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS u, coalesce(lead(y) OVER w, first_value(y) OVER w) AS v FROM ({}) WINDOW w AS (PARTITION BY c_custkey ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    for c, d, other, e, side, sign in (("x", "u", "y", "v", "x0", ">="), ("x", "u", "y", "v", "x1", "<="), ("y", "v", "x", "u", "y0", ">="), ("y", "v", "x", "u", "y1", "<=")):
        edges = step.format(rows)
        cut = f"{other}+({side}-{c})/({d}-{c})*({e}-{other})"
        at = (side, cut) if c == "x" else (cut, side)
        rows = f"SELECT c_custkey, 2*o AS o, x, y, x0, y0, x1, y1 FROM ({edges}) WHERE {c}{sign}{side} UNION ALL SELECT c_custkey, 2*o+1, {at[0]}, {at[1]}, x0, y0, x1, y1 FROM ({edges}) WHERE ({c}{sign}{side})<>({d}{sign}{side})"
    return f"SELECT c_custkey, round(abs(sum(x*v-u*y))/2,6)+0.0 AS area FROM ({step.format(rows)}) GROUP BY 1"


@register(_clip_sql())
def clip_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Area of each customer's ring within the nation box that its centre lies in."""
    b = F.broadcast(nations(spark, sf).select("x0", "y0"))
    inside = (F.col("lon") >= F.col("x0")) & (F.col("lon") < F.col("x0") + 72) & (F.col("lat") >= F.col("y0")) & (F.col("lat") < F.col("y0") + 34)
    g = rings(spark, sf).join(b, inside, "left").select("c_custkey", P.clip_by_box("cust_ring", F.col("x0"), F.col("y0"), F.col("x0") + 72, F.col("y0") + 34).alias("g"))
    return g.select("c_custkey", r(M.area("g")).alias("area"))


@register(f"SELECT a.l AS l, b.l AS m, round(greatest(max(a.d), max(b.d)),6) AS distance FROM (SELECT p.label AS l, q.label AS m, p.vec_id, min(sqrt(power(p.x-q.x,2)+power(p.y-q.y,2))) AS d FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings) p, (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings) q WHERE p.label<>q.label GROUP BY 1,2,3) a JOIN (SELECT p.label AS l, q.label AS m, p.vec_id, min(sqrt(power(p.x-q.x,2)+power(p.y-q.y,2))) AS d FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings) p, (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings) q WHERE p.label<>q.label GROUP BY 1,2,3) b ON a.l=b.m AND a.m=b.l WHERE a.l<b.l GROUP BY 1,2")
def hausdorff_points(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("label", F.element_at("embedding", 1).alias("x"), F.element_at("embedding", 2).alias("y"))
    return J.hausdorff_of_groups(e, "label", "x", "y").select(F.col("a").alias("l"), F.col("b").alias("m"), r("distance").alias("distance"))


@register()
def label_hulls(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("label", G.vertex(F.element_at("embedding", 1), F.element_at("embedding", 2)).alias("v")).groupBy("label").agg(G.multi_point(F.collect_list("v")).alias("g"))
    h = e.select("label", K.convex_hull_of("g").alias("h"), K.minimum_bounding_circle("g").alias("c"))
    return h.select("label", r(M.area("h")).alias("area"), r(F.col("c.radius")).alias("radius"))


@register()
def simplified_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return tracks(spark, sf).select("user_id", G.num_coordinates(K.simplify("traj", 20.0, "dp")).alias("dp"), G.num_coordinates(K.simplify("traj", 20.0)).alias("vw"))


@register()
def frechet_tracks(spark: SparkSession, sf: str) -> DataFrame:
    t = tracks(spark, sf)
    return t.select("user_id", r(K.frechet_distance("traj", P.translate("traj", 1, 0))).alias("distance"))


@register(f"SELECT c_custkey, 2+c_custkey%9 AS n FROM customer")
def ring_triangles(spark: SparkSession, sf: str) -> DataFrame:
    t = rings(spark, sf).select("c_custkey", K.triangulate("cust_ring").alias("t"))
    return t.select("c_custkey", G.num_geometries("t").cast("long").alias("n"))


@register("SELECT c_custkey, round((1+c_custkey%7)*cos(pi()/(4+c_custkey%9)),3) AS distance FROM customer")
def ring_poles(spark: SparkSession, sf: str) -> DataFrame:
    p = rings(spark, sf).select("c_custkey", K.polylabel("cust_ring", 0.000001).alias("p"))
    return p.select("c_custkey", r(F.col("p.distance"), 3).alias("distance"))


def _geodesic_sql(rounds: int = 25) -> str:
    """Vincenty's steps, one a level of a recursion; pairs near antipodes, where they fail, are left out on both sides."""
    f, a = 1 / 298.257223563, 6378137.0
    start = f"SELECT c_custkey, s_suppkey, atan((1-{f!r})*tan(radians(lat))) AS u1, atan((1-{f!r})*tan(radians(slat))) AS u2, radians(CASE WHEN slon-lon>180 THEN slon-lon-360 WHEN slon-lon<-180 THEN slon-lon+360 ELSE slon-lon END) AS l FROM ({PAIR}) WHERE {HAV}<2.9"
    parts = "*, sqrt(power(cos(u2)*sin(m),2)+power(cos(u1)*sin(u2)-sin(u1)*cos(u2)*cos(m),2)) AS ss, sin(u1)*sin(u2)+cos(u1)*cos(u2)*cos(m) AS cs"
    more = "*, atan2(ss, cs) AS g, CASE WHEN ss=0 THEN 0 ELSE cos(u1)*cos(u2)*sin(m)/ss END AS sa"
    last = "*, 1-sa*sa AS c2, CASE WHEN 1-sa*sa<=1e-15 THEN 0 ELSE cs-2*sin(u1)*sin(u2)/(1-sa*sa) END AS cm"
    all_ = lambda rows: f"SELECT {last} FROM (SELECT {more} FROM (SELECT {parts} FROM {rows}))"
    c = f"({f!r}/16*c2*(4+{f!r}*(4-3*c2)))"
    step = f"SELECT c_custkey, s_suppkey, u1, u2, l, l+(1-{c})*{f!r}*sa*(g+{c}*ss*(cm+{c}*cs*(-1+2*cm*cm))), k+1 FROM ({all_('(SELECT * FROM w WHERE k<' + str(rounds) + ')')})"
    u = f"(c2*{f * (2 - f) / (1 - f) ** 2!r})"
    big, small = f"(1+{u}/16384*(4096+{u}*(-768+{u}*(320-175*{u}))))", f"({u}/1024*(256+{u}*(-128+{u}*(74-47*{u}))))"
    ds = f"{small}*ss*(cm+{small}/4*(cs*(-1+2*cm*cm)-{small}/6*cm*(-3+4*ss*ss)*(-3+4*cm*cm)))"
    end = all_(f"(SELECT * FROM w WHERE k={rounds})")
    return f"WITH RECURSIVE w(c_custkey, s_suppkey, u1, u2, l, m, k) AS (SELECT *, l, 0 FROM ({start}) UNION ALL {step}) SELECT c_custkey, s_suppkey, round({a * (1 - f)!r}*{big}*(g-{ds}),3) AS metres FROM ({end})"


@register(_geodesic_sql())
def geodesic_distance(spark: SparkSession, sf: str) -> DataFrame:
    p = trades(spark, sf).where(D.central_angle(F.col("lon"), F.col("lat"), F.col("slon"), F.col("slat")) < 2.9)
    return p.select("c_custkey", "s_suppkey", r(D.vincenty(F.col("lon"), F.col("lat"), F.col("slon"), F.col("slat")), 3).alias("metres"))


def _utm_sql() -> str:
    f = 1 / 298.257223563
    n, e = f / (2 - f), (f * (2 - f)) ** 0.5
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    k = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    zone = f"SELECT *, least(60, floor((lon+180)/6)+1) AS z, radians(lat) AS p FROM ({CUST})"
    t = f"SELECT *, sinh(atanh(sin(p))-{e!r}*atanh({e!r}*sin(p))) AS t, radians(lon-(z*6-183)) AS l FROM ({zone})"
    g = f"SELECT *, atan2(t, cos(l)) AS xi, atanh(sin(l)/sqrt(1+t*t)) AS eta FROM ({t})"
    x = "eta+" + "+".join(f"{c!r}*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, c in enumerate(alpha, 1))
    y = "xi+" + "+".join(f"{c!r}*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, c in enumerate(alpha, 1))
    return f"SELECT c_custkey, round(500000+{k!r}*({x}),3) AS x, round({k!r}*({y})+CASE WHEN lat<0 THEN 10000000 ELSE 0 END,3) AS y FROM ({g})"


@register(_utm_sql())
def utm_points(spark: SparkSession, sf: str) -> DataFrame:
    p = D.to_utm(F.col("lon"), F.col("lat"), D.utm_zone(F.col("lon"), F.col("lat")))
    return customers(spark, sf).select("c_custkey", r(p["x"], 3).alias("x"), r(p["y"], 3).alias("y"))


@register(f"SELECT n_nationkey, date_trunc('day', ts) AS start, count(*) AS n FROM ({TRACK}) JOIN ({NATION}) ON x>x0 AND x<x1 AND y>y0 AND y<y1 GROUP BY 1, 2")
def events_geofence(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("geometry", G.point(F.col("event_id") % 360 - 180, F.col("value")))
    return fence_counts(e, nations(spark, sf), fence="nation_box", fence_id="n_nationkey")


@register(f"SELECT l_orderkey, l_linenumber, round(sqrt(power(slon-lon,2)+power(slat-lat,2)),6) AS length FROM lineitem JOIN orders ON o_orderkey=l_orderkey JOIN ({CUST}) ON c_custkey=o_custkey JOIN ({SUPP}) ON s_suppkey=l_suppkey")
def order_segments(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    i = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey"))
    rows = i.join(o, "l_orderkey").join(customers(spark, sf).select("c_custkey", "lon", "lat"), "c_custkey").join(suppliers(spark, sf).select("s_suppkey", "slon", "slat"), "s_suppkey")
    line = G.line_string(F.array(G.vertex(F.col("lon"), F.col("lat")), G.vertex(F.col("slon"), F.col("slat"))))
    return rows.select("l_orderkey", "l_linenumber", r(M.length(line)).alias("length"))


@register(f"SELECT c_custkey, round(greatest(0,least(360,lon+180)),6) AS at FROM ({CUST})")
def line_locate(spark: SparkSession, sf: str) -> DataFrame:
    g = G.line_string(F.array(G.vertex(-180, 0), G.vertex(0, 0), G.vertex(180, 0)))
    return customers(spark, sf).select("c_custkey", r(L.locate(g, F.col("lon"), F.col("lat"))).alias("at"))


@register(f"SELECT user_id, round(sum(sqrt(power(x2-x,2)+power(y2-y,2)))/4,3) AS length FROM ({STEP}) WHERE x2 IS NOT NULL GROUP BY 1")
def line_substring(spark: SparkSession, sf: str) -> DataFrame:
    n = M.length("traj")
    return tracks(spark, sf).select("user_id", r(M.length(L.substring("traj", n / 4, n / 2)), 3).alias("length"))


@register(f"SELECT c_custkey, 2*(4+c_custkey%9)+1 AS n FROM customer")
def chaikin_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rings(spark, sf).select("c_custkey", G.num_coordinates(P.chaikin("cust_ring")).cast("long").alias("n"))


@register(f"SELECT user_id, CASE WHEN min_by(x, n)=max_by(x, n) AND min_by(y, n)=max_by(y, n) THEN 0 ELSE 2 END AS n FROM ({STEP}) GROUP BY 1 HAVING count(*)>1")
def boundary_points(spark: SparkSession, sf: str) -> DataFrame:
    return tracks(spark, sf).select("user_id", G.num_geometries(P.boundary("traj")).alias("n"))


@register(f"SELECT c_custkey, sum(CASE WHEN (y>py)<>(y2>py) AND px<x+(py-y)/(y2-y)*(x2-x) THEN 1 ELSE 0 END)%2=1 AS contained, false AS corner FROM (SELECT *, lon+(1+c_custkey%7)*((c_custkey%13)/6.0-1.0) AS px, lat+0.123*(1+c_custkey%5) AS py FROM ({EDGE})) WHERE x2 IS NOT NULL GROUP BY 1")
def point_in_ring(spark: SparkSession, sf: str) -> DataFrame:
    v, k = F.get(G.vertices("cust_ring"), F.lit(0)), F.col("c_custkey")
    x, y = F.col("lon") + (1 + k % 7) * ((k % 13) / 6.0 - 1.0), F.col("lat") + 0.123 * (1 + k % 5)
    return rings(spark, sf).select("c_custkey", M.contains_xy("cust_ring", x, y).alias("contained"), M.contains_xy("cust_ring", v["x"], v["y"]).alias("corner"))


@register(f"SELECT c_custkey, round(abs(sum((x-lon)*(y2-lat)-(x2-lon)*(y-lat)))/2, 6) AS area FROM ({EDGE}) WHERE x2 IS NOT NULL GROUP BY 1")
def convex_hull_areas(spark: SparkSession, sf: str) -> DataFrame:
    return rings(spark, sf).select("c_custkey", r(M.area(K.convex_hull_of("cust_ring"))).alias("area"))


@register(f"SELECT c_custkey, list_sum(list_transform(generate_series(0, 15), lambda i: ((x//CAST(power(2,i) AS BIGINT))%2)*CAST(power(4,i) AS BIGINT)+((y//CAST(power(2,i) AS BIGINT))%2)*2*CAST(power(4,i) AS BIGINT))) AS key FROM (SELECT c_custkey, CAST(trunc((lon/2+90)/180*65535) AS BIGINT) AS x, CAST(trunc((lat/2+45)/90*65535) AS BIGINT) AS y FROM ({CUST}))")
def spatial_order(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in the order of their keys; the order itself is tested beside the code."""
    rows = A.spatial_sort(customers(spark, sf), "cust_pt", curve="morton")
    return rows.select("c_custkey", C.spatial_key("cust_pt", -180, -90, 180, 90, curve="morton").alias("key"))