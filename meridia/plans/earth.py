"""Registered queries on the ellipsoid and across the 180th meridian, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import antimeridian as S
from meridia.functions import geodesy as D
from meridia.functions import geometry as G
from meridia.functions import measures as M
from meridia.plans.catalog import EDGE, NATION, RING, STEP, r, register
from meridia.plans.tables import nations, rings, tracks

#: Rings that stay on the Earth: radius and latitude within 90 degrees.
ON_EARTH = "abs(lat)+1+c_custkey%7<90"
_E2, _A = D.FLAT * (2 - D.FLAT), D.A
#: Area between the equator and a latitude, a radian wide, on the ellipsoid.
_Q = f"({_A * _A * (1 - _E2) / 2!r}*(sin(p)/(1-{_E2!r}*sin(p)*sin(p))+atanh({_E2**0.5!r}*sin(p))/{_E2**0.5!r}))"
#: Sides in 64 steps along great circles of reduced latitudes, each step's area by the middle latitude.
_SIDES = f"SELECT c_custkey, i, radians(x) AS l1, atan({1 - D.FLAT!r}*tan(radians(y))) AS b1, radians(x2) AS l2, atan({1 - D.FLAT!r}*tan(radians(y2))) AS b2 FROM ({EDGE}) WHERE x2 IS NOT NULL AND {ON_EARTH}"
_ARCS = f"SELECT *, 2*asin(sqrt(power(sin((b2-b1)/2),2)+cos(b1)*cos(b2)*power(sin((l2-l1)/2),2))) AS d FROM ({_SIDES})"
_PLACES = f"SELECT c_custkey, i, k, sin((1-k/128.0)*d)/sin(d)*cos(b1)*cos(l1)+sin(k/128.0*d)/sin(d)*cos(b2)*cos(l2) AS vx, sin((1-k/128.0)*d)/sin(d)*cos(b1)*sin(l1)+sin(k/128.0*d)/sin(d)*cos(b2)*sin(l2) AS vy, sin((1-k/128.0)*d)/sin(d)*sin(b1)+sin(k/128.0*d)/sin(d)*sin(b2) AS vz FROM ({_ARCS}), (SELECT unnest(range(129)) AS k)"
_AT = f"SELECT c_custkey, i, k, atan2(vy, vx) AS l, atan(tan(asin(vz))/{1 - D.FLAT!r}) AS p FROM ({_PLACES})"
_STRIPS = f"SELECT c_custkey, i, k, l-lag(l, 2) OVER w AS dl, lag({_Q}, 2) OVER w AS q0, lag({_Q}, 1) OVER w AS q1, {_Q} AS q2 FROM ({_AT}) WINDOW w AS (PARTITION BY c_custkey, i ORDER BY k)"
_AREA = f"SELECT c_custkey, round(abs(sum((dl-2*pi()*round(dl/(2*pi())))*(q0+4*q1+q2)/6))/1e9) AS thousand_km2 FROM ({_STRIPS}) WHERE k>0 AND k%2=0 GROUP BY 1"


@register(_AREA)
def geodesic_ring_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Areas on the ellipsoid of all rings that stay on it, those over the seam too."""
    return rings(spark, sf).where(ON_EARTH).select("c_custkey", r(D.geodesic_area("cust_ring", 1e3) / 1e3, 0).alias("thousand_km2"))


#: A side along a meridian or the equator has a length that SQL can integrate: the boxes of nations.
_MERIDIAN = f"(SELECT sum({_A * (1 - _E2)!r}/power(1-{_E2!r}*power(sin(radians(y0+(j+0.5)*34/2000)), 2), 1.5)*radians(34/2000.0)) FROM (SELECT unnest(range(2000)) AS j))"


@register(f"SELECT n_nationkey, round({_MERIDIAN}/1e3, 3) AS km FROM ({NATION})")
def geodesic_meridians(spark: SparkSession, sf: str) -> DataFrame:
    """Length of the western side of each nation's box."""
    side = G.line_string(F.array(G.vertex(F.col("x0"), F.col("y0")), G.vertex(F.col("x0"), F.col("y0") + 34)))
    return nations(spark, sf).select("n_nationkey", r(D.geodesic_length(side, 1e3), 3).alias("km"))


@register(f"SELECT user_id, 1+sum(CAST(abs(x2-x)>180 AS BIGINT)) AS parts, round(sum(sqrt(power(least(abs(x2-x), 360-abs(x2-x)), 2)+power(y2-y, 2))), 3) AS length, true AS narrow FROM ({STEP}) WHERE x2 IS NOT NULL GROUP BY 1")
def split_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks cut at the 180th meridian: their parts and length, and whether every step is one that stays on a side."""
    s = tracks(spark, sf).select("user_id", F.explode(F.array(S.split_antimeridian("traj"))).alias("s"))
    widest = F.array_max(F.transform(F.flatten(F.transform(G.rings("s"), lambda v: G.pairs(v, lambda a, b: F.abs(b["x"] - a["x"])))), lambda d: d))
    return s.select("user_id", G.num_geometries("s").cast("long").alias("parts"), r(M.length("s"), 3).alias("length"), (widest <= 180).alias("narrow"))


@register(f"SELECT c_custkey, CASE WHEN min(x)<-180 OR max(x)>180 THEN 2 ELSE 1 END AS parts, round(max(n)/2.0*power(max(1+c_custkey%7), 2)*sin(2*pi()/max(n)), 5) AS area, true AS inside FROM ({RING}) GROUP BY c_custkey")
def split_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Rings of all customers cut at the 180th meridian: their parts and area, and whether they stay within 180 degrees."""
    s = rings(spark, sf).select("c_custkey", F.explode(F.array(S.split_antimeridian("cust_ring"))).alias("s"))
    b = G.bounds("s")
    return s.select("c_custkey", G.num_geometries("s").cast("int").alias("parts"), r(M.area("s"), 5).alias("area"), ((b["minx"] >= -180) & (b["maxx"] <= 180)).alias("inside"))
