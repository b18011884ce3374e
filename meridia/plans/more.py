"""More registered queries, of reference systems, cells, linework, distances and codes, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import cells as C
from meridia.functions import codes as O
from meridia.functions import constructive as P
from meridia.functions import crs as S
from meridia.functions import geometry as G
from meridia.functions import grids as R
from meridia.functions import kernels as K
from meridia.functions import linework as W
from meridia.functions import measures as M
from meridia.functions import pairwise as D
from meridia.operators import aggregates as A
from meridia.plans.catalog import CUST, EDGE, NATION, RING, r, register
from meridia.plans.tables import customers, nations, rings, spread, table

#: Two different nations' boxes, each pair once.
BOXES = f"SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1 FROM ({NATION}) a JOIN ({NATION}) b ON a.n_nationkey<b.n_nationkey"


def box_pairs(spark: SparkSession, sf: str) -> DataFrame:
    n = nations(spark, sf)
    return n.select(F.col("n_nationkey").alias("a"), F.col("nation_box").alias("g")).join(F.broadcast(n.select(F.col("n_nationkey").alias("b"), F.col("nation_box").alias("h"))), F.col("a") < F.col("b"))  # 25 rows


# --- reference systems -------------------------------------------------------------------------


@register(f"SELECT c_custkey, round(radians(lon)*6378137.0,4)+0.0 AS x, round(asinh(tan(radians(lat)))*6378137.0,4)+0.0 AS y, round(lon,7) AS lon, round(lat,7) AS lat FROM ({CUST})")
def crs_mercator(spark: SparkSession, sf: str) -> DataFrame:
    """Points moved to the web's map and back, by the systems that their column carries."""
    g = S.set_crs(customers(spark, sf).select("c_custkey", F.col("cust_pt").alias("geometry")), "geometry", 4326)
    there = S.to_crs(g, "geometry", 3857)
    there = there.withColumn("x", r(G.x("geometry"), 4)).withColumn("y", r(G.y("geometry"), 4))
    back = S.to_crs(there, "geometry", 4326)
    return back.select("c_custkey", "x", "y", r(G.x("geometry"), 7).alias("lon"), r(G.y("geometry"), 7).alias("lat"))


@register(f"SELECT c_custkey, round(lon,7) AS lon, round(lat,7) AS lat FROM ({CUST}) WHERE lon>=-12 AND lon<42 AND lat>=30 AND lat<70")
def crs_equal_area(spark: SparkSession, sf: str) -> DataFrame:
    """Points of Europe through the equal-area system and the conformal conic and back."""
    near = customers(spark, sf).where("lon >= -12 and lon < 42 and lat >= 30 and lat < 70").select("c_custkey", F.col("cust_pt").alias("geometry"))
    g = S.to_crs(near, "geometry", 3035, source=4258)
    g = S.to_crs(S.to_crs(g, "geometry", 3034), "geometry", 4258)
    return g.select("c_custkey", r(G.x("geometry"), 7).alias("lon"), r(G.y("geometry"), 7).alias("lat"))


@register(f"SELECT c_custkey, CAST(CASE WHEN lat>=0 THEN 32600 ELSE 32700 END + CASE WHEN lat>=72 AND lat<=84 AND lon>=0 AND lon<42 THEN CASE WHEN lon<9 THEN 31 WHEN lon<21 THEN 33 WHEN lon<33 THEN 35 ELSE 37 END WHEN lat>=56 AND lat<64 AND lon>=3 AND lon<12 THEN 32 ELSE least(60, floor((lon+180)/6)+1) END AS INTEGER) AS epsg FROM ({CUST})")
def crs_local_zones(spark: SparkSession, sf: str) -> DataFrame:
    return customers(spark, sf).select("c_custkey", S.local_utm("lon", "lat").alias("epsg"))


def _geocentric_sql() -> str:
    f = 1 / 298.257223563
    e2 = f * (2 - f)
    n = f"6378137.0/sqrt(1-{e2!r}*power(sin(radians(lat)),2))"
    return f"SELECT c_custkey, round(({n}+c_acctbal)*cos(radians(lat))*cos(radians(lon)),3)+0.0 AS x, round(({n}+c_acctbal)*cos(radians(lat))*sin(radians(lon)),3)+0.0 AS y, round(({n}*{1 - e2!r}+c_acctbal)*sin(radians(lat)),3)+0.0 AS z FROM ({CUST})"


@register(_geocentric_sql())
def crs_geocentric(spark: SparkSession, sf: str) -> DataFrame:
    p = customers(spark, sf).select("c_custkey", S.transform_columns(4979, 4978, "lon", "lat", F.col("c_acctbal").cast("double")).alias("p"))
    return p.select("c_custkey", r("p.x", 3).alias("x"), r("p.y", 3).alias("y"), r("p.z", 3).alias("z"))


# --- cells -------------------------------------------------------------------------------------


def _cover_sql(precision: int = 2) -> str:
    nx, ny = (5 * precision + 1) // 2, 5 * precision // 2
    w, h = 360.0 / 2**nx, 180.0 / 2**ny
    at = lambda c, low, size, n: f"least({2**n - 1}, greatest(0, floor(({c}-({low}))/{size!r})))::BIGINT"
    cells = f"SELECT *, unnest(generate_series({at('y0', -90.0, h, ny)}, {at('y1', -90.0, h, ny)})) AS j FROM (SELECT *, unnest(generate_series({at('x0', -180.0, w, nx)}, {at('x1', -180.0, w, nx)})) AS i FROM ({NATION}))"
    box = f"SELECT *, i*{w!r}-180 AS a, (i+1)*{w!r}-180 AS c, j*{h!r}-90 AS b, (j+1)*{h!r}-90 AS d FROM ({cells})"
    return f"SELECT n_nationkey, count(*) AS overlapping, count(*) FILTER ((a+c)/2>x0 AND (a+c)/2<x1 AND (b+d)/2>y0 AND (b+d)/2<y1) AS central, count(*) FILTER (a>=x0 AND c<=x1 AND b>=y0 AND d<=y1) AS inside FROM ({box}) GROUP BY 1"


@register(_cover_sql())
def geohash_covers(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda rule: F.size(R.geohash_cover("nation_box", 2, rule=rule)).cast("long")
    return nations(spark, sf).select("n_nationkey", n("overlap").alias("overlapping"), n("center").alias("central"), n("within").alias("inside"))


def _tile_cover_sql(zoom: int = 5) -> str:
    n = 2**zoom
    x = lambda c: f"least({n - 1}, greatest(0, floor(({c}+180)/360*{n})))::BIGINT"
    y = lambda c: f"least({n - 1}, greatest(0, floor((1-ln(tan(pi()/4+radians({c})/2))/pi())/2*{n})))::BIGINT"
    cells = f"SELECT *, unnest(generate_series({y('y1')}, {y('y0')})) AS j FROM (SELECT *, unnest(generate_series({x('x0')}, {x('x1')})) AS i FROM ({NATION}))"
    lat = lambda c: f"degrees(atan(sinh(pi()*(1-2*({c})/{n}.0))))"
    box = f"SELECT *, i*360.0/{n}-180 AS a, (i+1)*360.0/{n}-180 AS c, {lat('j+1')} AS b, {lat('j')} AS d FROM ({cells})"
    return f"SELECT n_nationkey, count(*) AS overlapping, count(*) FILTER ((a+c)/2>x0 AND (a+c)/2<x1 AND (b+d)/2>y0 AND (b+d)/2<y1) AS central, count(*) FILTER (a>=x0 AND c<=x1 AND b>=y0 AND d<=y1) AS inside FROM ({box}) GROUP BY 1"


@register(_tile_cover_sql())
def tile_covers(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda rule: F.size(R.tile_cover("nation_box", 5, rule=rule)).cast("long")
    return nations(spark, sf).select("n_nationkey", n("overlap").alias("overlapping"), n("center").alias("central"), n("within").alias("inside"))


@register(f"SELECT c_custkey, substr(h, 1, 3) AS parent, CAST(31+32 AS BIGINT) AS left_over, CAST(1 AS BIGINT) AS shared FROM (SELECT c_custkey, {'||'.join('substr(' + chr(39) + '0123456789bcdefghjkmnpqrstuvwxyz' + chr(39) + ', CAST(' + '+'.join(f'((CAST(floor((lon+180)/360*1024) AS BIGINT)//{2 ** (9 - (5 * k + j) // 2)})%2)*{16 >> j}' if (5 * k + j) % 2 == 0 else f'((CAST(floor((lat+90)/180*1024) AS BIGINT)//{2 ** (9 - (5 * k + j) // 2)})%2)*{16 >> j}' for j in range(5)) + ' AS INTEGER)+1, 1)' for k in range(4))} AS h FROM ({CUST}))")
def geohash_sets(spark: SparkSession, sf: str) -> DataFrame:
    """A cell from its children; what is left of it without one of them, but that one's children in its place; what two sets share."""
    h = customers(spark, sf).select("c_custkey", C.geohash(F.col("lon"), F.col("lat"), 4).alias("h")).withColumn("up", C.geohash_parent("h"))
    family, down = C.geohash_children("up"), C.geohash_children("h")
    apart = R.cell_difference(R.GEOHASH, F.array("up"), F.array("h"))
    return h.select("c_custkey", F.element_at(R.compact(R.GEOHASH, family), 1).alias("parent"), F.size(F.concat(apart, R.uncompact(R.GEOHASH, F.array("h"), 4))).cast("long").alias("left_over"), F.size(R.cell_intersection(R.GEOHASH, family, down)).cast("long").alias("shared"))


@register(f"SELECT c_custkey, CAST(12 AS INTEGER) AS level, CAST(4 AS BIGINT) AS children, true AS holds, round(lon,6) AS lon, round(lat,6) AS lat FROM ({CUST}) WHERE lon>-180")
def s2_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Points to the finest cells, their tokens, and back; and the cells around them."""
    c = customers(spark, sf).where("lon > -180").select("c_custkey", R.s2_cell("lon", "lat").alias("leaf")).withColumn("c", R.s2_parent("leaf", 12))
    c = c.select("c_custkey", "c", R.s2_from_token(R.s2_token("leaf")).alias("leaf"))
    out = c.select("c_custkey", R.s2_level("c").alias("level"), F.size(F.array_distinct(R.s2_children("c"))).cast("long").alias("children"), R.s2_contains("c", "leaf").alias("holds"), R.s2_center("leaf").alias("p"))
    return out.select("c_custkey", "level", "children", "holds", r("p.lon").alias("lon"), r("p.lat").alias("lat"))


@register(f"SELECT c_custkey, round(floor(round((lon+180)*8000,5))/8000-180,9) AS minx, round(floor(round((lat+90)*8000,5))/8000-90,9) AS miny FROM (SELECT c_custkey, round(lon,2) AS lon, round(lat,2) AS lat FROM ({CUST}))")
def plus_code_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """The lower corner of each point's code, after the code was shortened by a point nearby and recovered."""
    x, y = F.col("lon"), F.col("lat")
    code = C.plus_code_recover(C.plus_code_shorten(C.plus_code(x, y), x, y), x, y)
    b = customers(spark, sf).select("c_custkey", C.plus_code_bounds(code).alias("b"))
    return b.select("c_custkey", r("b.minx", 9).alias("minx"), r("b.miny", 9).alias("miny"))


@register(f"SELECT c_custkey, round((CAST(floor((lon+180)*(4294967296/360.0)) AS BIGINT)//2048*2048)*(360/4294967296.0)-180,9) AS lon, round((CAST(floor((lat+90)*(4294967296/180.0)) AS BIGINT)//2048*2048)*(180/4294967296.0)-90,9) AS lat, CAST(12 AS INTEGER) AS zoom FROM ({CUST})")
def short_link_points(spark: SparkSession, sf: str) -> DataFrame:
    p = customers(spark, sf).select("c_custkey", C.short_link_point(C.short_link(F.col("lon"), F.col("lat"), 12)).alias("p"))
    return p.select("c_custkey", r("p.lon", 9).alias("lon"), r("p.lat", 9).alias("lat"), "p.zoom")


# --- distances ---------------------------------------------------------------------------------


@register(f"SELECT a, b, round(sqrt(power(greatest(ax0-bx1, bx0-ax1, 0),2)+power(greatest(ay0-by1, by0-ay1, 0),2)),6) AS distance, greatest(ax0-bx1, bx0-ax1, 0)<=80 AND sqrt(power(greatest(ax0-bx1, bx0-ax1, 0),2)+power(greatest(ay0-by1, by0-ay1, 0),2))<=80 AS near FROM ({BOXES})")
def box_distances(spark: SparkSession, sf: str) -> DataFrame:
    return box_pairs(spark, sf).select("a", "b", r(D.distance("g", "h")).alias("distance"), D.dwithin("g", "h", 80).alias("near"))


@register(f"SELECT c_custkey, round(greatest(x0, least(x1, lon)),6) AS x, round(greatest(y0, least(y1, lat)),6) AS y, round(sqrt(power(lon-greatest(x0, least(x1, lon)),2)+power(lat-greatest(y0, least(y1, lat)),2)),6) AS length FROM ({CUST}) JOIN ({NATION}) ON n_nationkey=c_nationkey")
def shortest_lines(spark: SparkSession, sf: str) -> DataFrame:
    """From each customer to the box of the customer's nation."""
    at = customers(spark, sf).join(F.broadcast(nations(spark, sf).select(F.col("n_nationkey").alias("c_nationkey"), "nation_box")), "c_nationkey")  # 25 rows
    g = at.select("c_custkey", D.nearest_points("cust_pt", "nation_box", left_kind="point").alias("p"), M.length(D.shortest_line("cust_pt", "nation_box", left_kind="point")).alias("length"))
    return g.select("c_custkey", r(G.x("p.b")).alias("x"), r(G.y("p.b")).alias("y"), r("length").alias("length"))


@register(f"SELECT c_custkey, round(sqrt(3*3+4*4+power(c_acctbal,2)),4) AS length, round(abs(c_acctbal),4) AS apart FROM ({CUST})")
def lengths_in_space(spark: SparkSession, sf: str) -> DataFrame:
    """The length of a slope, and the distance of two lines that cross above each other."""
    z = F.col("c_acctbal").cast("double")
    slope = G.line_string(F.array(G.vertex(0, 0, 0), G.vertex(3, 4, z)))
    over, under = G.line_string(F.array(G.vertex(-1, 0, z), G.vertex(1, 0, z))), G.line_string(F.array(G.vertex(0, -1, 0), G.vertex(0, 1, 0)))
    return customers(spark, sf).select("c_custkey", slope.alias("g"), over.alias("o"), under.alias("u")).select("c_custkey", r(D.length_3d("g"), 4).alias("length"), r(D.distance_3d("o", "u"), 4).alias("apart"))


@register("SELECT c_custkey, round(2*(1+c_custkey%7)*sin(pi()/(4+c_custkey%9)),6) AS clearance FROM customer")
def ring_clearances(spark: SparkSession, sf: str) -> DataFrame:
    return rings(spark, sf).select("c_custkey", r(D.minimum_clearance("cust_ring")).alias("clearance"))


@register("SELECT c_custkey, true AS near, false AS far, false AS equal, true AS same FROM customer")
def exact_equality(spark: SparkSession, sf: str) -> DataFrame:
    g = rings(spark, sf).select("c_custkey", "cust_ring", P.translate("cust_ring", 1e-4, 0).alias("h"))
    return g.select("c_custkey", D.equals_exact("cust_ring", "h", 1e-3).alias("near"), D.equals_exact("cust_ring", "h", 1e-5).alias("far"), D.equals_identical("cust_ring", "h").alias("equal"), D.equals_identical("h", "h").alias("same"))


# --- linework ----------------------------------------------------------------------------------


def _star(n: int = 2):
    """Each ring's corners joined in steps of two, where their number is odd."""
    v = G.vertices("cust_ring")
    size = F.size(v) - 1
    return G.line_string(F.transform(F.sequence(F.lit(0), size), lambda i: F.get(v, (i * n) % size)))


@register("SELECT c_custkey, CAST(4+c_custkey%9 AS BIGINT) AS crossings, false AS simple, true AS closed, CAST(3*(4+c_custkey%9) AS BIGINT) AS edges FROM customer WHERE (4+c_custkey%9)%2=1")
def star_crossings(spark: SparkSession, sf: str) -> DataFrame:
    """Stars cross themselves once an edge."""
    g = rings(spark, sf).where("(4 + c_custkey % 9) % 2 = 1").select("c_custkey", _star().alias("g"))
    return g.select("c_custkey", G.num_geometries(W.self_intersections("g")).cast("long").alias("crossings"), W.is_simple("g").alias("simple"), G.is_closed("g").alias("closed"), G.num_geometries(W.node("g")).cast("long").alias("edges"))


@register("SELECT c_custkey, CAST(n*n AS BIGINT) AS faces, CAST(n*n AS DOUBLE) AS area, CAST(4*(n+1) AS BIGINT) AS dangles FROM (SELECT c_custkey, 1+c_custkey%4 AS n FROM customer)")
def grid_faces(spark: SparkSession, sf: str) -> DataFrame:
    """Faces of lines across each other, with loose ends around."""
    n = (1 + F.col("c_custkey") % 4).cast("int")
    far = n + F.lit(0.5)
    lines = F.transform(F.sequence(F.lit(0), n), lambda i: F.array(G.vertex(i, -0.5), G.vertex(i, far)))
    over = F.transform(F.sequence(F.lit(0), n), lambda i: F.array(G.vertex(-0.5, i), G.vertex(far, i)))
    g = spread(table(spark, sf, "customer").select("c_custkey"), "c_custkey").select("c_custkey", W.polygonize_full(G.multi_line_string(F.concat(lines, over))).alias("p"))
    return g.select("c_custkey", G.num_geometries("p.polygons").cast("long").alias("faces"), r(M.area("p.polygons")).alias("area"), G.num_geometries("p.dangles").cast("long").alias("dangles"))


@register(f"SELECT c_custkey, round(8.0*(1+c_custkey%7)*(1+c_custkey%7)/8,6) AS area, true AS valid FROM ({CUST})")
def repaired_bows(spark: SparkSession, sf: str) -> DataFrame:
    """Bows made valid: two triangles of half their box's area each way."""
    s = (1 + F.col("c_custkey") % 7).cast("double")
    bow = G.polygon(F.array(G.vertex(0, 0), G.vertex(s, s * 2), G.vertex(s, 0), G.vertex(0, s * 2), G.vertex(0, 0)))
    g = customers(spark, sf).select("c_custkey", bow.alias("g")).select("c_custkey", W.repair("g").alias("g"))
    return g.select("c_custkey", r(M.area("g")).alias("area"), K.is_valid("g").alias("valid"))


@register(f"SELECT n_nationkey, round((72+2*d)*(34+2*d),6) AS mitred, round(72*34+2*d*(72+34)+16*d*d*sin(pi()/16),6) AS rounded, round((72-2*d)*(34-2*d),6) AS shrunk FROM (SELECT n_nationkey, CAST(1.5 AS DOUBLE) AS d FROM nation)")
def box_buffers(spark: SparkSession, sf: str) -> DataFrame:
    g = nations(spark, sf)
    return g.select("n_nationkey", r(M.area(W.buffer("nation_box", 1.5, join="mitre"))).alias("mitred"), r(M.area(W.buffer("nation_box", 1.5))).alias("rounded"), r(M.area(W.buffer("nation_box", -1.5))).alias("shrunk"))


@register(f"SELECT c_custkey, round(lon+180,6) AS before, round(180-lon,6) AS after FROM ({CUST}) WHERE lon>-180")
def split_lines(spark: SparkSession, sf: str) -> DataFrame:
    line = G.line_string(F.array(G.vertex(-180, F.col("lat")), G.vertex(180, F.col("lat"))))
    g = customers(spark, sf).where("lon > -180").select("c_custkey", G.rings(W.split_by(line, F.col("cust_pt"))).alias("v"))
    wide = lambda i: r(F.element_at(F.element_at("v", i), -1)["x"] - F.element_at(F.element_at("v", i), 1)["x"])
    return g.select("c_custkey", wide(1).alias("before"), wide(2).alias("after"))


@register(f"SELECT a, b, CAST(CASE WHEN ax0=bx0 AND (ay0=by1 OR by0=ay1) THEN 72 WHEN ay0=by0 AND (ax0=bx1 OR bx0=ax1) THEN 34 ELSE 0 END AS DOUBLE) AS length FROM ({BOXES})")
def shared_borders(spark: SparkSession, sf: str) -> DataFrame:
    n = nations(spark, sf).select("n_nationkey", P.boundary("nation_box").alias("line"))
    two = n.select(F.col("n_nationkey").alias("a"), F.col("line").alias("g")).join(F.broadcast(n.select(F.col("n_nationkey").alias("b"), F.col("line").alias("h"))), F.col("a") < F.col("b"))  # 25 rows
    p = two.select("a", "b", W.shared_paths("g", "h").alias("s"))
    return p.select("a", "b", r(M.length("s.forward") + M.length("s.backward")).alias("length"))


@register(f"SELECT c_custkey, round(min(x),6) AS x, round(min_by(y, x),6)+0.0 AS y FROM ({RING}) WHERE (4+c_custkey%9)%2=0 GROUP BY 1")
def normal_starts(spark: SparkSession, sf: str) -> DataFrame:
    """Rings begin at their least vertex, whichever way they were drawn."""
    g = rings(spark, sf).where("(4 + c_custkey % 9) % 2 = 0").select("c_custkey", W.normalize(G.reverse("cust_ring")).alias("g"))
    v = F.get(G.vertices("g"), F.lit(0))
    return g.select("c_custkey", r(v["x"]).alias("x"), r(v["y"]).alias("y"))


@register(f"SELECT c_custkey, round(min(x),6) AS west, round(max(x),6) AS east, round(min(y),6) AS south, round(max(y),6) AS north FROM ({RING}) GROUP BY 1")
def ring_extremes(spark: SparkSession, sf: str) -> DataFrame:
    g = rings(spark, sf).select("c_custkey", G.vertices(W.extremes("cust_ring")).alias("v"))
    return g.select("c_custkey", r(F.get("v", F.lit(0))["x"]).alias("west"), r(F.get("v", F.lit(1))["x"]).alias("east"), r(F.get("v", F.lit(2))["y"]).alias("south"), r(F.get("v", F.lit(3))["y"]).alias("north"))


@register(f"SELECT c_custkey, round(abs(sum((x-lon)*(y2-lat)-(x2-lon)*(y-lat)))/2,5) AS area, true AS small FROM ({EDGE}) WHERE x2 IS NOT NULL GROUP BY 1")
def subdivided_rings(spark: SparkSession, sf: str) -> DataFrame:
    g = rings(spark, sf).select("c_custkey", W.subdivide("cust_ring", 8).alias("g"))
    return g.select("c_custkey", r(M.area("g"), 5).alias("area"), F.forall(G.rings("g"), lambda q: F.size(q) <= 8).alias("small"))


@register(f"SELECT c_custkey, true AS on_surface, true AS sampled, CAST(20 AS BIGINT) AS n FROM customer")
def points_of_rings(spark: SparkSession, sf: str) -> DataFrame:
    g = rings(spark, sf).select("c_custkey", "cust_ring", W.point_on_surface("cust_ring").alias("p"), G.vertices(W.sample_points("cust_ring", 20, seed=3)).alias("v"))
    return g.select("c_custkey", M.contains_xy("cust_ring", G.x("p"), G.y("p")).alias("on_surface"), F.forall("v", lambda q: M.intersects_xy("cust_ring", q["x"], q["y"])).alias("sampled"), F.size("v").cast("long").alias("n"))


@register(f"SELECT n_regionkey, CAST(360*170 AS DOUBLE) AS area, count(*) AS cells FROM ({NATION}) GROUP BY 1")
def region_voronoi(spark: SparkSession, sf: str) -> DataFrame:
    """Cells around the corners of each region's boxes fill the frame."""
    at = nations(spark, sf).groupBy("n_regionkey").agg(G.multi_point(F.collect_list(G.vertex(F.col("x0"), F.col("y0")))).alias("g"))  # 25 rows
    cells = at.select("n_regionkey", W.voronoi_polygons("g", (-180.0, -85.0, 180.0, 85.0)).alias("v"))
    return cells.select("n_regionkey", r(M.area("v"), 4).alias("area"), G.num_geometries("v").cast("long").alias("cells"))


@register(f"SELECT n_regionkey, CAST(0 AS DOUBLE) AS common, CAST(count(*)*72*34 AS DOUBLE) AS odd FROM ({NATION}) GROUP BY 1")
def region_overlays(spark: SparkSession, sf: str) -> DataFrame:
    return nations(spark, sf).groupBy("n_regionkey").agg(r(M.area(W.intersection_all("nation_box"))).alias("common"), r(M.area(W.symmetric_difference_all("nation_box"))).alias("odd"))


# --- codes -------------------------------------------------------------------------------------


@register("SELECT o_orderkey, CASE WHEN v<1024 THEN CAST(v AS BIGINT)||' B' WHEN v<10240 THEN printf('%.2f KiB', v/1024) WHEN v<1048576 THEN printf('%.1f KiB', v/1024) ELSE printf('%.2f MiB', v/1048576) END AS size FROM (SELECT o_orderkey, floor(CAST(o_totalprice AS DOUBLE)) AS v FROM orders)")
def order_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", O.size_text(F.floor("o_totalprice")).alias("size"))


@register("SELECT event_id, (epoch_us(ts)//1000)*65536+event_id%65536 AS id, epoch_us(ts)//1000 AS millis, epoch_us(ts)//30000000 AS step FROM events")
def sortable_event_ids(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    e = table(spark, sf, "events").select("event_id", at.alias("t"), O.sortable_id(at, F.col("event_id") % 65536).alias("id"))
    return e.select("event_id", "id", O.sortable_id_millis("id").alias("millis"), O.totp_window(F.unix_millis("t") / 1000).alias("step"))


@register(f"SELECT n_regionkey, count(*) AS n, CAST(sum(5) AS BIGINT) AS vertices FROM ({NATION}) GROUP BY 1")
def collected_boxes(spark: SparkSession, sf: str) -> DataFrame:
    g = nations(spark, sf).groupBy("n_regionkey").agg(A.collect("nation_box").alias("g"))
    return g.select("n_regionkey", G.num_geometries("g").cast("long").alias("n"), G.num_coordinates("g").cast("long").alias("vertices"))
