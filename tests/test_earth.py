"""Lengths and areas on the ellipsoid, and geometries over the 180th meridian."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.functions import antimeridian as S
from meridia.functions import codecs as X
from meridia.functions import geodesy as D
from meridia.functions import geometry as G
from meridia.functions import measures as M
from meridia.plans.earth import ON_EARTH, geodesic_ring_areas
from meridia.plans.tables import rings


def v(*points):
    return F.array(*[G.vertex(float(x), float(y)) for x, y in points])


def ring(*points):
    return G.polygon(v(*points, points[0]))


def table(spark, **shapes):
    out = None
    for name, g in shapes.items():
        row = spark.range(1).select(F.lit(name).alias("name"), g.alias("g"))
        out = row if out is None else out.union(row)
    return spark.createDataFrame(out.collect(), out.schema)


def test_areas(spark):
    got = {r["name"]: r["a"] for r in table(
        spark, degree=ring((0, 0), (1, 0), (1, 1), (0, 1)), octant=ring((0, 0), (90, 0), (0, 90)), half=ring((0, 0), (90, 0), (180, 0), (-90, 0)), seam=ring((179, 0), (-179, 0), (-179, 1), (179, 1)), plain=ring((-1, 0), (1, 0), (1, 1), (-1, 1)),
        hole=G.polygon(v((0, 0), (3, 0), (3, 3), (0, 3), (0, 0)), F.array(v((1, 1), (2, 1), (2, 2), (1, 2), (1, 1)))), outer=ring((0, 0), (3, 0), (3, 3), (0, 3)), inner=ring((1, 1), (2, 1), (2, 2), (1, 2)), line=G.line_string(v((0, 0), (1, 1))),
    ).select("name", D.geodesic_area("g").alias("a")).collect()}
    earth = 510065621724088.44  # of WGS 84
    assert got["octant"] == pytest.approx(earth / 8, rel=1e-12) and got["half"] == pytest.approx(earth / 2, rel=1e-12)
    assert got["degree"] == pytest.approx(12308778361.469452, rel=1e-6) and got["seam"] == pytest.approx(got["plain"], rel=1e-12)
    assert got["hole"] == pytest.approx(got["outer"] - got["inner"], rel=1e-12) and got["line"] == 0


def summed(k: int) -> float:
    """Area of the ring around customer k, by the terms of the query's SQL."""
    e2, lon, lat, r, n = D.FLAT * (2 - D.FLAT), k * 7919 % 36000 / 100 - 180, k * 6971 % 17000 / 100 - 85, 1 + k % 7, 4 + k % 9
    corners = [(math.radians(lon + r * math.cos(2 * math.pi * (i % n) / n)), math.atan((1 - D.FLAT) * math.tan(math.radians(lat + r * math.sin(2 * math.pi * (i % n) / n))))) for i in range(n + 1)]
    out = 0.0
    for (l1, b1), (l2, b2) in zip(corners, corners[1:]):
        d = 2 * math.asin(math.sqrt(math.sin((b2 - b1) / 2) ** 2 + math.cos(b1) * math.cos(b2) * math.sin((l2 - l1) / 2) ** 2))
        at = []
        for i in range(129):
            u, w = math.sin((1 - i / 128) * d) / math.sin(d), math.sin(i / 128 * d) / math.sin(d)
            x, y, z = u * math.cos(b1) * math.cos(l1) + w * math.cos(b2) * math.cos(l2), u * math.cos(b1) * math.sin(l1) + w * math.cos(b2) * math.sin(l2), u * math.sin(b1) + w * math.sin(b2)
            s = math.sin(math.atan(math.tan(math.asin(z)) / (1 - D.FLAT)))
            at.append((math.atan2(y, x), D.A**2 * (1 - e2) / 2 * (s / (1 - e2 * s * s) + math.atanh(e2**0.5 * s) / e2**0.5)))
        for a, b, c in zip(at[::2], at[1::2], at[2::2]):
            out += (c[0] - a[0] - 2 * math.pi * round((c[0] - a[0]) / (2 * math.pi))) * (a[1] + 4 * b[1] + c[1]) / 6
    return abs(out)


def test_areas_of_rings_have_no_error_that_rounding_shows(spark, tmp_path):
    keys = [*range(1, 12), 1938, 14474, 27747, 48450, 49062, 49853, 57483]  # the last ones came out a thousand too high
    spark.createDataFrame([(k, 1, 0.0) for k in keys], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    ringed = {r["c_custkey"]: r["a"] for r in rings(spark, str(tmp_path)).where(ON_EARTH).select("c_custkey", D.geodesic_area("cust_ring").alias("a")).collect()}
    assert len(ringed) > 12 and all(a == pytest.approx(summed(k), rel=1e-11) for k, a in ringed.items())
    got = {r["c_custkey"]: r["thousand_km2"] for r in geodesic_ring_areas(spark, str(tmp_path)).collect()}
    assert got == {k: round(summed(k) / 1e9) for k in ringed}


def test_areas_over_a_pole(spark):
    earth = 510065621724088.44
    shapes = table(spark, over=ring((0, 0), (90, 0), (180, 0), (180, 80), (0, 80)), south=ring((0, 0), (0, -90), (90, 0)), around=ring((0, 0), (120, 0), (-120, 0)), many=G.multi_polygon(F.array(F.array(v((0, 0), (90, 0), (0, 90), (0, 0))), F.array(v((0, 0), (0, -90), (90, 0), (0, 0))))), none=G.empty(G.POLYGON))
    got = {r["name"]: r["a"] for r in shapes.select("name", D.geodesic_area("g").alias("a")).collect()}
    assert got["over"] == pytest.approx(earth / 4, rel=1e-9) and got["south"] == pytest.approx(earth / 8, rel=1e-12) and got["around"] == pytest.approx(earth / 2, rel=1e-12)
    assert got["many"] == pytest.approx(earth / 4, rel=1e-12) and got["none"] == 0


def test_lengths(spark):
    rng = np.random.default_rng(0)
    a = np.stack([rng.uniform(-180, 180, 300), rng.uniform(-89, 89, 300), rng.uniform(-180, 180, 300), rng.uniform(-89, 89, 300)], 1)
    rows = spark.createDataFrame(a.tolist(), "a double, b double, c double, d double").select("*", D.geodesic_length(G.line_string(F.array(G.vertex(F.col("a"), F.col("b")), G.vertex(F.col("c"), F.col("d"))))).alias("m")).collect()
    want = {tuple(x): y for x, y in zip(a.tolist(), D.inverse(*a.T)[0])}
    known = [r for r in rows if r["m"] is not None]
    assert len(known) > 290 and all(r["m"] == pytest.approx(want[r["a"], r["b"], r["c"], r["d"]], rel=1e-9) for r in known)
    same, square = spark.range(1).select(D.geodesic_length(G.line_string(v((1, 1), (1, 1)))), D.geodesic_perimeter(ring((0, 0), (1, 0), (1, 1), (0, 1)), 1000.0)).first()
    assert same == 0 and square == pytest.approx(443.770917, rel=1e-6)


CASES = {
    "line": (lambda: G.line_string(v((170, 0), (-170, 10), (-160, 10), (175, 0))), "MULTILINESTRING ((170 0, 180 5), (-180 5, -170 10, -160 10, -180 2), (180 2, 175 0))"),
    "plain": (lambda: ring((0, 0), (1, 0), (1, 1)), "POLYGON ((0 0, 1 0, 1 1, 0 0))"),
    "point": (lambda: G.point(F.lit(190.0), F.lit(5.0)), "POINT (-170 5)"),
}


def test_lines_and_points_are_cut(spark):
    got = {r["name"]: r["w"] for r in table(spark, **{k: f() for k, (f, _) in CASES.items()}).select("name", X.to_wkt(S.split_antimeridian("g")).alias("w")).collect()}
    assert got == {k: w for k, (_, w) in CASES.items()}


def test_polygons_are_cut(spark):
    shapes = table(
        spark, box=ring((170, -10), (-170, -10), (-170, 10), (170, 10)), clock=ring((170, 10), (-170, 10), (-170, -10), (170, -10)), north=ring((0, 60), (90, 60), (180, 60), (-90, 60)), south=ring((-90, -60), (180, -70), (90, -60), (0, -60)),
        cee=ring((170, -20), (-170, -20), (-170, -10), (175, -10), (175, 10), (-170, 10), (-170, 20), (170, 20)),
        hole=G.polygon(v((170, -10), (-170, -10), (-170, 10), (170, 10), (170, -10)), F.array(v((175, -5), (-175, -5), (-175, 5), (175, 5), (175, -5)), v((171, -1), (171, 1), (172, 1), (171, -1)))),
    )
    cut = shapes.select("name", F.explode(F.array(S.split_antimeridian("g"))).alias("s")).select("name", M.area("s").alias("area"), G.num_geometries("s").alias("n"), G.bounds("s").alias("b")).collect()
    got = {r["name"]: (round(r["area"], 6), r["n"]) for r in cut}
    assert got == {"box": (400, 2), "clock": (400, 2), "north": (10800, 1), "south": (9900, 1), "cee": (500, 3), "hole": (299, 2)}
    assert all(-180 <= r["b"]["minx"] and r["b"]["maxx"] <= 180 for r in cut)


def test_missing_and_empty_ones_stay(spark):
    row = spark.range(1).select(S.split_antimeridian(F.lit(None).cast(G.GEOMETRY)), G.is_empty(S.split_antimeridian(G.empty(G.POLYGON)))).first()
    assert row[0] is None and row[1]


def test_rings_of_any_shape_keep_their_area(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        a = np.sort(rng.uniform(0, 2 * math.pi, 12))
        if np.diff(np.append(a, a[0] + 2 * math.pi)).max() > math.pi * 0.9:
            continue
        radius = rng.uniform(1, 15, 12)
        rows.append((i, [(float(178 + i % 5 + r * math.cos(t)), float(r * math.sin(t))) for t, r in zip(a, radius)]))
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in p]) for i, p in rows], "i int, p array<struct<x:double,y:double>>")
    df = df.select("i", G.polygon(F.transform(F.concat("p", F.slice("p", 1, 1)), lambda k: G.vertex(k["x"], k["y"]))).alias("g"))
    out = df.select("i", M.area("g").alias("a"), F.explode(F.array(S.split_antimeridian("g"))).alias("s")).select("i", "a", M.area("s").alias("b")).collect()
    assert len(out) > 20 and all(r["b"] == pytest.approx(r["a"], rel=1e-9) for r in out)
