"""Reference systems: published sample points, properties of projections, round trips, and columns that carry systems."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.functions import crs as S
from meridia.functions import geometry as G

PROJECTED = (3857, 3395, 3035, 3034, 5070, 3577, 32632, 32733, 25831, 26918)


def inside(code, n=40):
    w, s, e, h = S.crs(code).area
    rng = np.random.default_rng(code)
    return rng.uniform(max(w, -179), min(e, 179), n), rng.uniform(s, min(h, 84), n)


def test_sample_points():
    #: Points of the registry's guidance notes.
    assert np.allclose(S.transform(4258, 3035, 5.0, 50.0), (3962799.45, 2999718.85), atol=0.01)
    assert np.allclose(S.transform(4326, 3857, -100.33333333, 24.38178694), (-11169055.58, 2800000.0), atol=0.01)
    assert np.allclose(S.transform(4979, 4978, 2 + 7 / 60 + 46.38 / 3600, 53 + 48 / 60 + 33.82 / 3600, 73.0), (3771793.968, 140253.342, 5124304.349), atol=0.001)


@pytest.mark.parametrize("code", PROJECTED)
def test_round_trip_and_kind_of_projection(code):
    lon, lat = inside(code)
    assert S.roundtrip(4326, code, lon, lat).max() < 1e-8
    f = S.crs(code).factors(lon, lat)
    if S.crs(code).method in ("laea", "aea"):
        assert np.allclose(f["areal_scale"], 1, atol=1e-6)
    elif code != 3857:
        assert np.allclose(f["meridional_scale"], f["parallel_scale"], rtol=1e-6) and f["angular_distortion"].max() < 1e-2


def test_scale_at_standard_lines():
    assert S.crs(3034).factors(20.0, 35.0)["parallel_scale"] == pytest.approx(1, abs=1e-6)
    assert S.crs(5070).factors(-90.0, 45.5)["parallel_scale"] == pytest.approx(1, abs=1e-6)
    assert S.crs(32632).factors(9.0, 50.0)["meridional_scale"] == pytest.approx(0.9996, abs=1e-6)


def test_columns_as_arrays(spark):
    for code in (*PROJECTED, 4978):
        lon, lat = inside(code) if code != 4978 else inside(4326)
        df = spark.createDataFrame(list(zip(lon.tolist(), lat.tolist())), "x double, y double")
        rows = df.select("x", "y", S.transform_columns(4326, code, "x", "y").alias("p")).select("x", "y", "p", S.transform_columns(code, 4326, "p.x", "p.y", "p.z").alias("q")).collect()
        want = S.transform(4326, code, [r["x"] for r in rows], [r["y"] for r in rows], np.zeros(len(rows)))
        assert np.allclose([(r["p"]["x"], r["p"]["y"], r["p"]["z"]) for r in rows], np.stack(want, 1), atol=1e-6)
        assert np.allclose([(r["q"]["x"], r["q"]["y"]) for r in rows], [(r["x"], r["y"]) for r in rows], atol=1e-9)


def test_columns_carry_systems(spark, tmp_path):
    df = spark.createDataFrame([(1, 9.0, 48.0), (2, None, None)], "id int, x double, y double").select("id", G.point("x", "y", m=F.lit(7)).alias("geometry"))
    with pytest.raises(ValueError):
        S.to_crs(df, "geometry", 3857)
    at = S.set_epoch(S.set_crs(df, "geometry", "EPSG:4326"), "geometry", 2020.5)
    assert S.crs_of(at).to_epsg() == 4326 and S.epoch_of(at) == 2020.5
    with pytest.raises(ValueError):
        S.set_crs(at, "geometry", 3857)
    moved = S.to_crs(at, "geometry", 32632)
    assert S.crs_of(moved).canonical == "EPSG:32632" and S.epoch_of(moved) == 2020.5
    row = moved.select("id", G.x("geometry").alias("x"), G.y("geometry").alias("y"), G.m("geometry").alias("m"), G.z("geometry").alias("z")).orderBy("id").collect()
    assert row[0]["x"] == pytest.approx(500000) and row[0]["m"] == 7 and row[0]["z"] is None and row[1]["x"] is None
    moved.write.parquet(str(tmp_path / "g"))
    assert S.crs_of(spark.read.parquet(str(tmp_path / "g"))).canonical == "EPSG:32632"


def test_registry():
    assert S.crs("urn:ogc:def:crs:EPSG::4326") == S.crs(4326) == S.crs("WGS 84")
    for code in (*PROJECTED, 4326, 4978):
        c = S.crs(code)
        assert S.crs(c.to_projjson()) == c and S.crs(c.to_wkt()) == c and c.to_epsg() == code and c.info["name"] == c.name
        assert c.to_proj().startswith("+proj=") and c.to_cf()["grid_mapping_name"]
    assert S.crs(4326).axis_order == ["lat", "lon"] and S.crs("OGC:CRS84").axis_order == ["lon", "lat"]
    assert S.crs("OGC:CRS84").same_as(4326) and not S.crs("OGC:CRS84").same_as(4326, mode="strict")
    assert S.crs(4326).to_3d().kind == "geographic_3d" and S.crs(4979).to_2d() == S.crs(4326)
    assert [c.code for c in S.utm_zones(datum_name="WGS 84", area=(9, 48, 10, 49))] == ["32632"]
    assert S.search("laea")[0].code == "3035" and "3857" in S.codes("EPSG", kind="projected") and S.authorities() == ["EPSG", "OGC"]
    assert S.unit("EPSG", 9002)["factor"] == 0.3048 and len(S.units(category="angular")) == 2
    assert S.crs(4326).operation(32632)["steps"] == ["WGS 84 / UTM zone 32N"] and S.crs(4326).operation(3035)["ballpark"]
    with pytest.raises(ValueError):
        S.crs("EPSG:1")


def test_bounds_and_zones(spark):
    a = S.transform_bounds(4326, 3035, (5, 45, 15, 55))
    lon, lat = np.meshgrid(np.linspace(5, 15, 60), np.linspace(45, 55, 60))
    x, y = S.transform(4326, 3035, lon.ravel(), lat.ravel())
    assert a[0] <= x.min() + 1 and a[1] <= y.min() + 200 and a[2] >= x.max() - 1 and a[3] >= y.max() - 200
    df = spark.createDataFrame([(9.0, 48.0, 32632), (5.0, 60.0, 32632), (10.0, 78.0, 32633), (8.0, 78.0, 32631), (-70.0, -33.0, 32719), (181.0, 1.0, 32601)], "x double, y double, want int")
    assert df.where(S.local_utm("x", "y") != F.col("want")).count() == 0
