"""Files and tables that other readers accept, and ordinates put in and taken out."""

from __future__ import annotations

import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from meridia.functions import crs as S
from meridia.functions import geometry as G
from meridia.sources import files as I


def table(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, -4.0, 5.0), (3, None, None)], "id int, x double, y double")
    return df.select("id", F.when(F.col("id") == 2, G.box(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 2)).otherwise(G.point("x", "y")).alias("geometry"))


def test_geoparquet_footer(spark, tmp_path):
    path = str(tmp_path / "g")
    I.write_geoparquet(S.set_epoch(S.set_crs(table(spark).repartition(2), "geometry", 4326), "geometry", 2020.0), path)
    names = [p for p in (tmp_path / "g").iterdir() if p.suffix == ".parquet"]
    assert names
    for p in names:
        geo = json.loads(pq.read_schema(p).metadata[b"geo"])
        c = geo["columns"]["geometry"]
        assert geo["version"] == "1.1.0" and geo["primary_column"] == "geometry" and c["encoding"] == "WKB" and c["geometry_types"] == ["Point", "Polygon"]
        assert c["bbox"] == [-4, 3, 2, 7] and c["crs"]["id"] == {"authority": "EPSG", "code": 4326} and c["epoch"] == 2020
    back = I.read_geoparquet(spark, path)
    assert sorted((r["id"], r["n"]) for r in back.select("id", G.num_coordinates("geometry").alias("n")).where("n > 0").collect()) == [(1, 1), (2, 5)] and back.count() == 3
    assert I.read_geoparquet(spark, path, bbox=(1, 1, 3, 4)).select("id").collect()[0][0] == 1


def test_tables(spark):
    df = S.set_crs(table(spark), "geometry", 3857)
    arrow = I.to_arrow(df)
    assert S.crs_of(I.from_arrow(spark, arrow)).to_epsg() == 3857
    assert I.from_pandas(spark, I.to_pandas(df)).where(G.num_coordinates("geometry") == 5).count() == 1
    assert [x is None for x in I.to_numpy(df)] == [False, False, True]
    whole = json.loads(df.agg(I.to_feature_collection(df, id="id")).first()[0])
    assert whole["type"] == "FeatureCollection" and len(whole["features"]) == 3 and whole["features"][0]["geometry"]["type"] == "Point"
    back = I.from_features(spark, whole["features"] + [{"type": "Feature", "geometry": None, "properties": {"a": 1}}]).collect()
    assert len(back) == 4 and back[3]["properties"] == {"a": "1"} and back[3]["geometry"] is None


def test_ordinates(spark):
    df = table(spark)
    rows = df.select("id", G.coordinate_axes("geometry").alias("a"), G.nbytes("geometry").alias("n"), G.is_missing("geometry").alias("miss"), G.is_empty(G.fill_missing("geometry", G.empty(G.POINT))).alias("fill"), G.coordinate_axes(G.set_z("geometry", 4)).alias("z"), G.bounds_3d(G.set_z("geometry", 4)).alias("b"), G.coordinates("geometry", "XYZ").alias("c")).orderBy("id").collect()
    assert [(r["a"], r["n"], r["miss"], r["fill"], r["z"]) for r in rows] == [("XY", 16, False, False, "XYZ"), ("XY", 80, False, False, "XYZ"), (None, None, True, True, None)]
    assert rows[0]["b"]["minz"] == rows[0]["b"]["maxz"] == 4 and rows[0]["c"][0][:2] == [2, 3]
    moved = df.where("id < 3").select("id", G.set_coordinates("geometry", F.transform(G.coordinates("geometry"), lambda v: F.array(v[0] + 10, v[1]))).alias("g"))
    assert [(r["b"]["minx"], r["b"]["maxy"]) for r in moved.select("id", G.bounds("g").alias("b")).orderBy("id").collect()] == [(12, 3), (6, 7)]
    with pytest.raises(Exception):
        df.select(G.set_coordinates("geometry", F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(2.0))))).collect()
    line = spark.range(1).select(G.line_string(F.array(G.vertex(170, 0), G.vertex(-170, 1))).alias("g"), G.line_string(F.array(G.vertex(0, 0), G.vertex(90, 1))).alias("h"))
    assert line.select(G.crosses_antimeridian("g").alias("a"), G.crosses_antimeridian("h").alias("b")).first()[:] == (True, False)
