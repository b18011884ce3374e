"""Covers of many polygons by large cells: the same cells as h3_cover finds, without a row a cell."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.functions import h3 as H
from meridia.operators import coarse, covers
from meridia.plans import hexagons


@pytest.fixture(scope="module")
def shapes(spark):
    """Polygons with holes and parts, over the seam and the pole, small and large, whole hemispheres, and missing and empty ones."""
    box, frame = G.box(-20.0, 30.0, 25.0, 62.0), lambda *v: F.array(*[G.vertex(x, y) for x, y in v])
    hole = G.polygon(frame((0, 0), (30, 0), (30, 30), (0, 30)), F.array(frame((5, 5), (5, 25), (25, 25), (25, 5))))
    many = G.multi_polygon(F.array(F.array(frame((170, -3), (180, -3), (180, 4), (170, 4))), F.array(frame((-180, -3), (-171, -3), (-171, 4), (-180, 4)))))
    all_ = [box, hole, many, G.box(-187.0, 10.0, -174.0, 20.0), G.box(-180.0, 80.0, 180.0, 92.0), G.box(13.3, 52.4, 13.4, 52.5), G.box(-180.0, -90.0, 0.0, 90.0), F.lit(None).cast(G.GEOMETRY), G.empty(3), G.polygon(frame((100, -40), (140, 5), (101, -38)))]
    df = None
    for i, g in enumerate(all_):
        row = spark.range(1).select(F.lit(i).alias("id"), F.lit(f"row {i}").alias("other name"), g.alias("g"))
        df = row if df is None else df.union(row)
    return df.repartition(4).cache()


@pytest.mark.parametrize("level", [0, 2, 3])
def test_sums_are_those_of_covers(spark, shapes, level, monkeypatch):
    cells = covers.saved(covers.h3_cover(shapes, "g", level).select("id", "cell"))
    areas = covers.saved(cells.select("cell").distinct().select("cell", H.h3_area("cell").alias("m2")))
    wanted = {r["id"]: (r["n"], r["m2"]) for r in cells.join(areas, "cell").groupBy("id").agg(F.count("*").alias("n"), F.sum("m2").alias("m2")).collect()}
    got = coarse.h3_cover_sums(shapes, "g", level)
    assert got.columns == ["id", "other name", "n", "m2"]
    rows = got.collect()
    assert {r["id"]: r["n"] for r in rows} == {k: v[0] for k, v in wanted.items()} and len(rows) == 8
    assert all(abs(r["m2"] / wanted[r["id"]][1] - 1) < 1e-9 and r["other name"] == f"row {r['id']}" for r in rows)
    # the same with few pairs at a time
    parts = shapes.select("id", G.parts("g").alias("p")).toArrow().combine_chunks()
    whole = coarse.cover_sums(parts.column("p").combine_chunks(), level)
    monkeypatch.setattr(coarse, "PAIRS", 7)
    few = coarse.cover_sums(parts.column("p").combine_chunks(), level)
    assert whole[0].tolist() == few[0].tolist() == [wanted.get(i, (0,))[0] for i in parts.column("id").to_pylist()] and whole[1].tolist() == few[1].tolist()


def test_only_polygons_and_coarse_levels(spark):
    with pytest.raises(ValueError):
        coarse.h3_cover_sums(spark.range(1).select(G.point(F.lit(1.0), F.lit(2.0)).alias("g")), "g", 4)
    with pytest.raises(Exception, match="polygons"):
        coarse.h3_cover_sums(spark.range(1).select(G.point(F.lit(1.0), F.lit(2.0)).alias("g")), "g", 2).collect()


def test_rings_of_many_customers_take_seconds(spark, tmp_path):
    """F2 of round 4: 1,500 customers took two minutes, and rounds wrote and shuffled a row a cell."""
    n = 20_000
    spark.range(n).select(F.col("id").alias("c_custkey"), F.lit(0).alias("c_nationkey"), F.lit(0.0).alias("c_acctbal")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    start = time.time()
    rows = hexagons.h3_ring_covers(spark, str(tmp_path)).collect()
    assert time.time() - start < 60
    assert n * 0.97 < len(rows) == len({r["c_custkey"] for r in rows}) < n and all(r["n"] > 0 and r["km2"] > 0 for r in rows)
