"""The index and coverages against all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import crs as S
from meridia.functions import geometry as G
from meridia.operators import aggregates as A
from meridia.operators.index import SpatialIndex


def boxes(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double").select("id", F.when(F.col("a").isNotNull(), G.box("a", "b", "c", "d")).alias("geometry"))


def test_index(spark):
    rows = [(i, float(i), 0.0, i + 1.5, 1.0) for i in range(6)] + [(9, None, None, None, None)]
    at = SpatialIndex(S.set_epoch(S.set_crs(boxes(spark, rows), "geometry", 3857), "geometry", 2020.0), handle="id")
    asked = spark.createDataFrame([(1, 2.2, 0.5), (2, 50.0, 50.0)], "q int, x double, y double").select("q", G.point("x", "y").alias("p"))
    assert at.crs.to_epsg() == 3857 and at.epoch == 2020
    assert {tuple(r) for r in at.query(asked, "p", "within").select("q", "handle").collect()} == {(1, 1), (1, 2)}
    assert at.candidates(asked, "p").count() == 2 and at.join(asked, "p", "intersects").count() == 2
    assert {r["handle"] for r in at.query(asked, "p", distance=1.0).collect()} == {0, 1, 2, 3}
    assert {tuple(r) for r in at.self_join("overlaps").collect()} == {(i, i + 1) for i in range(5)}
    assert at.nearest(asked, "q", "p", k=1).where("q = 2").first()["handle"] == 5
    more, new = at.insert(boxes(spark, [(1, 49.0, 49.0, 51.0, 51.0)]))
    got = new.first()["handle"]
    assert got > 5 and {r["handle"] for r in more.query(asked, "p").collect()} == {1, 2, got} and more.keys().count() == 7
    less = more.remove([1]).remove(spark.createDataFrame([(got,)], "handle long"))
    assert {r["handle"] for r in less.query(asked, "p").collect()} == {2} and less.get(1).count() == 0 and less.items().columns == ["handle", "indexed"] and less.values().count() == 5
    assert "Join" in at.explain(asked, "p") and at.bounds().first()["maxx"] == 6.5


def test_coverages(spark):
    good = boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0), (2, 1.0, 0.0, 2.0, 1.0), (3, 1.0, 1.0, 2.0, 2.0)])
    assert A.coverage_is_valid(good, "geometry", "id")
    over = boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0), (2, 0.5, 0.0, 2.0, 1.0)])
    assert not A.coverage_is_valid(over, "geometry", "id")
    half = boxes(spark, [(1, 0.0, 0.0, 1.0, 2.0), (2, 1.0, 0.0, 2.0, 1.0)])  # the second one's corner lies within the first one's edge
    found = {r["id"]: r["n"] for r in A.coverage_invalid_edges(half, "geometry", "id").select("id", G.num_geometries("edges").alias("n")).collect()}
    assert found == {1: 1, 2: 1}
