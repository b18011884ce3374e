"""Triangles of polygons with holes and parts; joins of boxes and points; ids without clashes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from meridia.functions import codes as O
from meridia.functions import geometry as G
from meridia.functions import kernels as K
from meridia.functions import measures as M
from meridia.functions import pairwise as D
from meridia.operators import joins as J


def area(r):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))) / 2


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]


@pytest.mark.parametrize("holes", [[square(1, 1, 1)], [square(1, 1, 1), square(2.5, 2.5, 1)], [square(1, 1, 0.5), square(2, 1.1, 0.5), square(3, 1.2, 0.5), square(1, 3, 0.5)], [square(1, 1, 1)[::-1]]])
def test_holes_are_left_out(holes):
    t = K.ear_triangles(K.bridged([square(0, 0, 4), *holes]))
    assert sum(map(area, t)) == pytest.approx(16 - sum(map(area, holes)))
    for x in t:  # no triangle has its middle in a hole
        cx, cy = sum(p[0] for p in x[:3]) / 3, sum(p[1] for p in x[:3]) / 3
        assert not any(min(p[0] for p in h) < cx < max(p[0] for p in h) and min(p[1] for p in h) < cy < max(p[1] for p in h) for h in holes)


def test_all_parts(spark):
    one = lambda x: F.array(F.array(*[G.vertex(float(a), float(b)) for a, b in square(x, 0, 1)]))
    t = spark.range(1).select(K.triangulate(G.multi_polygon(F.array(one(0), one(5), one(9)))).alias("t")).select(M.area("t"), G.num_geometries("t")).first()
    assert tuple(t) == (3.0, 6)


def test_boxes_and_points(spark):
    rng = random.Random(5)
    points = spark.createDataFrame([(i, float(rng.randint(0, 6)), float(rng.randint(0, 6))) for i in range(60)], "p int, x double, y double").withColumn("pt", G.point(F.col("x"), F.col("y")))
    boxes = spark.createDataFrame([(i, float(i % 4), float(i // 4)) for i in range(12)], "b int, u double, v double").withColumn("box", G.box(F.col("u"), F.col("v"), F.col("u") + 2, F.col("v") + 2))
    for predicate in ("contains", "covers", "intersects", "touches", "within"):
        known = {(r["b"], r["p"]) for r in J.spatial_join(boxes, points, predicate, "box", "pt", left_kind="box", right_kind="point").collect()}
        assert known == {(r["b"], r["p"]) for r in J.spatial_join(boxes, points, predicate, "box", "pt").collect()}, predicate
    for predicate in ("within", "covered_by", "intersects", "touches", "contains"):
        known = {(r["b"], r["p"]) for r in J.spatial_join(points, boxes, predicate, "pt", "box", left_kind="point", right_kind="box").collect()}
        assert known == {(r["b"], r["p"]) for r in J.spatial_join(points, boxes, predicate, "pt", "box").collect()}, predicate


def test_nearest_places_in_columns(spark):
    line = G.line_string(F.array(G.vertex(0.0, 0.0), G.vertex(4.0, 0.0), G.vertex(4.0, 4.0)))
    rows = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (-1.0, -1.0), (3.0, 2.0)], "x double, y double").select("*", G.point(F.col("x"), F.col("y")).alias("p"), line.alias("g"), G.box(0.0, 0.0, 2.0, 2.0).alias("b"))
    for other in ("g", "b"):
        both = rows.select(M.length(D.shortest_line("p", other)).alias("u"), M.length(D.shortest_line("p", other, left_kind="point")).alias("v")).collect()
        assert all(r["u"] == pytest.approx(r["v"]) for r in both)
    none = spark.range(1).select(G.empty(G.POINT).alias("p"), line.alias("g")).select(D.shortest_line("p", "g", left_kind="point")).first()
    assert none[0] is None


def test_ids_have_no_gaps_and_keep_their_moment(spark):
    df = spark.range(1000).repartition(7)
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    ids = sorted(r[0] for r in O.sortable_ids(df, "i", at).select("i").collect())
    later = min(r[0] for r in O.sortable_ids(df, "i", at + F.expr("interval 1 second")).select("i").collect())
    assert ids == list(range(ids[0], ids[0] + 1000)) and later > ids[-1]
    assert O.sortable_ids(df.limit(0), "i").count() == 0
