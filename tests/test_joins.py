"""Joins planned by cells and broadcasts against all pairs: small and world-sized boxes, a dense place, missing rows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.operators import joins as J


def boxes(spark, rows, p):
    df = spark.createDataFrame(rows, f"{p}id int, a double, b double, c double, d double")
    return df.select(f"{p}id", F.when(F.col("a").isNotNull(), G.box("a", "b", "c", "d")).alias(f"{p}g"))


def made(seed, n, big):
    rng, rows = random.Random(seed), []
    for i in range(n):
        x, y = (rng.gauss(5, 0.01), rng.gauss(5, 0.01)) if i % 3 == 0 else (rng.uniform(-90, 90), rng.uniform(-60, 60))  # a third in one dense place
        s = rng.choice((0.001, 0.01, 0.5, 4))
        rows.append((i, x, y, x + s, y + s))
    for k in range(big):
        rows.append((n + k, -100.0, -80.0 + k, 100.0, 80.0))
    return rows + [(n + big, None, None, None, None)]


@pytest.mark.parametrize("most", [0, 20_000])
@pytest.mark.parametrize("within", [0.0, 1.5])
def test_pairs_of_bounds(spark, most, within):
    left, right = made(1, 250, 2), made(2, 180, 1)
    got = J.candidates(boxes(spark, left, "l"), boxes(spark, right, "r"), "lg", "rg", within=within, most_broadcast=most).select("lid", "rid").collect()
    want = {(i, j) for i, a, b, c, d in left for j, e, f, g, h in right if None not in (a, e) and a - within <= g and e <= c + within and b - within <= h and f <= d + within}
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want


def test_world_boxes_have_few_cells(spark):
    l = J.with_bounds(boxes(spark, made(1, 250, 2), "l"), "lg", "l").where("l_minx is not null")
    size, widest = J.extents([(l, "l")], 0.0)
    top = max(0, math.ceil(math.log(widest / size, 4) - 1e-9))
    cells = l.withColumn("l_level", J._level("l", size, 0.0)).select(F.size(J._cells("l", size, 0.0, top)).alias("n"))
    assert cells.agg(F.max("n")).first()[0] <= 4 * (top + 1)


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("most", [0, 20_000])
def test_nearest_points(spark, ties, most):
    rng = random.Random(3)
    left, right = [(i, float(rng.randrange(30)), float(rng.randrange(30))) for i in range(60)], [(i, float(rng.randrange(30)), float(rng.randrange(30))) for i in range(40)]
    l = spark.createDataFrame([*left, (99, None, None)], "lid int, x double, y double").select("lid", G.point("x", "y").alias("lg"))
    r = spark.createDataFrame([*right, (99, None, None)], "rid int, x double, y double").select("rid", G.point("x", "y").alias("rg"))
    got = {(a, b, round(d, 9), k) for a, b, d, k in J.nearest(l, r, "lid", "rid", "lg", "rg", k=3, ties=ties, most_broadcast=most).collect()}
    want = set()
    for i, x, y in left:
        near = sorted((math.sqrt((u - x) ** 2 + (v - y) ** 2), j) for j, u, v in right)
        for place, (d, j) in enumerate(near):
            rank = 1 + sum(e < d for e, _ in near) if ties else place + 1
            if rank <= 3:
                want.add((i, j, round(d, 9), rank))
    assert got == want


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "rid int, x double, y double").select("rid", G.point("x", "y").alias("rg"))
    l = spark.createDataFrame([(1, 0.0, 0.0)], "lid int, x double, y double").select("lid", G.point("x", "y").alias("lg"))
    assert J.nearest(l, none, "lid", "rid", "lg", "rg").count() == 0
    assert J.spatial_join(l, none, "intersects", "lg", "rg").count() == 0
    assert J.spatial_join(l, none, "intersects", "lg", "rg", how="anti").count() == 1


def test_semi_and_anti_by_cells(spark):
    """Each left row once, whichever of its cells has matches, by cells as by broadcast."""
    left = spark.range(400).select("id", F.rand(1).alias("x"), F.rand(2).alias("y")).select("id", G.point(F.col("x") * 20, F.col("y") * 20).alias("g"))
    right = spark.range(60).select(F.col("id").alias("rid"), G.point(F.rand(3) * 20, F.rand(4) * 20).alias("h"))
    left, right = (spark.createDataFrame(t.collect(), t.schema) for t in (left, right))
    at = lambda t: {r[0]: (r[1]["parts"][0][0][0]["x"], r[1]["parts"][0][0][0]["y"]) for r in t.collect()}
    near = {i for i, p in at(left).items() if any((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= 1 for q in at(right).values())}
    for most in (0, 20_000):
        found = [J.dwithin_join(left, right, 1.0, "g", "h", how=how, most_broadcast=most) for how in ("semi", "anti")]
        ids = [sorted(r["id"] for r in f.collect()) for f in found]
        assert ids[0] == sorted(near) and ids[1] == sorted(set(range(400)) - near)
    plan = found[0]._jdf.queryExecution().toString() if hasattr(found[0], "_jdf") else ""
    assert "transform" not in plan.split("== Physical Plan ==")[-1].split("Scan parquet")[0]  # distances of points come from columns
