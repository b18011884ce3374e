"""Unions of coverages against counts over grids of squares, with holes, islands in holes and touching corners."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.functions import kernels as K
from meridia.functions import measures as M
from meridia.operators.outlines import coverage_union


def union(spark, cells, by=("k",)):
    df = spark.createDataFrame(cells, "k int, x double, y double").select("k", G.box(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1).alias("g"))
    return coverage_union(df, "g", list(by))


def parts_of(cells):
    left, n = set(cells), 0
    while left:
        n, todo = n + 1, [left.pop()]
        while todo:
            x, y = todo.pop()
            for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if p in left:
                    left.discard(p)
                    todo.append(p)
    return n


@pytest.mark.parametrize("seed", range(3))
def test_random_squares(spark, seed):
    rng = random.Random(seed)
    grids = {k: {(x, y) for x in range(8) for y in range(8) if rng.random() < 0.6} for k in (1, 2)}
    out = union(spark, [(k, float(x), float(y)) for k, v in grids.items() for x, y in v]).select("k", M.area("g").alias("area"), M.perimeter("g").alias("around"), K.is_valid("g").alias("valid")).collect()
    for k, cells in grids.items():
        mine = [r for r in out if r["k"] == k]
        outline = sum(p not in cells for x, y in cells for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)))
        assert sum(r["area"] for r in mine) == len(cells) and sum(r["around"] for r in mine) == outline
        assert len(mine) == parts_of(cells) and all(r["valid"] for r in mine)


def test_an_island_in_a_hole(spark):
    ring = [(1, float(x), float(y)) for x in range(5) for y in range(5) if x in (0, 4) or y in (0, 4)]
    out = union(spark, [*ring, (1, 2.0, 2.0)]).select(M.area("g").alias("a"), F.size(G.rings("g")).alias("n")).collect()
    assert sorted(map(tuple, out)) == [(1.0, 1), (16.0, 2)]


def test_without_groups_and_with_nothing(spark):
    assert union(spark, [(1, 0.0, 0.0), (2, 1.0, 0.0)], by=()).select(M.area("g")).collect()[0][0] == 2
    assert union(spark, []).count() == 0
    df = spark.range(2).select(F.lit(1).alias("k"), F.lit(None).cast(G.GEOMETRY).alias("g"))
    assert coverage_union(df, "g", ["k"]).count() == 0
