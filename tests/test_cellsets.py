"""Sets of cells by joins against plain Python sets of leaves."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from meridia.functions import h3
from meridia.operators import cellsets as K


def leaves(cells, depth=4):
    """Geohashes as the sets of their descendants of a length, over a short alphabet."""
    return {c + tail for c in cells for tail in _tails(depth - len(c))}


def _tails(n):
    return [""] if n <= 0 else [a + t for a in "0b" for t in _tails(n - 1)]


class Short(K.Levels):
    """Words over two letters: a grid of families of two, so that families are complete often."""

    def __init__(self):
        super().__init__(4, lambda c: F.length(c), lambda c, n: F.substring(c, F.lit(1), n), lambda c: F.transform(F.array(F.lit("0"), F.lit("b")), lambda k: F.concat(c, k)), lambda c: F.lit(2))


@pytest.mark.parametrize("seed", range(3))
def test_against_sets_of_leaves(spark, seed):
    rng, grid = random.Random(seed), Short()
    words = lambda: ["".join(rng.choice("0b") for _ in range(rng.randint(1, 4))) for _ in range(8)]
    sides = [{k: words() for k in ("p", "q")} for _ in range(2)]
    a, b = (spark.createDataFrame([(k, c) for k, v in s.items() for c in v] + [("p", None)], "k string, cell string") for s in sides)
    for made, how in ((K.union, set.union), (K.intersection, set.intersection), (K.difference, set.difference)):
        got = {}
        for r in made(a, b, ["k"], "cell", grid).collect():
            got.setdefault(r["k"], []).append(r["cell"])
        for k in ("p", "q"):
            want, found = how(leaves(sides[0][k]), leaves(sides[1][k])), got.get(k, [])
            assert leaves(found) == want and len(found) == len(set(found))
            assert not any(x != y and y.startswith(x) for x in found for y in found)  # none within another
            assert not any(c[:-1] + {"0": "b", "b": "0"}[c[-1]] in found for c in found if len(c) > 1)  # no complete family
    assert {r["cell"] for r in K.uncompact(a.where("k = 'p'"), ["k"], "cell", grid, 4).collect()} == leaves(sides[0]["p"])


def test_hexagons_with_five_neighbours_are_families_of_six(spark):
    five = h3.h3_pentagons(spark, 1).limit(1).withColumn("k", F.lit(1))
    small = K.uncompact(five, ["k"], "cell", K.H3, 3)
    assert small.count() == 41 and K.compact(small, ["k"], "cell", K.H3).select("cell").collect() == five.select("cell").collect()
    less = small.limit(40)
    assert K.difference(five, less, ["k"], "cell", K.H3).count() == 1 == K.difference(small, less, ["k"], "cell", K.H3).count()


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], "k int, cell long"), spark.createDataFrame([(1, 0x8928308280FFFFF)], "k int, cell long")
    assert K.union(none, none, ["k"], "cell", K.H3).count() == 0 and K.union(some, none, ["k"], "cell", K.H3).count() == 1
    assert K.intersection(some, none, ["k"], "cell", K.H3).count() == 0 and K.difference(none, some, ["k"], "cell", K.H3).count() == 0 and K.difference(some, none, ["k"], "cell", K.H3).count() == 1
