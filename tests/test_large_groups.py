"""Groups of points, families of cells and poles, by what must not grow with copies, levels or squares."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from meridia.functions import geodesy as D
from meridia.functions import kernels as K
from meridia.operators import joins as J


def test_hausdorff_of_groups_with_copies(spark):
    points = [(k % 3, (k * 37 % 101) / 7, (k * 53 % 97) / 5) for k in range(90)]
    want = {}
    for a in range(3):
        for b in range(a + 1, 3):
            p, q = [v[1:] for v in points if v[0] == a], [v[1:] for v in points if v[0] == b]
            want[a, b] = max(max(min(math.dist(u, v) for v in t) for u in s) for s, t in ((p, q), (q, p)))
    found = J.hausdorff_of_groups(spark.createDataFrame(points * 20, "l int, x double, y double"), "l", "x", "y").collect()
    assert {(r["a"], r["b"]): round(r["distance"], 9) for r in found} == {k: round(v, 9) for k, v in want.items()}


def test_pole_of_a_ring_with_a_hole():
    shell, hole = [(0, 0), (8, 0), (8, 4), (0, 4), (0, 0)], [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]
    x, y, d = K.pole([[shell, hole]], 1e-6)
    assert abs(d - 2) < 2e-6 and abs(x - 6) < 1.1 and abs(y - 2) < 1e-5


def test_bearings_keep_their_digits(spark):
    """Courses of the first half are not moved by a turn and back, which cost them digits."""
    rows = spark.range(2000).select((F.col("id") * 0.017).alias("x"), (F.col("id") * 0.011 - 11).alias("y"))
    over = F.radians(F.lit(40.0) - F.col("x"))
    t = F.degrees(F.atan2(F.sin(over) * F.cos(F.radians(F.lit(5.0))), F.cos(F.radians("y")) * F.sin(F.radians(F.lit(5.0))) - F.sin(F.radians("y")) * F.cos(F.radians(F.lit(5.0))) * F.cos(over)))
    assert rows.select(D.bearing("x", "y", F.lit(40.0), F.lit(5.0)).alias("b"), t.alias("t")).where("t >= 0 and b != t").count() == 0
