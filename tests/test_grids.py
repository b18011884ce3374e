"""Cells, covers and cell sets against known values, plain Python and each other."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.functions import cells as C
from meridia.functions import geometry as G
from meridia.functions import grids as R


def points(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = [(rng.uniform(-180, 180), rng.uniform(-89.9, 89.9)) for _ in range(n)] + [(0.0, 0.0), (180.0, 0.0), (-180.0, 45.0), (12.0, 90.0), (45.0, 35.264)]
    return spark.createDataFrame(rows, "x double, y double")


def test_known_cell(spark):
    #: A sample cell of the grid's own description.
    row = spark.range(1).select(R.s2_token(R.s2_cell(F.lit(11.770681595), F.lit(49.703498679))).alias("t"), R.s2_cell(F.lit(11.770681595), F.lit(49.703498679)).alias("c")).first()
    assert row["t"] == "47a1cbd595522b39"
    assert row["c"] & (1 << 64) - 1 == 0x47A1CBD595522B39


def test_cells_hold_their_points(spark):
    df = points(spark).withColumn("c", R.s2_cell("x", "y", 12)).withColumn("leaf", R.s2_cell("x", "y"))
    df = df.select("*", R.s2_level("c").alias("level"), R.s2_center("leaf").alias("p"), R.s2_children("c").alias("k"), R.s2_parent("leaf", 12).alias("up"), R.s2_from_token(R.s2_token("c")).alias("back"), R.s2_contains("c", "leaf").alias("holds"), R.s2_center("c").alias("mid"))
    for r in df.collect():
        assert r["level"] == 12 and r["up"] == r["c"] == r["back"] and r["holds"]
        far = lambda a, b, x, y: np.linalg.norm(np.array([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)]) - np.array([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)]))
        at = np.radians([r["p"]["lon"], r["p"]["lat"], r["x"], r["y"]])
        assert far(*at) < 1e-8
        assert len(set(r["k"])) == 4
        assert far(*np.radians([r["mid"]["lon"], r["mid"]["lat"], r["x"], r["y"]])) < 1e-3
    again = df.select("c", F.explode("k").alias("k")).select("c", R.s2_parent("k", 12).alias("up"), R.s2_contains("c", "k").alias("holds"), R.s2_contains("k", "c").alias("not"))
    assert again.where("c <> up or not holds or not").count() == 0


def test_areas_and_neighbors(spark):
    whole = spark.range(1).select(F.explode(F.array(*[F.lit(f).cast("long") * 0 + ((2 * f + 1) << 60 if (2 * f + 1) << 60 < 1 << 63 else ((2 * f + 1) << 60) - (1 << 64)) for f in range(6)])).alias("c"))
    two = whole.select(F.explode(R.s2_children("c")).alias("c")).select(F.explode(R.s2_children("c")).alias("c"))
    area = two.select(F.sum(R.s2_area("c"))).first()[0]
    assert area == pytest.approx(4 * np.pi * R.RADIUS**2, rel=1e-9)
    near = two.select("c", F.explode(R.s2_neighbors("c")).alias("n"))
    assert two.count() == 96 and near.count() == 384 and near.distinct().count() == 384
    # neighbours of each other, and cells of the table
    assert near.join(near.selectExpr("n as c", "c as n"), ["c", "n"]).count() == 384
    assert near.select("n").join(two.selectExpr("c as n"), "n", "left_semi").count() == 384


def test_covers(spark):
    rows = [("tri", [(1.0, 1.0), (9.0, 2.0), (4.0, 8.0), (1.0, 1.0)]), ("thin", [(-3.0, -3.0), (20.0, -2.9), (20.0, -2.8), (-3.0, -3.0)])]
    df = spark.createDataFrame([(n, [{"x": x, "y": y, "z": None, "m": None} for x, y in r]) for n, r in rows], f"n string, r array<{G.VERTEX}>").select("n", G.polygon("r").alias("g"))

    def inside(p, ring):
        out = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > p[1]) != (by > p[1]) and p[0] < ax + (p[1] - ay) / (by - ay) * (bx - ax):
                out = not out
        return out

    for cover, bounds in ((lambda rule: R.geohash_cover("g", 3, rule=rule), lambda c: C.geohash_bounds(c)), (lambda rule: R.tile_cover("g", 7, rule=rule), lambda c: G.bounds(R.tile_polygon(c)))):
        found = {}
        for rule in ("bbox", "overlap", "center", "within"):
            for r in df.select("n", F.explode(cover(rule)).alias("c")).select("n", "c", bounds(F.col("c")).alias("b")).collect():
                found.setdefault((r["n"], rule), {})[r["c"]] = tuple(r["b"])
        for n, ring in rows:
            every = found[n, "bbox"]
            assert set(found.get((n, "within"), {})) <= set(found.get((n, "center"), {})) <= set(found[n, "overlap"]) <= set(every)
            for c, (x0, y0, x1, y1) in every.items():
                grid = [(x0 + (x1 - x0) * i / 12, y0 + (y1 - y0) * j / 12) for i in range(13) for j in range(13)]
                hits = [inside(p, ring) for p in grid]
                if any(hits):
                    assert c in found[n, "overlap"]
                if all(hits):
                    assert c in found[n, "within"]
                elif c in found.get((n, "within"), {}):
                    assert all(inside((x * 0.998 + 0.001 * (x0 + x1), y * 0.998 + 0.001 * (y0 + y1)), ring) for x, y in grid)
                assert (c in found.get((n, "center"), {})) == inside(((x0 + x1) / 2, (y0 + y1) / 2), ring)
            edge = [(ax + (bx - ax) * k / 500, ay + (by - ay) * k / 500) for (ax, ay), (bx, by) in zip(ring, ring[1:]) for k in range(501)]
            met = {c for c, (x0, y0, x1, y1) in every.items() if any(x0 <= x <= x1 and y0 <= y <= y1 for x, y in edge)}
            assert met <= set(found[n, "overlap"])


def test_bounding_cells(spark):
    df = spark.createDataFrame([(8.1, 47.1, 8.2, 47.2), (-1.0, -1.0, 1.0, 1.0), (10.0, 10.0, 10.0, 10.0)], "a double, b double, c double, d double").withColumn("g", G.box("a", "b", "c", "d"))
    for r in df.select("*", R.geohash_bounding_cell("g").alias("h"), R.tile_bounding_cell("g").alias("t")).select("*", C.geohash_bounds("h").alias("hb"), G.bounds(R.tile_polygon("t")).alias("tb"), C.tile_parts("t").alias("p")).collect():
        for b in (r["hb"], r["tb"]):
            if b is not None and b["minx"] is not None:
                assert b["minx"] <= r["a"] + 1e-9 and b["miny"] <= r["b"] + 1e-9 and b["maxx"] >= r["c"] - 1e-9 and b["maxy"] >= r["d"] - 1e-9
        assert (r["h"] == "") == (r["a"] == -1.0) and (r["p"]["z"] == 0) == (r["a"] == -1.0)


@pytest.mark.parametrize("grid", [R.GEOHASH, R.TILE, R.S2])
def test_sets_of_cells(spark, grid):
    rng = random.Random(3)
    top = {"string": "u"}.get(grid.type, 5 << 58 | 77 if grid is R.TILE else (3 << 60))
    level = R._level(grid, top) + 2
    leaves = sorted(R.expand_cells(grid, [top], level))

    def some():
        kids = grid.children(top)
        out = set(rng.sample(leaves, len(leaves) // 2)) | set(rng.sample(kids, 1)) | ({top} if rng.random() < 0.1 else set())
        return sorted(out)

    rows = [(i, some(), some()) for i in range(25)] + [(99, [], some()), (100, None, some()), (101, [top], leaves)]
    df = spark.createDataFrame(rows, f"i int, a array<{grid.type}>, b array<{grid.type}>")
    got = df.select("*", R.cell_union(grid, "a", "b").alias("u"), R.cell_intersection(grid, "a", "b").alias("n"), R.cell_difference(grid, "a", "b").alias("d"), R.compact(grid, "a").alias("c"), R.uncompact(grid, "a", level).alias("x")).collect()
    flat = lambda cells: set(R.expand_cells(grid, cells, level))
    for r in got:
        if r["a"] is None:
            assert r["u"] is None and r["c"] is None
            continue
        a, b = flat(r["a"]), flat(r["b"])
        assert flat(r["u"]) == a | b and flat(r["n"]) == a & b and flat(r["d"]) == a - b and flat(r["c"]) == a and set(r["x"]) == a
        assert len(r["c"]) <= len(r["a"]) and r["c"] == R.compact_cells(grid, r["c"])
    assert [r["u"] for r in got if r["i"] == 101] == [[top]]


def test_tiles_contain(spark):
    df = points(spark).where("abs(y) < 85").select(C.tile_id(C.tile_x("x", 4), C.tile_y("y", 4), F.lit(4)).alias("a"), C.tile_id(C.tile_x("x", 9), C.tile_y("y", 9), F.lit(9)).alias("b"), C.tile_id(C.tile_x(-F.col("x") - 1, 9), C.tile_y("y", 9), F.lit(9)).alias("c"))
    assert df.where(~R.tile_contains("a", "b") | R.tile_contains("b", "a")).count() == 0
    assert df.where(R.tile_contains("a", "c")).count() < df.count() / 4
    assert df.select(R.tile_center("b").alias("p"), "b").where(C.tile_id(C.tile_x("p.lon", 9), C.tile_y("p.lat", 9), F.lit(9)) != F.col("b")).count() == 0
