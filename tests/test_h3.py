"""Hexagonal cells: known numbers, whole-Earth sums, neighbours around corners of five faces, covers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.functions import h3 as H
from meridia.operators import covers


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def cells(spark, level):
    return H.h3_base_cells(spark).select(F.explode(H.h3_children("cell", F.lit(level))).alias("cell"))


def test_known_cells(spark):
    at = lambda lon, lat, level: H.h3_token(H.h3_cell(F.lit(lon), F.lit(lat), level))
    got = one(spark, at(-122.41795063018799, 37.775938728915946, 9), at(-121.976375972551, 37.345793375368, 5), at(10.0, -40.0, 2), at(-50.0, 85.0, 0), at(38.0, 79.2, 0))
    assert tuple(got) == ("8928308280fffff", "85283473fffffff", "82d10ffffffffff", "8003fffffffffff", "8001fffffffffff")
    assert tuple(one(spark, at(0.0, 91.0, 3), at(float("nan"), 1.0, 3), at(float("inf"), 1.0, 3))) == (None, None, None)
    with pytest.raises(ValueError):
        H.h3_cell("a", "b", 16)


def test_known_outline_and_area(spark):
    c = F.lit(0x85283473FFFFFFF)
    m, ring, area, level, base = one(spark, H.h3_center(c), H.h3_boundary(c), H.h3_area(c), H.h3_resolution(c), H.h3_base_cell(c))
    known = [(37.271355866731895, -121.91508032705622), (37.353926450852256, -121.86222328902491), (37.42834118609435, -121.9235499963016), (37.42012867767778, -122.0377349642703), (37.33755608435298, -122.09042892904395), (37.26319797461824, -122.02910130919)]
    assert [(v["lat"], v["lon"]) for v in ring] == [pytest.approx(k, abs=1e-9) for k in known]
    assert (m["lat"], m["lon"]) == pytest.approx((37.345793375368, -121.976375972551), abs=1e-9) and area / 1e6 == pytest.approx(265.0925581283, rel=1e-9) and (level, base) == (5, 20)


@pytest.mark.parametrize("level", [0, 1, 2, 3])
def test_the_whole_earth(spark, level):
    df = cells(spark, level).select("cell", H.h3_center("cell").alias("m"), H.h3_area("cell").alias("a"), H.h3_is_pentagon("cell").alias("five"), H.h3_is_valid("cell").alias("good"))
    n, same, area, five, good = df.agg(F.count("*"), F.sum((H.h3_cell("m.lon", "m.lat", level) == F.col("cell")).cast("int")), F.sum("a"), F.sum(F.col("five").cast("int")), F.min("good")).first()
    assert n == same == 2 + 120 * 7**level and five == 12 and good and area == pytest.approx(4 * 3.141592653589793 * H.RADIUS**2, rel=1e-12)


@pytest.mark.parametrize("level", [1, 2])
def test_neighbours_have_each_other(spark, level):
    sides = cells(spark, level).select("cell", F.explode(F.array_compact(H.h3_neighbors("cell", level))).alias("other")).cache()
    assert sides.count() == sides.distinct().count() == 6 * (2 + 120 * 7**level) - 12
    assert not sides.join(sides.select(F.col("other").alias("cell"), F.col("cell").alias("other")), ["cell", "other"], "left_anti").count()
    degree = sides.groupBy("cell").count().groupBy(H.h3_is_pentagon("cell").alias("five"), "count").count().collect()
    assert {(r[0], r[1]) for r in degree} == {(True, 5), (False, 6)}


def test_children_and_places(spark):
    five = H.h3_pentagons(spark, 2)
    rows = five.select("cell", F.posexplode(H.h3_children("cell", F.lit(4))).alias("i", "k")).union(spark.range(1).select(F.lit(0x822837FFFFFFFFF).alias("cell"), F.posexplode(H.h3_children(F.lit(0x822837FFFFFFFFF), F.lit(4))).alias("i", "k")))
    n, good, there = rows.agg(F.count("*"), F.sum((H.h3_child_position("k", F.lit(2)) == F.col("i")).cast("int")), F.sum((H.h3_child_at("cell", F.col("i"), F.lit(4)) == F.col("k")).cast("int"))).first()
    assert n == good == there == 12 * 41 + 49
    assert one(spark, H.h3_child_at(F.lit(0x822837FFFFFFFFF), F.lit(49), F.lit(4)))[0] is None and one(spark, H.h3_children_count(F.lit(0x822837FFFFFFFFF), F.lit(4)))[0] == 49
    token, parent, center = one(spark, H.h3_from_token(F.lit("8928308280fffff")), H.h3_token(H.h3_parent(F.lit(0x8928308280FFFFF), F.lit(6))), H.h3_token(H.h3_center_child(F.lit(0x85283473FFFFFFF), F.lit(7))))
    assert (token, parent, center) == (0x8928308280FFFFF, "86283082fffffff", "872834700ffffff")


def test_paths_and_local_places(spark):
    df = spark.createDataFrame([(10.0 + i, 50.0 + j) for i in range(3) for j in range(3)], "lon double, lat double").select(H.h3_cell("lon", "lat", 4).alias("a"))
    pairs = df.crossJoin(df.select(F.col("a").alias("b")))  # nine rows each
    d = pairs.select("a", "b", H.h3_grid_distance("a", "b").alias("d"), H.h3_grid_distance("b", "a").alias("e"), H.h3_grid_path("a", "b", 4).alias("path"), H.h3_local_ij("b", "a").alias("ij"))
    d = d.withColumn("back", H.h3_from_local_ij("a", "ij.i", "ij.j", 4)).collect()
    known = [r for r in d if r["d"] is not None]
    assert len(known) > 60 and all(r["d"] == r["e"] and len(r["path"]) == r["d"] + 1 == len(set(r["path"])) and r["path"][0] == r["a"] and r["path"][-1] == r["b"] and r["back"] == r["b"] for r in known if r["e"] is not None)
    start = known[0]["a"]
    disk = covers.h3_disks(spark.createDataFrame([(start,)], "c long"), "c", 4, 4).groupBy("steps").count().collect()
    assert sorted(map(tuple, disk)) == [(0, 1), (1, 6), (2, 12), (3, 18), (4, 24)]
    steps = {r["other"]: r["steps"] for r in covers.h3_disks(spark.createDataFrame([(start,)], "c long"), "c", 4, 4).collect()}
    assert all(steps.get(r["b"], 5) == r["d"] for r in known if r["a"] == start and r["d"] <= 4)


def test_a_disk_around_five(spark):
    five = H.h3_pentagons(spark, 3).limit(2)
    got = covers.h3_disks(five, "cell", 3, 2).groupBy("cell", "steps").count().collect()
    assert sorted({(r["steps"], r["count"]) for r in got}) == [(0, 1), (1, 5), (2, 10)]


@pytest.mark.parametrize(("level", "within"), [(2, 53), (3, 453)])
def test_covers_of_a_box(spark, level, within):
    df = spark.range(1).select("id", G.box(-10.0, -10.0, 10.0, 10.0).alias("g"))
    found = {rule: {r["cell"] for r in covers.h3_cover(df, "g", level, rule=rule).collect()} for rule in covers.RULES}
    assert len(found["within"]) == within
    assert found["within"] < found["center"] < found["overlap"] <= found["bbox"]
    # the same by looking at every cell
    every = cells(spark, level).withColumn("m", H.h3_center("cell")).where("abs(m.lon) < 10 and abs(m.lat) < 10")
    assert {r["cell"] for r in every.collect()} == found["center"]


def test_covers_write_shapes_once_and_deal_out_large_ones(spark, monkeypatch):
    wrote, one_by_one = [], covers.saved
    monkeypatch.setattr(covers, "saved", lambda df: wrote.append(one_by_one(df)) or wrote[-1])
    df = spark.range(2).select("id", F.when(F.col("id") == 0, G.box(-20.0, 30.0, 25.0, 62.0)).otherwise(G.box(170.0, -3.0, 180.0, 4.0)).alias("g"))
    cells = lambda: sorted(map(tuple, covers.h3_cover(df, "g", 2).collect()))
    found = cells()
    assert len(found) == len(set(found)) > 60
    assert [x.count() for x in wrote if "g_" in x.columns] == [2]  # rounds write numbers of rows and cells
    outlines = next(x for x in wrote if "ring_" in x.columns)
    assert outlines.count() == outlines.select("cell").distinct().count()
    monkeypatch.setattr(covers, "MOST_ROWS", 5)
    monkeypatch.setattr(covers, "MOST_OUTLINES", 0)
    wrote.clear()
    assert cells() == found
    assert any(x.count() for x in wrote if "n_" in x.columns)


def test_covers_of_lines_points_and_missing_ones(spark):
    df = spark.range(1).select(F.lit("line").alias("id"), G.line_string(F.array(G.vertex(-10.0, -40.0), G.vertex(10.0, -40.0))).alias("g"))
    df = df.union(spark.range(1).select(F.lit("point"), G.point(F.lit(13.4), F.lit(52.5)))).union(spark.range(1).select(F.lit("none"), F.lit(None).cast(G.GEOMETRY)))
    got = {}
    for r in covers.h3_cover(df, "g", 2).select("id", H.h3_token("cell").alias("t")).collect():
        got.setdefault(r["id"], set()).add(r["t"])
    assert "82d10ffffffffff" in got["line"] and len(got["point"]) == 1 and "none" not in got
    with pytest.raises(ValueError):
        covers.h3_cover(df, "g", 2, rule="contains")


def test_bounding_cells(spark):
    row = one(spark, covers.h3_bounding_cell(G.box(13.3, 52.4, 13.5, 52.6)), covers.h3_bounding_cell(G.box(-100.0, -50.0, 100.0, 50.0)))
    assert one(spark, H.h3_resolution(F.lit(row[0])))[0] >= 2 and row[1] is None
