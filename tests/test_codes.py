"""Point codes and rounding against plain arithmetic."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meridia.functions import cells, codecs, constructive
from meridia.functions import geometry as G


def bounds(code):
    box, even = [-180.0, -90.0, 180.0, 90.0], True
    for ch in code:
        v = cells.GEOHASH.index(ch)
        for k in range(4, -1, -1):
            low, high = (0, 2) if even else (1, 3)
            box[high if not v >> k & 1 else low] = (box[low] + box[high]) / 2
            even = not even
    return tuple(box)


def test_geohash_bounds_of_every_length(spark):
    codes = ["s", "ezs42", "u4pruydqqvj", "zzzzzzzzzzzz", "0", "7"]
    rows = spark.createDataFrame([(c,) for c in codes], "code string").select("code", cells.geohash_bounds("code").alias("b")).collect()
    assert {r["code"]: tuple(r["b"]) for r in rows} == {c: bounds(c) for c in codes}


def test_polyline_round_trip(spark):
    text = "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    rows = spark.createDataFrame([(text,), ("",), (None,)], "t string").select("t", codecs.from_polyline("t").alias("g"), codecs.to_polyline(codecs.from_polyline("t")).alias("again")).collect()
    got = {r["t"]: r for r in rows}
    assert [(v["x"], v["y"]) for v in got[text]["g"]["parts"][0][0]] == [(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)]
    assert got[text]["again"] == text and got[""]["g"]["parts"] == [] and got[None]["g"] is None


def test_polyline_that_ends_early(spark):
    with pytest.raises(Exception, match="ends early"):
        spark.createDataFrame([("_p~iF",)], "t string").select(codecs.from_polyline("t")).collect()


def test_quantize_scales_then_rounds(spark):
    got = spark.range(1).select(constructive.quantize(G.point(F.lit(2.5), F.lit(-2.5)), 0).alias("g")).select(G.x("g"), G.y("g")).first()
    assert tuple(got) == (3.0, -3.0)
