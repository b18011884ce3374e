"""Codes beside geometry against known values and plain Python."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from meridia.functions import cells as C
from meridia.functions import codes as K


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_sizes(spark):
    #: Texts of sizes.
    want = {10000.0: "9.77 KiB", 1024.0: "1.00 KiB", 1023.0: "1023 B", 1e-308: "0 B", 0.0: "0 B", -1.0: "-1 B", -1023.0: "-1023 B", math.inf: "(inf)", -math.inf: "(-inf)", 1e24: "847.0 ZiB", 1e25: "(too large to display)"}
    df = spark.createDataFrame([(v, t) for v, t in want.items()] + [(math.nan, "(nan)"), (None, None)], "v double, t string")
    assert df.where(~K.size_text("v").eqNullSafe(F.col("t"))).count() == 0


def test_sortable_ids(spark):
    got = one(spark, K.sortable_id(F.timestamp_millis(F.lit(1_700_000_000_123)), F.lit(7)))
    assert got == (1_700_000_000_123 << 16) + 7
    assert one(spark, K.sortable_id_millis(F.lit(got))) == 1_700_000_000_123
    ids = [r["id2"] for r in K.sortable_ids(spark.range(500, numPartitions=4), "id2").collect()]
    assert len(set(ids)) == 500


def test_one_time_passwords(spark):
    #: Test vectors of RFC 6238.
    key = "GEZDGNBVGY3TQOJQGEZDGNBVGY3TQOJQ"
    want = {59: "94287082", 1111111109: "07081804", 1234567890: "89005924", 20000000000: "65353130"}
    df = spark.createDataFrame(list(want.items()), "t long, code string").withColumn("w", K.totp_window("t"))
    assert df.where(K.totp_generate(F.lit(key), "w", digits=8) != F.col("code")).count() == 0
    assert df.where(K.totp_verify(F.lit(key), "code", F.col("w") + 1, digits=8)).count() == 4
    assert df.where(K.totp_verify(F.lit(key), "code", F.col("w") + 2, digits=8)).count() == 0


def test_blurred_image(spark):
    import numpy as np

    image = np.zeros((16, 24, 3), np.uint8)
    image[:, :, 0] = np.linspace(0, 255, 24)[None, :]
    image[:, :, 1] = np.linspace(200, 50, 16)[:, None]
    df = spark.createDataFrame([(bytearray(image.tobytes()), 24, 16), (None, 1, 1)], "p binary, w int, h int").withColumn("code", K.blurhash_encode("p", "w", "h"))
    rows = df.withColumn("back", K.blurhash_decode("code", "w", "h")).collect()
    assert rows[1]["code"] is None and rows[1]["back"] is None
    back = np.frombuffer(bytes(rows[0]["back"]), np.uint8).reshape(16, 24, 3).astype(int)
    assert len(rows[0]["code"]) == 28 and np.abs(back - image.astype(int)).mean() < 20
    assert K.blur_encode(bytes([255, 0, 0]) * 4, 2, 2, 1, 1) == "00TI:j"


def test_plus_codes(spark):
    #: Codes of the format's description.
    df = spark.createDataFrame([("8FVC9G8F+6X", 8.5, 47.4, "9G8F+6X"), ("9C3W9QCJ+2VX", -0.116, 51.36, None)], "code string, x double, y double, short string")
    rows = df.select("*", C.plus_code_bounds("code").alias("b"), C.plus_code_shorten("code", "x", "y").alias("s")).collect()
    assert rows[0]["s"] == "9G8F+6X"
    assert rows[0]["b"]["miny"] == pytest.approx(47.3655, abs=1e-9) and rows[0]["b"]["maxx"] == pytest.approx(8.525, abs=1e-9)
    back = df.where("short is not null").select(C.plus_code_recover("short", "x", "y").alias("c")).first()["c"]
    assert back == "8FVC9G8F+6X"
    assert one(spark, C.plus_code_recover(F.lit("8FVC9G8F+6X"), 0.0, 0.0)) == "8FVC9G8F+6X"
    assert one(spark, C.plus_code_bounds(F.lit("9G8F+6X"))) is None
    grid = spark.createDataFrame([(lon / 7, lat / 7) for lon in range(-1250, 1250, 97) for lat in range(-620, 620, 83)], "x double, y double")
    b = grid.select("x", "y", C.plus_code_bounds(C.plus_code("x", "y")).alias("b"), C.plus_code_recover(C.plus_code_shorten(C.plus_code("x", "y"), F.col("x") + 0.01, F.col("y") - 0.01), F.col("x") + 0.01, F.col("y") - 0.01).alias("r"), C.plus_code("x", "y").alias("c"))
    assert b.where("not (x >= b.minx - 1e-9 and x <= b.maxx + 1e-9 and y >= b.miny - 1e-9 and y <= b.maxy + 1e-9)").count() == 0
    assert b.where("r <> c").count() == 0


def test_short_links(spark):
    #: Codes of the format's description.
    df = spark.createDataFrame([("0EEQhq--", 0.054, 51.510, 9), ("0OP4tR~rx", 19.579, 51.876, 19), ("0OP4tR@rx", 19.579, 51.876, 19)], "code string, lon double, lat double, zoom int")
    for r in df.select("*", C.short_link_point("code").alias("p")).collect():
        assert r["p"]["zoom"] == r["zoom"]
        assert r["p"]["lon"] == pytest.approx(r["lon"], abs=1e-2) and r["p"]["lat"] == pytest.approx(r["lat"], abs=1e-2)
    assert one(spark, C.short_link_point(F.lit("X"))) is None


def test_lru_and_head(tmp_path):
    c = K.LRU(2)
    c["a"], c["b"] = 1, 2
    assert c.get("a") == 1 and c.peek("b") == 2
    c["c"] = 3
    assert "b" not in c and list(c) == ["a", "c"] and c.popitem() == ("a", 1) and len(c) == 1
    (tmp_path / "refs").mkdir()
    (tmp_path / "HEAD").write_text("ref: refs/x\n")
    (tmp_path / "refs" / "x").write_text("abc\n")
    assert K.head_commit(str(tmp_path)) == "abc"
