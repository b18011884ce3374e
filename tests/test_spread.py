"""Rows and cells are dealt to tasks whatever the size of their file, and a cell is asked once."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import h3
from meridia.operators import covers
from meridia.operators.saved import MOST_ROWS, spread


def test_small_files_are_spread(spark, tmp_path):
    spark.range(10_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spread(spark.read.parquet(str(tmp_path / "t")), "id")
    assert df.rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism and df.count() == 10_000
    assert spread(spark.range(0), "id").count() == 0
    assert spread(spark.range(MOST_ROWS * 40), "id").rdd.getNumPartitions() == 40


def test_cells_by_bits(spark):
    """Parents, children and centre children against the digits as text."""
    points = spark.range(200).select(((F.col("id") * 7919) % 36000 / 100 - 180).alias("x"), ((F.col("id") * 6971) % 17000 / 100 - 85).alias("y"))
    cells = points.select(h3.h3_cell("x", "y", 5).alias("c")).union(h3.h3_pentagons(spark, 5))
    text = lambda n: h3._pack(h3.h3_base_cell("c"), F.substring(h3.h3_digits("c"), F.lit(1), F.lit(n)))
    tails = [str(i) if n == 1 else f"{i}{j}" for n in (2,) for i in range(7) for j in range(7)]
    wanted = F.transform(F.filter(F.array(*map(F.lit, tails)), lambda t: ~(h3._five(h3.h3_base_cell("c")) & F.ltrim(F.concat(h3.h3_digits("c"), t), F.lit("0")).startswith("1"))), lambda t: h3._pack(h3.h3_base_cell("c"), F.concat(h3.h3_digits("c"), t)))
    same = cells.select((h3.h3_parent("c", 2) == text(2)).alias("a"), (h3.h3_children("c", F.lit(7)) == wanted).alias("b"), (h3.h3_center_child("c", 7) == h3._pack(h3.h3_base_cell("c"), F.concat(h3.h3_digits("c"), F.lit("00")))).alias("d"), (h3.h3_is_pentagon("c") == (h3._five(h3.h3_base_cell("c")) & (F.ltrim(h3.h3_digits("c"), F.lit("0")) == ""))).alias("e"))
    assert same.where("not (a and b and d and e)").count() == 0 and same.count() == 212


def test_disks_of_neighbouring_cells(spark):
    """Disks that overlap share their cells' neighbours, and each is whole."""
    own = spark.createDataFrame([(i * 0.2, 10.0) for i in range(6)], "x double, y double").select(h3.h3_cell("x", "y", 4).alias("cell")).distinct()
    n = covers.h3_disks(own, "cell", 4, 2).groupBy("cell", "steps").count().collect()
    assert len(n) == 3 * own.count() and all(r["count"] == (6 * r["steps"] or 1) for r in n)


def test_tracks_are_dealt_by_their_events(spark, tmp_path):
    """Tasks have few tracks whatever their file's size, without another shuffle for the group."""
    from meridia.plans.tables import tracks

    spark.range(MOST_ROWS * 20).select("id", (F.col("id") % 2000).alias("user_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("event_id"), F.rand(1).alias("value")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    t = tracks(spark, str(tmp_path))
    sizes = t.groupBy(F.spark_partition_id()).count().collect()
    assert t.rdd.getNumPartitions() == 20 and sum(r["count"] for r in sizes) == 2000 and max(r["count"] for r in sizes) < 300
