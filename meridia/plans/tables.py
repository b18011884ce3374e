"""Geometry derived from the plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import constructive as P
from meridia.functions import geometry as G
from meridia.operators.saved import spread  # noqa: F401 - for the queries too


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """c_custkey, c_nationkey, lon, lat, cust_pt."""
    k = F.col("c_custkey")
    lon, lat = (k * 7919) % 36000 / 100.0 - 180.0, (k * 6971) % 17000 / 100.0 - 85.0
    rows = spread(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey")
    return rows.select("c_custkey", "c_nationkey", "c_acctbal", lon.alias("lon"), lat.alias("lat")).withColumn("cust_pt", G.point(F.col("lon"), F.col("lat")))


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    lon, lat = (k * 104729) % 36000 / 100.0 - 180.0, (k * 15485863) % 17000 / 100.0 - 85.0
    return table(spark, sf, "supplier").select("s_suppkey", lon.alias("slon"), lat.alias("slat")).withColumn("supp_pt", G.point(F.col("slon"), F.col("slat")))


def nations(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    x, y = -180.0 + 72.0 * (n % 5), -85.0 + 34.0 * F.floor(n / 5)
    return table(spark, sf, "nation").select("n_nationkey", "n_regionkey", x.alias("x0"), y.alias("y0")).withColumn("nation_box", G.box(F.col("x0"), F.col("y0"), F.col("x0") + 72, F.col("y0") + 34))


def rings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return customers(spark, sf).select("c_custkey", "lon", "lat", P.regular_polygon(F.col("lon"), F.col("lat"), 1 + k % 7, 4 + k % 9).alias("cust_ring"))


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """A line per user through its events by time, m the seconds."""
    # by events, so that a task, and a batch that goes to Python, has few tracks however many there are
    e = spread(table(spark, sf, "events").select("user_id", "ts", "event_id", "value"), "user_id").select("user_id", "ts", "event_id", (F.col("event_id") % 360 - 180).cast("double").alias("x"), F.col("value").alias("y"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("m"))
    sort = F.sort_array(F.collect_list(F.struct("ts", "event_id", G.vertex(F.col("x"), F.col("y"), None, F.col("m")).alias("v"))))
    return e.groupBy("user_id").agg(sort.alias("s")).where("size(s) > 1").select("user_id", G.line_string(F.transform("s", lambda v: v["v"])).alias("traj"))


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of customers and suppliers that have traded, each once, with the points of both."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    pairs = lines.join(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey").select("c_custkey", "s_suppkey").distinct()
    return pairs.join(customers(spark, sf), "c_custkey").join(suppliers(spark, sf), "s_suppkey")
