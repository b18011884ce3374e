"""Streaming: counts of events by fence and time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions import geometry as G
from meridia.operators.joins import spatial_join


def fence_counts(events: DataFrame, fences: DataFrame, *, time: str = "ts", geometry: str = "geometry", fence: str = "fence", fence_id: str = "fence_id", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """fence_id, start and n of the points that fall into each fence, by tumbling window.

    Works on batches and streams; on a stream the watermark `late` bounds its state. The fences are a
    small static table: the join is a broadcast by bounds.
    """
    inside = spatial_join(events.withWatermark(time, late), fences, "within", geometry, fence, left_kind="point")
    return inside.groupBy(F.window(time, window).alias("w"), fence_id).agg(F.count("*").alias("n")).select(fence_id, F.col("w.start").alias("start"), "n")


def points_of(events: DataFrame, x: str, y: str) -> DataFrame:
    return events.withColumn("geometry", G.point(F.col(x), F.col(y)))
