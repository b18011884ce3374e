"""Grouped geometry: bounds, dissolves, coverages, counts, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import cells as C
from meridia.functions import geometry as G
from meridia.functions import kernels as K
from meridia.operators import joins as J


def total_bounds(geometry) -> list[Column]:
    """Aggregates minx, miny, maxx, maxy; missing and empty geometries don't count."""
    b = G.bounds(geometry)
    return [F.min(b["minx"]).alias("minx"), F.min(b["miny"]).alias("miny"), F.max(b["maxx"]).alias("maxx"), F.max(b["maxy"]).alias("maxy")]


def dissolve(df: DataFrame, by: list[str], geometry: str, *, level: int = 8, fan: int = 6) -> DataFrame:
    """`by` and the union of each group's polygons; groups whose geometries are all missing go.

    Unions go up a tree: first of what shares a cell of a Hilbert curve, then of the unions of 2^fan
    neighbouring cells, and so on. A task unites a cell's own geometries, or at most 2^fan unions.
    """
    some = df.where(F.col(geometry).isNotNull())
    frame = some.agg(*total_bounds(F.col(geometry))).first()
    at, cell = free_name("cell", df), C.spatial_key(F.col(geometry), *[F.lit(frame[k] if frame[k] is not None else 0.0) for k in ("minx", "miny", "maxx", "maxy")], level=level)
    out = some.select(*by, geometry, F.coalesce(cell, F.lit(0)).alias(at)).groupBy(*by, at).agg(K.union_all(F.col(geometry)).alias(geometry))
    for _ in range(-(-2 * level // fan) - 1):
        out = out.groupBy(*by, F.shiftright(F.col(at), fan).alias(at)).agg(K.union_all(F.col(geometry)).alias(geometry))
    return out.groupBy(*by).agg(K.union_all(F.col(geometry)).alias(geometry))


def free_name(name: str, df: DataFrame) -> str:
    """`name`, with underscores after it while a column is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def coverage_edges(df: DataFrame, geometry: str, by: list[str] | None = None) -> DataFrame:
    """Edges that one polygon alone has: the outline of a valid coverage. `by`, x1, y1, x2, y2."""
    edge = lambda a, b: F.when((a["x"] < b["x"]) | ((a["x"] == b["x"]) & (a["y"] <= b["y"])), F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))).otherwise(F.struct(b["x"].alias("x1"), b["y"].alias("y1"), a["x"].alias("x2"), a["y"].alias("y2")))
    rows = df.select(*(by or []), F.explode(F.flatten(F.transform(G.rings(F.col(geometry)), lambda r: G.pairs(r, edge)))).alias("e")).select(*(by or []), "e.*")
    return rows.groupBy(*(by or []), "x1", "y1", "x2", "y2").count().where("count = 1").drop("count")


def coverage_invalid_edges(df: DataFrame, geometry: str, id: str) -> DataFrame:
    """id and edges (a multi-line) of the polygons whose boundary doesn't fit those of others: inside of one, along one on the same side, or along one without ending where it does."""
    pairs = J.self_join(df.select(id, geometry), "intersects", geometry, id)
    found = F.udf(lambda a, b: [_misfits(a, b), _misfits(b, a)], f"array<{G.GEOMETRY}>", useArrow=True)
    both = pairs.select(id, f"{id}_2", found(F.col(geometry), F.col(f"{geometry}_2")).alias("e"))
    each = both.select(F.col(id), F.element_at("e", 1).alias("edges")).union(both.select(F.col(f"{id}_2"), F.element_at("e", 2))).where(F.size("edges.parts") > 0)
    return each.groupBy(id).agg(F.struct(F.lit(5).alias("kind"), F.array_distinct(F.flatten(F.collect_list("edges.parts"))).alias("parts")).cast(G.GEOMETRY).alias("edges"))


def _misfits(a, b):
    if a is None or b is None or not a["parts"] or not b["parts"]:
        return K.made(5, [])
    ra, rb = K.oriented(K.parts_of(a)), K.oriented(K.parts_of(b))
    ea, eb = K.noded(ra, rb)
    whole_a, whole_b, other = {e for r in ra for e in zip(r, r[1:])}, {e for r in rb for e in zip(r, r[1:])}, set(eb)
    bad = []
    for e in ea:
        back = e[::-1]
        if e in other or back in other and (e not in whole_a or back not in whole_b) or back not in other and K.place(((e[0][0] + e[1][0]) / 2, (e[0][1] + e[1][1]) / 2), K.parts_of(b)) > 0:
            bad.append([list(e)])
    return K.made(5, bad)


def coverage_is_valid(df: DataFrame, geometry: str, id: str) -> bool:
    """Whether polygons meet only along whole common edges."""
    return coverage_invalid_edges(df, geometry, id).limit(1).count() == 0


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value and count, for sorting by count."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))


def collect(geometry) -> Column:
    """Aggregate: the group's single geometries as one of the multi kind."""
    all_ = F.collect_list(G.col(geometry))
    first = F.get(all_, F.lit(0))["kind"]
    made = F.struct(F.when(first <= 3, first + 3).otherwise(first).cast("int").alias("kind"), F.flatten(F.transform(all_, lambda g: g["parts"])).alias("parts"))
    return F.when(F.size(all_) > 0, made).cast(G.GEOMETRY)


def spatial_sort(df: DataFrame, geometry: str, *, level: int = 16, curve: str = "hilbert", partitions: int | None = None) -> DataFrame:
    """Rows in the order of a space-filling curve, range-partitioned; empty geometries last."""
    frame = df.agg(*total_bounds(F.col(geometry))).first()
    key = C.spatial_key(F.col(geometry), *[F.lit(frame[k] if frame[k] is not None else 0.0) for k in ("minx", "miny", "maxx", "maxy")], level=level, curve=curve)
    df = df.withColumn("_key", key)
    out = df.repartitionByRange(partitions, F.col("_key").asc_nulls_last()) if partitions else df.repartitionByRange(F.col("_key").asc_nulls_last())
    return out.sortWithinPartitions(F.col("_key").asc_nulls_last()).drop("_key")
