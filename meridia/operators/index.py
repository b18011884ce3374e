"""An index of geometries: a DataFrame with handles and bounds, and the searches that are planned over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions import crs as S
from meridia.functions import geometry as G
from meridia.operators import joins as J


class SpatialIndex:
    """Present geometries under handles of type long. Changing one gives a new index over the same rows.

    Rows are numbered by Spark where no handle column is named, so the DataFrame should be a written
    table. Searches give handles and rows, not objects; they are plans, and run when they are read.
    """

    def __init__(self, df: DataFrame, geometry: str = "geometry", *, handle: str | None = None):
        rows = df.select(F.col(handle).cast("long").alias("handle") if handle else F.monotonically_increasing_id().alias("handle"), F.col(geometry).alias("indexed"))
        self.rows = rows.where(F.col("indexed").isNotNull())
        self._about = dict(df.schema[geometry].metadata or {})

    def _over(self, rows: DataFrame) -> SpatialIndex:
        other = object.__new__(SpatialIndex)
        other.rows, other._about = rows, self._about
        return other

    @property
    def crs(self) -> S.Crs | None:
        return S.crs(self._about["crs"]) if "crs" in self._about else None

    @property
    def epoch(self) -> float | None:
        return self._about.get("epoch")

    def candidates(self, queries: DataFrame, geometry: str, **plan) -> DataFrame:
        """Columns of the queries and the handle of each row whose bounds meet theirs."""
        return J.candidates(queries, self.rows, geometry, "indexed", **plan).select(*queries.columns, "handle")

    def query(self, queries: DataFrame, geometry: str, predicate: str = "intersects", *, distance: float | None = None, **plan) -> DataFrame:
        """Columns of the queries and the handle of each row that predicate(query, row) holds for, or that is within a distance of a query point."""
        if distance is not None:
            return J.dwithin_join(queries, self.rows, distance, geometry, "indexed", **plan).select(*queries.columns, "handle")
        return J.spatial_join(queries, self.rows, predicate, geometry, "indexed", **plan).select(*queries.columns, "handle")

    def join(self, queries: DataFrame, geometry: str, predicate: str = "intersects", **plan) -> DataFrame:
        """As query, with the indexed geometry."""
        return J.spatial_join(queries, self.rows, predicate, geometry, "indexed", **plan)

    def self_join(self, predicate: str = "intersects", **plan) -> DataFrame:
        """Pairs of handles, each once, for a symmetric predicate."""
        return J.self_join(self.rows, predicate, "indexed", "handle", **plan).select("handle", "handle_2")

    def nearest(self, queries: DataFrame, id: str, geometry: str, *, k: int = 1, ties: bool = False, **plan) -> DataFrame:
        """Query id, handle, distance and rank of the nearest rows of query points."""
        return J.nearest(queries, self.rows, id, "handle", geometry, "indexed", k=k, ties=ties, **plan)

    def insert(self, df: DataFrame, geometry: str = "geometry") -> tuple[SpatialIndex, DataFrame]:
        """The index with more geometries, and these with the handles they got: beyond the highest so far."""
        top = self.rows.agg(F.max("handle")).first()[0]
        new = df.select((F.monotonically_increasing_id() + F.lit(0 if top is None else top + 1)).alias("handle"), F.col(geometry).alias("indexed")).where(F.col("indexed").isNotNull())
        return self._over(self.rows.union(new)), new

    def remove(self, handles) -> SpatialIndex:
        """The index without the rows of some handles: a list, or a DataFrame with a column handle."""
        if isinstance(handles, DataFrame):
            return self._over(self.rows.join(handles.select("handle").distinct(), "handle", "left_anti"))
        return self._over(self.rows.where(~F.col("handle").isin(list(handles))))

    def get(self, handle: int) -> DataFrame:
        """The row of one handle, or none."""
        return self.rows.where(F.col("handle") == handle)

    def keys(self) -> DataFrame:
        return self.rows.select("handle")

    def values(self) -> DataFrame:
        return self.rows.select("indexed")

    def items(self) -> DataFrame:
        return self.rows

    def explain(self, queries: DataFrame, geometry: str, predicate: str = "intersects", **plan) -> str:
        """Spark's plan of a query, as text."""
        return self.query(queries, geometry, predicate, **plan)._jdf.queryExecution().toString()

    def bounds(self) -> DataFrame:
        """One row: minx, miny, maxx, maxy of all."""
        b = G.bounds(F.col("indexed"))
        return self.rows.agg(F.min(b["minx"]).alias("minx"), F.min(b["miny"]).alias("miny"), F.max(b["maxx"]).alias("maxx"), F.max(b["maxy"]).alias("maxy"))
