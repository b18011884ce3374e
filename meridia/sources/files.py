"""GeoJSON and GeoParquet files."""

from __future__ import annotations

import json

import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import codecs as X
from meridia.functions import geometry as G
from meridia.functions.crs import crs_of, epoch_of, set_crs
from meridia.operators.aggregates import total_bounds


def read_geojson(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """geometry, properties (map of text) and id of the features of a collection, or of one a line."""
    schema = "type string, id string, geometry string, properties map<string,string>, features array<struct<id:string,geometry:string,properties:map<string,string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=not lines)
    one = rows.where("type = 'Feature'").select("id", "geometry", "properties")
    many = rows.where("type = 'FeatureCollection'").select(F.explode("features").alias("f")).select("f.id", "f.geometry", "f.properties")
    return one.union(many).select(X.from_geojson(F.col("geometry")).alias("geometry"), "properties", "id")


def write_geojson(df: DataFrame, path: str, geometry: str = "geometry") -> None:
    """Newline-delimited features; all other columns are properties."""
    rest = [c for c in df.columns if c != geometry]
    df.select(X.to_feature(F.col(geometry), F.struct(*rest) if rest else None).alias("value")).write.mode("overwrite").text(path)


def write_geoparquet(df: DataFrame, path: str, geometry: str = "geometry") -> None:
    """GeoParquet 1.1: WKB with stored bounds, which let readers skip row groups, and the `geo` entry in every file's footer.

    Spark writes the files; then each is copied, a row group at a time, with the entry added, by tasks
    of its own. The path must be one that Arrow's file systems reach from all executors.
    """
    b, known = G.bounds(F.col(geometry)), crs_of(df, geometry)
    kinds = F.collect_set(F.when(F.col(geometry).isNotNull(), F.concat(G.geometry_type(F.col(geometry)), F.when(G.has_z(F.col(geometry)), " Z").otherwise(""))))
    about = df.agg(kinds.alias("kinds"), *total_bounds(F.col(geometry))).first()
    out = df.withColumn("bbox", F.struct(b["minx"].alias("xmin"), b["miny"].alias("ymin"), b["maxx"].alias("xmax"), b["maxy"].alias("ymax"))).withColumn(geometry, X.to_wkb(F.col(geometry)))
    out.write.mode("overwrite").parquet(path)
    column = {"encoding": "WKB", "geometry_types": sorted(about["kinds"]), "covering": {"bbox": {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}}}
    if about["minx"] is not None:
        column["bbox"] = [about["minx"], about["miny"], about["maxx"], about["maxy"]]
    if known is not None:
        column["crs"] = known.to_projjson_dict()
    if epoch_of(df, geometry) is not None:
        column["epoch"] = epoch_of(df, geometry)
    geo = json.dumps({"version": "1.1.0", "primary_column": geometry, "columns": {geometry: column}})
    files = [r[0] for r in df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path").collect()]  # names only: no content is read

    def label(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(file)
                source = pq.ParquetFile(at, filesystem=fs)
                schema = source.schema_arrow.with_metadata({**(source.schema_arrow.metadata or {}), b"geo": geo.encode()})
                folder, _, name = at.rpartition("/")
                with pq.ParquetWriter(f"{folder}/_geo-{name}", schema, filesystem=fs, compression="snappy") as sink:
                    for i in range(source.num_row_groups):
                        sink.write_table(source.read_row_group(i).replace_schema_metadata(schema.metadata))
                fs.move(f"{folder}/_geo-{name}", f"{folder}/geo-{name}")  # another name: Hadoop keeps checksums by name beside local files
                for old in (at, f"{folder}/.{name}.crc"):
                    if fs.get_file_info(old).type == pafs.FileType.File:
                        fs.delete_file(old)
            yield batch

    spark = df.sparkSession
    if files:
        spark.createDataFrame([(f,) for f in files], "path string").repartition(len(files)).mapInArrow(label, "path string").count()


def read_geoparquet(spark: SparkSession, path: str, geometry: str = "geometry", *, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The table with its geometry decoded; bbox becomes a filter on the stored bounds, pushed to the scan."""
    df = spark.read.parquet(path)
    if bbox and "bbox" in df.columns:
        a, b, c, d = bbox
        df = df.where((F.col("bbox.xmin") <= c) & (F.col("bbox.xmax") >= a) & (F.col("bbox.ymin") <= d) & (F.col("bbox.ymax") >= b))
    return df.withColumn(geometry, X.from_wkb(F.col(geometry))).drop("bbox")


def from_arrow(spark: SparkSession, table, geometry: str = "geometry") -> DataFrame:
    """An Arrow table with WKB in one column; its `geo` metadata, if any, names the reference system."""
    df = spark.createDataFrame(table).withColumn(geometry, X.from_wkb(F.col(geometry)))
    geo = json.loads((table.schema.metadata or {}).get(b"geo", b"{}"))
    found = geo.get("columns", {}).get(geometry, {}).get("crs")
    return set_crs(df, geometry, found) if found else df


def to_arrow(df: DataFrame, geometry: str = "geometry"):
    """An Arrow table on the driver with WKB in the geometry column, and `geo` metadata."""
    table, known = df.withColumn(geometry, X.to_wkb(F.col(geometry))).toArrow(), crs_of(df, geometry)
    geo = {"version": "1.1.0", "primary_column": geometry, "columns": {geometry: {"encoding": "WKB"} | ({"crs": known.to_projjson_dict()} if known else {})}}
    return table.replace_schema_metadata({**(table.schema.metadata or {}), b"geo": json.dumps(geo).encode()})


def from_pandas(spark: SparkSession, frame, geometry: str = "geometry") -> DataFrame:
    """A pandas frame with WKB in one column."""
    return spark.createDataFrame(frame).withColumn(geometry, X.from_wkb(F.col(geometry)))


def to_pandas(df: DataFrame, geometry: str = "geometry"):
    """A pandas frame on the driver with WKB in the geometry column."""
    return df.withColumn(geometry, X.to_wkb(F.col(geometry))).toPandas()


def to_numpy(df: DataFrame, geometry: str = "geometry"):
    """An array of WKB bytes on the driver, None for missing rows."""
    return to_pandas(df.select(geometry), geometry)[geometry].to_numpy()


def to_feature_collection(df: DataFrame, geometry: str = "geometry", *, id: str | None = None) -> Column:
    """Aggregate over rows: one GeoJSON FeatureCollection, all other columns as properties. For groups that fit in a row."""
    rest = [c for c in df.columns if c not in (geometry, id)]
    feature = X.to_feature(F.col(geometry), F.struct(*rest) if rest else None, F.col(id) if id else None)
    return F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list(feature), ","), F.lit("]}"))


def from_features(spark: SparkSession, features: list[dict]) -> DataFrame:
    """geometry, properties (map of text) and id of GeoJSON features given as mappings."""
    rows = [(json.dumps(f.get("geometry")) if f.get("geometry") else None, {k: v if isinstance(v, str) else json.dumps(v) for k, v in (f.get("properties") or {}).items()}, None if f.get("id") is None else str(f["id"])) for f in features]
    return spark.createDataFrame(rows, "g string, properties map<string,string>, id string").select(X.from_geojson(F.col("g")).alias("geometry"), "properties", "id")
