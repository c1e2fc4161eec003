"""Published layers: landed feature pages in, versioned tables and lists out."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import columns as C
from ..operators.geo import box_of
from ..operators.select import upsert_by_key

RINGS = "rings array<array<array<double>>>"


@dataclass(frozen=True)
class Layer:
    """A published table: the schema of its features and how a feature becomes a row."""

    name: str
    attributes: str
    geometry: bool = False
    static: bool = False


#: Field names as published.
SERVICE_REQUESTS = Layer(
    "service_requests",
    "REQUEST_ID long, DATE_INITIATED long, DATE_CLOSED long, DESCRIPTION string, INITIATED_BY string, PRIORITY string, ADDRESS string, "
    "COMMUNITY string, DISTRICT string, REQUEST_CATEGORY string, RESOLUTION string, LATITUDE double, LONGITUDE double, STATUS string, "
    "DEPT_RESPONSIBILITY string, WORK_ORDER string, ObjectId long",
)
CUSTOM_FIELDS = Layer(
    "custom_fields", "REQUESTID long, CUSTOM_FIELD_ID long, CUSTOM_FIELD_NAME string, CUSTOM_FIELD_VALUE string, ObjectId long"
)
CENSUS_AREAS = Layer(
    "census_areas",
    "OBJECTID long, DAUID string, DAPOP2021 int, DATDWELL20 int, DAURDWELL2 int, DAAREA double, DAPOPDEN double, DARPLAT double, "
    "DARPLONG double, CSDNAME string, CDNAME string",
    geometry=True,
    static=True,
)


def write_feature_pages(rows: DataFrame, layer: Layer, path: str, order: str, page: int = 1000) -> None:
    """Rows under the layer's published names as pages of ``page`` features, a page a line; the reverse of reading them."""
    names = [f.strip().split(" ")[0] for f in layer.attributes.split(",")]
    parts = [F.struct(*names).alias("attributes")] + ([F.struct("rings").alias("geometry")] if layer.geometry else [])
    pages = rows.select(F.floor(F.col(order) / page).alias("page"), F.struct(*parts).alias("f")).groupBy("page").agg(F.collect_list("f").alias("features"))
    pages.select(F.to_json(F.struct("features")).alias("value")).write.option("compression", "gzip").text(path)  # names repeat in every feature


def read_feature_pages(spark: SparkSession, path: str, layer: Layer, page_a_line: bool = False) -> DataFrame:
    """One row per feature of the landed pages, with ``rings`` where the layer has geometry. A page is a file, or a line."""
    schema = f"features array<struct<attributes: struct<{_typed(layer.attributes)}>, geometry: struct<rings: array<array<array<double>>>>>>"
    pages = spark.read.schema(schema).option("multiLine", not page_a_line).option("mode", "FAILFAST").json(path)
    rows = pages.select(F.explode("features").alias("f"))
    return rows.select("f.attributes.*", *([F.col("f.geometry.rings").alias("rings")] if layer.geometry else []))


def _typed(fields: str) -> str:
    return ", ".join(": ".join(f.strip().split(" ", 1)) for f in fields.split(","))


def service_request_rows(features: DataFrame) -> DataFrame:
    """Published fields under their column names; instants from epoch milliseconds. Object and request ids are required."""
    named = {c: F.col(c) for c in ("DESCRIPTION", "INITIATED_BY", "PRIORITY", "ADDRESS", "COMMUNITY", "DISTRICT", "REQUEST_CATEGORY", "RESOLUTION",
                                   "LATITUDE", "LONGITUDE", "STATUS", "DEPT_RESPONSIBILITY", "WORK_ORDER")}
    return features.select(
        _required("ObjectId").alias("object_id"), _required("REQUEST_ID").alias("request_id"),
        C.epoch_to_utc(F.col("DATE_INITIATED")).alias("date_initiated"), C.epoch_to_utc(F.col("DATE_CLOSED")).alias("date_closed"),
        *[c.alias(n.lower()) for n, c in named.items()],
    )


def custom_field_rows(features: DataFrame) -> DataFrame:
    """As published; null values are kept."""
    return features.select(
        _required("ObjectId").alias("object_id"), _required("REQUESTID").alias("request_id"), F.col("CUSTOM_FIELD_ID").alias("field_id"),
        F.col("CUSTOM_FIELD_NAME").alias("name"), F.col("CUSTOM_FIELD_VALUE").alias("value"),
    )


def census_rows(features: DataFrame) -> DataFrame:
    """Areas with rings and bounding box (null without rings)."""
    return features.select(
        F.col("OBJECTID").alias("object_id"), F.col("DAUID").alias("dauid"), F.col("DAPOP2021").alias("people"), F.col("DATDWELL20").alias("dwellings"),
        F.col("CSDNAME").alias("subdivision"), F.col("CDNAME").alias("division"), "rings", *box_of(F.col("rings")),
    )


def _required(name: str) -> Column:
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"{name} is missing")).cast("long"))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``; a local session without one gets a
    temporary folder, a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("placewise.work", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("placewise.work", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows written and read again, so that what is derived from them several times is worked out once."""
    return settled_and_counted(df, name)[0]


def settled_and_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """As ``settled``, with the number of rows, observed as they are written."""
    path, watch = work_folder(df.sparkSession, name), Observation()
    df.observe(watch, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), watch.get["n"] or 0


CALL_COLUMNS = ["object_id", "request_id", "date_initiated", "date_closed", "address", "community", "district", "latitude", "longitude", "initiated_by"]


def scan_calls(spark: SparkSession, path: str) -> DataFrame:
    """The ten columns that derivations need."""
    return spark.read.parquet(path).select(*CALL_COLUMNS)


def scan_areas(spark: SparkSession, path: str) -> DataFrame:
    """Areas with geometry; dwellings and people default to 0."""
    rows = spark.read.parquet(path).filter("size(rings) > 0 and min_lon is not null")
    return rows.fillna(0, ["dwellings", "people"])


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A list written as CSV, all columns as text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def write_list(rows: DataFrame, path: str) -> None:
    """A ranked list as one CSV file with a header. Lists are short: a row per place."""
    rows.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def write_by_type(rows: DataFrame, path: str, kind: str = "canonical_type") -> None:
    """A subdirectory of CSV per type."""
    rows.withColumn("slug", C.slug(F.col(kind))).repartition("slug").write.partitionBy("slug").option("header", True).csv(path)


def replace_snapshot(spark: SparkSession, rows: DataFrame, root: str, version: str) -> None:
    """Write a whole version beside the others, then append it to the pointer table: readers see the old or the new.

    The folder is named by the version and a number of its own, so a version that is landed twice overwrites nothing.
    """
    folder = f"version={version}-{uuid.uuid4().hex[:8]}"
    rows.write.parquet(f"{root}/{folder}")
    pointer = spark.createDataFrame([(version, folder)], "version string, folder string").withColumn("at", F.current_timestamp())
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/_pointer")


def _pointed(spark: SparkSession, root: str):
    if not exists(spark, f"{root}/_pointer"):
        return None
    return spark.read.parquet(f"{root}/_pointer").agg(F.max_by(F.struct("version", "folder"), F.struct("at", "version")).alias("p")).first()["p"]


def current_version(spark: SparkSession, root: str) -> str | None:
    """The version that the pointer names; None before the first."""
    found = _pointed(spark, root)
    return found and found["version"]


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The current version; it stays readable while a newer one is written."""
    return spark.read.parquet(f"{root}/{_pointed(spark, root)['folder']}")


def append_once(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose key is not stored."""
    spark = rows.sparkSession
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    rows.write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Write the rows over the partitions that they fall in; other partitions keep their files."""
    rows.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


#: The column by which a keyed table is partitioned: the range of keys.
RANGE = "key_range"
#: Ranges that the first rows of a keyed table lie in: about so many at most, or more where each has so many rows.
MOST_RANGES, RANGE_ROWS = 256, 1_000_000


class KeyedTable:
    """A table of one row per key (a number) into which small deltas are merged.

    It is partitioned by ranges of ``width`` keys, so a partition has a bounded number of rows and a delta of recent keys meets few.
    The first merge widens them by powers of two where its rows would lie in more than ``MOST_RANGES`` ranges of fewer than ``RANGE_ROWS`` rows,
    so that files are not many and small; the width is kept beside the table, and who opens it later takes that.
    A merge reads and writes those alone: what they come to is written to a folder beside the table first, then over the
    partitions. A merge that was cut short there is finished from that folder by the next merge or whoever opens the table next, so merging the same
    delta again gives the same table. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str, order: str, width: int = 1_000_000):
        """``order`` is the column by which the last written of rows that repeat a key is told."""
        self.spark, self.path, self.key, self.order, self.width = spark, path.rstrip("/"), key, order, width
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.pending, self.widened = f"{self.path}.pending", f"{self.path}.width"
        self._finish()

    def read(self) -> DataFrame:
        return self._ranges(self.path).drop(RANGE)

    def merge(self, delta: DataFrame) -> None:
        """Rows of new keys are added, rows of keys that are there replace them unless those were written later. An empty delta
        changes nothing. A null key is an error: such a row has no place.
        """
        self._finish()
        key = F.coalesce(F.col(self.key), F.raise_error(F.lit(f"{self.key} is null")).cast(self.schema[self.key].dataType))
        delta = settled(delta.select(*self.schema.names).withColumn(self.key, key), "delta")
        delta = delta.withColumn(RANGE, F.floor(F.col(self.key) / self._width(delta)).cast("long"))
        met = [r[0] for r in delta.select(RANGE).distinct().collect()]  # as many as partitions that are rewritten
        held = self._ranges(self.path).filter(F.col(RANGE).isin(met)).withColumn("_new", F.lit(0))
        rows = held.unionByName(delta.withColumn("_new", F.lit(1)))  # of equally late rows, the delta's
        # Rows of a range meet once, for the merge and for the files.
        last = upsert_by_key(rows.repartition(RANGE), self.key, F.struct(self.order, "_new"), [RANGE]).drop("_new")
        last.write.partitionBy(RANGE).mode("overwrite").parquet(self.pending)
        self._finish()

    def _width(self, delta: DataFrame) -> int:
        """Keys of a range: what the table was begun with; before that, what suits the delta, which is written down first."""
        if not exists(self.spark, self.path):
            some = [F.approx_count_distinct(F.floor(F.col(self.key) / (self.width << i))).alias(f"_{i}") for i in range(0, 40, 2)]
            counted = delta.agg(F.count("*").alias("n"), *some).first()
            most = max(MOST_RANGES, counted["n"] // RANGE_ROWS)
            self.width <<= next((i for i in range(0, 40, 2) if counted[f"_{i}"] <= most), 40)
            self.spark.createDataFrame([(self.width,)], "width long").coalesce(1).write.mode("overwrite").parquet(self.widened)
        elif exists(self.spark, f"{self.widened}/_SUCCESS"):
            self.width = self.spark.read.schema("width long").parquet(self.widened).first()["width"]
        return self.width

    def _ranges(self, path: str) -> DataFrame:
        schema = StructType([*self.schema.fields]).add(RANGE, "long")
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _finish(self) -> None:
        """Take over what a merge has written in whole, and remove it; what it left half written is only removed."""
        if exists(self.spark, f"{self.pending}/_SUCCESS"):
            replace_partitions(self._ranges(self.pending).repartition(RANGE), self.path, RANGE)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.pending)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def keep_sample(sample: DataFrame, path: str) -> None:
    """A version's sample, kept once for its layer and edit time: keeping it again replaces it, other versions' files are left alone."""
    replace_partitions(sample.withColumn("version", F.date_format("edited_at", "yyyyMMdd'T'HHmmss")), path, "layer", "version")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    schema = "edited_at timestamp_ntz, business_key string, object_id long, layer string, version string"
    return spark.read.schema(schema).parquet(path).select("layer", "edited_at", "business_key", "object_id")


MICROS = "_us"


def write_counted(rows: DataFrame, path: str, *by: str) -> None:
    """Rows whose counts, least and greatest values can be had from file footers alone (``read_counted``).

    Spark reads numbers there, not timestamps, so each timestamp has its microseconds beside it.
    """
    micros = {c + MICROS: F.unix_micros(F.col(c).cast("timestamp")) for c, t in rows.dtypes if t.startswith("timestamp")}
    rows.withColumns(micros).write.partitionBy(*by).mode("overwrite").parquet(path)


def read_counted(spark: SparkSession, path: str) -> DataFrame:
    """The table by Spark's second interface for sources, to which counts, minima and maxima are handed down: no rows are
    read for them, whether of all rows or by partition."""
    v1 = "spark.sql.sources.useV1SourceList"
    before = spark.conf.get(v1)
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    spark.conf.set(v1, ",".join(s for s in before.split(",") if s != "parquet"))
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(v1, before)


BUCKET_BYTES = 128 << 20
LEAST_BUCKETS = 8


def size_and_time(spark: SparkSession, paths: list[str]) -> tuple[int, int]:
    """Bytes of the files below the paths, and when the last path was changed."""
    size = newest = 0
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        size += fs.getContentSummary(at).getLength()
        newest = max(newest, fs.getFileStatus(at).getModificationTime())
    return size, newest


def buckets_for(size: int) -> int:
    """A power of two, so that tables of different size can still be joined bucket by bucket."""
    n = LEAST_BUCKETS
    while n * BUCKET_BYTES < size:
        n *= 2
    return n


def store_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """The rows as a table of the session's catalogue, in ``buckets`` files by a hash of ``key``, sorted by it.

    Joins and aggregates on the key read tables of one number of buckets where they lie, without a shuffle.
    """
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).saveAsTable(name)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS NOSCAN")
    return spark.table(name)
