"""Files: bundle listings, the legacy store, and queue folders as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import media_kind

MESSAGE = T.StructType([
    T.StructField("queue", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("message_type", T.StringType()),
    T.StructField("job_id", T.StringType()), T.StructField("idempotency_key", T.StringType()), T.StructField("created_at_ms", T.LongType()),
    T.StructField("attempt", T.LongType()),
])
RESOLUTION = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("keep", T.LongType())])
LEGACY = T.StructType([
    T.StructField("scan_id", T.StringType()), T.StructField("video", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("expected_count", T.LongType()), T.StructField("updated_at_ms", T.LongType()), T.StructField("resolved_duplicates", T.StringType()),
])


def pack(files: DataFrame, folder: str, path: str = "path", content: str = "content") -> None:
    """Many small files as the rows of one table, in the shape that Spark's reader of binary files gives: path, modificationTime, length, content.

    A store of a file each costs a few operations of the file system, and a place in the driver's list, for every file; here both
    depend on the bytes alone. `listing` reads either.
    """
    data = F.col(content).cast("binary")
    rows = files.select(F.col(path).alias("path"), F.current_timestamp().alias("modificationTime"), F.octet_length(data).cast("long").alias("length"), data.alias("content"))
    rows.write.option("parquet.block.size", 16 << 20).parquet(folder)


def listing(spark: SparkSession, folder: str, packed: bool = False, nested: bool = False, ending: str = "") -> DataFrame:
    """path, modificationTime, length and content of a folder's files (nested: of its folders too), or of the files that `pack` wrote there.

    Spark's reader of binary files leaves out those without a byte; packed ones are all listed.
    """
    if packed:
        return spark.read.schema("path string, modificationTime timestamp, length long, content binary").parquet(folder).filter(F.col("path").endswith(ending))
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(nested).lower()).option("pathGlobFilter", f"*{ending}").load(folder)


def bundle_listing(spark: SparkSession, folder: str, manifest: str = "manifest.json", packed: bool = False) -> DataFrame:
    """The JSON bundles of a folder with size, time and content, without the manifest. Contents are read only if selected."""
    named = listing(spark, folder, packed, ending=".json").withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    return named.filter(F.col("file_name") != manifest).select(
        "file_name", "path", F.col("length").alias("bytes"), F.unix_millis("modificationTime").alias("modified_at_ms"), "content"
    )


def media(spark: SparkSession, folder: str, packed: bool = False) -> DataFrame:
    """Media files of a folder with their kind and content; contents are read only if selected."""
    return listing(spark, folder, packed, nested=True).select("path", media_kind(F.col("path")).alias("kind"), F.col("length").alias("bytes"), "content")


def resolutions(text: str) -> Column:
    """Resolved duplicates of a stored text: objects, or legacy pairs [a, b] that keep a."""
    objects = F.from_json(text, T.ArrayType(RESOLUTION))
    pairs = F.from_json(text, T.ArrayType(T.ArrayType(T.LongType())))
    old = F.transform(pairs, lambda p: F.struct(p[0].alias("a"), p[1].alias("b"), p[0].alias("keep")))
    return F.when(F.col(text).rlike(r"^\s*\[\s*\["), old).otherwise(objects)


def legacy_store(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of the legacy JSON store, one object per line."""
    rows = spark.read.schema(LEGACY).json(path)
    return rows.withColumn("resolved_duplicates", resolutions("resolved_duplicates"))


def queue_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Messages as they arrive in a folder of JSON files."""
    return spark.readStream.schema(MESSAGE).json(folder)
