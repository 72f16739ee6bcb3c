"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import shared_folder, small_batches  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder; every executor can read it again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def times(df: DataFrame, n: str, most: int = 1000) -> DataFrame:
    """Each row `n` times (a column that goes), with _i from 1; no row makes an array of more than about `most` or n / most places."""
    blocks = df.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(most).cast("long"))))
    return blocks.withColumn("_i", F.explode(F.sequence(F.col("_b") + 1, F.least(F.col("_b") + most, F.col(n))))).drop("_b", n)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def checked_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Hint a broadcast only where the counted rows are within `most`; otherwise the join shuffles."""
    return F.broadcast(df) if rows <= most else df


def running_total(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """Exclusive prefix sum of `value` in the total order `order`, without a single-task window.

    Rows are range-partitioned; each partition's sum is one row, so the only global step
    sees as many rows as there are partitions.
    """
    ranged = df.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_pid"), value.cast("long").alias("_val"))
    ranged = cut(ranged)
    sums = ranged.groupBy("_pid").agg(F.sum("_val").alias("_sum"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_pid", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(F.broadcast(starts), "_pid")
        .withColumn(out, F.col("_base") + F.coalesce(F.sum("_val").over(inside), F.lit(0)))
        .drop("_pid", "_val", "_base")
    )
