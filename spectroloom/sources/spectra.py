"""Spectra from files and from relational tables, and sinks for features and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectroloom.operators.matrix import vectors
from spectroloom.sources import versions


def read_vectors(spark: SparkSession, path: str, row_id: str, x: str, format: str = "parquet") -> DataFrame:
    """``(row_id, x)`` of a file of vectors."""
    return vectors(spark.read.format(format).load(path), row_id, x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, x, label)`` of the embeddings table."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def spectra(df: DataFrame, row_id: str, channel: Column, value: Column, size: int) -> DataFrame:
    """Long records as zero-filled vectors: the sum of ``value`` at each channel 0 to ``size`` - 1.

    Two aggregations: sums by (row, channel), with partial sums before the shuffle, then one map a row.
    Records without a row id or a channel (a null date, say) add nothing and make no row; a channel
    outside the range is an error.
    """
    found = df.select("*", F.col(row_id).cast("long").alias("_row"), channel.cast("int").alias("_channel")).where("_row is not null and _channel is not null")
    inside = F.when(F.col("_channel").between(0, size - 1), F.col("_channel")).otherwise(F.raise_error(F.lit(f"a channel is not in 0 to {size - 1}")).cast("int"))
    sums = found.groupBy(F.col("_row").alias("row_id"), inside.alias("channel")).agg(value.alias("v"))
    held = sums.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("channel", "v"))).alias("m"))
    return held.select("row_id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0.0))).alias("x"))


def part_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's revenue by month of the year."""
    return spectra(table(spark, sf_dir, "lineitem"), "l_partkey", F.month("l_shipdate") - 1, F.sum("l_extendedprice"), 12)


def supplier_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's revenue by calendar month, from the table's first to its last."""
    lines, month = table(spark, sf_dir, "lineitem"), F.year("l_shipdate") * 12 + F.month("l_shipdate")
    first, last = lines.agg(F.min(month), F.max(month)).first()
    return spectra(lines, "l_suppkey", month - (first or 0), F.sum("l_extendedprice"), (last or 0) - (first or 0) + 1)


def user_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events by hour of the day."""
    return spectra(table(spark, sf_dir, "events"), "user_id", F.hour("ts"), F.count("*").cast("double"), 24)


def write_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").parquet(path)


def append_history(spark: SparkSession, path: str, run_id: str, record: dict) -> None:
    """Add a record of a run to a history of JSON lines."""
    versions.append(spark, path, run_id, record)


def read_history(spark: SparkSession, path: str, run_id: str) -> list[dict]:
    """A run's records in order; broken records are passed over (``versions.history`` also counts them)."""
    return versions.history(spark, path, run_id)[0]
