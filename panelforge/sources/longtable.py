"""Reading, cleaning and writing the long observation table (timestamp, ticker, feature, value)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.columns import INGEST_ORDER, finite

SCHEMA = "timestamp bigint, ticker string, feature string, value double"
YEAR_2000_MS = 946_684_800_000


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Long CSV with a header, and ``ingest_order``; empty fields and ``null`` are missing."""
    return tidy(in_file_order(spark.read.schema(SCHEMA).option("header", True).option("nullValue", "null").csv(path)))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return tidy(in_file_order(spark.read.schema(SCHEMA).parquet(path)))


def in_file_order(read: DataFrame) -> DataFrame:
    """Add ``ingest_order``: file, place of the split in it, place of the row in the split. Of repeated observations the reshape takes the last.

    ``read`` comes straight from a reader of files.
    """
    return read.select("*", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")).alias(INGEST_ORDER))


def tidy(long: DataFrame) -> DataFrame:
    """Fixed types; the missing ticker becomes the empty string. ``ingest_order`` is kept where there is one."""
    kept = [INGEST_ORDER] if INGEST_ORDER in long.columns else []
    return normalise_nulls(long.select(
        F.col("timestamp").cast("bigint").alias("timestamp"),
        F.coalesce(F.when(F.col("ticker") != "null", F.col("ticker")), F.lit("")).alias("ticker"),
        F.col("feature").cast("string").alias("feature"), F.col("value").cast("double").alias("value"), *kept,
    ))


def normalise_nulls(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating column."""
    return df.select(*[
        finite(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def since_2000(df: DataFrame) -> DataFrame:
    return df.filter(F.col("timestamp") >= YEAR_2000_MS)


def union_observations(sources: Sequence[DataFrame]) -> DataFrame:
    """All sources' observations without missing values or exact repeats."""
    return reduce(DataFrame.unionByName, sources).filter("value is not null").dropDuplicates(
        ["timestamp", "ticker", "feature", "value"])


def text_rows(long: DataFrame) -> DataFrame:
    """Content of the written file: separators in text become dashes, a missing ticker ``null``, a missing time -1."""
    def safe(c):
        return F.regexp_replace(c, "[,\\n\\r]", "-")

    return long.select(
        F.coalesce("timestamp", F.lit(-1)).alias("timestamp"), F.coalesce(safe("ticker"), F.lit("null")).alias("ticker"),
        safe("feature").alias("feature"), "value",
    )


def write_csv(long: DataFrame, path: str, mode: str = "overwrite") -> None:
    text_rows(long).write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Store a panel or feature table for later runs."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_results(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Predictions, quantile rows and return series as csv or parquet; metric rows as json."""
    writer = df.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
