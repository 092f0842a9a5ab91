"""A panel stored for ordered work: in buckets by ticker, sorted by time, with its group sizes beside it.

Rolling features over a stored panel need no shuffle, since every ticker lies in one bucket, and no look at the data to know how large its
groups are. A ticker too long for one task still takes the block layouts.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators.ordered import Sizes, bounded_by
from panelforge.session import max_group_rows, stored

#: Rows that a bucket should hold, about.
BUCKET_ROWS = 2_000_000
_KEYS = (("ticker",), ("timestamp",), ())


@dataclass(frozen=True)
class PanelStore:
    """Where a stored panel lies, and what was measured when it was written."""

    path: str
    buckets: int
    schema: str
    sizes: dict[tuple[str, ...], Sizes]

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """The panel under a table name of this session, which knows its buckets."""
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({self.schema}) USING parquet CLUSTERED BY (ticker) SORTED BY (ticker, timestamp) "
                  f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'")
        return spark.table(f"`{name}`")

    @contextmanager
    def known(self, growth: float = 1.0):
        """Operators called inside take the stored sizes instead of counting; ``growth`` as in ``bounded_by``."""
        with bounded_by(lambda: self.sizes, growth):
            yield


def write_panel(df: DataFrame, path: str, name: str, bucket_rows: int = BUCKET_ROWS) -> PanelStore:
    """Write a panel and register it as table ``name``; a bucket is one file. Rows of a ticker that repeat a timestamp are kept."""
    spark = df.sparkSession
    rows = stored(df)
    per = {keys: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) for keys in _KEYS}
    sizes = {}
    for keys, counts in per.items():
        largest, total, groups = counts.agg(F.max("n"), F.sum("n"), F.count("n")).first()
        sizes[keys] = Sizes(largest or 0, total or 0, groups or 0)
    buckets = max(1, math.ceil(sizes[()].total / min(bucket_rows, max_group_rows(spark))))
    # Dealt as the buckets are, so a task writes one of them.
    rows.repartition(buckets, "ticker").write.format("parquet").bucketBy(buckets, "ticker").sortBy("ticker", "timestamp").option(
        "path", f"{path}/rows").mode("overwrite").saveAsTable(name)
    store = PanelStore(path, buckets, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), sizes)
    told = [("|".join(k), s.largest, s.total, s.groups, store.buckets, store.schema) for k, s in sizes.items()]
    spark.createDataFrame(told, "keys string, largest bigint, total bigint, groups bigint, buckets int, columns string").coalesce(1).write.mode("overwrite").json(f"{path}/sizes")
    return store


def read_panel(spark: SparkSession, path: str) -> PanelStore:
    """What ``write_panel`` left at ``path``; ``table`` gives its rows."""
    rows = spark.read.schema("keys string, largest bigint, total bigint, groups bigint, buckets int, columns string").json(f"{path}/sizes").collect()  # three rows
    sizes = {tuple(k for k in r["keys"].split("|") if k): Sizes(r["largest"], r["total"], r["groups"]) for r in rows}
    return PanelStore(path, rows[0]["buckets"], rows[0]["columns"], sizes)
