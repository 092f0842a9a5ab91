"""Session settings shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Largest ordered group (one ticker's history, one timestamp's cross-section)
# that a single task may hold. Beyond it operators use the block layouts in
# ``operators.ordered``.
GROUP_ROWS_KEY = "spark.panelforge.maxGroupRows"
GROUP_ROWS_DEFAULT = 1_000_000

# Largest table that may be broadcast, in rows (after a count).
BROADCAST_ROWS_KEY = "spark.panelforge.maxBroadcastRows"
BROADCAST_ROWS_DEFAULT = 200_000


# Source rows of one shuffle partition, about. A sort holds its partition, so their number has to follow the input.
PARTITION_ROWS_KEY = "spark.panelforge.partitionRows"
PARTITION_ROWS_DEFAULT = 100_000
MAX_PARTITIONS = 20_000
FIRST_PARTITIONS_KEY = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def build_session(
    app: str = "panelforge", master: str | None = None, shuffle: int | None = None, settings: dict[str, str] | None = None
) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master)
    if shuffle:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle))
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on; partition counts stay the cluster's choice."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def partitions_of(spark: SparkSession, rows: int) -> int:
    """Partitions for ``rows`` rows that are dealt once and gone through many times: of bounded size, and few enough that starting tasks costs little."""
    wanted = -(-rows // int(spark.conf.get(PARTITION_ROWS_KEY, str(PARTITION_ROWS_DEFAULT))))
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return min(max(wanted, few), MAX_PARTITIONS)


def size_partitions(spark: SparkSession, rows: int) -> None:
    """Let shuffles over tables of ``rows`` rows begin with partitions of bounded size; adaptive execution puts small ones together.

    The cluster's own numbers are only raised, never lowered, and where it does not put partitions together they stay.
    """
    wanted = min(-(-rows // int(spark.conf.get(PARTITION_ROWS_KEY, str(PARTITION_ROWS_DEFAULT)))), MAX_PARTITIONS)
    own = spark.conf.get(FIRST_PARTITIONS_KEY, None) or spark.conf.get("spark.sql.shuffle.partitions")
    if wanted > int(own):
        spark.conf.set(FIRST_PARTITIONS_KEY, str(wanted))


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS_KEY, str(GROUP_ROWS_DEFAULT)))


def max_broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_ROWS_KEY, str(BROADCAST_ROWS_DEFAULT)))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; a scratch one only where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="panelforge-")
    context.setCheckpointDir(folder)


def stored(df: DataFrame) -> DataFrame:
    """Write an intermediate that several later steps read to the checkpoint folder, once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate as a table by columns, for steps that read a few of them at a time."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
