"""The corpus pipeline: each stage is written as Parquet and read again as the next one's documents.

Every stage keeps whole rows, extra columns included, and handles null ids and texts as its operator does. Stages but
the last return the columns of documents. ORACLE_SQL is None: of the stages only the third could be written in SQL, so the tests hold each
against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import decontaminate, mixing, pii, quality_knn, simhash
from panelforge.llm.common import read, remainder, stored
from panelforge.session import shared_folder

#: Most keys that the third stage sends to all tasks; beyond it a plain join removes them.
BROADCAST_IDS = 100_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from labels outside the held-out third."""
    space = quality_knn.learn(docs, read(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1), "quality")
    scored = quality_knn.score(docs, space, names=("__score", "__predicted"))
    return scored.where("__predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest (doc_id, hash of the text) stays, once."""
    keyed = docs.withColumn("__key", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")))
    classes = simhash.near_duplicates(keyed, id_col="__key")
    first = classes.where("doc_id = component_id").select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(first, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a twentieth of their words in benchmark passages go. The key holds the text, so clean rows that share an id with them, or have none, stay."""
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    found = decontaminate.decontaminate(keyed, read(spark, sf_dir, "benchmark"), id_col="__key")
    bad = stored(found.where(decontaminate.contaminated(decontaminate.n_hit(), F.col("n_words"))).select(F.col("doc_id").alias("__key")).distinct())
    if bad.count() <= BROADCAST_IDS:
        bad = F.broadcast(bad)
    return keyed.join(bad, "__key", "left_anti").select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: a row for each draw of a document, dealt to its shard and in the shard's order; ``words`` is its size.

    Documents stay whole: the one per source of which the target takes a part is taken or left out, whichever is nearer. Columns of the
    documents that are named like those added here (shard, pass, words, place) are kept with ``doc_`` before their name.
    """
    names, added = list(docs.columns), ["shard", "pass", "words", "place"]
    drawn = mixing.shards(mixing.mix(docs, carry=tuple(names))).where(2 * F.col("words") >= F.col("size"))
    kept = []
    for c in names:
        as_name = c
        while as_name in added or as_name != c and as_name in names:
            as_name = f"doc_{as_name}"
        kept.append(F.col(f"row.`{c}`").alias(as_name))
    return drawn.select(*kept, "shard", "pass", F.col("size").alias("words"), "place")


STAGES = [
    ("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", private), ("mixing", mixture),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
