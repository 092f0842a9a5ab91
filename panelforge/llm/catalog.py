"""Registered queries of the text operators, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import (
    chat, decontaminate, html_text, language, manifest, mixing, pii, quality_knn, quality_rules, simhash, sql, tokens, toxicity, warc,
)
from panelforge.llm.common import read, remainder


def op1_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of the maximal conversations, rendered."""
    return chat.format_chats(read(spark, folder, "conversations"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return quality_rules.cascade(docs).drop("text")


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents"))


def op4_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    """Revisits of the capture log made from ``pages``."""
    return warc.resolve(warc.captures(read(spark, folder, "pages")))


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    held = remainder("doc_id", 3) == 1
    space = quality_knn.learn(docs, labels.where(~held), "quality")
    return quality_knn.score(docs.select("doc_id", "text"), space).select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(read(spark, folder, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        # One parameter only: a second one would be the place in the array.
        return F.size(F.filter(F.split("base_spans", ","), lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    held = remainder("doc_id", 5) == 0
    model = toxicity.learn(docs, labels.where(~held), "toxic")
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.decontaminate(
        read(spark, folder, "documents"), read(spark, folder, "benchmark"), near_terms=decontaminate.NEAR_TERMS, slop=decontaminate.SLOP)
    hit = decontaminate.n_hit()
    return found.withColumn("n_hit", hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"), F.sha2(F.array_join("near_items", ","), 256).alias("near_sha256"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(read(spark, folder, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",").alias("shards"))


def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(read(spark, folder, "pages").select("page_id", "url", "html"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    aligned = tokens.align(read(spark, folder, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    counts = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps"]
    return tokens.consistency(aligned.select("doc_id", *counts, digest, "pairs", "times")).select(
        "doc_id", *counts[:4], "n_best", "count_sum", "groups_sha256", "n_overlaps")


def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    found = manifest.manifest(read(spark, folder, "documents"), check={"text": manifest.tampered("text", "doc_id")})
    return manifest.verify(found).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op13_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    held = remainder("doc_id", 4) == 2
    model = language.learn(docs.where(~held))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_chat_formatting, op2_quality_rules, op3_simhash, op4_warc_revisits, op5_quality_classifier, op6_pii, op7_toxicity, op8_decontamination, op9_mixing, op10_html_extraction,
           op11_alignment, op12_manifest, op13_language]
    return {**{f.__name__: f for f in own}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": sql.CHAT, "op2_quality_rules": sql.QUALITY_RULES, "op4_warc_revisits": sql.WARC, "op8_decontamination": sql.DECONTAMINATION,
            "op12_manifest": sql.MANIFEST}
