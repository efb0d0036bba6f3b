"""Queries of the text operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from boxlens.llm import bpe, chat, chunks, decontaminate, fingerprint, licenses, oracles, pii, quality, ranking, repair, secrets, simhash, urls
from boxlens.llm.common import read

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return decontaminate.summary(found).withColumnRenamed("id", "doc_id")


def op3_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.deduplicate(read(spark, sf_dir, "documents"))
    chars = lambda spans: F.aggregate(spans, F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        F.col("id").alias("doc_id"), "text", "shared", "removed", chars("shared").alias("n_shared"), chars("removed").alias("n_removed"),
        (F.size("shared") > 0).alias("repeats"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), said)
    nodes, members = chat.prefix_tree(rows.union(extra))
    return chat.digests(chat.read_back(nodes, members)).withColumnRenamed("conv", "conv_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.summary(pii.find(docs, pii.learn(docs))).withColumnRenamed("id", "doc_id")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.drop("ids").withColumnRenamed("id", "doc_id")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def url_entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Captures and list entries: each page is fetched on a day set by its id, each event changes a list.

    An event names the page with its user's number: its host, the parent domain of a third
    of them, or the host with the first step of the path; one in four takes the pattern off.
    """
    pages, events = read(spark, sf_dir, "pages"), read(spark, sf_dir, "events")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 61).cast("int")).alias("day"))
    host = urls.host_of(F.col("url"))
    pattern = F.when(F.col("event_id") % 3 == 0, F.regexp_replace(host, r"^[^.]*\.", "")).when(F.col("event_id") % 3 == 1, host).otherwise(
        F.concat(host, F.lit("/"), F.split_part(urls.path_of(F.col("url")), F.lit("/"), F.lit(2)), F.lit("/")))
    entries = events.join(pages, F.col("user_id") == F.col("page_id")).select(
        F.concat(F.lit("list"), (F.col("event_id") % 5).cast("string")).alias("list"), pattern.alias("pattern"), (F.col("event_id") % 4 != 0).alias("active"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("event_id") * 7 % 53).cast("int")).alias("day"), F.col("event_id").alias("seq"))
    return captures, entries


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, entries = url_entries(spark, sf_dir)
    return urls.evaluate(captures, urls.intervals(entries)).withColumn("day", F.col("day").cast("string")).withColumnRenamed("id", "page_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return secrets.summary(found).withColumnRenamed("id", "doc_id")


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults dealt by a checksum of conversation and turn; ``copies`` is 2 for a repeated row."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    return rows.filter(way != 0).select(
        "conv_id", "turn", F.when(way == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"), F.when(way == 3, 2).otherwise(1).alias("copies"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    report, turns = repair.repair(damaged(rows), copies_col="copies")
    hashed = repair.digests(turns)
    every = rows.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(report, every["conv_id"].eqNullSafe(report["conv"]), "left").join(hashed, every["conv_id"].eqNullSafe(hashed["conv"]), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": op1_licenses,
        "op2_decontaminate": op2_decontaminate,
        "op3_chunks": op3_chunks,
        "op4_chat": op4_chat,
        "op5_quality": op5_quality,
        "op6_pii": op6_pii,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_fingerprint": op8_fingerprint,
        "op9_urls": op9_urls,
        "op10_simhash": op10_simhash,
        "op11_secrets": op11_secrets,
        "op12_ranking": op12_ranking,
        "op13_repair": op13_repair,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return pipeline | {
        "op1_licenses": oracles.licenses(),
        "op2_decontaminate": oracles.DECONTAMINATE,
        "op4_chat": oracles.CHAT,
        "op9_urls": oracles.URLS,
        "op12_ranking": oracles.RANKING,
    }
