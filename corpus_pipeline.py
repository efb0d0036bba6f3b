"""Corpus pipeline: quality, near-duplicates, benchmark decontamination, personal data, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of ``documents``. A stage's result is written and read again before the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlens.llm import bpe, decontaminate, pii, quality, similar
from boxlens.llm.common import read
from boxlens.session import materialize

RANKS = "byte_bpe_multi_50k.tiktoken"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores at least one half; the model learns from the labels that are not held out.

    Null and empty texts have statistics of zero and are scored like any other, very long ones
    as a whole. Repeated rows are judged alike. Rows without an id have no label to learn from;
    an empty table stays empty; other columns are passed through unread.
    """
    stats = materialize(quality.statistics_of(docs), "statistics")
    return quality.keep_good(docs, quality.fit(stats, read(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: that with the least id, a named one before one without an id.

    Near-duplicates have a similarity of 0.8 or more between their sets of five-word shingles, or
    are joined by a chain of such pairs; 256-bit SimHashes say which pairs are worth a look at whole
    texts (see ``similar``). Rows that repeat an id are judged by their own texts. Null and empty
    texts are one group; very long texts are read whole; an empty table stays empty; columns
    other than id and text are passed through unread.
    """
    return similar.one_per_group(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of a benchmark text.

    Rows are judged by their texts (hashed to 64 bits), whatever their ids: null ids and repeats
    of an id stay if their own text is clean. Null and empty texts are clean; very long texts are read whole; an empty
    table stays empty; columns other than the text are passed through unread.
    """
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = decontaminate.contamination(keyed, read(spark, sf_dir, "benchmark"))
    hit = materialize(found.filter(F.size("hits") > 0).select(F.col("id").alias("text_key")).distinct(), "contaminated")
    return docs.join(hit, F.xxhash64(docs["text"]) == hit["text_key"], "left_anti")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets and ``n_chars`` set anew where a text changed.

    Null and empty texts, and rows without personal data, stay as they are; ids and repeats do
    not matter; very long texts are read whole; an empty table stays empty.
    """
    return pii.redact(docs, pii.learn(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them.

    A row per row: null and empty texts give no ids, a null id stays null, repeats come back as
    often, very long texts are encoded whole, and an empty table gives an empty result.
    """
    coded = bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", clean_of_benchmarks),
    ("personal data", without_personal_data),
    ("byte-level BPE", tokens),
]

#: Learned scores, spans and merges have no SQL form; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialize(docs, f"stage{number}")
    return docs
