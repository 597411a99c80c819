"""A corpus pipeline: each stage takes the documents the one before it kept.

Language identification drops documents without an identified language; line dedup takes repeated runs of
lines out of the texts; the n-gram Jaccard join keeps one document of each group of near copies;
decontamination drops documents that hold benchmark passages; encoding gives the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import common, decontaminate, language_id, line_dedup, ngram_join, piece_codec


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found and not another than the declared one; those with null, empty or foreign texts go, an empty table stays empty. All columns stay."""
    model = language_id.fit_text_model(docs, "text", "lang")
    judged = language_id.identify(docs, model, declared="lang", host="source", prefix="_")
    return judged.where("_keep").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that stand earlier; all documents and columns stay, n_chars is counted anew, null texts stay null."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; documents without words are in no group. All columns stay."""
    return ngram_join.keep_one(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none. All columns stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, items).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of every document; a null text has null for both, an empty one no ids."""
    return piece_codec.encode(docs.select("doc_id", "text")).select("doc_id", "ids", F.size("ids").alias("n_tokens"))


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table ``documents``, the result of each but the last in a table of its own until the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        kept = common.stored(f(spark, docs, sf_dir), f"pipeline-{name}")
        if hasattr(docs, "stored_at"):
            common.discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
