"""Corpus pipeline: five stages, each over all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared checkpoint folder and rereads it for the next
one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodloom.llm import hyperminhash, langid, mixing, spans, viterbi
from moodloom.llm.common import settle


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; those without letters go."""
    return langid.keep_known(docs)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return hyperminhash.one_of_each(docs)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without sentence spans that occurred before; those left empty go."""
    return spans.cleaned(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a document occurs once per use."""
    return mixing.repeated(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every document of the mix."""
    done = viterbi.encode(docs.select("doc_id", "text"), remember=False)
    return done.select("doc_id", F.col("pieces.n_tokens").alias("n_tokens"), F.col("pieces.ids").alias("ids"))


STAGES = [
    ("language", known_language),
    ("near_dedup", one_per_group),
    ("span_dedup", without_passages),
    ("mix", mixed),
    ("encode", encoded),
]

#: SQL has no SentencePiece and no trained classifier; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
