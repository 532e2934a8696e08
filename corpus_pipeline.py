"""Stages that turn raw documents into a training set; each calls one operator of ``tandemrank.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemrank.llm import jaccard, language, lines, mixing, pieces
from tandemrank.llm.common import captured, drop_path, table
from tandemrank.session import materialize

# Shares of each domain's expected tokens that stay: sound documents all, poor ones a half, toxic ones a tenth.
KEEP = {"good": 1.0, "low": 0.5, "toxic": 0.1}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (null, empty, no letters) go."""
    return language.keep_known(docs)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal or nearly equal lines one stays; documents that consist of repeats alone go."""
    return lines.drop_emptied(docs)


def join_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are alike in five-word sequences one stays."""
    return jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poor and toxic documents are thinned out to the target weights."""
    return mixing.thin_out(docs, mixing.label_domains(table(spark, sf_dir, "labels")), KEEP)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    return pieces.round_trip(docs).select("doc_id", "lang", "source", F.col("n_tokens"), "round_trip", "ids")


_BEFORE: list[str] = []


def tidy(stage):
    """``stage``, dropping the scratch tables of the stage before: its result has been written by now and is read as ``docs``."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _BEFORE:
            drop_path(spark, _BEFORE.pop())
        with captured() as mine:
            out = stage(spark, docs, sf_dir)
        _BEFORE.extend(mine)
        return out

    return run_stage


STAGES = [
    ("language_id", tidy(identify_language)), ("line_dedup", tidy(deduplicate_lines)), ("jaccard_join", tidy(join_similar)),
    ("mixing", tidy(mix)), ("sentencepiece", tidy(encode)),
]
# Kernels, word hashes, rates and pieces have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
