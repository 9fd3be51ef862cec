"""The cleaning pipeline over ``documents``: quality rules, line dedup, SimHash near-dedup,
substring dedup, best-fit packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as
Parquet to the shared folder and hands it, reread, to the next stage. All stages but the last
return the columns of ``documents`` (``n_chars`` follows the text). SQL cannot say the stages' models,
fingerprints and packing, so there is no oracle; ``tests/llm`` holds the operators of the stages against
brute-force versions and the chain of stages by its columns, row counts and empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelens.llm import op1_simhash, op4_lines, op5_packing, op7_quality, op8_substrings
from cachelens.session import load_table, materialize

ORACLE_SQL = None


def _with_text_of(docs: DataFrame, done: DataFrame) -> DataFrame:
    """``done`` with the columns of ``docs`` alone, by position, and ``n_chars`` of the new texts."""
    n = len(docs.columns)
    out = done.toDF(*docs.columns, *(f"__extra{i}" for i in range(len(done.columns) - n))).select(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands."""
    return op7_quality.keep_good(docs, public_tokenizers.path("piece_bpe_32k.model"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds."""
    return _with_text_of(docs, op4_lines.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash component."""
    return op1_simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that start more than once; other texts stay as they are."""
    return _with_text_of(docs, op8_substrings.remove_repeated(docs, only_changed=True))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in sequences of 2048 tokens."""
    return op5_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
