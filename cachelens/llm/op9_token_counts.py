"""Token counts through a cache keyed by content and tokenizer digests.

The content of a text is normalised as far as the tokenizer cannot tell the difference (runs of
ASCII white space, for tokenizers that drop it), digested with SHA-256, and looked up in a
Parquet table of counts stored by (tokenizer digest, content digest). Only distinct contents that the
table lacks are encoded, one representative row each, and their counts are appended. The digest of a
tokenizer covers its file and its library's version, so another vocabulary never meets old counts.

Without ``cache`` a new table is made in the shared folder. Defined cases: a null text counts
as empty (0 bytes, 0 tokens); null ids and repeated rows pass through; an empty table gives an
empty result and appends nothing; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cachelens.llm.common import map_batches, materialize, text_bytes
from cachelens.llm.vocab import encode_words
from cachelens.session import scratch_path

CACHE_SCHEMA = "tokenizer string, content binary, n_tokens long"


def tokenizer_digest(path: str, library: str = "tokenizers") -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library} {version(library)}".encode()).hexdigest()


def content_digest(text: Column) -> Column:
    """SHA-256 of a text with each run of ASCII white space as one space and none at the ends."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", " "))
    return F.unhex(F.sha2(plain, 256))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, cache: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row."""
    spark = docs.sparkSession
    cache = cache or scratch_path(spark, "token-counts")
    own = F.lit(tokenizer_digest(path))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)  # a new table may have no files yet
    text = F.col(text_col)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), content_digest(text).alias("content"))
    keyed = materialize(
        named.select("doc_id", "content", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "contents")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == own)
    misses = (
        keyed.groupBy("content").agg(F.min("doc_id").alias("first_id"))
        .join(stored.select("content"), "content", "left_anti")
        .select(F.col("content").alias("missing"), "first_id")
    )
    todo = named.join(misses, (F.col("content") == F.col("missing")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("content", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = [len(encode_words(path, t)) // 4 for t in text_bytes(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["content", "n_tokens"])

    encoded = map_batches(todo, run, "content binary, n_tokens long")
    encoded.select(own.alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)
    # one row per content, written apart from the join: its sides can then be split where many
    # rows share a content
    counts = materialize(
        spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == own)
        .groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return keyed.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
