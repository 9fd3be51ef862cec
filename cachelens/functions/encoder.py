"""Text -> L2-normalised vector (B5), pluggable.

Default encoder (offline, deterministic): the JVM splits the lower-cased text into word tokens, and an
Arrow-batched UDF gives every distinct token of the batch a bucket and a sign (from its md5, as SQL can
state them), adds +-1 per token into ``dim`` buckets with one count over the flattened batch
(a sparse random projection of the token counts) and normalises. Any ``pandas.Series[str] -> list of vectors`` callable can
replace it (``make_encoder_udf``); with the iterator form a model is loaded once per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_DIM = 64


def tokens(text: Column) -> Column:
    """Word tokens in lower case; the first and the last may be empty."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def token_codes(values: list[str], dim: int = DEFAULT_DIM) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, weight) of each token: from the first 36 bits of its md5; an empty one weighs nothing."""
    bits = np.array([int(hashlib.md5(t.encode()).hexdigest()[:9], 16) for t in values], np.int64)
    weight = np.where(np.array([t == "" for t in values], bool), 0.0, 1.0 - 2.0 * (bits % 2))
    return (bits >> 4) % dim, weight


def sql_text_vector(table: str, dim: int = DEFAULT_DIM) -> str:
    """DuckDB CTE ``vec`` (doc_id, s: list of ``dim`` signed counts) of the texts of ``table``."""
    return f"""
tok AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 9))::BIGINT AS bits
        FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM {table}) WHERE t <> ''),
cnt AS (SELECT doc_id, (bits >> 4) % {dim} AS i, sum(CASE WHEN bits % 2 = 1 THEN -1 ELSE 1 END)::DOUBLE AS v FROM tok GROUP BY ALL),
vec AS (SELECT d.doc_id, list(coalesce(c.v, 0.0) ORDER BY g.i) AS s
        FROM {table} d CROSS JOIN range({dim}) g(i) LEFT JOIN cnt c ON c.doc_id = d.doc_id AND c.i = g.i GROUP BY d.doc_id)"""


def _hash_udf(dim: int):
    @F.arrow_udf("array<float>")
    def encode(toks: pa.Array) -> pa.Array:
        n = len(toks)
        rows = np.repeat(np.arange(n), toks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        coded = toks.flatten().dictionary_encode()
        bucket, weight = token_codes(coded.dictionary.to_pylist(), dim)
        at = coded.indices.to_numpy(zero_copy_only=False)
        v = np.bincount(rows * dim + bucket[at], weights=weight[at], minlength=n * dim).astype(np.float64).reshape(n, dim)
        size = np.sqrt((v * v).sum(axis=1, keepdims=True))
        v = np.divide(v, size, out=v, where=size > 0).astype(np.float32)
        return pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), dim).cast(pa.list_(pa.float32()))

    return encode


def embed_text(text: Column, dim: int = DEFAULT_DIM, encoder: Callable | None = None) -> Column:
    """Column of L2-normalised ``ARRAY<FLOAT>`` vectors for ``text``."""
    if encoder is not None:
        return make_encoder_udf(encoder)(text)
    return _hash_udf(dim)(tokens(text))


def make_encoder_udf(encode_batch: Callable[[pd.Series], list]):
    """Wrap a batch encoder (texts -> vectors) as an iterator pandas UDF that normalises."""
    @F.pandas_udf("array<float>")
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vecs = np.asarray(encode_batch(texts.fillna("")), dtype=np.float64)
            norms = np.linalg.norm(vecs, axis=1, keepdims=True)
            norms[norms == 0] = 1.0
            yield pd.Series(list((vecs / norms).astype(np.float32)))
    return enc
