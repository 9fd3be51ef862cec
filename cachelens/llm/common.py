"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cachelens.session import load_table, materialize  # noqa: F401  (for the operators)

#: White space of all contracts: the ASCII characters that ``bytes.split`` and ``bytes.strip`` take.
ASCII_SPACE = " \t\n\r\x0b\x0c"
#: Rows of a batch that a function sees at a time.
ROWS_AT_ONCE = 1_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "documents")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function of one record batch; empty batches give nothing. A batch is
    worked on in slices, so that a task holds the results of ``ROWS_AT_ONCE`` rows only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                out = fn(batch.slice(at, ROWS_AT_ONCE))
                if out is not None and out.num_rows:
                    yield out
            pa.default_memory_pool().release_unused()  # a worker lives through many tasks

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def content_key(text: Column) -> list[Column]:
    """Two independent 64-bit digests of a text (null: empty): a key for equal contents."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole), F.xxhash64(F.lit(7), whole)]


class Memo(dict):
    """Results of a pure function by argument, ``limit`` of them at most.

    ``map(memo.__getitem__, keys)`` runs at dictionary speed where keys repeat. When half the
    limit is held, these entries become the older half and the oldest go; an older entry that
    is asked for again moves to the younger half, so frequent ones stay.
    """

    def __init__(self, fn: Callable, limit: int = 400_000):
        super().__init__()
        self.fn, self.half, self.older = fn, limit // 2, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.fn(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


_held: dict = {}


def held(key: tuple, make: Callable):
    """``make()``, kept in the worker until another key is asked for: a worker that goes on to the
    next stage holds one vocabulary with its memos, not those of all stages."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def longs(values) -> pa.Array:
    """Unsigned 64-bit numpy values as signed Spark longs with the same bits."""
    return pa.array(np.ascontiguousarray(values, np.uint64).view(np.int64))
