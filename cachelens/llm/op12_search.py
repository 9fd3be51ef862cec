"""Ranked lexical search over K2-treaps of the term-document grid.

1. A scan over the documents counts the items' terms in each text: one narrow row per document with its
   number of terms and its (term, occurrences) pairs, written to the shared folder. The counts
   over all documents (N, L, the documents of each term) are sums over these rows.
2. A task reads ``SHARD_DOCS`` documents at a time, in its partition's order, and files their impacts (the
   part of a score that does not depend on the item) in a grid of terms by documents, as a K2-treap: a quadtree in
   level order, one bit for each quadrant of a cell, children found by rank over the bits, and
   the largest impact of every cell.
3. An item has one row of the grid per term. From the root on, its row paths go down jointly: an
   entry is a range of documents with one cell for each row, and the weighted sum of the
   cells' maxima bounds the score of every document in the range. The ranges with the highest bounds
   are halved first, ``BATCH`` at a time; a range under the k-th best score so far is left out. At
   the leaves the sum is the score. The k best go on from shard to shard of a task.
4. The tasks' k best of each item are merged in two steps, so that no task meets all of them.

Items are searched in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` bytes (counted first),
so what is broadcast and what a task emits is bounded; each block takes a pass over the documents.

Defined cases: a null text has no terms, and such a document or item has no row in the result; documents
with equal scores are ordered by ascending id, null ids last; rows that repeat an id are documents
of their own, and equal rows take a rank each; items that repeat both id and text are one item;
an empty table on either side gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cachelens.llm.common import map_batches, materialize, text_bytes

SHARD_DOCS = 16_384
BLOCK_ITEMS = 2_048
BLOCK_BYTES = 8 << 20
#: Document ranges that are halved at a time.
BATCH = 512
#: Steps of the merge: groups of the first one.
MERGE_GROUPS = 64
LAST_ID = 2**63 - 1

#: Letters and digits in lower case and all other characters beyond ASCII are kept, the rest parts terms.
_TERM_BYTES = bytes(b if chr(b).isalnum() else 32 for b in range(128)).lower() + bytes(range(128, 256))


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(_TERM_BYTES).split()


POSTINGS = "id long, n long, terms binary, counts binary"


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``POSTINGS`` of every document with a term: the numbers of its vocabulary terms and their
    occurrences, packed."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        number = shared.value
        texts = [terms(raw) for raw in text_bytes(batch.column(1))]
        n = np.array([len(t) for t in texts], np.int64)
        known = np.fromiter(map(number.get, chain.from_iterable(texts), repeat(-1)), np.int64, int(n.sum()))
        cell = np.repeat(np.arange(len(n)), n) * (len(number) + 1) + known
        cell, occurs = np.unique(cell[known >= 0], return_counts=True)
        row, term = np.divmod(cell, len(number) + 1)
        ends = np.searchsorted(row, np.arange(len(n) + 1)) * 4
        packed = [x.astype(np.int32).tobytes() for x in (term, occurs)]
        lists = [pa.array([p[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()) for p in packed]
        out = pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n), *lists], ["id", "n", "terms", "counts"])
        return out.filter(pa.array(n > 0))

    return map_batches(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), run, POSTINGS)


def documents_of_terms(postings: DataFrame) -> DataFrame:
    """``term, df``, added up in each batch before the shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        term, df = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(term.astype(np.int64)), pa.array(df.astype(np.int64))], ["term", "df"])

    return map_batches(postings.select("terms"), run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of ``x`` (under 2^31), one place apart."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class K2Treap:
    """Points (row, column, value > 0) of a square grid of side 2^height, each cell at most once."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, height: int):
        self.height = height
        code = (_spread(row) << np.uint64(1)) | _spread(column)
        order = np.argsort(code)
        code, value = code[order], value[order].astype(np.int64)
        maxima, quadrants = [value], []
        for _ in range(height):  # from the leaves up: the cells above and their quadrants
            above = code >> np.uint64(2)
            first = np.flatnonzero(np.r_[True, above[1:] != above[:-1]])
            cell = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(above)]))
            quadrants.append((4 * cell + (code & np.uint64(3)).astype(np.int64), len(first)))
            value = np.maximum.reduceat(value, first)
            code = above[first]
            maxima.append(value)
        self.maxima = np.concatenate(maxima[::-1])
        n_cells = sum(n for _, n in quadrants)
        bits = np.zeros(-(-4 * n_cells // 64) * 64, bool)
        start = 0
        for own, n in quadrants[::-1]:
            bits[4 * start + own] = True
            start += n
        self.bits = np.packbits(bits, bitorder="little").view("<u8")
        self.ranks = np.cumsum(np.r_[0, np.bitwise_count(self.bits[:-1])], dtype=np.int64)

    def child(self, cell: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """The cells (numbered in level order, root 0) in the given quadrants; -1 where nothing is."""
        at = 4 * np.maximum(cell, 0) + quadrant
        word = np.minimum(at >> 6, len(self.bits) - 1)
        bit = (at & 63).astype(np.uint64)
        held = self.bits[word]
        below = held & ((np.uint64(1) << bit) - np.uint64(1))
        found = self.ranks[word] + np.bitwise_count(below).astype(np.int64) + 1
        return np.where((cell >= 0) & ((held >> bit) & np.uint64(1) > 0), found, -1)


class Best:
    """The k best (score, id) of an item: highest score first, ties to the smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.r_[self.score, score], np.r_[self.id, ids]
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]

    def may_enter(self, bound: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        if len(self.score) < self.k:
            return bound > 0
        return (bound > self.score[-1]) | ((bound == self.score[-1]) & (least_id < self.id[-1]))


def search(treap: K2Treap, rows: np.ndarray, weights: np.ndarray, ids: np.ndarray, best: Best, batch: int = BATCH) -> None:
    """Adds to ``best`` what the shard's documents (columns, with ascending ``ids``) score for the rows."""
    height = treap.height
    bound = np.array([np.iinfo(np.int64).max])
    level, prefix, cells = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int64)
    while len(bound):
        top = np.argpartition(-bound, batch)[:batch] if len(bound) > batch else np.arange(len(bound))
        rest = np.ones(len(bound), bool)
        rest[top] = False
        l, p, c = level[top], prefix[top], cells[top]
        row_bit = (rows[None, :] >> (height - 1 - l)[:, None]) & 1
        under = np.concatenate([treap.child(c, 2 * row_bit + half) for half in (0, 1)])
        p = np.concatenate([2 * p, 2 * p + 1])
        l = np.concatenate([l, l]) + 1
        b = np.where(under >= 0, treap.maxima[under], 0) @ weights
        leaf = (l == height) & (b > 0)
        if leaf.any():
            best.add(b[leaf], ids[p[leaf]])
        inner = (l < height) & (b > 0)
        bound, level, prefix = np.r_[bound[rest], b[inner]], np.r_[level[rest], l[inner]], np.r_[prefix[rest], p[inner]]
        cells = np.concatenate([cells[rest], under[inner]])
        least = ids[np.minimum(prefix << (height - level), len(ids) - 1)]
        go = best.may_enter(bound, least)
        bound, level, prefix, cells = bound[go], level[go], prefix[go], cells[go]


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - rows)
            batch = batch.slice(part.num_rows)
            held.append(part)
            rows += part.num_rows
            if rows == size:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def shard_treap(shard: pa.Table, n_terms: int, total: int, n_docs: int) -> tuple[K2Treap | None, np.ndarray]:
    """The treap of a shard's impacts and the ids of its columns in ascending order."""
    ids = np.array(shard.column("id").fill_null(LAST_ID).to_numpy())
    order = np.argsort(ids, kind="stable")
    shard = shard.take(pa.array(order))
    packed = [shard.column(c).to_pylist() for c in ("terms", "counts")]
    term, tf = (np.frombuffer(b"".join(p), np.int32).astype(np.int64) for p in packed)
    if not len(term):
        return None, ids[order]
    n = shard.column("n").to_numpy()
    m = 100 - 50 + (50 * n * n_docs) // total
    column = np.repeat(np.arange(len(ids)), [len(x) // 4 for x in packed[0]])
    impact = (1_000_000_000 * tf) // (1_000 * tf + 20 * m[column])
    some = impact > 0
    height = max(1, int(max(n_terms, len(ids)) - 1).bit_length())
    return (K2Treap(term[some], column[some], impact[some], height) if some.any() else None), ids[order]


def _search_block(docs: DataFrame, items: list[list[bytes]], k: int, id_col: str, text_col: str, shard_docs: int) -> DataFrame | None:
    """``item`` (number in the block), ``id, score``: the k best of every task."""
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for own in items for t in own))}
    if not vocabulary:
        return None
    postings = materialize(count_terms(docs, vocabulary, id_col, text_col), "postings")
    n_docs, total = postings.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    df = dict(documents_of_terms(postings).collect())  # at most the block's vocabulary
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in df}
    asked = []
    for own in items:
        known = sorted(vocabulary[t] for t in set(own) if weight.get(vocabulary[t], 0) > 0)
        asked.append((np.array(known, np.int64), np.array([weight[t] for t in known], np.int64)))
    shared = docs.sparkSession.sparkContext.broadcast(asked)
    n_terms = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in shared.value]
        for shard in _shards(batches, shard_docs):
            treap, ids = shard_treap(shard, n_terms, total, n_docs)
            if treap:
                for own, (rows, weights) in zip(best, shared.value, strict=True):
                    if len(rows):
                        search(treap, rows, weights, ids, own)
        number = np.repeat(np.arange(len(best)), [len(b.id) for b in best])
        ids = np.concatenate([b.id for b in best])
        found = pa.array(ids, mask=ids == LAST_ID)
        yield pa.RecordBatch.from_arrays([pa.array(number), found, pa.array(np.concatenate([b.score for b in best]))], ["item", "id", "score"])

    return postings.coalesce(-(-n_docs // shard_docs)).mapInArrow(run, "item long, id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
         shard_docs: int = SHARD_DOCS, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` highest-scoring documents with a score above 0."""
    spark = docs.sparkSession
    asked = materialize(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")).filter("text IS NOT NULL").distinct(), "items")
    n, size = asked.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-n // block_items), -(-(size or 0) // block_bytes))
    kind = items.schema[item_id].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {kind}, id long, score long, block int, item long")
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        hits = _search_block(docs, [terms(r.text.encode()) for r in own], k, id_col, text_col, shard_docs)
        if hits is not None:
            names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(own)], f"item long, item_id {kind}")
            found = found.unionByName(hits.join(F.broadcast(names), "item").withColumn("block", F.lit(block)).select(*found.columns))
    best_first = [F.desc("score"), F.asc_nulls_last("id")]
    group = Window.partitionBy("block", "item", F.pmod(F.xxhash64("id", "score"), F.lit(MERGE_GROUPS))).orderBy(*best_first)
    whole = Window.partitionBy("block", "item").orderBy(*best_first)
    merged = found.withColumn("first", F.row_number().over(group)).filter(F.col("first") <= k)
    merged = merged.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
    return merged.select("item_id", "rank", F.col("id").alias("doc_id"), "score")
