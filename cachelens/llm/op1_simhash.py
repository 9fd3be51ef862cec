"""SimHash near-duplicates by an index of masked bit patterns in Gray order.

Fingerprints are collapsed to distinct values first, so exact copies cost one entry however
many there are. A distinct value is filed under upper nodes: a node is a mask of whole blocks
of bits and the pattern found there. With ``blocks`` blocks and at most ``max_distance``
differing bits, two linked values agree on at least ``blocks - max_distance`` blocks, so they
meet under a node with a difference of zero; no candidate is lost. Under a node the values
are sorted by Gray rank, runs of neighbours become inner nodes that hold the bits shared by all their
members, and a search goes down adding up the differing bits of the node patterns; a whole
group is left when the sum exceeds the bound.

A node with more than ``max_node`` values (a dense cloud of near copies) is dealt to a grid of
cells of bounded size, every pair of parts meeting in exactly one cell; nothing is dropped.
Each node emits only a spanning forest of its links, which keeps every component.

Defined cases: a null or empty text and one without words has fingerprint 0 and links like any
other; a null ``doc_id`` takes part and gets its component, but is never a component's id
(null if the component has no other); repeated rows give repeated rows; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelens.llm.common import longs, map_batches, materialize, text_bytes
from cachelens.llm.components import connected_components

BITS = 64
LEAF, FAN = 16, 8
#: Fewer values under a node than this are compared without inner nodes.
MAX_NODE = 20_000
PAIRS_AT_ONCE = 1 << 21


def simhash(text: bytes, shingle: int) -> int:
    """64-bit SimHash of the ASCII-lower-cased words of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        h = [digest(b" ".join(words), 42)]
    else:
        h = [digest(b" ".join(w), 42) for w in zip(*(words[i:] for i in range(shingle)), strict=False)]
    h = np.array(h, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65_536):
        part = h[i : i + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (signed long with the fingerprint's bits) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([simhash(t, shingle) for t in text_bytes(batch.column(1))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), longs(fps)], ["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(narrow, run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Rank of each code in the reflected binary Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def block_masks(blocks: int, max_distance: int) -> list[int]:
    """Masks of the upper nodes: every choice of ``blocks - max_distance`` of the bit blocks."""
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [reduce(int.__or__, c) for c in itertools.combinations(parts, blocks - max_distance)]


def choose_blocks(n: int, max_distance: int, per_node: int = 64) -> int:
    """Smallest number of blocks whose node patterns are wide enough for about ``per_node``
    of ``n`` evenly spread values each. Any choice finds the same links."""
    for blocks in range(max_distance + 1, max_distance + 5):
        if n / 2 ** (BITS * (blocks - max_distance) / blocks) <= per_node:
            break
    return blocks


def _levels(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple]:
    """Inner nodes of a forest over Gray-sorted codes, lowest level first.

    ``starts, ends`` are the code ranges of the trees. A level holds, by node: its children's
    range, AND and OR of its codes, the end of its codes; and by tree: its nodes' range.
    """

    def group(lo, hi, size):
        n = np.maximum(1, -(-(hi - lo) // size))
        tree = np.repeat(np.arange(len(lo)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a = lo[tree] + k * size
        return tree, a, np.minimum(a + size, hi[tree]), np.cumsum(n) - n, np.cumsum(n)

    _, a, b, first, last = group(starts, ends, LEAF)
    every = np.bitwise_and.reduceat(codes, a)
    some = np.bitwise_or.reduceat(codes, a)
    levels = [(a, b, every, some, b, first, last)]
    while (last - first).max(initial=0) > FAN:
        _, _, every, some, end, lo, hi = levels[-1]
        _, a, b, first, last = group(lo, hi, FAN)
        levels.append((a, b, np.bitwise_and.reduceat(every, a), np.bitwise_or.reduceat(some, a), end[b - 1], first, last))
    return levels


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, member) for every member of every range."""
    n = hi - lo
    owner = np.repeat(np.arange(len(lo)), n)
    return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[owner]


def forest_links(codes: np.ndarray, trees: np.ndarray, max_distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of positions with equal ``trees`` and close ``codes``.

    The input is sorted by (tree, Gray rank). Every code goes down its tree; on each level the
    node's own bits (those its parent does not hold) add to the differences so far.
    """
    if len(codes) < 2:
        return
    starts = np.flatnonzero(np.r_[True, trees[1:] != trees[:-1]])
    ends = np.r_[starts[1:], len(trees)]
    levels = _levels(codes, starts, ends)
    tree = np.repeat(np.arange(len(starts)), ends - starts)
    top = levels[-1]
    cost = np.cumsum((ends - starts)[tree] + 1)
    at = 0
    while at < len(codes):  # as many searching codes at once as keep the frontier bounded
        to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + PAIRS_AT_ONCE)))
        query = np.arange(at, min(to, len(codes)))
        at = query[-1] + 1
        owner, node = _spread(top[5][tree[query]], top[6][tree[query]])
        query = query[owner]
        held = np.zeros(len(query), np.uint64)
        diff = np.zeros(len(query), np.int64)
        for depth in range(len(levels) - 1, -1, -1):
            a, b, every, some, end = levels[depth][:5]
            mask = ~(every[node] ^ some[node])  # bits that all members share
            diff += np.bitwise_count((codes[query] ^ every[node]) & mask & ~held)
            near = (diff <= max_distance) & (end[node] > query)
            query, node, mask, diff = query[near], node[near], mask[near], diff[near]
            owner, node = _spread(a[node], b[node])
            query, held, diff = query[owner], mask[owner], diff[owner]
        diff += np.bitwise_count((codes[query] ^ codes[node]) & ~held)
        near = (diff <= max_distance) & (node > query)
        yield query[near], node[near]


def spanning_links(codes: np.ndarray, trees: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (root, member) positions, of the links of ``forest_links``."""
    parent = np.arange(len(codes))
    for i, j in forest_links(codes, trees, max_distance):
        while len(i):  # hook larger roots under smaller ones, then shorten all paths
            ri, rj = parent[i], parent[j]
            apart = ri != rj
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            np.minimum.at(parent, np.maximum(ri, rj), np.minimum(ri, rj))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    member = np.flatnonzero(parent != np.arange(len(codes)))
    return parent[member], member


def links(values: DataFrame, max_distance: int = 4, max_node: int = MAX_NODE) -> DataFrame:
    """``a, b``: links between the distinct values in ``values.fp`` that keep every component."""
    spark = values.sparkSession
    masks = block_masks(choose_blocks(values.count(), max_distance), max_distance)
    filed = values.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m - 2**64 if m >= 2**63 else m)).alias("pattern"))
        for i, m in enumerate(masks)])).alias("node")).select("fp", "node.mask", "node.pattern")
    large = materialize(filed.groupBy("mask", "pattern").count().filter(F.col("count") > max_node), "large-nodes")
    if large.isEmpty():
        cells = filed.withColumn("cell", F.lit(0))
    else:  # parts of half the bound; cell (p, q), p <= q, holds the parts p and q
        parts = large.select("mask", "pattern", F.ceil(F.col("count") / (max_node // 2)).cast("int").alias("parts"))
        cells = (
            filed.join(parts, ["mask", "pattern"], "left")
            .withColumn("parts", F.coalesce("parts", F.lit(1)))
            .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
            .withColumn("cell", F.least("part", "other") * F.col("parts") + F.greatest("part", "other"))
            .select("fp", "mask", "pattern", "cell")
        )
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = cells.repartition(partitions, "mask", "pattern", "cell").sortWithinPartitions("mask", "pattern", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                rows, rest = rest, None
            else:
                rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
                rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
                new = np.flatnonzero((rows[1:, 1:] != rows[1:, :-1]).any(axis=0))
                cut = new[-1] + 1 if len(new) else 0  # the last node may go on in the next batch
                rows, rest = rows[:, :cut], rows[:, cut:]
            if rows is None or not rows.shape[1]:
                continue
            tree = np.r_[0, np.cumsum((rows[1:, 1:] != rows[1:, :-1]).any(axis=0))]
            codes = rows[0].view(np.uint64) if rows[0].flags.c_contiguous else rows[0].copy().view(np.uint64)
            order = np.lexsort((gray_rank(codes), tree))
            codes, tree = codes[order], tree[order]
            a, b = spanning_links(codes, tree, max_distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([longs(codes[a]), longs(codes[b])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, max_distance: int = 4, id_col: str = "doc_id",
                    text_col: str = "text", max_node: int = MAX_NODE) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; ``component_id`` is the smallest ``doc_id``
    reachable over links of at most ``max_distance`` differing bits."""
    marked = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash")
    values = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-values")
    found = materialize(links(values, max_distance, max_node), "simhash-links")
    roots = connected_components(found)  # node, root: only values with a link
    rooted = values.join(roots, values.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 4, max_distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with all columns.

    Rows that repeat an id stay or go together. Rows without an id stay only where nothing of
    their component has one; as they cannot be told apart, all of them do.
    """
    found = near_duplicates(docs, shingle, max_distance, id_col, text_col)
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("component_id").alias("__first")).distinct()
    return docs.join(first, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__first")), "left_semi")
