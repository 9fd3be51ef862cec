"""Periodic runs of words by scale-tiled distribution.

A run is a stretch of consecutive words with smallest period q, at least ``EXPONENT`` periods and
``MIN_WORDS`` words long, that no neighbouring word extends with the same period.

1. Periods are taken by octave, [P, 2P). For an octave a document is exploded into tiles that
   start every ``C`` words and reach ``8 P`` or more words into the next, so each run is seen whole
   by a tile, or by a chain of tiles whose fragments overlap by four periods. All octaves up to
   ``TILE / 8`` share the tiles of ``2 TILE`` words; a longer octave has tiles of ``16 P`` words. A
   document of up to ``TILE`` words is one tile.
2. A tile is solved by itself. Boundaries are set every P words: a run of the octave has one among its first
   P words, where the next 2P words come again q words later. Equal blocks are found by doubled hashes, and
   the Z-functions at the boundary, forward and backward, give the exact ends of the fragment
   within the tile. Two offsets of one octave that both fit make the words a power of a shorter
   one, so a boundary gives one fragment at most, and a tile holds O(words) of them in all.
3. Fragments are shuffled by document and period, and fragments that overlap by a period or more
   are stitched to runs. Only fragments travel, each distinct one once; texts of one content share them.
4. The runs of a text go back to its documents: broadcast while they are under ``max_broadcast``
   bytes (counted first), joined beyond that. Both give the same rows.

The tiles of long documents are dealt evenly to the tasks; those of short documents are solved
where they are read, many to a numpy call.

Defined cases: a null text has no words; rows with the same text, null ids and repeated ids included,
have the same runs; a text of white space only gives an empty text; an empty table gives an empty
result; ``collapse_runs`` keeps other columns by position, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cachelens.llm.common import content_key, map_batches, materialize, text_bytes

EXPONENT = 4
MIN_WORDS = 6
TILE = 16_384
#: Words of short documents that are solved together.
WORDS_AT_ONCE = 200_000
MAX_BROADCAST = 64 << 20

FRAGMENT = "k1 long, k2 long, period long, start long, stop long"
RUNS = "array<struct<start:long,period:long,length:long>>"


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words."""
    number = defaultdict(count().__next__)
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values of ``a`` and ``b`` (same length) are equal."""
    if not len(a):
        return 0
    differ = a != b
    at = int(differ.argmax())
    return at if differ[at] else len(a)


def z_forward(words: np.ndarray, boundary: int, period: int) -> int:
    """The boundary's Z-function at ``period``: words from the boundary on that come again ``period`` later."""
    at, step, n = boundary, 4 * period, len(words)
    while at + period < n:
        stop = min(at + step, n - period)
        same = _agreeing(words[at:stop], words[at + period : stop + period])
        at += same
        if at < stop:
            break
        step *= 2
    return at - boundary


def z_backward(words: np.ndarray, boundary: int, period: int) -> int:
    """Words before the boundary, nearest first, that come again ``period`` later."""
    at, step = boundary, 4 * period
    while at > 0:
        start = max(0, at - step)
        same = _agreeing(words[start:at][::-1], words[start + period : at + period][::-1])
        at -= same
        if at > start:
            break
        step *= 2
    return boundary - at


def _prime_factors(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return found + [n] * (n > 1)


def _is_power(words: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch of period ``period`` (two periods from ``start`` at least) has a shorter one."""
    own = words[start : start + period]
    return any(np.array_equal(own, words[start + period // d : start + period // d + period]) for d in _prime_factors(period))


def boundary_matches(blocks: np.ndarray, octave: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries (multiples of ``octave``) and periods in [octave, 2 octave) where the block hash comes
    again; boundaries with several such periods lie in a power and are left out."""
    n = len(blocks)
    rows = -(-n // octave)
    if rows < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grid = np.zeros(rows * octave, np.uint64)
    grid[:n] = blocks
    grid = grid.reshape(rows, octave)
    at = np.flatnonzero(grid[1:] == grid[:-1, :1])
    at = at[at + octave < n]
    row = at // octave
    alone = np.r_[True, row[1:] != row[:-1]] & np.r_[row[:-1] != row[1:], True] if len(row) else np.empty(0, bool)
    return row[alone] * octave, at[alone] - row[alone] * octave + octave


def tile_fragments(words: np.ndarray, lowest: int, highest: int) -> list[tuple[int, int, int]]:
    """(start, stop, period) of the tile's maximal stretches whose smallest period is in the octaves
    ``lowest`` to ``highest`` and that are long enough for a run."""
    found: list[tuple[int, int, int]] = []
    blocks = _mixed(words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
    octave = 1
    while octave <= highest and EXPONENT * octave <= len(words):
        blocks = _mixed(blocks[:-octave] * np.uint64(0x94D049BB133111EB) + blocks[octave:])  # of 2 octave words
        if octave >= lowest:
            reached: dict[int, int] = {}  # end of the last fragment of a period
            for boundary, period in zip(*(x.tolist() for x in boundary_matches(blocks, octave)), strict=True):
                if boundary + period <= reached.get(period, 0):
                    continue
                again = z_forward(words, boundary, period)
                if again < 2 * octave or _is_power(words, boundary, period):
                    continue
                start, stop = boundary - z_backward(words, boundary, period), boundary + period + again
                reached[period] = stop
                if stop - start >= max(MIN_WORDS, EXPONENT * period):
                    found.append((start, stop, period))
        octave *= 2
    return found


def explode_tiles(n: int, tile: int = TILE) -> Iterator[tuple[int, int, int, int]]:
    """(lowest octave, highest octave, start, stop) of the tiles of a document of ``n`` words."""
    shared = max(1, tile // 8)
    if n <= tile:
        yield 1, max(1, n), 0, n
        return
    for start in range(0, n, tile):
        yield 1, shared, start, min(n, start + 2 * tile)
        if start + 2 * tile >= n:
            break
    octave = 2 * shared
    while EXPONENT * octave <= n:
        for start in range(0, n, 8 * octave):
            yield octave, octave, start, min(n, start + 16 * octave)
            if start + 16 * octave >= n:
                break
        octave *= 2


def _fragment_rows(keys: list[tuple[int, int]], found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = [[k[0] for k in keys], [k[1] for k in keys], [f[2] for f in found], [f[0] for f in found], [f[1] for f in found]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in FRAGMENT.split(", ")])


def _short_fragments(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Fragments of documents of one tile each, solved side by side: numbers of their own part them."""
    keys: list[tuple[int, int]] = []
    found: list[tuple[int, int, int]] = []
    names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    together: list[list[bytes]] = []
    rows: list[int] = []

    def solve() -> None:
        size = np.array([len(t) for t in together], np.int64)
        start = np.cumsum(size + 1) - size - 1
        words = np.full(int(size.sum()) + len(size), -1, np.int64)
        words[start + size] = -1 - np.arange(len(size))
        inside = np.ones(len(words), bool)
        inside[start + size] = False
        words[inside] = numbered([w for t in together for w in t])
        for first, stop, period in tile_fragments(words, 1, int(size.max())):
            row = int(np.searchsorted(start, first, "right")) - 1
            keys.append(names[rows[row]])
            found.append((first - int(start[row]), stop - int(start[row]), period))
        together.clear()
        rows.clear()

    held = 0
    for row, raw in enumerate(text_bytes(batch.column(2))):
        words = raw.split()
        if len(words) >= MIN_WORDS:
            together.append(words)
            rows.append(row)
            held += len(words)
        if held >= WORDS_AT_ONCE:
            solve()
            held = 0
    if together:
        solve()
    return _fragment_rows(keys, found) if found else None


def fragments(docs: DataFrame, text_col: str = "text", tile: int = TILE) -> DataFrame:
    """``FRAGMENT`` rows of all tiles of all texts, keyed by the content of the text."""
    spark = docs.sparkSession
    k1, k2 = content_key(F.col(f"`{text_col}`"))
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    one_tile = F.octet_length("text") <= 2 * tile  # a word and its space take two bytes at least

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                words = numbered(text_bytes(one.column(2))[0].split()).astype(np.int32)
                for low, high, start, stop in explode_tiles(len(words), tile):
                    yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), *(pa.array([x], pa.int64()) for x in (low, high, start)),
                                                      pa.array([words[start:stop].tobytes()], pa.binary())], ["k1", "k2", "low", "high", "start", "words"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, low, high, start, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [(s + start, e + start, p) for s, e, p in tile_fragments(np.frombuffer(packed, np.int32).astype(np.int64), low, high)]
                if found:
                    yield _fragment_rows([(a, b)] * len(found), found)

    tiles = texts.filter(~one_tile).mapInArrow(explode, "k1 long, k2 long, low long, high long, start long, words binary")
    dealt = tiles.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return map_batches(texts.filter(one_tile), _short_fragments, FRAGMENT).unionByName(dealt.mapInArrow(solve, FRAGMENT))


def stitch(found: DataFrame) -> DataFrame:
    """``k1, k2, runs``: fragments of one document and period that share a period of words are one run;
    the runs of a document by start, then period."""
    order = Window.partitionBy("k1", "k2", "period").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = before.isNull() | (F.col("start") + F.col("period") > before)
    chained = found.distinct().withColumn("opens", opens.cast("long")).withColumn("chain", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = chained.groupBy("k1", "k2", "period", "chain").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    run = F.struct("start", "period", (F.col("stop") - F.col("start")).alias("length"))
    return runs.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(run)).alias("runs"))  # of one text


def periodic_runs(docs: DataFrame, text_col: str = "text", tile: int = TILE) -> DataFrame:
    """``k1, k2, runs`` for the contents (``common.content_key``) that hold a run."""
    return stitch(fragments(docs, text_col, tile))


def _collapsed(raw: bytes, runs: list[dict] | None) -> tuple[bytes, int]:
    words = raw.split()
    if not runs:
        return b" ".join(words), len(words)
    change = np.zeros(len(words) + 1, np.int64)
    for run in runs:
        change[run["start"] + run["period"]] += 1
        change[run["start"] + run["length"]] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return b" ".join(w for w, k in zip(words, kept.tolist(), strict=True) if k), len(words)


def collapse_runs(docs: DataFrame, text_col: str = "text", tile: int = TILE, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` with each run's words after its first period dropped (kept words joined by one space), and
    ``n_words, runs`` (by start, then period) at the end."""
    runs = materialize(periodic_runs(docs, text_col, tile), "periodic-runs")
    size = runs.agg(F.sum(F.lit(64) + F.size("runs") * 24)).first()[0] or 0
    at = docs.columns.index(text_col)
    n = len(docs.columns)
    ready = docs.toDF(*(f"c{i}" for i in range(n)))
    k1, k2 = content_key(F.col(f"c{at}"))
    joined = ready.withColumns({"k1": k1, "k2": k2}).join(F.broadcast(runs) if size <= max_broadcast else runs, ["k1", "k2"], "left")
    joined = joined.select(*(f"c{i}" for i in range(n)), "runs")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column(n).to_pylist()
        done = [_collapsed(raw, r) for raw, r in zip(text_bytes(batch.column(at)), own, strict=True)]
        columns = list(batch.columns[:n])
        columns[at] = pa.array([d[0] for d in done], pa.binary()).cast(pa.string())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("period", pa.int64()), ("length", pa.int64())]))
        columns += [pa.array([d[1] for d in done], pa.int64()), pa.array([r or [] for r in own], kind)]
        return pa.RecordBatch.from_arrays(columns, [str(i) for i in range(n + 2)])

    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"n_words long, runs {RUNS}").fields])
    return map_batches(joined, run, schema)
