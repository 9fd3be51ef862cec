"""Exact substring deduplication over bytes with blockwise suffix sorting.

Every byte covered by a ``size``-byte string that also starts earlier (smaller document, or earlier in
the same one) is removed; the first place of a string keeps it.

1. Equal windows of ``size`` bytes have the same smallest gram (``GRAM`` bytes, by hash), their anchor.
   Anchors found once in all documents cannot hold a repeated window; they are counted and left
   out.
2. Each document gives its stretches, the runs of windows under one anchor. Of equal stretches only the
   first place keeps its windows for now; a task drops the later ones that it meets itself, so what
   remains of a stretch, however often it is found, is a row or so for each task.
3. An anchor with several distinct stretches (or one that may repeat windows of its own) may hold equal windows in
   different stretches. The distinct texts of these are dealt by anchor to shards of ``shard_bytes`` on average.
   A shard sorts the suffixes of its windows blockwise: the suffixes at a difference cover's positions are ranked once;
   then, one suffix bucket (between two splitters) at a time, suffixes are sorted by their first ``COVER`` bytes and
   longer ties are resolved by the cover ranks, at the distance where both suffixes meet the cover. What
   is in memory is a shard and a bucket. Neighbours that share ``size`` bytes form a class, and its
   first place keeps its windows.
4. An anchor whose distinct texts exceed ``hot_bytes`` (a very common line amid different neighbours) is not dealt
   to one task. Its texts are cut to slices of up to ``SLICE`` windows by the anchor's distance from the window's start;
   all windows of a slice share its core, so slices whose core is found once have no equal elsewhere. What
   is left is cut to single windows, and their first places are found as in step 2.
5. The windows to go are gathered by document and their bytes are cut out.

Anchors are broadcast while they stay under ``max_broadcast`` bytes (they are counted first); beyond
that a document's anchors are joined to it. Both give the same rows.

Defined cases: a null text is empty; texts under ``size`` bytes keep all; null ids come after all
others; rows that repeat an id with another text are documents of their own, ordered by a digest of the text;
rows that repeat both are one document and are all treated alike; an empty table gives an empty
result; other columns are kept by position. What is left of a text may cut a character, so it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cachelens.llm.common import content_key, longs, map_batches, materialize, text_bytes

SIZE = 100
GRAM = 32
COVER = 32
SHARD_BYTES = 2 << 20
#: Distinct texts of an anchor, in bytes, that go to one shard.
HOT_BYTES = 8 << 20
#: Windows of a slice of a hot anchor's text.
SLICE = 8
#: Suffixes of a bucket.
BUCKET = 1 << 16
MAX_BROADCAST = 64 << 20
#: Bytes of text that are hashed at a time: the arrays of a step stay in a core's cache.
BYTES_AT_ONCE = 1 << 16
#: Digests whose first place a task keeps in mind.
REMEMBERED = 1_000_000

_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_LETTERS = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)


# ---------------------------------------------------------------------------- anchors

def gram_hashes(text: np.ndarray) -> np.ndarray:
    """Hash of every run of ``GRAM`` bytes."""
    h, length = _LETTERS[text], 1
    for multiplier in _MULTIPLIERS:
        longer = h[:-length] * multiplier
        longer += h[length:]
        h = longer
        length *= 2
    h ^= h >> np.uint64(31)
    h *= _MULTIPLIERS[1]
    h ^= h >> np.uint64(29)
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    low, have = values, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[: len(low) - (width - have)], low[width - have :]) if have < width else low


def stretches(text: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Stretches of the documents (``size`` bytes or more each) that follow each other in ``text`` and end at
    ``ends``: (anchor, document, first window as a place in ``text``, windows, 1 or 2). The last is 2 where windows
    of the stretch may equal each other: only if the anchor's gram starts one that is not the last."""
    grams = gram_hashes(text)
    low = sliding_min(grams, size - GRAM + 1)
    new = np.empty(len(low), bool)
    new[0] = True
    np.not_equal(low[1:], low[:-1], out=new[1:])
    new[ends[:-1]] = True
    new[(ends[:-1, None] - size + 1 + np.arange(size - 1)).ravel()] = False  # these reach into the next document
    start = np.flatnonzero(new)
    document = np.searchsorted(ends, start, "right")
    # a stretch ends before the next one or with its document's last window
    stop = np.minimum(np.r_[start[1:], len(low)], ends[document] - size + 1)
    at = np.flatnonzero(grams[: len(low)] == low)
    of = np.searchsorted(start, at, "right") - 1
    times = 1 + (np.bincount(of[at < stop[of] - 1], minlength=len(start)) > 0)
    return low[start], document, start, stop - start, times


def _pieces(texts: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of ``size`` bytes or more, cut so that ``BYTES_AT_ONCE`` are looked at together: (bytes, ends,
    row of each piece, its start in the row). Pieces of one row overlap by ``size - 1`` bytes."""
    parts: list[tuple[int, int, bytes]] = []
    held = 0

    def packed():
        return (np.frombuffer(b"".join(p[2] for p in parts), np.uint8), np.cumsum([len(p[2]) for p in parts]),
                np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64))

    for row, raw in enumerate(texts):
        for at in range(0, len(raw) - size + 1, BYTES_AT_ONCE):
            part = raw[at : at + BYTES_AT_ONCE + size - 1]
            parts.append((row, at, part))
            held += len(part)
            if held >= BYTES_AT_ONCE:
                yield packed()
                parts, held = [], 0
    if parts:
        yield packed()


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, k, text``: a document is known by its id and a digest of its text."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), content_key(F.col(f"`{text_col}`"))[0].alias("k"), F.col(f"`{text_col}`").alias("text"))


def repeated_anchors(ready: DataFrame, size: int) -> DataFrame:
    """Anchors of at least two places; places are added up in each batch before the shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = []
        for text, ends, _, _ in _pieces(text_bytes(batch.column(0)), size):
            anchor, _, _, _, n = stretches(text, ends, size)
            found.append(np.repeat(anchor, n))
        if not found:
            return None
        anchor, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([longs(anchor), pa.array(n.astype(np.int32))], ["anchor", "n"])

    return map_batches(ready.select("text"), run, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")


# ---------------------------------------------------------------------------- stretches

STRETCH = "id long, k long, start int, windows int, d1 long, d2 long, anchor long, own boolean, later boolean"
TEXT = "d1 long, d2 long, anchor long, bytes binary"


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [f.split()[0] for f in schema.split(", ")])


class FirstPlaces:
    """The first places of digests that a task has met, the most recent ``REMEMBERED`` or more."""

    def __init__(self):
        self.least: dict[bytes, tuple] = {}

    def later(self, digests: list[bytes], places: list[tuple]) -> list[bool]:
        """Whether each place comes after a known one of its digest."""
        if len(self.least) > REMEMBERED:
            self.least.clear()
        out = []
        for digest, place in zip(digests, places, strict=True):
            known = self.least.get(digest)
            if known is None or place < known:
                self.least[digest] = place
            out.append(known is not None and place > known)
        return out


def cut_stretches(ready: DataFrame, anchors: DataFrame, size: int, max_broadcast: int, schema: str = STRETCH) -> DataFrame:
    """``STRETCH`` rows under the given anchors, or their ``TEXT`` rows, each once in a task."""
    spark = ready.sparkSession
    shared = None
    if anchors.count() * 8 <= max_broadcast:
        shared = spark.sparkContext.broadcast(np.sort(anchors.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)))
    else:  # a text's own anchors come with it
        def list_anchors(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows, parts = [], []
            for text, ends, row, _ in _pieces(text_bytes(batch.column(1)), size):
                anchor, document, _, _, _ = stretches(text, ends, size)
                rows.append(row[document])
                parts.append(anchor)
            if not parts:
                return None
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), longs(np.concatenate(parts))], ["k", "anchor"])

        own = map_batches(ready.select("k", "text"), list_anchors, "k long, anchor long").distinct().join(anchors, "anchor")
        ready = ready.join(own.groupBy("k").agg(F.collect_list("anchor").alias("anchors")), "k").select("id", "k", "text", "anchors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, seen = FirstPlaces(), set()
        for batch in batches:
            if len(seen) > REMEMBERED:
                seen.clear()
            wanted = shared.value if shared else np.unique(np.concatenate([np.array(x, np.int64) for x in batch.column(3).to_pylist()]).view(np.uint64))
            names = [(i is None, i or 0, k) for i, k in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True)]
            for text, ends, row, at in _pieces(text_bytes(batch.column(2)), size):
                anchor, document, start, windows, times = stretches(text, ends, size)
                spot = np.minimum(np.searchsorted(wanted, anchor), max(0, len(wanted) - 1))
                known = wanted[spot] == anchor if len(wanted) else np.zeros(len(anchor), bool)
                if not known.any():
                    continue
                anchor, document, start, windows, times = (x[known] for x in (anchor, document, start, windows, times))
                raw = text.tobytes()
                own = [raw[a : a + n + size - 1] for a, n in zip(start.tolist(), windows.tolist(), strict=True)]
                digests = [xxhash.xxh3_128_digest(x) for x in own]
                digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                if schema == TEXT:
                    new = [i for i, d in enumerate(digests) if not (d in seen or seen.add(d))]
                    yield _batch(TEXT, [digest[new, 0], digest[new, 1], longs(anchor[new]), pa.array([own[i] for i in new], pa.binary())])
                    continue
                begins = np.r_[0, ends[:-1]]
                row, start = row[document], start - begins[document] + at[document]
                places = [(names[r], s) for r, s in zip(row.tolist(), start.tolist(), strict=True)]
                yield _batch(STRETCH, [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), start.astype(np.int32), windows.astype(np.int32),
                                       digest[:, 0], digest[:, 1], longs(anchor), times > 1, firsts.later(digests, places)])

    return ready.mapInArrow(run, schema)


# ---------------------------------------------------------------------------- suffix sorting

def difference_cover(modulus: int) -> list[int]:
    """Residues such that every difference is one of two of them, found greedily."""
    cover, missing = [0], set(range(1, modulus))
    while missing:
        gain = {r: len(missing & {x for c in cover for x in ((r - c) % modulus, (c - r) % modulus)}) for r in range(modulus) if r not in cover}
        best = max(gain, key=lambda r: (gain[r], -r))
        missing -= {x for c in cover for x in ((best - c) % modulus, (c - best) % modulus)}
        cover.append(best)
    return sorted(cover)


_COVER = np.array(difference_cover(COVER))
_IN_COVER = np.isin(np.arange(COVER), _COVER)
_SLOT = np.cumsum(_IN_COVER) - 1
#: For two residues, the least distance at which both meet the cover.
_MEET = np.array([[next(d for d in range(COVER) if _IN_COVER[(i + d) % COVER] and _IN_COVER[(j + d) % COVER]) for j in range(COVER)] for i in range(COVER)])


def window_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on."""
    h, length = _LETTERS[text], 1
    while 2 * length <= size:
        h = h[:-length] * _MULTIPLIERS[length % 5] + h[length:]
        h ^= h >> np.uint64(31)
        length *= 2
    rest = size - length
    return h[: len(h) - rest] * _MULTIPLIERS[3] + h[rest:] if rest else h


class BlockSorter:
    """Sorts suffixes of ``text``, a bucket at a time, and classes those whose first ``size`` bytes agree."""

    def __init__(self, text: bytes, size: int):
        self.size, self.length = size, len(text)
        blocks = len(text) // COVER + 1
        data = np.zeros((blocks + 4) * COVER + size, np.uint8)
        data[: len(text)] = np.frombuffer(text, np.uint8)
        self.words = np.zeros(len(data) - 7, np.uint64)  # the eight bytes from each place on
        for k in range(8):
            self.words = (self.words << np.uint64(8)) | data[k : k + len(self.words)]
        self.whole = window_hashes(data, size)
        self.samples = (np.arange(blocks)[:, None] * COVER + _COVER).ravel()
        self.samples = self.samples[self.samples < len(text)]
        self._rank_samples()

    def _rank_samples(self) -> None:
        """Ranks of the samples' whole suffixes: names of their first bytes, doubled for those that are tied
        until none is. A rank is the place of the first sample with this name, so that naming a tied group
        anew leaves all others as they are."""

        def places(opens: np.ndarray) -> np.ndarray:
            return np.maximum.accumulate(np.where(opens, np.arange(len(opens)), 0))

        def in_ties(opens: np.ndarray) -> np.ndarray:
            return ~opens | np.r_[~opens[1:], False]

        keys = [self.words[self.samples + k] for k in range(0, COVER, 8)]
        order = np.lexsort(keys[::-1])
        opens = np.zeros(len(order), bool)
        opens[:1] = True
        for key in keys:
            key = key[order]
            opens[1:] |= key[1:] != key[:-1]
        ranks = np.empty(len(order), np.int64)
        ranks[order] = places(opens) + 1
        tied, length = order[in_ties(opens)], COVER
        while length < self.length and len(tied):
            following = tied + len(_COVER) * (length // COVER)
            after = np.where(following < len(ranks), ranks[np.minimum(following, len(ranks) - 1)], 0)
            by = np.lexsort((after, ranks[tied]))
            tied, after = tied[by], after[by]
            group = ranks[tied]
            new_group = np.r_[True, group[1:] != group[:-1]]
            opens = new_group | np.r_[True, after[1:] != after[:-1]]
            ranks[tied] = group + places(opens) - places(new_group)
            tied = tied[in_ties(opens)]
            length *= 2
        self.ranks = np.r_[ranks, np.zeros(3 * len(_COVER), np.int64)]

    def _cover_rank(self, at: np.ndarray) -> np.ndarray:
        return self.ranks[(at // COVER) * len(_COVER) + _SLOT[at % COVER]]

    def _before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sign of suffix ``a`` against ``b`` whose first ``COVER`` bytes agree, by cover ranks."""
        meet = _MEET[a % COVER, b % COVER]
        return np.sign(self._cover_rank(a + meet) - self._cover_rank(b + meet))

    def _resolve(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Sorts ``order`` inside its groups of tied suffixes: runs are merged two by two, each
        suffix finding its place in the other run by halving."""
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[first, len(group)])
        begin, count = np.repeat(first, size), np.repeat(size, size)
        width = 1
        while width < (size.max() if len(size) else 0):
            at = np.flatnonzero(count > width)
            inner = at - begin[at]
            run = inner // width
            low = np.minimum((run ^ 1) * width, count[at])
            base = low.copy()
            high = np.minimum(low + width, count[at])
            mine, right = order[at], (run & 1) == 1
            while True:
                open_ = low < high
                if not open_.any():
                    break
                middle = (low + high) // 2
                sign = self._before(order[np.minimum(begin[at] + middle, len(order) - 1)], mine)
                goes = open_ & ((sign < 0) | (right & (sign == 0)))
                low = np.where(goes, middle + 1, low)
                high = np.where(open_ & ~goes, middle, high)
            out = order.copy()
            out[begin[at] + (run & ~1) * width + inner % width + low - base] = mine
            order = out
            width *= 2
        return order

    def buckets(self, starts: np.ndarray) -> Iterator[np.ndarray]:
        """The places ``starts`` by bucket, in no order within one."""
        n = -(-len(starts) // BUCKET)
        if n <= 1:
            yield starts
            return
        keys = self.words[starts]
        splitters = np.unique(np.quantile(np.sort(self.words[self.samples]), np.arange(1, n) / n, method="nearest"))
        bucket = np.searchsorted(splitters, keys, "right")
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        yield from np.split(starts[order], cuts)

    def classes(self, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each bucket: its places in suffix order, and whether each opens a class of places with the
        same ``size`` bytes."""
        for own in self.buckets(starts):
            keys = [self.words[own + k] for k in range(0, COVER, 8)]
            by = np.lexsort(keys[::-1])
            tied = np.ones(len(by), bool)
            tied[:1] = False
            for key in keys:
                key = key[by]
                tied[1:] &= key[1:] == key[:-1]
            order, group = own[by], np.cumsum(~tied)
            # ties of one and the same window need no order among them; the others are resolved
            opening = np.flatnonzero(~tied)
            alike = np.minimum.reduceat(self.whole[order], opening) == np.maximum.reduceat(self.whole[order], opening)
            mixed = np.flatnonzero(~alike[group - 1])
            order[mixed] = self._resolve(order[mixed], group[mixed])
            same = np.flatnonzero(tied)
            for k in [*range(COVER, self.size - 8, 8), self.size - 8]:
                same = same[self.words[order[same] + k] == self.words[order[same - 1] + k]]
            opens = np.ones(len(order), bool)
            opens[same] = False
            yield order, opens


def first_windows(texts: list[bytes], place: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text, its windows that come first in ``place`` order among the equal windows of all texts;
    ``place`` is that of the text's first window and grows by one from window to window."""
    lengths = np.array([len(t) for t in texts], np.int64)
    windows = lengths - size + 1
    begin = np.cumsum(lengths) - lengths
    at = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = np.repeat(begin, windows) + at
    key = np.zeros(int(lengths.sum()), np.int64)
    key[starts] = np.repeat(place, windows) + at
    first = np.zeros(len(key), bool)
    for order, opens in BlockSorter(b"".join(texts), size).classes(starts):
        own = key[order]
        least = np.minimum.reduceat(own, np.flatnonzero(opens))
        first[order] = own == least[np.cumsum(opens) - 1]
    return [first[b : b + n] for b, n in zip(begin.tolist(), windows.tolist(), strict=True)]


# ---------------------------------------------------------------------------- answers

#: Windows to go of a document: from ``start`` on, all of them, or those whose bit in ``firsts`` is not set.
GONE = "id long, k long, start int, windows int, firsts binary"


def rank_places(found: DataFrame) -> DataFrame:
    """The rows of ``found`` that no task knows to be later, with ``first``: whether it is the first place of
    its digest. A digest has about a row for each task here."""
    order = Window.partitionBy("d1", "d2").orderBy(F.col("id").isNull(), "id", "k", "start")
    return found.filter("NOT later").drop("later").withColumn("first", F.rank().over(order) == 1)


def all_gone(rows: DataFrame) -> DataFrame:
    return rows.select("id", "k", "start", "windows", F.lit(None).cast("binary").alias("firsts"))


SLICES = "c1 long, c2 long, d1 long, d2 long, at int, windows int, id long, k long, start int"


def slices(texts: DataFrame, size: int) -> DataFrame:
    """``SLICES`` of texts ``d1, d2, anchor, bytes, id, k, start``: windows ``at`` to ``at + windows - 1`` of the text
    whose next anchor is the same and ``SLICE i`` to ``SLICE (i + 1) - 1`` bytes away, under the digest of i and of the
    bytes that they all hold."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column(3).to_pylist()
        text = np.frombuffer(b"".join(own), np.uint8)
        ends = np.cumsum([len(x) for x in own])
        begins = np.r_[0, ends[:-1]]
        anchors = batch.column(2).to_numpy().view(np.uint64)
        grams = gram_hashes(text)
        found = np.flatnonzero(grams == np.repeat(anchors, np.diff(np.r_[0, ends]))[: len(grams)])
        n = ends - begins - size + 1
        row = np.repeat(np.arange(len(own)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        window = begins[row] + at
        following = found[np.searchsorted(found, window)]  # each window holds its anchor
        step = (following - window) // SLICE
        new = np.r_[True, (row[1:] != row[:-1]) | (following[1:] != following[:-1]) | (step[1:] != step[:-1])]
        first = np.flatnonzero(new)
        core = following[first] - step[first] * SLICE
        raw = text.tobytes()
        digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[c : c + size - SLICE + 1], i) for c, i in zip(core.tolist(), step[first].tolist(), strict=True)), np.int64).reshape(-1, 2)
        taken = pa.array(row[first])
        return _batch(SLICES, [digest[:, 0], digest[:, 1], batch.column(0).take(taken), batch.column(1).take(taken), at[first].astype(np.int32),
                               np.diff(np.r_[first, len(row)]).astype(np.int32), batch.column(4).take(taken), batch.column(5).take(taken),
                               (batch.column(6).to_numpy()[row[first]] + at[first]).astype(np.int32)])

    return map_batches(texts.select("d1", "d2", "anchor", "bytes", "id", "k", "start"), run, SLICES)


def single_windows(texts: DataFrame, size: int) -> DataFrame:
    """Windows ``at`` to ``at + windows - 1`` of texts ``id, k, start, bytes`` (``start`` is that of the first one) as
    ``STRETCH`` rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = FirstPlaces()
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                id_, k, start, own, at, n = (c.to_pylist() for c in part.columns)
                row = np.repeat(np.arange(len(n)), n)
                shift = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                digests = [xxhash.xxh3_128_digest(x[i : i + size]) for x, a, m in zip(own, at, n, strict=True) for i in range(a, a + m)]
                places = [(id_[r] is None, id_[r] or 0, k[r], start[r] + s) for r, s in zip(row.tolist(), shift.tolist(), strict=True)]
                digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                taken = pa.array(row)
                yield _batch(STRETCH, [part.column(0).take(taken), part.column(1).take(taken), pa.array([p[3] for p in places], pa.int32()), np.ones(len(row), np.int32),
                                       digest[:, 0], digest[:, 1], np.zeros(len(row), np.int64), np.zeros(len(row), bool), firsts.later(digests, places)])

    return texts.select("id", "k", "start", "bytes", "at", "windows").mapInArrow(run, STRETCH)


def hot_windows_to_go(texts: DataFrame, size: int) -> DataFrame:
    """``GONE`` rows of the first places of a hot anchor's texts ``d1, d2, anchor, bytes, id, k, start``."""
    cut = materialize(slices(texts, size), "slices")
    shared = cut.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("c1", "c2")
    left = cut.join(shared, ["c1", "c2"], "left_semi").join(texts.select("d1", "d2", "bytes").distinct(), ["d1", "d2"])
    single = materialize(single_windows(left, size), "windows")
    return all_gone(single.filter("later")).unionByName(all_gone(rank_places(single).filter("NOT first")))


def solve_shards(firsts: DataFrame, texts: DataFrame, shards: int, size: int) -> DataFrame:
    """``GONE`` rows of the first places ``firsts`` of the ``texts``; those that keep all give none."""
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")

    def solve(places: pa.Table, texts: pa.Table) -> pa.Table:
        bytes_of = dict(zip(zip(*(texts.column(c).to_pylist() for c in ("d1", "d2")), strict=True), texts.column("bytes").to_pylist(), strict=True))
        known = sorted({((i is None, i or 0, k), s, (a, b)) for i, k, s, a, b in zip(*(places.column(c).to_pylist() for c in ("id", "k", "start", "d1", "d2")), strict=True)})
        number = {x: i for i, x in enumerate(sorted({x[0] for x in known}))}
        own = [bytes_of[x[2]] for x in known]
        place = np.array([(number[x[0]] << 40) + x[1] for x in known], np.int64)
        firsts = first_windows(own, place, size) if own else []
        rows = [i for i, f in enumerate(firsts) if not f.all()]
        columns = [[None if known[i][0][0] else known[i][0][1] for i in rows], [known[i][0][2] for i in rows], [known[i][1] for i in rows], [len(firsts[i]) for i in rows],
                   [np.packbits(firsts[i], bitorder="little").tobytes() for i in rows]]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in GONE.split(", ")])

    narrow = firsts.select("id", "k", "start", "d1", "d2", shard)
    return narrow.groupBy("shard").cogroup(texts.select("d1", "d2", "bytes", shard).groupBy("shard")).applyInArrow(solve, GONE)


def _cut_out(raw: bytes, runs: list[dict] | None, size: int) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, maximal removed runs)."""
    if not runs:
        return raw, 0, 0
    change = np.zeros(len(raw) + 1, np.int32)
    for run in runs:  # neighbouring windows cover one stretch of bytes
        if run["firsts"] is None:
            change[run["start"]] += 1
            change[run["start"] + run["windows"] - 1 + size] -= 1
        else:
            bits = np.unpackbits(np.frombuffer(run["firsts"], np.uint8), count=run["windows"], bitorder="little")
            edges = np.flatnonzero(np.diff(np.r_[1, bits, 1].astype(np.int8)))
            np.add.at(change, run["start"] + edges[::2], 1)
            np.add.at(change, run["start"] + edges[1::2] - 1 + size, -1)
    gone = np.cumsum(change[:-1]) > 0
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def windows_to_go(ready: DataFrame, size: int, max_broadcast: int, shard_bytes: int, hot_bytes: int) -> DataFrame:
    """``GONE`` rows of all documents."""
    anchors = materialize(repeated_anchors(ready, size), "anchors")
    found = materialize(cut_stretches(ready, anchors, size, max_broadcast), "stretches")
    ranked = materialize(rank_places(found), "places")
    gone = all_gone(found.filter("later")).unionByName(all_gone(ranked.filter("NOT first")))
    firsts = ranked.filter("first")
    kinds = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("own").alias("own"), F.sum(F.col("windows") + (size - 1)).alias("n"))
    unclear = materialize(kinds.filter("kinds > 1 OR own").select("anchor", "n"), "unclear-anchors")
    texts = materialize(cut_stretches(ready, unclear.select("anchor"), size, max_broadcast, TEXT), "texts")
    calm, hot = unclear.filter(F.col("n") <= hot_bytes), unclear.filter(F.col("n") > hot_bytes).select("anchor")
    shards = max(1, -(-(calm.agg(F.sum("n")).first()[0] or 0) // shard_bytes))
    asked = firsts.join(unclear.select("anchor"), "anchor", "left_semi")
    if hot.isEmpty():
        return gone.unionByName(solve_shards(asked, texts, shards, size))
    gone = gone.unionByName(solve_shards(asked.join(hot, "anchor", "left_anti"), texts.join(hot, "anchor", "left_anti"), shards, size))
    once = texts.join(hot, "anchor", "left_semi").groupBy("d1", "d2").agg(F.max("bytes").alias("bytes"))
    placed = asked.join(hot, "anchor", "left_semi").select("d1", "d2", "anchor", "id", "k", "start").distinct()
    return gone.unionByName(hot_windows_to_go(materialize(placed.join(once, ["d1", "d2"]), "hot-texts"), size))


def remove_repeated(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST,
                    shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``docs`` with ``kept`` (binary), ``n_bytes, n_removed, n_spans`` at the end."""
    gone = windows_to_go(_documents(docs, id_col, text_col), size, max_broadcast, shard_bytes, hot_bytes)
    lists = gone.groupBy("id", "k").agg(F.collect_set(F.struct("start", "windows", "firsts")).alias("__gone"))  # of one text
    n = len(docs.columns)
    at = docs.columns.index(text_col)
    fields = docs.toDF(*(f"c{i}" for i in range(n)))
    with_key = fields.select(*fields.columns, F.col(f"c{docs.columns.index(id_col)}").cast("long").alias("__id"), content_key(F.col(f"c{at}"))[0].alias("__k"))
    joined = with_key.join(lists, with_key["__id"].eqNullSafe(lists["id"]) & (with_key["__k"] == lists["k"]), "left").select(*fields.columns, "__gone")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = text_bytes(batch.column(at))
        done = [_cut_out(raw, own, size) for raw, own in zip(raws, batch.column(n).to_pylist(), strict=True)]
        columns = [*batch.columns[:n], pa.array([d[0] for d in done], pa.binary()), pa.array([len(r) for r in raws], pa.int64()),
                   *(pa.array([d[i] for d in done], pa.int64()) for i in (1, 2))]
        return pa.RecordBatch.from_arrays(columns, [str(i) for i in range(n + 4)])

    schema = StructType([*docs.schema.fields, *StructType.fromDDL("kept binary, n_bytes long, n_removed long, n_spans long").fields])
    return map_batches(joined, run, schema)
