"""Substring deduplication with suffix automata over sharded reference texts.

A window is ``size`` consecutive words of one document. Windows that are equal have the same
smallest gram (``GRAM`` words) by hash, their anchor; so the stretches of windows under one
anchor can be worked on by themselves, in the shard of the anchor.

1. Every document gives its stretches as (anchor, how often the anchor's gram is found in it);
   anchors found once in all cannot hold a repeated window and are left out.
2. The other anchors' stretches are listed by a digest of their words and counted. Where an anchor has
   one distinct stretch, found several times, all its windows are repeated and no text is needed.
3. The stretches of the remaining anchors are the reference text, each distinct one once. A shard is a
   bounded number of them, dealt by anchor. Its task builds the suffix automaton of its
   stretches, with the number of places of every state, and streams each stretch through it: the
   matching statistics at a word give the state of the window that ends there, and the window
   is repeated if its state has at least two places.
4. An anchor with more than ``shard_words`` words (a very common line amid different neighbours) is
   split further, by the digest of the whole window, which equal windows share: its windows'
   places are added up by digest, and no task holds the anchor.
5. The answers (a bit per window) go back to the documents, keyed by the digest of the text, and
   all words covered by repeated windows are removed.

The anchors of steps 2 to 4 are broadcast while they stay under ``max_broadcast`` bytes (they are
counted first); beyond that the stretches are joined with them. Both give the same rows.

Defined cases: a null text has no words; texts under ``size`` words keep all; rows that repeat
an id are documents of their own; an empty table gives an empty result; the digest that keys
texts is 128 bits of the content, so ids may be null or tie; ``remove_repeated`` keeps other columns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cachelens.llm.common import content_key, longs, map_batches, materialize, text_bytes

GRAM = 8
SHARD_WORDS = 150_000
MAX_BROADCAST = 64 << 20


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of every run of ``gram`` words."""
    h = np.zeros(len(words) - gram + 1, np.uint64)
    for k in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(h)]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours."""
    low, have = values, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[: len(low) - (width - have)], low[width - have :]) if have < width else low


def stretches(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: (anchor, first window, windows, 1 or 2).

    The last is 2 where the anchor's gram is found more than once among the run's words, so that
    windows of one run may equal each other.
    """
    grams = gram_hashes(words)
    width = size - GRAM + 1
    low = sliding_min(grams, width)
    start = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    end = np.r_[start[1:], len(low)]  # windows
    first = start + (grams[start[:, None] + np.arange(width)] == low[start][:, None]).argmax(axis=1)
    tail = end - 1
    last = tail + width - 1 - (grams[tail[:, None] + np.arange(width - 1, -1, -1)] == low[start][:, None]).argmax(axis=1)
    return low[start], start, end - start, 1 + (last > first)


def _documents(docs: DataFrame, text_col: str) -> DataFrame:
    k1, k2 = content_key(F.col(text_col))
    return docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))


def repeated_anchors(docs: DataFrame, size: int, text_col: str = "text") -> DataFrame:
    """``anchor``: anchors found at least twice in all documents."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = []
        for raw in text_bytes(batch.column(0)):
            words = raw.split()
            if len(words) >= size:
                anchor, _, _, n = stretches(word_hashes(words), size)
                found.append(np.repeat(anchor, n))
        if not found:
            return None
        anchor, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([longs(anchor), pa.array(n)], ["anchor", "n"])

    found = map_batches(docs.select(F.col(text_col).alias("text")), run, "anchor long, n long")
    return found.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")


STRETCH = "k1 long, k2 long, start int, windows int, anchor long, d1 long, d2 long"
TEXT = "anchor long, d1 long, d2 long, words binary"
WINDOWS = "d1 long, d2 long, n long, marks binary"


def _cut(raw: bytes, size: int, wanted: np.ndarray) -> Iterator[tuple]:
    """Stretches of a text under the sorted anchors ``wanted``: (first window, windows, anchor,
    digest, packed words)."""
    words = raw.split()
    if len(words) < size:
        return
    hashes = word_hashes(words)
    anchor, start, n, _ = stretches(hashes, size)
    at = np.searchsorted(wanted, anchor)
    known = at < len(wanted)
    known[known] = wanted[at[known]] == anchor[known]
    for first, count, name in zip(start[known].tolist(), n[known].tolist(), anchor[known].tolist(), strict=True):
        own = hashes[first : first + count + size - 1].tobytes()
        yield first, count, name, xxhash.xxh3_128_digest(own), own


def _stretch_rows(k1: list[int], k2: list[int], found: list[list[tuple]]) -> pa.RecordBatch:
    rows = [(a, b, *s) for a, b, own in zip(k1, k2, found, strict=True) for s in own]
    digest = np.frombuffer(b"".join(r[5] for r in rows), np.int64).reshape(-1, 2)
    columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()),
               pa.array([r[3] for r in rows], pa.int32()), longs(np.array([r[4] for r in rows], np.uint64)), pa.array(digest[:, 0]), pa.array(digest[:, 1])]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in STRETCH.split(", ")])


def _text_rows(found: list[list[tuple]], seen: set) -> pa.RecordBatch:
    """Each distinct stretch when a task meets it first."""
    if len(seen) > 1_000_000:
        seen.clear()
    rows = [s for own in found for s in own if not (s[3] in seen or seen.add(s[3]))]
    digest = np.frombuffer(b"".join(r[3] for r in rows), np.int64).reshape(-1, 2)
    columns = [longs(np.array([r[2] for r in rows], np.uint64)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([r[4] for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in TEXT.split(", ")])


def _window_rows(found: list[list[tuple]], size: int) -> pa.RecordBatch:
    """Each distinct stretch of a batch with its number there and the digests of its windows."""
    times = Counter(s[3] for own in found for s in own)
    packed = {s[3]: s[4] for own in found for s in own}
    digest = np.frombuffer(b"".join(packed), np.int64).reshape(-1, 2)
    marks = [b"".join(xxhash.xxh3_128_digest(own[at : at + 8 * size]) for at in range(0, len(own) - 8 * (size - 1), 8)) for own in packed.values()]
    columns = [pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([times[d] for d in packed], pa.int64()), pa.array(marks, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in WINDOWS.split(", ")])


def cut_stretches(docs: DataFrame, anchors: DataFrame, size: int, text_col: str, max_broadcast: int, schema: str = STRETCH) -> DataFrame:
    """``STRETCH`` rows of every document for the given anchors, their distinct ``TEXT`` rows, or
    their ``WINDOWS`` rows."""
    spark = docs.sparkSession
    ready = _documents(docs, text_col)
    shared = None
    if anchors.count() * 8 <= max_broadcast:
        shared = spark.sparkContext.broadcast(np.sort(anchors.select("anchor").toArrow().column(0).to_numpy().view(np.uint64)))
    else:  # a text's own anchors come with it
        def list_anchors(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows, parts = [], []
            for row, raw in enumerate(text_bytes(batch.column(2))):
                words = raw.split()
                if len(words) >= size:
                    parts.append(np.unique(stretches(word_hashes(words), size)[0]))
                    rows += [row] * len(parts[-1])
            at = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), longs(np.concatenate(parts))], ["k1", "k2", "anchor"]) if parts else None

        own = map_batches(ready, list_anchors, "k1 long, k2 long, anchor long").distinct().join(anchors, "anchor")
        ready = ready.join(own.groupBy("k1", "k2").agg(F.collect_list("anchor").alias("anchors")), ["k1", "k2"]).select("k1", "k2", "text", "anchors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            if shared:
                wanted = [shared.value] * batch.num_rows
            else:
                wanted = [np.sort(np.array(x, np.int64).view(np.uint64)) for x in batch.column(3).to_pylist()]
            found = [list(_cut(raw, size, w)) for raw, w in zip(text_bytes(batch.column(2)), wanted, strict=True)]
            if any(found) and schema == WINDOWS:
                yield _window_rows(found, size)
            elif any(found):
                yield _text_rows(found, seen) if schema == TEXT else _stretch_rows(batch.column(0).to_pylist(), batch.column(1).to_pylist(), found)

    return ready.mapInArrow(run, schema)


class SuffixAutomaton:
    """Suffix automaton of several texts over integers, with the places of every state."""

    def __init__(self):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        self.places.append(0)
        return len(self.step) - 1

    def _split(self, state: int, letter: int, below: int) -> int:
        """The state of the longest text of ``state`` that ends with ``letter`` only."""
        step, link, length = self.step, self.link, self.length
        if length[below] == length[state] + 1:
            return below
        copy = self._state(length[state] + 1, step[below].copy(), link[below])
        link[below] = copy
        while state >= 0 and step[state].get(letter) == below:
            step[state][letter] = copy
            state = link[state]
        return copy

    def add(self, text: list[int], times: int) -> None:
        """Takes in a text that is found ``times`` times."""
        step, link = self.step, self.link
        last = 0
        for letter in text:
            known = step[last].get(letter)
            if known is not None:
                last = self._split(last, letter, known)
            else:
                new = self._state(self.length[last] + 1, {}, 0)
                state = last
                while state >= 0 and letter not in step[state]:
                    step[state][letter] = new
                    state = link[state]
                if state >= 0:
                    link[new] = self._split(state, letter, step[state][letter])
                last = new
            self.places[last] += times

    def finish(self) -> None:
        """Adds up the places along the suffix links, longest states first."""
        places, link = self.places, self.link
        for state in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            places[link[state]] += places[state]

    def repeated(self, text: list[int], size: int) -> np.ndarray:
        """For a text that was taken in: whether each of its windows has two places or more."""
        step, link, length, places = self.step, self.link, self.length, self.places
        out = np.zeros(len(text) - size + 1, bool)
        state = 0
        for i, letter in enumerate(text):
            state = step[state][letter]
            while length[link[state]] >= size:
                state = link[state]
            if i + 1 >= size:
                out[i + 1 - size] = places[state] > 1
        return out


def unclear_anchors(counts: DataFrame, size: int) -> DataFrame:
    """``anchor, words``: anchors whose windows have to be looked at, with the words of their distinct stretches."""
    words = F.sum(F.col("windows") + (size - 1)).alias("words")
    return counts.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max("n").alias("most"), words).filter("kinds > 1 or most = 1").select("anchor", "words")


def reference_shards(anchors: DataFrame, shard_words: int) -> tuple[DataFrame, Column]:
    """``anchor, words`` of the anchors that a task can hold as a whole, and their shard, of
    ``shard_words`` words on average."""
    calm = anchors.filter(F.col("words") <= shard_words)
    words = calm.agg(F.sum("words")).first()[0] or 0
    return calm, F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-words // shard_words)))).cast("int")


def split_answers(docs: DataFrame, anchors: DataFrame, size: int, text_col: str, max_broadcast: int) -> DataFrame:
    """``d1, d2, repeated`` of the stretches under ``anchors``, from the places of every window by its digest."""
    windows = materialize(cut_stretches(docs, anchors, size, text_col, max_broadcast, WINDOWS), "windows")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = batch.column(3).to_pylist()
        n = np.array([len(m) // 16 for m in marks])
        row = pa.array(np.repeat(np.arange(len(n)), n))
        mark = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
        at = np.arange(len(mark)) - np.repeat(np.cumsum(n) - n, n)
        columns = [*(batch.column(c).take(row) for c in range(3)), pa.array(np.repeat(n, n), pa.int32()), pa.array(at, pa.int32()), pa.array(mark[:, 0]), pa.array(mark[:, 1])]
        return pa.RecordBatch.from_arrays(columns, ["d1", "d2", "n", "windows", "at", "w1", "w2"])

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = []
        for n, at in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            own = np.zeros(n, bool)
            own[at] = True
            bits.append(np.packbits(own, bitorder="little").tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], ["d1", "d2", "repeated"])

    places = map_batches(windows, each, "d1 long, d2 long, n long, windows int, at int, w1 long, w2 long")
    repeated = materialize(places.groupBy("w1", "w2").agg(F.sum("n").alias("n")).filter("n > 1").select("w1", "w2", F.lit(True).alias("hit")), "repeated-windows")
    if repeated.count() * 16 <= max_broadcast:
        repeated = F.broadcast(repeated)
    hits = places.join(repeated, ["w1", "w2"], "left").groupBy("d1", "d2").agg(F.max("windows").alias("windows"), F.collect_set(F.when(F.col("hit"), F.col("at"))).alias("at"))
    return map_batches(hits, mark, "d1 long, d2 long, repeated binary")


def answers(docs: DataFrame, found: DataFrame, size: int, text_col: str, max_broadcast: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``d1, d2, repeated``: a bit for each window of the distinct stretches that need a look at
    their words. All windows of the other stretches in ``found`` are repeated."""
    counts = materialize(found.groupBy("anchor", "d1", "d2").agg(F.count("*").alias("n"), F.max("windows").alias("windows")), "stretch-counts")
    unclear = materialize(unclear_anchors(counts, size), "unclear-anchors")
    hot = unclear.filter(F.col("words") > shard_words).select("anchor")
    calm, shard = reference_shards(unclear, shard_words)
    calm = calm.select("anchor")
    asked = counts.join(calm, "anchor", "left_semi")
    texts = cut_stretches(docs, calm, size, text_col, max_broadcast, TEXT)

    def search(_: tuple, text: pa.Table, count: pa.Table) -> pa.Table:
        times = dict(zip(zip(*(count.column(c).to_pylist() for c in ("d1", "d2")), strict=True), count.column("n").to_pylist(), strict=True))
        automaton = SuffixAutomaton()
        numbers: dict[int, int] = {}
        kept: dict[tuple[int, int], list[int]] = {}
        for d1, d2, packed in zip(*(text.column(c).to_pylist() for c in ("d1", "d2", "words")), strict=True):
            if (d1, d2) not in kept:
                kept[d1, d2] = own = [numbers.setdefault(w, len(numbers)) for w in np.frombuffer(packed, np.uint64).tolist()]
                automaton.add(own, times[d1, d2])
        automaton.finish()
        bits = [np.packbits(automaton.repeated(own, size), bitorder="little").tobytes() for own in kept.values()]
        return pa.table({"d1": pa.array([k[0] for k in kept], pa.int64()), "d2": pa.array([k[1] for k in kept], pa.int64()), "repeated": pa.array(bits, pa.binary())})

    answered = texts.groupBy(shard.alias("shard")).cogroup(asked.groupBy(shard.alias("shard"))).applyInArrow(search, "d1 long, d2 long, repeated binary")
    return answered if hot.isEmpty() else answered.unionByName(split_answers(docs, hot, size, text_col, max_broadcast))


def _keep(raw: bytes, runs: list | None, size: int) -> tuple[bytes, int, int]:
    """(kept words joined by a space, words, removed words)."""
    words = raw.split()
    change = np.zeros(len(words) + 1, np.int64)
    for run in runs or ():
        if run["repeated"] is None:
            at = np.arange(run["start"], run["start"] + run["windows"])
        else:
            at = run["start"] + np.flatnonzero(np.unpackbits(np.frombuffer(run["repeated"], np.uint8), bitorder="little"))
        np.add.at(change, at, 1)
        np.add.at(change, at + size, -1)
    gone = np.cumsum(change[:-1]) > 0
    removed = int(gone.sum())
    if removed:
        return b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g), len(words), removed
    return b" ".join(words), len(words), 0


def remove_repeated(docs: DataFrame, size: int = 35, text_col: str = "text", max_broadcast: int = MAX_BROADCAST,
                    only_changed: bool = False, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with the kept words of each text, joined by one space, and ``n_words, n_removed``
    at the end. ``only_changed`` leaves texts without a removed word as they are."""
    anchors = materialize(repeated_anchors(docs, size, text_col), "anchors")
    found = materialize(cut_stretches(docs, anchors, size, text_col, max_broadcast), "stretches")
    answered = materialize(answers(docs, found, size, text_col, max_broadcast, shard_words), "answers")
    lists = (
        found.select("k1", "k2", "start", "windows", "d1", "d2").join(answered, ["d1", "d2"], "left").groupBy("k1", "k2")
        .agg(F.collect_set(F.struct("start", "windows", "repeated")).alias("__runs"))  # of one text; copies agree
    )
    at = docs.columns.index(text_col)
    fields = [F.col(f"`{c}`") for c in docs.columns]
    k1, k2 = content_key(F.col(f"`{text_col}`"))
    ready = docs.select(*fields, k1.alias("__k1"), k2.alias("__k2"))
    joined = ready.join(lists, (ready["__k1"] == lists["k1"]) & (ready["__k2"] == lists["k2"]), "left").select(*fields, "__runs")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = text_bytes(batch.column(at))
        done = [_keep(raw, own, size) for raw, own in zip(raws, batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
        texts = [raw if only_changed and not d[2] else d[0] for raw, d in zip(raws, done, strict=True)]
        columns = list(batch.columns[:-1])
        columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
        columns += [pa.array([d[i] for d in done], pa.int64()) for i in (1, 2)]
        return pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])

    schema = StructType([*docs.schema.fields, *StructType.fromDDL("n_words long, n_removed long").fields])
    return map_batches(joined, run, schema)
