"""Line deduplication by sharded minimal perfect hashes.

A line's key is the line without white space at its ends, in ASCII lower case. Keys are digested to
128 bits in the map tasks and aggregated to the first document, the last one and the number of
documents; only keys of at least two documents go into the index. The index is cut into shards by
the digest's leading bits; a task per shard builds a minimal perfect hash over its digests and three arrays
in its order: 64-bit fingerprints, counts, and first documents. Documents look their lines up
in these arrays and keep a repeated line only in the first document that holds it.

While all arrays together stay under ``max_broadcast`` bytes (their size is summed first), they
are broadcast and each document is read once more and rewritten in place: no line and no text
is shuffled. Beyond that, the digests of the lines (never the lines) go to their shards, in
salted groups of bounded size that each get the shard's arrays, and the answers are joined to
their documents. Both ways give the same rows.

Defined cases: a null text counts as one empty line; a document with a null id counts as the
last of all (all null ids as one document); rows that repeat an id are one document; an empty
table gives an empty result; other columns are kept by ``dedup_lines``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cachelens.llm.common import content_key, longs, map_batches, materialize, text_bytes

MIN_CHARS = 10
SHARD_KEYS = 200_000
GROUP_ROWS = 500_000
MAX_BROADCAST = 64 << 20
LAST_ID = 2**63 - 1


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, another one for each seed."""
    x = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spot(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each 128-bit key (a, b) among ``size`` bits of a level."""
    return (mix(a ^ mix(b, level), level) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys by levels of bit arrays.

    On each level the keys that meet no other key set their bit and are done; the others go to
    the next level. A key's number is the rank of its bit.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # packed bits
        self.before = []  # by level: ranks at the start of every byte
        total = 0
        for bits in levels:
            rank = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
            self.before.append(np.r_[0, rank[:-1]] + total)
            total += int(rank[-1])
        self.size = total

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels = []
        while len(a):
            size = 8 * (len(a) // 4 + 1)  # two bits a key
            at = spot(a, b, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            a, b = a[~alone[at]], b[~alone[at]]
        return cls(levels)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of each key of the build set; any number or -1 for other keys."""
        out = np.full(len(a), -1, np.int64)
        todo = np.arange(len(a))
        for k, (bits, before) in enumerate(zip(self.levels, self.before, strict=True)):
            at = spot(a[todo], b[todo], k, 8 * len(bits))
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            hit = (bits[byte] >> bit & 1).astype(bool)
            lower = bits[byte] & ((np.uint16(1) << bit) - 1).astype(np.uint8)
            out[todo[hit]] = (before[byte] + np.bitwise_count(lower))[hit]
            todo = todo[~hit]
        return out


class Shard:
    """Arrays of one shard: probe with digests, get the first document where the count suffices."""

    def __init__(self, levels: list[bytes], prints: bytes, counts: bytes, firsts: bytes):
        self.hash = PerfectHash([np.frombuffer(x, np.uint8) for x in levels])
        self.prints, self.counts, self.firsts = np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.uint32), np.frombuffer(firsts, np.int64)

    def first_of(self, place: np.ndarray, check: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.hash.find(place, check)
        known = at >= 0
        known[known] = self.prints[at[known]] == check[known]
        known[known] = self.counts[at[known]] >= min_docs
        return known, np.where(known, self.firsts[at], 0) if len(self.firsts) else np.zeros(len(at), np.int64)


def line_keys(raw: bytes) -> list[bytes | None]:
    """Digest of each line's key; None for keys under ``MIN_CHARS`` code points."""
    digest, out = xxhash.xxh3_128_digest, []
    for line in raw.split(b"\n"):
        key = line.strip().lower()
        n = len(key)
        out.append(digest(key) if n >= 4 * MIN_CHARS or n >= MIN_CHARS and len(key.decode()) >= MIN_CHARS else None)
    return out


def _digests(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2) -> DataFrame:
    """``h1, h2, first_id, n_docs`` of every key found in at least two documents. ``n_docs`` counts rows while only
    ``min_docs`` = 2 is asked; beyond that rows that repeat an id are made one document first."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found, rows = [], []
        for row, raw in enumerate(text_bytes(batch.column(1))):
            own = {k for k in line_keys(raw) if k}
            found += own
            rows += [row] * len(own)
        if not found:
            return None
        a, b = _digests(found)
        return pa.RecordBatch.from_arrays([longs(a), longs(b), batch.column(0).take(pa.array(rows))], ["h1", "h2", "doc_id"])

    narrow = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    held = map_batches(narrow, run, "h1 long, h2 long, doc_id long")
    if min_docs > 2:
        held = held.distinct()
    return (
        held.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n_docs"))
        .filter("first_id < last_id").select("h1", "h2", "first_id", "n_docs")
    )


SHARD_SCHEMA = "shard int, levels array<binary>, prints binary, counts binary, firsts binary"


def build_index(lines: DataFrame, bits: int) -> DataFrame:
    """One row of arrays (``SHARD_SCHEMA``) for each of the ``2 ** bits`` shards with keys."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        place, check, first = (table.column(c).to_numpy() for c in ("h1", "h2", "first_id"))
        count = np.minimum(table.column("n_docs").to_numpy(), 2**32 - 1).astype(np.uint32)
        place, check = place.view(np.uint64), check.view(np.uint64)
        perfect = PerfectHash.build(place, check)
        order = np.empty(len(place), np.int64)
        order[perfect.find(place, check)] = np.arange(len(place))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([[x.tobytes() for x in perfect.levels]], pa.list_(pa.binary())),
                         "prints": [check[order].tobytes()], "counts": [count[order].tobytes()], "firsts": [first[order].tobytes()]})

    return lines.withColumn("shard", _shard(bits)).groupBy("shard").applyInArrow(build, SHARD_SCHEMA)


def _shard(bits: int):
    return F.shiftrightunsigned("h1", 64 - bits).cast("int") if bits else F.lit(0)


def _rewrite(raw: bytes, drop: list[bool]) -> bytes:
    return b"\n".join(x for x, gone in zip(raw.split(b"\n"), drop, strict=True) if not gone)


def _with_counts(docs: DataFrame) -> StructType:
    return StructType([*docs.schema.fields, *StructType.fromDDL("n_lines long, n_dropped long").fields])


def _finish(batch: pa.RecordBatch, at: int, raws: list[bytes], drops: list[list[bool]]) -> pa.RecordBatch:
    """The batch with its text rewritten and ``n_lines, n_dropped`` added."""
    kept = [_rewrite(raw, drop) if any(drop) else raw for raw, drop in zip(raws, drops, strict=True)]
    columns = list(batch.columns)
    columns[at] = pa.array(kept, pa.binary()).cast(pa.string())
    columns += [pa.array([len(d) for d in drops], pa.int64()), pa.array([sum(d) for d in drops], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])


def _probe_broadcast(docs: DataFrame, index: DataFrame, bits: int, min_docs: int, at: int) -> DataFrame:
    """The last column of ``docs`` is the id."""
    arrays = docs.sparkSession.sparkContext.broadcast({r["shard"]: (list(map(bytes, r["levels"])), bytes(r["prints"]), bytes(r["counts"]), bytes(r["firsts"])) for r in index.collect()})
    shards: dict[int, Shard] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = arrays.value
        for batch in batches:
            if not batch.num_rows:
                continue
            raws = text_bytes(batch.column(at))
            ids = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            keys = [line_keys(raw) for raw in raws]
            drop = [[False] * len(k) for k in keys]
            where = [(row, line) for row, k in enumerate(keys) for line, x in enumerate(k) if x]
            if where:
                place, check = _digests([keys[row][line] for row, line in where])
                shard = (place >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(place), np.int64)
                owner = ids[np.fromiter((row for row, _ in where), np.int64, len(where))]
                gone = np.zeros(len(place), bool)
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(shard[order]) > 0, True])
                for a, b in zip(cuts, cuts[1:], strict=False):
                    own = order[a:b]
                    s = int(shard[own[0]])
                    if s in held:
                        if s not in shards:
                            shards[s] = Shard(*held[s])
                        known, first = shards[s].first_of(place[own], check[own], min_docs)
                        gone[own] = known & (first != owner[own])
                for k in np.flatnonzero(gone):
                    row, line = where[k]
                    drop[row][line] = True
            yield _finish(batch.select(range(batch.num_columns - 1)), at, raws, drop)

    return docs.mapInArrow(run, _with_counts(docs.drop(docs.columns[-1])))


def _probe_shuffled(docs: DataFrame, index: DataFrame, bits: int, min_docs: int, at: int) -> DataFrame:
    """As ``_probe_broadcast``; the digests travel to the shards."""
    names = docs.columns
    text, ident = names[at], names[-1]
    k1, k2 = content_key(F.col(text))
    keyed = docs.withColumns({"__k1": k1, "__k2": k2})

    def probes(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found, rows = [], []
        for row, raw in enumerate(text_bytes(batch.column(0))):
            own = {k for k in line_keys(raw) if k}
            found += own
            rows += [row] * len(own)
        if not found:
            return None
        a, b = _digests(found)
        return pa.RecordBatch.from_arrays([longs(a), longs(b), *(batch.column(i).take(pa.array(rows)) for i in (1, 2, 3))], ["h1", "h2", "id", "k1", "k2"])

    asked = materialize(map_batches(keyed.select(text, ident, "__k1", "__k2"), probes, "h1 long, h2 long, id long, k1 long, k2 long")
                        .distinct().withColumn("shard", _shard(bits)), "probes")
    salts = asked.groupBy("shard").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("salts"))
    cell = F.concat_ws("#", "shard", "salt")  # one column: a deal by shard alone would do for two
    left = asked.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("k1", "id"), "salts").cast("int")).withColumn("cell", cell)
    right = index.join(salts, "shard").withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).withColumn("cell", cell)

    def answer(_: tuple, questions: pa.Table, arrays: pa.Table) -> pa.Table:
        schema = pa.schema([("id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
        if not (questions.num_rows and arrays.num_rows):
            return schema.empty_table()
        row = arrays.slice(0, 1).to_pylist()[0]
        shard = Shard(row["levels"], row["prints"], row["counts"], row["firsts"])
        place, check = (questions.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        known, first = shard.first_of(place, check, min_docs)
        gone = known & (first != questions.column("id").to_numpy())
        return questions.select(schema.names).filter(pa.array(gone))

    gone = left.drop("shard", "salt", "salts").groupBy("cell").cogroup(right.drop("shard", "salt", "salts").groupBy("cell")).applyInArrow(answer, "id long, k1 long, k2 long, h1 long, h2 long")
    lists = gone.groupBy("id", "k1", "k2").agg(F.collect_list(F.struct("h1", "h2")).alias("__gone"))  # of one document's lines
    joined = keyed.join(lists, (keyed[ident] == lists["id"]) & (keyed["__k1"] == lists["k1"]) & (keyed["__k2"] == lists["k2"]), "left")
    columns = [F.col(f"`{c}`") for c in names[:-1]]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = text_bytes(batch.column(at))
        drops = []
        for raw, gone in zip(raws, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            lost = {np.array([g["h1"], g["h2"]], np.int64).tobytes() for g in gone or ()}
            drops.append([k in lost for k in line_keys(raw)])
        return _finish(batch.select(range(batch.num_columns - 1)), at, raws, drops)

    return map_batches(joined.select(*columns, "__gone"), run, _with_counts(docs.select(*columns)))


def dedup_lines(docs: DataFrame, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text",
                max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` with rewritten texts, and ``n_lines, n_dropped`` at the end (by position, should
    the input have columns of these names)."""
    spark = docs.sparkSession
    lines = materialize(repeated_lines(docs, id_col, text_col, min_docs), "repeated-lines")
    bits = max(0, (lines.count() // SHARD_KEYS).bit_length())
    index = materialize(build_index(lines, bits), "line-index")
    size = F.length("prints") + F.length("counts") + F.length("firsts") + F.aggregate("levels", F.lit(0), lambda n, x: n + F.length(x))
    total = index.agg(F.sum(size)).first()[0] or 0
    at = docs.columns.index(text_col)
    fields = [F.col(f"`{c}`") for c in docs.columns]
    ready = docs.select(*fields, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("__line_owner"))
    probe = _probe_broadcast if total <= max_broadcast else _probe_shuffled
    return probe(ready, index, bits, min_docs, at)
