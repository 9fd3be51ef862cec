"""Best-fit packing of token pieces into sequences after a dominance reduction.

Texts are tokenised, closed by a separator id, and cut only where one is longer than a
sequence. What matters for packing is how many pieces there are of each length, a table of at
most ``capacity`` rows: the plan is made on these counts. The reduction fixes, from the longest
piece down, sets that provably dominate every alternative for their longest piece

* the piece alone, when nothing fits beside it;
* the piece and its exact complement;
* the piece and the largest that fits, when at most one more piece can fit beside it, or when
  at most two can and no pair of them takes more room than that largest one;

and what is left is packed best fit, longest first. The plan is a short list of patterns with
multiplicities (its size depends on ``capacity``, not on the rows); pieces are numbered within
their length in salted groups of bounded size, and each number falls into one slot of the plan.

Defined cases: a null text counts as empty (one separator); null ids pack like others; repeated
rows are packed each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cachelens.llm.common import map_batches, materialize, text_bytes
from cachelens.llm.vocab import encode_words

#: Rows numbered together in one window group.
GROUP_ROWS = 10_000


def pieces(docs: DataFrame, path: str, capacity: int, separator: int = 0, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, packed, if asked for)."""
    closing = np.array([separator], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, part, start, length, crc, ids = [], [], [], [], [], []
        for row, text in enumerate(text_bytes(batch.column(1))):
            every = encode_words(path, text) + closing
            for k, at in enumerate(range(0, len(every), 4 * capacity)):
                own = every[at : at + 4 * capacity]
                rows.append(row)
                part.append(k)
                start.append(at // 4)
                length.append(len(own) // 4)
                crc.append(zlib.crc32(own))
                if with_ids:
                    ids.append(own)
        columns = {"doc_id": batch.column(0).take(pa.array(rows, pa.int64())), "piece": pa.array(part, pa.int32()), "start": pa.array(start, pa.int64()),
                   "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
        if with_ids:
            columns["ids"] = pa.array(ids, pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_batches(narrow, run, schema)


def reduce_by_dominance(counts: Counter, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Fixed sets as (times, lengths); takes what it fixes out of ``counts``."""
    fixed = []

    def fix(times: int, *lengths: int) -> None:
        fixed.append((times, lengths))
        for x in lengths:
            counts[x] -= times
            if not counts[x]:
                del counts[x]

    for longest in sorted(counts, reverse=True):
        while own := counts.get(longest, 0):
            room = capacity - longest
            counts[longest] -= 1  # partners are looked for among the others
            small = [x for x in sorted(counts)[:4] for _ in range(min(counts[x], 3))][:3]
            fitting = [x for x in counts if x <= room and counts[x] > 0]
            best = max(fitting, default=0)
            pairs = 0
            if best and best < room and len(small) > 1 and sum(small[:2]) <= room:
                beyond_two = len(small) > 2 and sum(small) <= room
                order = sorted(fitting)
                lo, hi = 0, len(order) - 1
                while lo <= hi and not beyond_two:  # largest sum of two that fits
                    total = order[lo] + order[hi]
                    if total > room:
                        hi -= 1
                        continue
                    if lo != hi or counts[order[lo]] > 1:
                        pairs = max(pairs, total)
                    lo += 1
                if beyond_two:
                    pairs = room + 1
            counts[longest] += 1
            if not best:
                fix(own, longest)
            elif best == room or pairs <= best:
                fix(own // 2 if best == longest else min(own, counts[best]), longest, best)
            else:
                break
    return fixed


def best_fit(counts: Counter, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit, longest first, on counts: equal sequences move together as (times, lengths)."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    closed = []
    smallest = min(counts, default=capacity)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in by_room if r >= length), default=None)
            if room is None:
                times, content, room = left, (), capacity
            else:
                times, content = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
            each = min(room // length, left)
            full = min(times, left // each)
            for n, k in ((full, each), (1 if full < times and left - full * each else 0, left - full * each)):
                if n:
                    k = min(k, each)
                    rest, now = room - k * length, content + (length,) * k
                    if rest < smallest:
                        closed.append((n, now))
                    else:
                        by_room.setdefault(rest, []).append((n, now))
                    left -= n * k
                    times -= n
            if times and content:
                by_room.setdefault(room, []).append((times, content))
    return closed + [x for kept in by_room.values() for x in kept]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Sequences to make, as (times, lengths in a sequence), for counts of pieces by length."""
    left = Counter({x: n for x, n in counts.items() if n})
    return reduce_by_dominance(left, capacity) + best_fit(left, capacity)


def slots(patterns: list[tuple[int, tuple[int, ...]]], capacity: int) -> dict[int, np.ndarray]:
    """By length: rows (first number, first sequence, pieces in a sequence, offset of the first)."""
    out: dict[int, list] = {}
    used: Counter = Counter()
    sequence = 0
    for times, lengths in patterns:
        offset = 0
        for length, k in sorted(Counter(lengths).items(), reverse=True):
            out.setdefault(length, []).append((used[length], sequence, k, offset))
            used[length] += times * k
            offset += length * k
        sequence += times
    return {x: np.array(rows, np.int64) for x, rows in out.items()}


def pack(docs: DataFrame, path: str, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    # the position of a piece is written with it: equal pieces differ by it, however often they are found
    cut = materialize(pieces(docs, path, capacity, separator, id_col, text_col).withColumn("position", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    slot = slots(plan(counts, capacity), capacity)
    groups = F.array(*[F.lit(-(-counts.get(x, 0) // GROUP_ROWS) or 1) for x in range(capacity + 1)])
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("position"), F.get(groups, F.col("length").cast("int"))))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32", "position")
    numbered = (
        salted.withColumn("number", F.row_number().over(order) - 1)
        .join(first, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("number")).alias("number"))
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        length = batch.column(3).to_numpy()
        number = batch.column(5).to_numpy()
        sequence, offset = np.empty_like(number), np.empty_like(number)
        for x in np.unique(length):
            at = np.flatnonzero(length == x)
            rows = slot[x][np.searchsorted(slot[x][:, 0], number[at], "right") - 1]
            k = number[at] - rows[:, 0]
            sequence[at] = rows[:, 1] + k // rows[:, 2]
            offset[at] = rows[:, 3] + k % rows[:, 2] * x
        columns = [*batch.columns[:5], pa.array(sequence), pa.array(offset)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_batches(numbered, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(docs: DataFrame, packed: DataFrame, path: str, capacity: int = 2048, separator: int = 0,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``sequence_id, ids``: the packed ids of every sequence (``capacity`` at most). Documents
    need ids of their own here."""
    cut = pieces(docs, path, capacity, separator, id_col, text_col, with_ids=True).select("doc_id", "piece", "ids")
    parts = packed.join(cut, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.concat_ws("", F.transform("parts", lambda p: F.hex(p["ids"])))
    return parts.select("sequence_id", F.unhex(joined).alias("ids"))
