"""Byte-level BPE: exact encoding in linear time, and decoding.

Tokens are byte strings, mapped to Latin-1 so that one character is one byte and an
Aho-Corasick automaton over them can be asked for the longest token at a position. The encoder
takes longest tokens greedily and steps back (next shorter token, then the token before) when
a token cannot stand beside its neighbour. Whether two tokens may be neighbours does not
depend on the rest of the text, so it is worked out once from the order of merges and
memoised; a position found to be a dead end is never entered again.

``encode`` adds ``ids`` (binary, little-endian unsigned 32-bit ids) to ``doc_id``; ``decode``
turns such ids into bytes. Defined cases: a null text counts as empty and gives no ids; equal
pieces give equal ids wherever they stand; repeated rows and null ids pass through; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelens.llm.common import Memo, held, map_batches, packed


@cache
def tokens_by_id(path: str) -> dict[int, bytes]:
    with open(path, "rb") as f:
        return {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}


def decode_ids(path: str, ids: bytes) -> bytes:
    return b"".join(map(tokens_by_id(path).__getitem__, np.frombuffer(ids, "<u4").tolist()))


class ByteBPE:
    """Encoder for a rank file of byte tokens (``base64 rank`` lines) and a splitting pattern."""

    def __init__(self, path: str, pattern: str):
        self.tokens = tokens_by_id(path)
        self.ranks = {t: i for i, t in self.tokens.items()}
        self.split = regex.compile(pattern)
        self.may_follow: dict[tuple[int, int], bool] = Memo(lambda pair: self._may_follow(*pair), 200_000)
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int | None] = {}
        self.automaton = ahocorasick.Automaton()
        self._learn_merges()
        self.ids = Memo(self._piece, 400_000)

    def _learn_merges(self) -> None:
        """How the merges build each token, in rank order: the split into two older tokens that
        may be neighbours. A longer token without one is never built by merges."""
        for rank in sorted(self.tokens):
            token, at = self.tokens[rank], None
            for cut in range(len(token) - 1, 0, -1):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None and max(a, b) < rank and a in self.parts and b in self.parts:
                    if self._may_follow(a, b):
                        at = (a, b)
                        break
            if at or len(token) == 1:
                self.parts[rank] = at
                if at:
                    self.merged[at] = rank
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.reach = max(len(self.tokens[rank]) for rank in self.parts)
        for rank in self.parts:
            token = self.tokens[rank]
            shorter = (self.ranks.get(token[:n]) for n in range(len(token) - 1, 0, -1))
            self.shorter[rank] = next((r for r in shorter if r in self.parts), None)

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' bytes from scratch leaves these two tokens.

        Undoes merges at the seam from the latest on: if two parts that met at the seam merge
        into a token older than the merges undone so far, that merge would have come first.
        """
        bound = len(self.ranks) + 1
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < bound:
                return False
            if left > right and self.parts[left] or not self.parts[right]:
                if not self.parts[left]:
                    return True
                bound, left = left, self.parts[left][1]
            else:
                bound, right = right + 1, self.parts[right][0]

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        found = [whole] if whole is not None else self._backtrack(raw)
        return packed(found)

    def _backtrack(self, raw: bytes) -> list[int]:
        text, tokens, shorter, follow = raw.decode("latin-1"), self.tokens, self.shorter, self.may_follow
        size, reach, search = len(raw), self.reach, self.automaton.iter_long
        dead = bytearray(size + 1)
        out: list[int] = []

        def longest(at: int) -> int:  # looks as far as the longest token goes, so a piece of any length takes linear time
            return next(search(text[at : at + reach]))[1]

        at, token = 0, longest(0)
        while True:
            end = at + len(tokens[token])
            if not dead[end] and (not out or follow[out[-1], token]):
                out.append(token)
                if end == size:
                    return out
                at, token = end, longest(end)
                continue
            token = shorter[token]
            if token is None:  # nothing fits here: no way leads through this position
                dead[at] = 1
                token = out.pop()
                at -= len(tokens[token])

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.ids.__getitem__, self.split.findall(text)))


def bpe(path: str, pattern: str) -> ByteBPE:
    """One encoder per Python worker."""
    return held(("bpe", path, pattern), lambda: ByteBPE(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           with_decoded: bool = False) -> DataFrame:
    """``doc_id, ids``: the whole text's ids, without special tokens; ``with_decoded`` adds what
    ``decode`` makes of them, in the same task."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = bpe(path, pattern).encode
        ids = [enc(t or "") for t in batch.column(1).to_pylist()]
        columns = {"doc_id": batch.column(0), "ids": pa.array(ids, pa.binary())}
        if with_decoded:
            columns["decoded"] = pa.array([decode_ids(path, x) for x in ids], pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(narrow, run, "doc_id long, ids binary" + ", decoded binary" * with_decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes that the ids stand for."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [decode_ids(path, x or b"") for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded binary")
