"""Quality rules with tokeniser fertility.

Beside counts of words, symbols and repeats, each text is measured with a public vocabulary:
characters per token, the share of tokens that are single bytes for want of a piece, and the
entropy of the text's tokens in bits. Text of a language that a vocabulary knows stays inside
bands of these three that hardly depend on the topic; symbol runs, lists, shouting and copied
filler leave them. Bands are kept per language, and per script for other languages.

Words are encoded one by one (the pieces of this kind of vocabulary do not cross white space
runs once these are single spaces), memoised per worker.

Defined cases: a null text has no words and fails the base rules; a null or unknown language
takes the band of the text's script; null ids and repeated rows pass through; an empty table
gives an empty result; other columns are ignored by ``measure`` and kept by ``keep_good``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelens.llm.common import ASCII_SPACE, Memo, held, map_batches, packed

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50


class Band(NamedTuple):
    """Bounds for a text of ``n`` tokens. Both measures of short texts scatter, and entropy grows
    with the length, so the bounds follow ``n``: characters per token stay above ``chars - chars_slack /
    sqrt(n)`` and under ``max_chars``; byte tokens under a share of ``max_bytes``; the entropy
    above ``bits - bits_loss / n ** bits_power - bits_slack``."""

    chars: float
    chars_slack: float
    max_chars: float
    max_bytes: float
    bits: float
    bits_loss: float
    bits_power: float
    bits_slack: float

    def holds(self, n: float, chars: float, in_bytes: float, bits: float) -> bool:
        return (
            self.chars - self.chars_slack / n**0.5 <= chars <= self.max_chars
            and in_bytes <= self.max_bytes
            and bits >= self.bits - self.bits_loss / n**self.bits_power - self.bits_slack
        )


#: By language, for the vocabulary ``piece_bpe_32k``: medians and entropy curves of good texts,
#: with slack beyond their lowest values.
LANGUAGE_BANDS = {
    "en": Band(2.66, 7.0, 6.0, 0.05, 7.10, 23.0, 0.6, 0.38),
    "de": Band(2.65, 7.0, 6.0, 0.05, 6.88, 19.7, 0.6, 0.38),
    "fr": Band(2.37, 7.0, 6.0, 0.05, 6.74, 29.8, 0.7, 0.38),
    "es": Band(2.31, 7.0, 6.0, 0.05, 6.89, 34.6, 0.7, 0.38),
}
#: By script, where the language has no band: letters outside the vocabulary cost more tokens.
SCRIPT_BANDS = {
    "Latin": Band(1.8, 9.0, 6.0, 0.10, 6.7, 25.0, 0.6, 1.2),
    "Cyrillic": Band(1.3, 9.0, 5.0, 0.10, 6.5, 25.0, 0.6, 1.2),
    "Greek": Band(0.6, 9.0, 4.0, 0.20, 5.5, 25.0, 0.6, 1.2),
    "Han": Band(0.4, 9.0, 3.0, 0.70, 6.5, 25.0, 0.6, 1.2),
    "other": Band(0.25, 9.0, 6.0, 0.90, 5.0, 25.0, 0.6, 1.2),
}
SCRIPT = {name: regex.compile(rf"\p{{{name}}}") for name in SCRIPT_BANDS if name != "other"}


def script_of(text: str) -> str:
    """The script of most letters."""
    if text.isascii():
        return "Latin"
    n = {name: len(p.findall(text)) for name, p in SCRIPT.items()}
    n["other"] = len(regex.findall(r"\p{L}", text)) - sum(n.values())
    return max(n, key=n.get)


def _vocabulary(path: str) -> tuple[Memo, np.ndarray]:
    def load():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        return Memo(lambda word: packed(model.encode(word.decode()))), is_byte

    return held(("pieces", path), load)


def base_counts(text: str, raw: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """``word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    word_chars = len(text) - sum(map(text.count, ASCII_SPACE))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return word_chars, n_symbols, len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words that are found at least twice in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    window = ids[:n]
    for k in range(1, size):  # numbers of longer and longer windows, kept small
        window = window * len(number) + ids[k : n + k]
        if k < size - 1 and len(number) > 1 << 20:
            window = np.unique(window, return_inverse=True)[1]
    _, inverse, count = np.unique(window, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[inverse] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[twice + k] = True
    return int(covered.sum())


def fertility(words: list[bytes], chars: int, path: str) -> tuple[int, float, float, float]:
    """Tokens, characters per token, share of byte tokens, entropy of the tokens in bits."""
    memo, is_byte = _vocabulary(path)
    ids = np.frombuffer(b"".join(map(memo.__getitem__, words)), "<u4")
    if not len(ids):
        return 0, 0.0, 0.0, 0.0
    kinds, n = np.unique(ids, return_counts=True)
    share = n / len(ids)
    return len(ids), (chars + len(words) - 1) / len(ids), float(share[is_byte[kinds]].sum()), float(-(share * np.log2(share)).sum())


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_tokens long, chars_per_token double, byte_share double, token_bits double, kept boolean"


def judge(text: str | None, lang: str | None, path: str) -> tuple:
    """The values of ``FIELDS`` for one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    word_chars, n_symbols, n_dup, n_repeat = base_counts(text, raw, words)
    failed = len(words) < MIN_WORDS or 100 * n_repeat > 50 * len(words)
    n, chars, in_bytes, bits = fertility(words, word_chars, path)
    band = LANGUAGE_BANDS.get(lang) or SCRIPT_BANDS[script_of(text)]
    kept = not failed and n > 0 and band.holds(n, chars, in_bytes, bits)
    return len(words), word_chars, n_symbols, n_dup, n_repeat, failed, n, chars, in_bytes, bits, kept


def measure(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id`` and ``FIELDS`` of every row."""
    schema = "doc_id long, " + FIELDS

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [judge(t, g, path) for t, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        names = [f.split()[0] for f in FIELDS.split(", ")]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), run, schema)


def keep_good(docs: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns as they are."""
    at, of = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = [judge(t, g, path)[-1] for t, g in zip(batch.column(at).to_pylist(), batch.column(of).to_pylist(), strict=True)]
        return batch.filter(pa.array(good, pa.bool_()))

    return map_batches(docs, run, docs.schema)
