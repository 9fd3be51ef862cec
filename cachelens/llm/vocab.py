"""Whole-text ids by public vocabularies, memoised by white-space separated word.

Only for tokenizers that drop white space before they merge, so that a text's ids are those
of its words one after another.
"""

from __future__ import annotations

import json
import os

from cachelens.llm.common import Memo, held, packed

# The pre-tokenizer pattern under which a run of letters is one unit and a run of
# other signs after it another.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Signs that may follow a word; no apostrophe and nothing of special tokens.
TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints,
    else the next one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in prints]
    return {x: chr(x) for x in prints} | {x: chr(256 + i) for i, x in enumerate(others)}


class WordIds(Memo):
    """Word (UTF-8 bytes without ASCII white space) to its packed little-endian ids.

    A word of Latin letters and following signs is put together from its lower-cased letters and
    its signs, which repeat more; other words go to the library as they are.
    """

    def __init__(self, path: str):
        super().__init__(self._word, 800_000)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            config = json.load(f)
        steps = [n["type"] for n in (config["normalizer"] or {}).get("normalizers", ())]
        split, *rest = (config["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": LETTER_RUNS} and [r["type"] for r in rest] == ["ByteLevel"]
        self.model, self.bytes = self.tokenizer.model, _byte_letters()
        self.letters, self.tails = Memo(self._letters, 800_000), Memo(self._whole, 50_000)

    def _whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _letters(self, low: str) -> bytes:
        """Ids of one unit of lower-case letters."""
        unit = low if low.isascii() else low.encode().decode("latin-1").translate(self.bytes)
        return packed([t.id for t in self.model.tokenize(unit)])

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if self.plain:
            core = text.rstrip(TAIL)
            if core.isalpha() and max(core) < "\u0250" and (low := core.lower()).isalpha():
                tail = text[len(core) :]
                return self.letters[low] + self.tails[tail] if tail else self.letters[low]
        return self._whole(text)


def word_ids(path: str) -> WordIds:
    return held(("words", path), lambda: WordIds(path))


def encode_words(path: str, text: bytes) -> bytes:
    return b"".join(map(word_ids(path).__getitem__, text.split()))
