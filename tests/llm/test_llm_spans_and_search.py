"""Suffix deduplication, lexical search and periodic runs against plain Python, on awkward documents: nulls,
empty and very long texts, ties, repeated rows, and extra columns named like the operators' own."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cachelens.llm import op11_suffixes, op12_search, op13_periods
from cachelens.llm.common import content_key

pytest.importorskip("public_tokenizers")  # as the other operators' tests

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, id long, k long, kept binary, n_bytes long, n_words long, runs array<long>, start long, period long, "
          "k1 long, c0 long, c1 string, firsts binary, windows int, anchor long, score long, rank int, term long")


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 7, 7, b"x", 7, 7, [7], 7, 7, 7, 7, "c", b"x", 7, 7, 7, 7, 7) for d, t in rows], SCHEMA)


# ---------------------------------------------------------------------------------- op11

def passages():
    rng = random.Random(3)
    vocabulary = ["tion", "erre", "the", "Ünder", "naïve", "漢字", "x", "don't", "42", "🙂"]
    prose = [" ".join(rng.choice(vocabulary) + rng.choice(["", "a", "er"]) for _ in range(n)) for n in (10, 60, 150, 400)]
    common = " ".join(f"common{i}" for i in range(20))
    out = [None, "", "short", prose[1], prose[1], prose[1] + " tail", "head " + prose[1], prose[2] + "\n" + prose[0] + prose[3], prose[3] + prose[2],
           "a" * 99, "a" * 100, "a" * 101, "b" * 500, "ab" * 300, "x" + "ab" * 300, "ÜÜ" * 80, "\x00" * 300]
    out += [prose[2][i : i + 300] for i in (0, 7, 31, 90)]
    out += [f"own words {rng.random()} {rng.random()} {common} {rng.random()} {rng.random()} and more {rng.random()}" for _ in range(40)]
    out += ["".join(rng.choice("ab") for _ in range(1500)), "".join(rng.choice("ab") for _ in range(1500)) * 2]
    rows = [(i * 7 % 61, t) for i, t in enumerate(out)]
    return rows + [rows[3], rows[3], rows[8], (None, prose[2]), (None, prose[2]), (None, None), (None, prose[3] + "!"), (5, prose[1] + "?"), (5, prose[1] + "!")]


def brute_suffix_dedup(rows, digest, size):
    """(bytes, removed, spans, kept) of each (id, text)."""
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, digest[r[1]])):
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - size + 1):
            if raw[i : i + size] in seen:
                gone[i : i + size] = [True] * size
            seen.add(raw[i : i + size])
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d, t] = (len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g))
    return out


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 600, "hot_bytes": 600}, {"max_broadcast": 0, "shard_bytes": 2000}, {"size": 40}, {"size": 64, "hot_bytes": 0}], ids=str)
def test_suffix_dedup(spark, options):
    rows = passages()
    docs = frame(spark, rows)
    digest = {r.text: r.k for r in docs.select("text", content_key(docs.text)[0].alias("k")).collect()}
    want = brute_suffix_dedup(rows, digest, options.get("size", 100))
    done = op11_suffixes.remove_repeated(docs, **options)
    assert done.columns == docs.columns + ["kept", "n_bytes", "n_removed", "n_spans"]
    n = len(docs.columns)
    got = [(r[0], r[1], (r[n + 1], r[n + 2], r[n + 3], bytes(r[n]))) for r in done.collect()]
    assert sorted(map(repr, got)) == sorted(repr((d, t, want[d, t])) for d, t in rows)
    assert op11_suffixes.remove_repeated(docs.limit(0), **options).collect() == []


def test_long_texts_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(op11_suffixes, "BYTES_AT_ONCE", 500)
    rng = random.Random(9)
    part = [bytes(rng.choice(b"abcdefgh ") for _ in range(2000)) for _ in range(3)]
    texts = [part[0] + part[1], b"x" + part[1] + part[0], part[2] + part[2][:700]]

    def found(size=100):
        return {raw[a : a + size + w - 1]
                for data, ends, row, at in op11_suffixes._pieces(texts, size) for raw in [data.tobytes()]
                for _, _, first, windows, _ in [op11_suffixes.stretches(data, ends, size)] for a, w in zip(first.tolist(), windows.tolist())}

    windows = {s[i : i + 100] for s in found() for i in range(len(s) - 99)}
    assert windows == {t[i : i + 100] for t in texts for i in range(len(t) - 99)}


def test_blockwise_suffix_sort(monkeypatch):
    monkeypatch.setattr(op11_suffixes, "BUCKET", 50)
    rng = random.Random(4)
    for text in (bytes(rng.choice(b"ab") for _ in range(900)), b"ab" * 400, b"a" * 700, b"xyz" * 100 + b"abcd" * 100 + b"xyz" * 100, bytes(rng.choice(b"abcdefghij") for _ in range(300)) * 3):
        starts = np.arange(len(text) - 99)
        got, classes = [], 0
        for order, opens in op11_suffixes.BlockSorter(text, 100).classes(starts):
            got += order.tolist()
            classes += int(opens.sum())
        assert sorted(got) == starts.tolist()
        prefixes = [text[i : i + 100] for i in got]  # equal windows are one class, in no order among them
        assert prefixes == sorted(prefixes)
        assert classes == len({text[i : i + 100] for i in starts})


def test_difference_cover():
    cover = op11_suffixes.difference_cover(32)
    assert {(a - b) % 32 for a in cover for b in cover} == set(range(32)) and len(cover) <= 10


# ---------------------------------------------------------------------------------- op12

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def term_list(t):
    return TERM.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_rank(rows, items, k):
    texts = [(d, term_list(t)) for d, t in rows]
    texts = [(d, Counter(t), len(t)) for d, t in texts if t]
    n_docs, total = len(texts), sum(n for _, _, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for d, c, n in texts:
            m = 100 - 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(term_list(text)) if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("options", [{}, {"shard_docs": 3, "block_items": 2, "k": 4}, {"shard_docs": 17, "block_bytes": 40, "k": 1}], ids=str)
def test_lexical_search(spark, options):
    rng = random.Random(6)
    vocabulary = ["alpha", "Beta", "naïve", "漢字", "x1", "the", "of", "zeta", "Éa"] + [f"w{i}" for i in range(60)]
    texts = [None, "", " .;- ", "the", "THE the The", "alpha-beta_Éa", "alpha beta"] + [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 90]))) for _ in range(60)]
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(30_000)))
    rows = [(i * 5 % 71, t) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, texts[12]), (None, texts[12]), (3, texts[12])]
    items = [(1, "alpha beta w1 w2 w3"), (2, "the of THE"), (3, None), (4, "  "), (5, "missing words only"), (6, texts[9]), (6, "Éa zeta"), (6, texts[9]), (None, "x1 w7")]
    got = op12_search.rank(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), **options).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_rank(rows, items, options.get("k", 50))))


def test_lexical_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    docs = frame(spark, [(1, "alpha")])
    assert op12_search.rank(docs.limit(0), items).collect() == []
    assert op12_search.rank(docs, items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in op12_search.rank(docs, items).collect()] == [(1, 1, 1)]


def test_k2_treap_holds_its_points():
    rng = np.random.default_rng(1)
    cells = rng.choice(32 * 32, 200, replace=False)
    value = rng.integers(1, 99, 200)
    treap = op12_search.K2Treap(cells // 32, cells % 32, value, 5)
    want = dict(zip(cells.tolist(), value.tolist()))
    for cell in range(32 * 32):
        at = np.zeros(1, np.int64)
        for level in range(5):
            at = treap.child(at, 2 * ((cell // 32 >> 4 - level) & 1) + np.array([(cell % 32 >> 4 - level) & 1]))
            inside = [v for c, v in want.items() if c // 32 >> 4 - level == cell // 32 >> 4 - level and c % 32 >> 4 - level == cell % 32 >> 4 - level]
            assert (treap.maxima[at[0]] == max(inside)) if inside else at[0] == -1
        assert (at[0] >= 0) == (cell in want)


# ---------------------------------------------------------------------------------- op13

def brute_runs(words):
    runs, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and j > i:
                runs.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, q, e - s) for (s, e), q in runs.items())


def collapsed(words, runs):
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts():
    rng = random.Random(8)
    out = [None, "", " \n\t ", "one", "a a a a a", "a a a a a a", "a a a a a a a a b", "a b a b a b a b", "x a b a b a b a b a y", "É É É É É É\x0bÉ", "a\x85a " * 9]
    out += [" ".join(rng.choice("ab") for _ in range(300)) for _ in range(6)] + [" ".join("aaab"[rng.randrange(4)] for _ in range(500)) for _ in range(4)]
    for q in (3, 7, 16, 31, 33, 100):
        unit = [f"u{rng.randrange(q)}" for _ in range(q)]
        out.append(" ".join(["head"] + unit * 6 + unit[: q // 2] + ["tail"]))
        out.append(" ".join(unit * 4) + " x " + " ".join(unit * 5))
        out.append(" ".join((unit[:5] * 8 + unit) * 5))
    out.append(" ".join(["lorem", "ipsum", "dolor"] * 700 + ["x"] * 50 + ["lorem", "ipsum"] * 300))
    return out


@pytest.mark.parametrize("options", [{}, {"tile": 16}, {"tile": 64, "max_broadcast": 0}], ids=str)
def test_periodic_runs(spark, options):
    texts = periodic_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[6]), (None, texts[6]), (4, texts[12]), (4, texts[12])]
    docs = frame(spark, rows)
    done = op13_periods.collapse_runs(docs, **options)
    assert done.columns == docs.columns + ["n_words", "runs"]
    n, got = len(docs.columns), []
    for r in done.collect():
        got.append((r[0], r[1], r[n], [tuple(x) for x in r[n + 1]]))
    want = []
    for d, t in rows:
        words = WORDS.findall(t or "")
        runs = brute_runs(words)
        want.append((d, collapsed(words, runs), len(words), runs))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert op13_periods.collapse_runs(docs.limit(0), **options).collect() == []


def test_periods_of_a_long_text():
    unit = [f"u{i % 977}" for i in range(5000)]
    words = ["x"] * 20 + unit * 5 + [f"v{i}" for i in range(70_000)] + ["a", "b"] * 40_000
    ids = op13_periods.numbered([w.encode() for w in words])
    found = set()
    for low, high, start, stop in op13_periods.explode_tiles(len(ids), 4096):
        found |= {(s + start, e + start, p) for s, e, p in op13_periods.tile_fragments(ids[start:stop], low, high)}
    chained = []
    for s, e, p in sorted(found, key=lambda f: (f[2], f[0])):
        if chained and chained[-1][2] == p and s + p <= chained[-1][1]:
            chained[-1] = (chained[-1][0], max(e, chained[-1][1]), p)
        else:
            chained.append((s, e, p))
    assert (0, 20, 1) in chained and (95_020, 175_020, 2) in chained
    assert any(p == 977 for _, _, p in chained) and not any(p % 2 == 0 and p > 2 and s >= 95_020 for s, _, p in chained)


def test_op13_query_on_the_given_table(spark):
    from cachelens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        words = WORDS.findall(r.text or "")
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue
        runs = brute_runs(words)
        best = min(((-x, s, q) for s, q, x in runs), default=None)
        want = (len(runs), *((best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4),
                hashlib.sha256("".join(f"{s},{x},{q}\n" for s, q, x in runs).encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest())
        g = got[r.doc_id]
        assert (g.n_runs, g.start, g.length, g.period, g.exponent_milli, g.runs_sha256, g.collapsed_sha256) == want
