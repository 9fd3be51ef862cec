"""Text operators against plain Python, on awkward documents: nulls, empty and very long texts,
ties, repeated rows, and extra columns named like the operators' own."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

P = pytest.importorskip("public_tokenizers")

SCHEMA = ("doc_id long, text string, lang string, n_chars long, n_lines long, n_dropped long, n_words long, n_removed long, "
          "fp long, component_id long, piece int, length long, ids string, content string, n_tokens long, h1 long, root long, salt int")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def texts():
    rng = random.Random(5)
    vocabulary = ["tion", "erre", "the", "of", "Ünder", "naïve", "漢字", "x", "ABC", "don't", "42", "a,", "<|endoftext|>", "İz", "ΣΑΣ"]
    prose = [" ".join(rng.choice(vocabulary) + rng.choice(["", "a", "er", "ing"]) for _ in range(n)) for n in (3, 60, 120, 400)]
    passage = " ".join(f"w{i}" for i in range(60))
    long = "\n".join(" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(2500))
    out = [None, "", " \t\n ", "one", prose[0], prose[1], prose[1], prose[1] + " tail words", prose[2] + "\n" + passage, passage + "\n" + prose[3],
           "  A Line That Repeats \nown line of nine\nshort\nshort", "a line that repeats\r\nother line here", "x\x0b\x0ca line that repeats", long, long + " end",
           "same same same same " * 30, "no" + "space" * 3000, "  nbsp words\x85here\x1cthere", "é ́x 'S 'LL 12345", "🙂🙂 👩‍👩‍👧 ok"]
    return out


@pytest.fixture(scope="module")
def rows():
    own = [(i * 3 + 1, t) for i, t in enumerate(texts())]
    return own + [own[5], own[5], own[8], (None, "a line that repeats\nnull id"), (None, None), (None, "a line that repeats\nnull id")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(d, t, "en" if i % 3 else None, None, 7, 7, 7, 7, 7, 7, 7, 7, "c", "c", 7, 7, 7, 7) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORDS.findall(t or "")


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def brute_simhash(t):
    w = words(lower(t or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, distance):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def test_simhash_components(docs, nothing, rows):
    from cachelens.llm.op1_simhash import keep_first, near_duplicates

    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in near_duplicates(docs).collect()]
    fps = {t: brute_simhash(t) for _, t in rows}
    root = brute_components(set(fps.values()), 4)
    first = {}
    for d, t in rows:
        if d is not None:
            first[root[fps[t]]] = min(d, first.get(root[fps[t]], d))
    want = [(d, fps[t], first.get(root[fps[t]])) for d, t in rows]
    assert Counter(got) == Counter(want)
    kept = Counter(r.doc_id for r in keep_first(docs).collect())
    lone = any(d is None and c is None for d, _, c in want)  # rows without an id stay or go together
    assert kept == Counter(d for d, _, c in want if (lone if d is None else d == c))
    assert near_duplicates(nothing).collect() == [] and keep_first(nothing).columns == nothing.columns


@pytest.mark.parametrize("max_node", [20_000, 40])
def test_links_in_dense_clouds(spark, max_node):
    from cachelens.llm.components import connected_components
    from cachelens.llm.op1_simhash import links

    rng = random.Random(3)
    centre = rng.getrandbits(64)
    cloud = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(300)}
    values = sorted(cloud | {rng.getrandbits(64) for _ in range(300)})
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    got = {r.node % 2**64: r.root for r in connected_components(links(df, 4, max_node)).collect()}
    want = brute_components(values, 4)
    classes = defaultdict(set)
    for v, r in want.items():
        classes[r].add(v)
    mine = defaultdict(set)
    for v in values:
        mine[got.get(v, ("alone", v))].add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, classes.values()))


def test_more_blocks_find_the_same_links():
    from cachelens.llm.op1_simhash import block_masks, choose_blocks

    for blocks, distance in ((5, 4), (6, 4), (7, 3)):
        masks = block_masks(blocks, distance)
        rng = random.Random(blocks)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << x for x in rng.sample(range(64), distance))
            assert any(a & m == b & m for m in masks)
    assert choose_blocks(10, 4) == 5 and choose_blocks(10**9, 4) > 5


def test_byte_bpe_equals_the_library(docs, nothing, rows):
    import tiktoken

    from cachelens.llm.op2_byte_bpe import decode, encode

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = [(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in decode(encode(docs, path, P.PATTERN), path).collect()]
    want = [(d, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t in rows]
    assert Counter(got) == Counter(want)
    both = encode(docs, path, P.PATTERN, with_decoded=True).collect()
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in both) == Counter(want)
    assert decode(encode(nothing, path, P.PATTERN), path).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_byte_bpe_on_random_bytes_and_long_runs(name):
    import tiktoken

    from cachelens.llm.op2_byte_bpe import bpe

    own = bpe(P.path(name), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(1)
    cases = ["".join(rng.choice(alphabet) for _ in range(200)) for alphabet in ("ab", "aab \n", "éàüß漢 \t", "'strevl 019") for _ in range(100)]
    for t in cases + ["ab" * 4000, "a" * 9000, " " * 5000, " \x85\x1c"]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode_ordinary(t)


def brute_lines(rows):
    def key(x):
        return lower(x.strip(" \t\n\r\x0b\x0c"))

    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(2**63 - 1 if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        own = 2**63 - 1 if d is None else d
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == own]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("max_broadcast", [1 << 20, 0])
def test_line_dedup(docs, nothing, rows, max_broadcast):
    from cachelens.llm.op4_lines import dedup_lines

    out = dedup_lines(docs, max_broadcast=max_broadcast)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = [(r[0], r[-2], r[-1], r[1]) for r in out.collect()]
    assert Counter(got) == Counter(brute_lines(rows))
    assert {r[5] for r in out.collect()} == {7}  # the input's own columns stay
    assert dedup_lines(nothing, max_broadcast=max_broadcast).collect() == []


def test_perfect_hash_is_minimal():
    from cachelens.llm.op4_lines import PerfectHash

    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 5000):
        a, b = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
        perfect = PerfectHash.build(a, b)
        assert sorted(perfect.find(a, b).tolist()) == list(range(n))


@pytest.mark.parametrize("max_broadcast", [1 << 20, 0])
def test_substring_dedup(docs, nothing, rows, max_broadcast):
    from cachelens.llm.op8_substrings import remove_repeated

    size = 35
    every = [words(t) for _, t in rows]
    count = Counter(tuple(w[i : i + size]) for w in every for i in range(len(w) - size + 1))
    want = []
    for (d, _), w in zip(rows, every, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone |= set(range(i, i + size))
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    out = remove_repeated(docs, size, max_broadcast=max_broadcast)
    assert Counter((r[0], r[-2], r[-1], r[1]) for r in out.collect()) == Counter(want)
    assert remove_repeated(nothing, max_broadcast=max_broadcast).collect() == []


@pytest.mark.parametrize("max_broadcast", [0, 1 << 20])
def test_a_very_common_line_is_split(spark, max_broadcast):
    from pyspark.sql import functions as F

    from cachelens.llm import op8_substrings as op

    rng = random.Random(9)
    lines = [" ".join(f"{name}{i}" for i in range(n)) for name, n in (("l", 12), ("m", 34), ("p", 40))]
    made = [" ".join(f"u{rng.randrange(10**9)}" for _ in range(45)) for _ in range(2 * 400)]
    texts = [f"{made[2 * i]} {lines[i % 3]} {made[2 * i + 1]}" for i in range(400)]
    texts += [texts[0], texts[4], f"x {texts[1]}", " ".join(texts[7].split()[20:90]), " ".join(lines[2:] * 5), "l0 l1", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    where = defaultdict(list)
    for i, t in enumerate(texts):
        own = (t or "").split()
        for j in range(len(own) - 34):
            where[tuple(own[j : j + 35])].append((i, j))
    gone = {(i, j + k) for places in where.values() if len(places) > 1 for i, j in places for k in range(35)}
    want = {i: " ".join(w for j, w in enumerate((t or "").split()) if (i, j) not in gone) for i, t in enumerate(texts)}
    got = {r.doc_id: r.text for r in op.remove_repeated(df, max_broadcast=max_broadcast, shard_words=1500).collect()}
    assert got == want and any(got[i] != (t or "") for i, t in enumerate(texts))

    found = op.cut_stretches(df, op.repeated_anchors(df, 35), 35, "text", max_broadcast)
    counts = found.groupBy("anchor", "d1", "d2").agg(F.count("*").alias("n"), F.max("windows").alias("windows"))
    unclear = op.unclear_anchors(counts, 35)
    calm, shard = op.reference_shards(unclear, 1500)
    assert unclear.agg(F.max("words")).first()[0] > 4 * 1500
    assert (calm.groupBy(shard).agg(F.sum("words").alias("words")).agg(F.max("words")).first()[0] or 0) <= 4 * 1500


def test_automaton_counts_places_of_windows():
    from cachelens.llm.op8_substrings import SuffixAutomaton

    rng = random.Random(4)
    for _ in range(60):
        size = rng.choice([2, 3, 5])
        known = {tuple(rng.randint(0, 3) for _ in range(rng.randint(size, 25))): rng.randint(1, 3) for _ in range(5)}
        automaton = SuffixAutomaton()
        for t, n in known.items():
            automaton.add(list(t), n)
        automaton.finish()
        count = Counter()
        for t, n in known.items():
            for i in range(len(t) - size + 1):
                count[t[i : i + size]] += n
        for t in known:
            assert automaton.repeated(list(t), size).tolist() == [count[t[i : i + size]] > 1 for i in range(len(t) - size + 1)]


def library_ids(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [e.ids for e in library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]


def test_token_counts_and_their_cache(spark, docs, nothing, rows, tmp_path):
    from cachelens.llm.op9_token_counts import CACHE_SCHEMA, count_tokens

    path, store = P.path("word_bpe_49k.json"), str(tmp_path / "counts")
    want = Counter((d, len((t or "").encode()), len(i), len(i) > 20) for (d, t), i in zip(rows, library_ids(rows), strict=True))
    assert Counter(map(tuple, count_tokens(docs, path, 20, store).collect())) == want
    stored = spark.read.schema(CACHE_SCHEMA).parquet(store).count()
    distinct = len({" ".join(words(t)) for _, t in rows})
    assert distinct <= stored
    assert Counter(map(tuple, count_tokens(docs, path, 20, store).collect())) == want
    assert spark.read.schema(CACHE_SCHEMA).parquet(store).count() == stored  # all found
    assert count_tokens(nothing, path).collect() == []


def test_packing(spark, docs, nothing, rows):
    from cachelens.llm.op5_packing import pack, sequences

    path = P.path("word_bpe_49k.json")
    got = pack(docs, path, 64).collect()
    want = []
    for (d, _), ids in zip(rows, library_ids(rows), strict=True):
        ids = [*ids, 0]
        for k, at in enumerate(range(0, len(ids), 64)):
            want.append((d, k, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())))
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= 1.02 * -(-sum(r.length for r in got) // 64) + 1
    assert pack(nothing, path).collect() == []
    named = docs.filter("doc_id > 20").dropDuplicates(["doc_id"])
    whole = {r.sequence_id: len(r.ids) // 4 for r in sequences(named, pack(named, path, 64), path, 64).collect()}
    assert sum(whole.values()) == pack(named, path, 64).agg({"length": "sum"}).first()[0]


def test_packing_plan_against_first_fit():
    from cachelens.llm.op5_packing import plan

    rng = random.Random(6)
    for _ in range(150):
        capacity = rng.choice([10, 20, 64, 2048])
        lengths = [rng.randint(1, capacity if rng.random() < 0.7 else max(1, capacity // 6)) for _ in range(rng.randint(0, 200))]
        made, bins = Counter(), []
        patterns = plan(Counter(lengths), capacity)
        for times, content in patterns:
            assert times > 0 and 0 < sum(content) <= capacity
            for x in content:
                made[x] += times
        assert made == Counter(lengths)
        for x in sorted(lengths, reverse=True):
            at = next((i for i, room in enumerate(bins) if room >= x), None)
            if at is None:
                bins.append(capacity - x)
            else:
                bins[at] -= x
        assert sum(n for n, _ in patterns) <= len(bins) + 1


def test_quality_counts(docs, nothing, rows):
    from cachelens.llm.op7_quality import keep_good, measure

    path = P.path("piece_bpe_32k.model")
    want = []
    for d, t in rows:
        w = words(t)
        count = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered),
                     len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    got = measure(docs, path).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter(want)
    assert not any(r.kept and r.base_failed for r in got)
    assert Counter(r.doc_id for r in keep_good(docs, path).collect()) == Counter(r.doc_id for r in got if r.kept)
    assert measure(nothing, path).collect() == [] and keep_good(nothing, path).columns == nothing.columns


def test_quality_on_labelled_documents(spark):
    """Held-out accuracy: the labels were not used by the rules."""
    from cachelens.llm.op7_quality import measure

    sf = "/root/testdata/sf0.01"
    got = measure(spark.read.parquet(f"{sf}/documents.parquet"), P.path("piece_bpe_32k.model"))
    seen = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed").select("quality", "kept").collect()
    good, bad = [r.kept for r in seen if r.quality == 1], [r.kept for r in seen if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_license_scan(spark, docs, nothing):
    from cachelens.llm.op3_licenses import ISC, MIT, scan

    filled = MIT.replace("<year> <copyright holders>", "2020 Jane Roe").replace("\n\n", "\n").lower().replace("license", "licence")
    mine = spark.createDataFrame([(1, filled), (2, "intro\nReleased under the MIT licence!\nreleased under the mit license"), (3, ISC + "\nmore"), (4, None), (None, ISC)],
                                 "doc_id long, text string")
    assert {tuple(r) for r in scan(mine).collect()} == {(1, "text", "MIT", 1), (2, "line", "MIT", 2), (None, "text", "ISC", 1)}
    assert scan(docs).collect() == [] and scan(nothing).collect() == []


def test_whole_licences_are_known(spark):
    from pathlib import Path

    import duckdb

    from cachelens.llm import op3_licenses as op

    body = op.MIT.split("\n\n", 1)[1]
    filed = [(name, (Path(op.__file__).parent / "licences" / f"{name}.txt").read_text()) for name in op.FILES]
    bsd = "\n".join(["Copyright (c) 2020, A. All rights reserved.", op.BSD_START, *(f"{i}. {c}" for i, c in enumerate(op.BSD_CONDITIONS, 1)), op.BSD_END])
    cases = [*filed, ("MIT", body), ("MIT", f"The MIT License (MIT)\n\n{body}"), ("BSD-3-Clause", bsd), ("BSD-3-Clause", f"BSD 3-Clause License\n\n{bsd}"),
             ("Zlib", f"zlib License\n\n(C) 2001 A\n{op.ZLIB}"), ("Unlicense", op.UNLICENSE % "https://unlicense.org")]
    cases += [(None, bsd.replace("binary", "other")), (None, filed[0][1][:5000])]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = sorted(tuple(r) for r in op.scan(df).collect())
    assert [(i, name) for i, unit, name, _ in got if unit == "text"] == [(i, name) for i, (name, _) in enumerate(cases) if name]
    with duckdb.connect() as db:
        db.register("documents", df.toArrow())
        assert sorted(db.sql(op.oracle()).fetchall()) == got


def test_very_long_pieces_take_linear_time():
    import time

    import tiktoken

    from cachelens.llm.op2_byte_bpe import bpe, tokens_by_id

    path = P.path("byte_bpe_50k.tiktoken")
    encoder = bpe(path, P.PATTERN)
    rng = random.Random(3)
    library = tiktoken.Encoding("b", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in tokens_by_id(path).items()}, special_tokens={})
    took = {}
    for size in (250_000, 1_000_000):
        word = "".join(rng.choices("etaoinshrdlu", k=size))
        begin = time.perf_counter()
        ids = np.frombuffer(encoder._piece(word), "<u4")
        took[size] = time.perf_counter() - begin
        assert b"".join(encoder.tokens[i] for i in ids.tolist()) == word.encode()
    assert took[1_000_000] < 30 and took[1_000_000] < 12 * took[250_000]
    word = "".join(rng.choices("etaoinshrdlu", k=20_000))
    assert np.frombuffer(encoder._piece(word), "<u4").tolist() == library.encode_ordinary(word)


def test_packing_numbers_one_piece_found_many_times(spark, monkeypatch):
    """Equal rows, null ids included, are dealt to bounded groups by their position."""
    from cachelens.llm import op5_packing

    monkeypatch.setattr(op5_packing, "GROUP_ROWS", 20)
    docs = spark.createDataFrame([(None, "the same text again")] * 300 + [(7, "the same text again")] * 50 + [(i, f"text {i}") for i in range(20)], "doc_id long, text string").repartition(3)
    found = op5_packing.pack(docs, P.path("word_bpe_49k.json"), 64).collect()
    assert len(found) == 370
    filled = defaultdict(list)
    for r in found:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64


def test_line_dedup_counts_documents_not_rows(spark):
    from cachelens.llm.op4_lines import dedup_lines

    rows = [(1, "a line of enough points\nonly here, once"), (1, "a line of enough points\nsecond row of one"), (2, "a line of enough points"), (3, "held by three docs"), (4, "held by three docs"), (5, "held by three docs")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"max_broadcast": 0}):
        got = {(r.doc_id, r.n_lines): r.n_dropped for r in dedup_lines(docs, min_docs=3, **options).collect()}
        assert got == {(1, 2): 0, (2, 1): 0, (3, 1): 0, (4, 1): 1, (5, 1): 1}
