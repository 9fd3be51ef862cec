"""Vector search and page extraction on awkward rows, and the registered queries' contracts."""

import html as references
import random
import re

import numpy as np
import pytest


def table(spark, vectors, ids):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2.0) for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double")


def brute(vectors, ids, wanted, k):
    x = np.array(vectors, np.float32).astype(np.float64)
    ids = np.array(ids)
    out = {}
    for q in wanted:
        score = (x * x[np.flatnonzero(ids == q)[0]]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def test_search_recall_and_exact_scores(spark):
    from cachelens.llm.op6_ann import nearest

    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((3000, 32)) * rng.uniform(0.5, 2, (3000, 1))
    vectors[1000:2000] = vectors[0]  # one very common vector
    df = table(spark, vectors, range(3000))
    got = nearest(df, df.filter("vec_id % 100 = 0")).collect()
    want = brute(vectors, range(3000), range(0, 3000, 100), 20)
    hits = 0
    for q, best in want.items():
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        exact = dict(brute(vectors, range(3000), [q], 2999)[q])
        assert all(abs(exact[r.vec_id] - r.score) < 1e-12 for r in own)
        hits += len({r.vec_id for r in own} & {i for i, _ in best})
    assert hits >= 0.9 * 20 * len(want)


def test_search_leaves_unusable_vectors_out(spark):
    from cachelens.llm.op6_ann import nearest

    nan, inf = float("nan"), float("inf")
    vectors = [[1, 0], [0.5, 0.5], [1, 0], None, [], [0, 0], [nan, 1], [inf, 1], [None, 1], [1, 2, 3], [0.9, 0.1], [1, 0]]
    df = table(spark, vectors, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, None, 2])
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in nearest(df, df, 4).orderBy("query_id", "rank").collect()]
    assert got[:4] == [(0, 1, 2, 1.0), (0, 2, 2, 1.0), (0, 3, None, 0.9), (0, 4, 1, 0.5)]
    assert {q for q, *_ in got} == {0, 1, 2} and [g[2] for g in got if g[0] == 2] == [0, None, 1]
    assert nearest(df.filter("vec_id = 0"), df, 4).filter("query_id = 0").collect() == []
    assert nearest(df.limit(0), df).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- x --><div class="ad-box">Buy</div><div role="search">find</div>
<article><header><h1>Title &amp;amp; more</h1></header><p>First  <b>bold</b>
line &lt;x&gt; caf&eacute;<br>next<p>Second<aside>pull</aside><div id="newsletter-signup">join</div><ul><li>one<li>two</ul>
<span hidden>ghost</span><form><input>go</form><p>Last<section class="comments"><p>Reader says</p></section></article>
<div class="sidebar">side</div><footer>&copy; me</footer></body></html>"""


def test_blocks_of_a_marked_article():
    from cachelens.llm.op10_html import main_texts

    assert main_texts([PAGE]) == ["Title &amp; more\nFirst bold line <x> café next\nSecond\none\ntwo\nLast"]


def test_pages_without_an_article_lose_what_pages_share(spark):
    from cachelens.llm.op10_html import extract

    rng = random.Random(2)
    rows, want = [], {}
    for i in range(40):
        own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(3)]
        rows.append((i, f"http://a.example/{i}", "<div>Home News About us</div>" + "".join(f"<div>{x}</div>" for x in own) + "<div>All rights reserved by example</div>", "x"))
        want[i] = "\n".join(own)
    rows += [(100, None, None, "x"), (101, "http://b.example", "", "x"), (102, "no url", "plain text only", "x"), (0, *rows[0][1:]), (None, "http://c.example/", "<p>x</p><p", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id in want:
            assert r.text == want[r.page_id]
    assert {r.page_id: r.text for r in got if r.page_id not in want} == {100: "", 101: "", 102: "plain text only", None: "x"}
    assert extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("copies", [3, 1000])
def test_copies_of_an_unmarked_page_keep_their_text(spark, copies):
    from cachelens.llm.op10_html import extract, main_texts

    rng = random.Random(copies)
    own = [[" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(3)] for _ in range(9)]
    page = ["<div>Home News About us</div>" + "".join(f"<div>{x}</div>" for x in o) + "<div>Contact</div>" for o in own]
    html = page + [f"<nav>copy {i}</nav>{page[0]}" for i in range(copies)]
    want = ["\n".join(o) for o in own] + ["\n".join(own[0])] * copies
    assert main_texts(html) == want
    df = spark.createDataFrame([(i, f"http://a.example/{i}", x) for i, x in enumerate(html)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract(df).collect()} == dict(enumerate(want))


def test_runs_are_counted_over_all_shards_of_a_host(spark, monkeypatch):
    from cachelens.llm import op10_html

    rng = random.Random(4)
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(500)) for _ in range(10)]
    rows = [(i, "http://a.example/", f"<div>Home News About us</div><div>{x}</div><div>{'Old notice of four' if i < 4 else 'No'}</div>") for i, x in enumerate(own)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (op10_html.SHARD_BYTES, 4000):  # at 4000, one or two pages a shard
        monkeypatch.setattr(op10_html, "SHARD_BYTES", size)
        assert {r.page_id: r.text for r in op10_html.extract(df).collect()} == dict(enumerate(own))


def test_repeated_runs_against_brute_force():
    from cachelens.llm.op10_html import repeated_runs

    rng = random.Random(8)
    for _ in range(100):
        pages = [[[rng.randrange(4) for _ in range(rng.randint(0, 9))] for _ in range(3)] for _ in range(5)]
        tokens, owner, spans = [], [], []
        for i, page in enumerate(pages):
            for b in page:
                spans.append((i, b, len(tokens)))
                tokens += [*b, -1]
                owner += [i] * (len(b) + 1)
        found = {}
        for i, b, _ in spans:
            for j in range(len(b) - 2):
                found.setdefault(tuple(b[j : j + 3]), set()).add(i)
        want = np.zeros(len(tokens), bool)
        for _, b, at in spans:
            for j in range(len(b) - 2):
                if len(found[tuple(b[j : j + 3])]) >= 3:
                    want[at + j : at + j + 3] = True
        assert (repeated_runs(np.array(tokens), np.array(owner), 3, 3) == want).all()


def test_given_pages_keep_their_articles(spark):
    from cachelens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op10_html_text"](spark, sf).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S).group(1)
        parts = (" ".join(references.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_contract_columns(spark):
    from cachelens.llm.queries import QUERIES

    want = {
        "op1_simhash": "doc_id fingerprint component_id",
        "op2_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op4_line_dedup": "doc_id n_lines n_dropped kept_sha256",
        "op5_packing": "doc_id piece start length ids_crc32 sequence_id offset",
        "op6_ann": "query_id rank vec_id score",
        "op7_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op8_substring_dedup": "doc_id n_words n_removed kept_sha256",
        "op9_token_counts": "doc_id n_bytes n_tokens over_limit",
        "op10_html_text": "page_id url text n_chars",
    }
    for name, columns in want.items():
        assert set(columns.split()) <= set(QUERIES[name](spark, "/root/testdata/sf0.001").columns)


def test_pipeline_stages_follow_each_other(spark):
    import corpus_pipeline
    from cachelens.session import materialize

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), f"test-{name}")  # as run() does; nothing stays cached
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= n
            n = docs.count()
    assert docs.select("doc_id").distinct().count() == n
    for name, stage in corpus_pipeline.STAGES:
        none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
        assert stage(spark, none, sf).collect() == []


def test_articles_keep_their_text():
    from cachelens.llm.op10_html import read

    def text(page):
        return read(page).text

    for empty in ("<svg/>", "<svg viewBox='0 0 1 1' />", "<svg-icon></svg-icon>", "<title-card>t</title-card>", "<svg><title>x</title><path d='M0'/></svg>", "<select-menu/>"):
        assert text(f"<article><p>one</p>{empty}<p>two</p></article>").replace("\nt\n", "\n") == "one\ntwo"
    assert text("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>") == "so x=2 holds"
    assert text("<main><h1>Title</h1><article><p>body</p></article><p>beside</p></main>") == "Title\nbody"
    assert text("<body><h1>Site</h1><article><h1>Title</h1><p>body</p></article></body>") == "Title\nbody"
    for kept in ('class="search-engine-history"', 'id="form"', 'class="related-work-of-darwin"', 'id="social"', 'class="share-of-votes"', 'id="notice"', 'class="reply-to-critics"'):
        assert text(f"<article><p>one</p><section {kept}><p>two</p></section></article>") == "one\ntwo", kept
    for gone in ('class="share-buttons"', 'class="related"', 'class="related-links"', 'class="adBox"', 'class="comments"', 'id="comments-section"', 'class="newsletter-x"', 'class="x cookie-bar"', 'class="social"'):
        assert text(f"<article><p>one</p><div {gone}><p>two</p></div></article>") == "one", gone


def test_long_pages_and_clashing_columns(spark):
    from cachelens.llm.op10_html import extract

    body = "".join(f"<p>paragraph {i} of this page<!-- x --><svg/></p>" for i in range(40_000))
    rows = [(1, "http://a.org/x", f"<article>{body}</article>", "h", "t", "r", True, 5), (1, None, None, None, None, None, None, None), (None, "http://a.org/y", "<main>\n<p>one</p></main>", "h", "t", "r", False, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string, rest string, open boolean, runs int")
    got = {(r.page_id, r.url): r.text for r in extract(pages).collect()}
    assert got[1, "http://a.org/x"] == "\n".join(f"paragraph {i} of this page" for i in range(40_000))
    assert got[1, None] == "" and got[None, "http://a.org/y"] == "one"


def test_articles_lose_what_the_articles_of_a_host_share(spark, monkeypatch):
    from cachelens.llm import op10_html

    rng = random.Random(6)

    def words(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    plea = "Support our newsroom with a small gift each month please"
    own = [[words(30) for _ in range(3)] for _ in range(20)]
    near = words(200)  # copies that differ in one line
    want = ["\n".join(["See also", *o]) for o in own] + ["\n".join([near, f"dated {i}"]) for i in range(20)] + ["\n".join([near, "dated 0"])] * 50
    pages = [f"<article><h2>See also</h2><p>{o[0]}</p><div>{plea}</div><p>{o[1]}</p><p>{o[2]}</p></article>" for o in own]
    pages += [f"<article><p>{near}</p><p>dated {i}</p></article>" for i in range(20)]
    pages += [pages[20]] * 50
    assert op10_html.main_texts(pages) == want
    other = f"<article><p>{plea}</p><p>one</p></article>"
    rows = [(i, "http://a.example/", p) for i, p in enumerate(pages)] + [(1000 + i, f"http://b{i}.example/", other) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    every = dict(enumerate(want)) | {1000 + i: f"{plea}\none" for i in range(6)}
    for size in (op10_html.SHARD_BYTES, 3000):  # at 3000, a few articles a shard
        monkeypatch.setattr(op10_html, "SHARD_BYTES", size)
        assert {r.page_id: r.text for r in op10_html.extract(df).collect()} == every
