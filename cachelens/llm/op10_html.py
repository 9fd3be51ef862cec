"""Main text of web pages with suffix arrays over the pages of a host.

Pages are read into blocks of text. What the markup itself names as menu, header, footer, sidebar,
notice, advert, form, script, style or reader comment is left out. In a page whose article is marked
(``article``, else ``main``) the article's blocks are the text, with a first-level heading that stands in ``main`` beside it. In other pages boilerplate has to be
told from the text by repetition: the token streams of a host's pages are concatenated,
their suffixes sorted (to a depth of ``MIN_RUN`` tokens), and token runs that several distinct pages
share are boilerplate; blocks that such runs cover are removed and the unique ones kept.

A host's pages are dealt in shards of bounded size (``SHARD_BYTES`` of text), so a host of any
size is split; the shards' runs are added up by host, so the result is the same for any number of shards.
A run has to be found in ``MIN_SHARE`` of a host's pages, and in ``MIN_PAGES`` at least. Pages whose
blocks (without those that the markup names) are equal are copies and count once. Only hosts with a page
without a marked article are counted.

A marked article is held against its host too, as sites repeat pleas and notices in unnamed elements inside it. There only
long runs count (``ARTICLE_RUN`` tokens, in ``MIN_SHARE`` of the host's distinct articles and ``ARTICLE_PAGES`` at least), a block goes only if such runs
cover it wholly, and an article that would lose more than half of its words is a near copy of others and stays whole. The tokens
that maximal shared runs of some length or more cover are those that shared runs of just that length cover, so the suffixes are sorted to that
depth and the answer does not depend on the shards: a shard names the runs that its share of the pages makes
possible, and those of a host with several shards are counted again over the whole host.

Defined cases: a null or empty html gives an empty text; pages without a url share the host '';
repeated rows are pages each; null ids pass through; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import html
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cachelens.llm.common import content_key, longs, map_batches, materialize
from cachelens.llm.op8_substrings import gram_hashes

SHARD_BYTES = 4 << 20
MIN_RUN, MIN_PAGES, MIN_SHARE = 3, 3, 0.2
ARTICLE_RUN, ARTICLE_PAGES = 8, 5

MARKUP = regex.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<svg(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^\"'>])*/>"  # closed by itself
    r"|<(?P<raw>script|style|template|noscript|textarea|title|svg|iframe|select|annotation|annotation-xml)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^\"'>])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>",
    regex.I | regex.S,
)
ATTRIBUTE = regex.compile(r"""([a-z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b""", regex.I)

# HTML element names by their role, and words that name page parts in attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mtext mspace mstyle mtable mtr mtd mpadded mphantom semantics".split())
DROPPED = frozenset("nav footer aside form head button dialog menu object audio video canvas map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
DROPPED_NAMES = frozenset(
    "nav navbar navigation navi menu menubar breadcrumb breadcrumbs topbar masthead footer sidebar rail widget widgets notice notices cookie cookies consent gdpr banner popup modal "
    "overlay newsletter subscribe subscription signup login paywall ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted comment comments "
    "reply replies disqus respond share sharing social related recommended recommendations pagination pager toolbar form search skip".split())
HEADER_NAMES = frozenset(("header", "hero"))
# Names that are words of articles too: there a class has to be such a name, alone or with the suffix of a container.
WORDS_OF_TEXT = frozenset("search form related recommended recommendations share sharing social rail skip notice notices reply replies respond banner menu navigation widget widgets overlay "
                          "promotion comment comments subscription login".split())
CONTAINERS = frozenset("area bar block box bottom button buttons container content group inner item items list links panel section top wrap wrapper".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NAME_PART = regex.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block(NamedTuple):
    text: str
    dropped: bool
    place: int  #: 2 inside an article, 1 inside main, 0 elsewhere
    title: bool = False  #: a first-level heading


def _names_part(name: str, value: str, in_article: bool) -> bool:
    """Whether a class or id names a page part that is left out."""
    if not in_article:
        return not {p.lower() for p in NAME_PART.findall(value)}.isdisjoint(DROPPED_NAMES | HEADER_NAMES)
    for token in value.split():
        parts = [p.lower() for p in NAME_PART.findall(token)]
        found = DROPPED_NAMES.intersection(parts)
        if found - WORDS_OF_TEXT:
            return True
        # an id of one such word is an anchor of the article
        if found and (name == "class" or len(parts) > 1) and all(p in DROPPED_NAMES or p in CONTAINERS for p in parts):
            return True
    return False


def _named_out(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attributes.strip():
        return False
    for name, value, bare in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if bare or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in DROPPED_ROLES:
            return True
        if name == "style" and regex.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, regex.I):
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") or name in ("class", "id") and tag == "article":
            if _names_part(name, value, in_article):
                return True
    return False


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, white space as single spaces, character references decoded."""
    out: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int]] = [("", False, 0)]  # open elements: name, left out, place

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack[-1][1], stack[-1][2], any(name == "h1" for name, _, _ in stack)))
            parts.clear()

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["close"]:
            if tag in INLINE:
                if stack[-1][0] == f"{tag}!":
                    end_block()
                    stack.pop()
                continue
            end_block()
            if any(name == tag for name, _, _ in stack[1:]):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag not in VOID and (stack[-1][0] == f"{tag}!" or _named_out(tag, m["attributes"], stack[-1][2] == 2)):
                end_block()  # a hidden span or the like, and the same inside it
                stack.append((f"{tag}!", True, stack[-1][2]))
            continue
        end_block()
        while len(stack) > 1 and stack[-1][0] in CLOSES.get(tag, ()):
            stack.pop()
        if tag not in VOID and not m["attributes"].endswith("/"):
            _, left_out, place = stack[-1]
            left_out = left_out or _named_out(tag, m["attributes"], place == 2)
            stack.append((tag, left_out, max(place, {"article": 2, "main": 1}.get(tag, 0))))
    if at < len(page):
        parts.append(regex.sub(r"<[^>]*\Z", "", page[at:]))
    end_block()
    return out


def repeated_runs(tokens: np.ndarray, page: np.ndarray, depth: int, pages: int) -> np.ndarray:
    """Marks the tokens covered by runs of ``depth`` tokens that ``pages`` distinct pages share.

    Negative tokens end a run. The suffixes are sorted by prefix doubling until ``depth`` tokens
    of each have been looked at.
    """
    covered = np.zeros(len(tokens), bool)
    start, group = sorted_runs(tokens, depth)
    if not len(start):
        return covered
    first, _ = distinct_pairs(group, page[start])
    found = np.bincount(group[first], minlength=len(tokens) + 1)  # distinct pages by run
    hit = start[found[group] >= pages]
    for k in range(depth):
        covered[hit + k] = True
    return covered


def sorted_runs(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of ``depth`` tokens start, and a number that equal runs share."""
    n = len(tokens)
    if n < depth:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank, known = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while known < depth:
        step = min(known, depth - known)
        later = np.full(n, -1, np.int64)
        later[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + later + 1, return_inverse=True)[1]
        known += step
    stops = np.r_[0, np.cumsum(tokens < 0)]
    start = np.arange(n - depth + 1)
    start = start[stops[start + depth] == stops[start]]  # runs inside one block
    return start, rank[start]


def distinct_pairs(group: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, int]:
    """Positions of the first of each (group, owner), and their number."""
    order = np.lexsort((owner, group))
    g, o = group[order], owner[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (o[1:] != o[:-1])]
    return order[new], int(new.sum())


class Page(NamedTuple):
    text: str  #: blocks that the markup leaves, a line each
    rest: str  #: the other blocks
    open: bool  #: no article is marked


def read(page: str) -> Page:
    every = blocks(page)
    own = [b for b in every if not b.dropped]
    place = max((b.place for b in own), default=0)

    def kept(b: Block) -> bool:
        return not b.dropped and (b.place == place or b.place == 1 and b.title)

    rest = [b.text for b in every if not kept(b)]
    return Page("\n".join(b.text for b in every if kept(b)), "\n".join(rest), bool(own) and not place)


def _short(block: str) -> int:
    return xxhash.xxh3_64_intdigest(block.encode(), seed=1)


def _run_digests(words: list[str], depth: int = MIN_RUN) -> np.ndarray:
    return gram_hashes(np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words)), depth)


def page_runs(pages: list[Page], depth: int = MIN_RUN) -> tuple[np.ndarray, np.ndarray]:
    """(run, page number): digests of the runs of ``depth`` tokens and of the blocks that are
    shorter, once for each page."""
    numbers: dict[str, int] = {}
    tokens, owner, short = [], [], set()
    for number, page in enumerate(pages):
        for block in f"{page.text}\n{page.rest}".split("\n"):
            words = block.split()
            if len(words) < depth:
                if words:
                    short.add((_short(block), number))
                continue
            tokens += [numbers.setdefault(w, len(numbers)) for w in words] + [-1]
            owner += [number] * (len(words) + 1)
    runs, pages_of = [np.array([x[0] for x in short], np.uint64)], [np.array([x[1] for x in short], np.int64)]
    ids = np.array(tokens, np.int64)
    start, group = sorted_runs(ids, depth)
    if len(start):
        first, _ = distinct_pairs(group, np.array(owner, np.int64)[start])
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in numbers), np.uint64, len(numbers))
        runs.append(gram_hashes(hashes[ids], depth)[start[first]])  # no run reaches over a block's end
        pages_of.append(np.array(owner, np.int64)[start[first]])
    return np.concatenate(runs), np.concatenate(pages_of)


def _covered(words: list[str], shared: np.ndarray, depth: int) -> bool:
    hit = np.flatnonzero(np.isin(_run_digests(words, depth), shared))
    covered = np.zeros(len(words), bool)
    for k in range(depth):
        covered[hit + k] = True
    return bool(covered.all())


def without_shared(text: str, shared: np.ndarray) -> str:
    """The blocks of an open page that runs with the sorted digests ``shared`` do not cover."""
    kept = []
    for block in text.split("\n"):
        words = block.split()
        if len(words) < MIN_RUN:
            gone = np.isin(np.array([_short(block)], np.uint64), shared).all()
        else:
            gone = _covered(words, shared, MIN_RUN)
        if not gone:
            kept.append(block)
    return "\n".join(kept)


def article_without_shared(text: str, shared: np.ndarray) -> str:
    """The blocks of a marked article that long runs with the digests ``shared`` do not cover; all of them if the
    others hold more than half of the words."""
    kept, gone, total = [], 0, 0
    for block in text.split("\n"):
        words = block.split()
        total += len(words)
        if len(words) >= ARTICLE_RUN and _covered(words, shared, ARTICLE_RUN):
            gone += len(words)
        else:
            kept.append(block)
    return text if 2 * gone > total else "\n".join(kept)


def _frequent(pages: list[Page], depth: int, least: int) -> np.ndarray:
    """Digests of the runs that enough of the distinct contents of ``pages`` share."""
    texts = {t: i for i, t in enumerate(dict.fromkeys(p.text for p in pages))}
    need = max(least, int(np.ceil(MIN_SHARE * len(texts))))
    run, page = page_runs(pages, depth)
    content = np.array([texts[p.text] for p in pages], np.int64)[page]
    shared, n = np.unique(run[distinct_pairs(run, content)[0]], return_counts=True) if len(run) else (run, run)
    return shared[n >= need]


def main_texts(pages: list[str]) -> list[str]:
    """Main texts of pages of one host."""
    every = [read(p) for p in pages]
    shared = _frequent(every, MIN_RUN, MIN_PAGES)
    inside = _frequent([Page(p.text, "", False) for p in every if not p.open and p.text], ARTICLE_RUN, ARTICLE_PAGES)
    return [without_shared(p.text, shared) if p.open else article_without_shared(p.text, inside) for p in every]


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` of every page."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = [read(x or "") for x in batch.column(3).to_pylist()]
        columns = [pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.bool_()))]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["page_id", "url", "host", "text", "rest", "open"])

    written = map_batches(own, parse, "page_id long, url string, host string, text string, rest string, open boolean")
    read_pages = materialize(written.withColumn("row", F.monotonically_increasing_id()), "pages", compression="zstd")
    marked = _clean(read_pages.filter("not open"), shared_in_articles(read_pages.filter("not open and text <> ''")), article_without_shared)
    open_hosts = materialize(read_pages.filter("open").select("host").distinct(), "open-hosts")
    if open_hosts.isEmpty():
        return marked
    shared = shared_runs(read_pages.join(open_hosts, "host", "left_semi").select("host", "text", "rest"))
    return marked.unionByName(_clean(read_pages.filter("open"), shared, without_shared))


def _clean(pages: DataFrame, shared: DataFrame | None, keep: Callable[[str, np.ndarray], str]) -> DataFrame:
    """``page_id, url, text`` without what ``keep`` drops for the shared runs of the page's host."""
    if shared is None:
        return pages.select("page_id", "url", "text")

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [keep(text, runs) for text, runs in zip(batch.column(2).to_pylist(), _run_lists(batch.column(3)), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    # a host has at most 1 / MIN_SHARE times as many shared runs as a page has runs on average
    lists = shared.groupBy("host").agg(F.collect_list("run").alias("runs"))
    found = pages.join(lists, "host", "left").select("page_id", "url", "text", "runs")
    cleaned = map_batches(found.filter("runs IS NOT NULL"), clean, "page_id long, url string, text string")
    return found.filter("runs IS NULL").select("page_id", "url", "text").unionByName(cleaned)


def _run_lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted digests of each row; pages of a host follow each other with equal lists."""
    last = None
    for runs in column:
        if last is None or not runs.values.equals(last):
            last, digests = runs.values, np.sort(runs.values.to_numpy().view(np.uint64))
        yield digests


def shared_in_articles(articles: DataFrame, shard_bytes: int | None = None) -> DataFrame | None:
    """``host, run``: digests of the runs of ``ARTICLE_RUN`` tokens that enough distinct articles of a host share; none: nothing.
    ``articles`` has ``host, text`` and the written number ``row``, which deals a host's articles evenly."""
    k1, k2 = content_key(F.col("text"))
    contents = articles.select("host", k1.alias("c1"), k2.alias("c2"), F.octet_length("text").alias("size"))
    hosts = (contents.groupBy("host", "c1", "c2").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
             .groupBy("host").agg(F.sum("n").alias("pages"), F.ceil(F.sum("size") / (shard_bytes or SHARD_BYTES)).cast("int").alias("shards"),
                                  F.greatest(F.lit(ARTICLE_PAGES), F.ceil(F.count("*") * MIN_SHARE)).alias("need"), F.count("*").alias("contents")))
    hosts = materialize(hosts.filter("contents >= need"), "article-hosts")
    if hosts.isEmpty():
        return None
    # one key column: rows dealt by host alone would satisfy a grouping by (host, shard)
    cell = F.concat_ws("#", "host", F.pmod(F.xxhash64("row"), F.col("shards")))
    dealt = articles.join(hosts, "host").select(cell.alias("cell"), "host", "text", (F.col("need") / F.col("pages")).alias("share"), "need", "shards")

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The texts of a cell as one, compressed; texts have no empty lines."""
        cells: dict[str, list[int]] = {}
        for i, name in enumerate(batch.column(0).to_pylist()):
            cells.setdefault(name, []).append(i)
        texts = batch.column(2).to_pylist()
        packed = [zlib.compress("\n\n".join(dict.fromkeys(texts[i] for i in own)).encode(), 1) for own in cells.values()]
        first = pa.array([own[0] for own in cells.values()])
        columns = [batch.column(0).take(first), batch.column(1).take(first), *(c.take(first) for c in batch.columns[3:])]
        return pa.RecordBatch.from_arrays([*columns, pa.array([len(own) for own in cells.values()]), pa.array(packed, pa.binary())],
                                          ["cell", "host", "share", "need", "shards", "pages", "texts"])

    dealt = map_batches(dealt, pack, "cell string, host string, share double, need long, shards int, pages long, texts binary")

    def candidates(table: pa.Table) -> pa.Table:
        """Runs that may be in enough articles: somewhere the part of them is at least the shard's part of the host's pages."""
        texts = list(dict.fromkeys(t for b in table.column("texts").to_pylist() for t in zlib.decompress(b).decode().split("\n\n")))
        share, need, shards = (table.column(c)[0].as_py() for c in ("share", "need", "shards"))
        run, _ = page_runs([Page(t, "", False) for t in texts], ARTICLE_RUN)
        found, n = np.unique(run, return_counts=True)  # a run comes once for each text
        found = found[n >= (need if shards == 1 else share * sum(table.column("pages").to_pylist()) - 1e-6)]
        return pa.table({"host": pa.repeat(table.column("host")[0], len(found)), "run": longs(found), "shards": pa.repeat(pa.scalar(shards, pa.int32()), len(found))})

    named = materialize(dealt.groupBy("cell").applyInArrow(candidates, "host string, run long, shards int").distinct(), "article-runs")
    whole, parts = named.filter("shards = 1").select("host", "run"), named.filter("shards > 1")
    if named.isEmpty():
        return None
    if parts.isEmpty():
        return whole

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs, rows = [], []
        for i, (text, asked) in enumerate(zip(batch.column(1).to_pylist(), _run_lists(batch.column(4)), strict=True)):
            run, _ = page_runs([Page(text, "", False)], ARTICLE_RUN)
            run = run[np.isin(run, asked)]
            runs.append(run)
            rows.append(np.full(len(run), i))
        at = pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), longs(np.concatenate(runs)), batch.column(2).take(at), batch.column(3).take(at)], ["host", "run", "c1", "c2"])

    lists = parts.groupBy("host").agg(F.collect_list("run").alias("runs"))
    asked = articles.join(lists, "host").select("host", "text", k1.alias("c1"), k2.alias("c2"), "runs")
    counts = map_batches(asked, count, "host string, run long, c1 long, c2 long").distinct().groupBy("host", "run").agg(F.count("*").alias("n"))
    return whole.unionByName(counts.join(hosts, "host").filter("n >= need").select("host", "run"))


def shared_runs(pages: DataFrame, shard_bytes: int | None = None) -> DataFrame:
    """``host, run``: digests of the runs that enough distinct pages of a host share."""
    k1, k2 = content_key(F.col("text"))
    single = materialize(pages.dropDuplicates(["host", "text", "rest"]).withColumn("content", F.struct(k1, k2)), "distinct-pages")
    size = F.octet_length("text") + F.octet_length("rest")
    hosts = materialize(
        single.groupBy("host", "content").agg(F.sum(size).alias("size")).groupBy("host")
        .agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / (shard_bytes or SHARD_BYTES))).cast("int").alias("shards"),
             F.greatest(F.lit(MIN_PAGES), F.ceil(F.count("*") * MIN_SHARE)).alias("need")), "hosts")
    # one key column: rows dealt by host alone would satisfy a grouping by (host, shard)
    shard = F.pmod(F.xxhash64("text", "rest"), F.col("shards"))
    dealt = single.join(hosts, "host").select(F.concat_ws("#", "host", shard).alias("cell"), "host", "text", "rest", F.col("content.*")).toDF("cell", "host", "text", "rest", "c1", "c2")

    def run(table: pa.Table) -> pa.Table:
        every = [Page(t, r, False) for t, r in zip(table.column("text").to_pylist(), table.column("rest").to_pylist(), strict=True)]
        runs, page = page_runs(every)
        at = pa.array(page)
        return pa.table({"host": table.column("host").take(at), "run": longs(runs), "c1": table.column("c1").take(at), "c2": table.column("c2").take(at)})

    found = dealt.groupBy("cell").applyInArrow(run, "host string, run long, c1 long, c2 long").distinct()
    counts = found.groupBy("host", "run").agg(F.count("*").alias("n")).join(hosts.select("host", "need"), "host")
    return counts.filter("n >= need").select("host", "run")
