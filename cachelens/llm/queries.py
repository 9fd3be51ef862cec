"""The registered query of each operator, with its DuckDB oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelens.llm.common import documents, load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cachelens.llm.op1_simhash import near_duplicates

    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cachelens.llm.op2_byte_bpe import encode

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN, with_decoded=True)
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cachelens.llm.op4_lines import dedup_lines

    done = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cachelens.llm.op5_packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cachelens.llm.op6_ann import nearest

    vectors = load_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cachelens.llm.op7_quality import measure

    return measure(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cachelens.llm.op8_substrings import remove_repeated

    done = remove_repeated(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cachelens.llm.op9_token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cachelens.llm.op10_html import extract

    return extract(load_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cachelens.llm.op3_licenses import scan

    return scan(documents(spark, sf_dir))


@query
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cachelens.llm.op11_suffixes import remove_repeated

    done = remove_repeated(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cachelens.llm.op12_search import rank

    return rank(documents(spark, sf_dir), load_table(spark, sf_dir, "benchmark"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the periodic tails that op13's contract plants: of documents whose id has a
    CRC-32 h divisible by 10, each word i >= a becomes word a + (i - a) % p. A null id has no tail.
    Words and text pass through a generator each, so that a row's are made once."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.when(h % 10 == 0, F.col("text")), F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    cut = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.explode(F.array(words)).alias("w"))
    cut = cut.withColumn("a", F.expr("CASE WHEN size(w) > 0 THEN g % size(w) END").cast("int"))
    cut = cut.withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)").cast("int"))
    tail = "slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((size(w) - a) / p) AS INT))), 1, size(w) - a)"
    text = F.expr(f"CASE WHEN a IS NULL THEN text ELSE array_join(concat(slice(w, 1, a), {tail}), ' ') END")
    return cut.select("doc_id", F.explode(F.array(text)).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cachelens.llm.op13_periods import collapse_runs

    done = collapse_runs(planted_periods(documents(spark, sf_dir)))
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    best = F.expr("array_min(transform(runs, r -> struct(-r.length AS length, r.start AS start, r.period AS period)))")
    done = done.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))
    return done.select("doc_id", "n_words", "n_runs", "best.start", (-F.col("best.length")).alias("length"), "best.period",
                       F.expr("(-1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def _op3_oracle() -> str:
    from cachelens.llm.op3_licenses import oracle

    return oracle()


ORACLES["op3_license_scan"] = _op3_oracle()


_SPACES = " || ".join(f"chr({x})" for x in (32, 9, 10, 11, 12, 13))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLES["op4_line_dedup"] = f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM s),
k AS (SELECT *, translate(trim(line, {_SPACES}), '{_UPPER}', '{_UPPER.lower()}') AS key FROM l),
h AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
f AS (SELECT k.*, coalesce(h.first_id <> k.doc_id, false) AS gone FROM k LEFT JOIN h ON h.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id"""

ORACLES["op8_substring_dedup"] = """
WITH s AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM s),
v AS (SELECT doc_id, pos, word, md5(string_agg(word, ' ') OVER o) AS h, count(*) OVER o AS n FROM w
      WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
r AS (SELECT h FROM v WHERE n = 35 GROUP BY h HAVING count(*) > 1),
m AS (SELECT v.doc_id, v.pos, v.word, (v.n = 35 AND r.h IS NOT NULL)::INTEGER AS starts FROM v LEFT JOIN r ON r.h = v.h),
c AS (SELECT *, max(starts) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM m),
d AS (SELECT doc_id, count(*) AS n, sum(gone) AS g, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT s.doc_id, coalesce(d.n, 0)::BIGINT AS n_words, coalesce(d.g, 0)::BIGINT AS n_removed, sha256(coalesce(d.kept, '')) AS kept_sha256
FROM s LEFT JOIN d ON d.doc_id = s.doc_id"""


_TERM = "regexp_extract_all(translate(text, '{u}', '{l}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')".format(u=_UPPER, l=_UPPER.lower())

ORACLES["op12_lexical_search"] = f"""
WITH d AS (SELECT doc_id, {_TERM} AS terms FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
c AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS total FROM s),
i AS (SELECT DISTINCT item_id, unnest({_TERM}) AS term FROM benchmark WHERE text IS NOT NULL),
t AS (SELECT doc_id, n, unnest(terms) AS term FROM s),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM f, c),
m AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // total))))::BIGINT AS score
      FROM p JOIN w USING (term) JOIN i USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM m WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50"""
