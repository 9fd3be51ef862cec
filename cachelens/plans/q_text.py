"""Registered text-preparation and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cachelens.functions.text import model_family, sql_model_family, text_digest
from cachelens.operators import profiling as P
from cachelens.operators import sketches as K
from cachelens.operators import text as X
from cachelens.plans.catalog import ORACLES, T, register
from cachelens.session import materialize
from cachelens.streaming.conversations import first_user_turns
from cachelens.streaming.lookup_stream import file_stream

# --- SQL spellings shared by the oracles ------------------------------------------------
TC = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''))::INTEGER"
STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
NOT_BLANK = f"(text IS NOT NULL AND length({STRIP.format(c='text')}) > 0)"
FILTERED = f"(SELECT doc_id, text, lang, source, {TC} AS token_count FROM documents WHERE {NOT_BLANK}) f0"
KEPT = f"(SELECT * FROM {FILTERED} WHERE token_count BETWEEN 3 AND 512)"
DEDUP = f"""(SELECT min(doc_id) AS doc_id, text, arg_min(token_count, doc_id) AS token_count,
                    count(*) AS frequency FROM {KEPT} k GROUP BY text)"""


def _docs(spark, sf):
    return T(spark, sf, "documents")


def _dedup(spark, sf):
    return X.dedup_exact(X.length_filter(_docs(spark, sf)), "text", "doc_id")


@register("first_user_turn", f"""
WITH a AS (
  SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS fu, count(*) AS num_turns
  FROM conversations GROUP BY conv_id)
SELECT conv_id::BIGINT AS query_id, {STRIP.format(c='fu')} AS query_text, conv_id::BIGINT AS original_index,
       num_turns::INTEGER AS num_turns, CAST(conv_id AS VARCHAR) AS conversation_id
FROM a WHERE fu IS NOT NULL AND length({STRIP.format(c='fu')}) > 0
""")
def q_first_user_turn(spark, sf):
    return X.first_user_turn_flat(T(spark, sf, "conversations"))


@register("stream_first_user_turn", ORACLES["first_user_turn"])
def q_stream_first_user_turn(spark, sf):
    """A2, B1 as a stream: the turns arrive as a file stream; a conversation's start time is derived from its number."""
    turns = file_stream(spark, sf, "conversations").withColumn("started", F.timestamp_seconds(F.col("conv_id") * 60 + 1_600_000_000))
    return first_user_turns(turns, "started")


@register("max_rows", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 100")
def q_max_rows(spark, sf):
    return X.max_rows(_docs(spark, sf).select("doc_id", "lang", "source"), 100, "doc_id")


@register("token_count", f"SELECT doc_id, {TC} AS token_count FROM documents")
def q_token_count(spark, sf):
    return X.with_token_count(_docs(spark, sf)).select("doc_id", "token_count")


@register("length_filter", f"SELECT doc_id, token_count FROM {KEPT}")
def q_length_filter(spark, sf):
    return X.length_filter(_docs(spark, sf)).select("doc_id", "token_count")


@register("dedup_exact", """
SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source,
       count(*) AS frequency
FROM documents GROUP BY text
""")
def q_dedup_exact(spark, sf):
    return X.dedup_exact(_docs(spark, sf).select("doc_id", "text", "lang", "source")).drop("text")


@register("dense_ids", f"SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS query_id FROM {KEPT}")
def q_dense_ids(spark, sf):
    return X.renumber(X.length_filter(_docs(spark, sf)).select("doc_id"), "doc_id")


@register("preprocess", f"""
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS query_id, doc_id, token_count, frequency FROM {DEDUP} d
""")
def q_preprocess(spark, sf):
    return X.preprocess(_docs(spark, sf).select("doc_id", "text")).select(
        "query_id", "doc_id", "token_count", "frequency")


@register("model_family", f"""
SELECT {sql_model_family('source')} AS model_family, count(*) AS n FROM documents GROUP BY 1
""")
def q_model_family(spark, sf):
    return _docs(spark, sf).groupBy(model_family(F.col("source")).alias("model_family")) \
        .agg(F.count(F.lit(1)).alias("n"))


@register("group_top_n_other", """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
top AS (SELECT source FROM c ORDER BY n DESC, source LIMIT 8)
SELECT coalesce(t.source, 'Other') AS source_group, count(*) AS n
FROM documents d LEFT JOIN top t ON d.source = t.source GROUP BY 1
""")
def q_group_top_n_other(spark, sf):
    grouped = P.group_top_n_other(_docs(spark, sf).select("source"), "source", 8, out_col="source_group")
    return grouped.groupBy("source_group").agg(F.count(F.lit(1)).alias("n"))


@register("group_whitelist_other", """
SELECT CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'Other' END AS lang_group, count(*) AS n
FROM documents GROUP BY 1
""")
def q_group_whitelist_other(spark, sf):
    grouped = P.group_top_n_other(_docs(spark, sf).select("lang"), "lang", whitelist=["en", "de"], out_col="lang_group")
    return grouped.groupBy("lang_group").agg(F.count(F.lit(1)).alias("n"))


def _hist_sql(vals_sql: str, bins: int, stage: str | None = None) -> str:
    st = f"'{stage}' AS stage, " if stage else ""
    return f"""(
WITH v AS (SELECT x::DOUBLE AS x FROM {vals_sql} WHERE x IS NOT NULL),
e AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
             CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM v),
c AS (SELECT least(floor((x - lo) / ((hi - lo) / {float(bins)!r}))::INTEGER, {bins - 1}) AS bin, count(*) AS n
      FROM v, e WHERE x BETWEEN lo AND hi GROUP BY 1)
SELECT {st}g.bin::INTEGER AS bin, round(lo + g.bin * ((hi - lo) / {float(bins)!r}), 6) AS bin_lo,
       round(lo + (g.bin + 1) * ((hi - lo) / {float(bins)!r}), 6) AS bin_hi, coalesce(c.n, 0)::BIGINT AS count
FROM range({bins}) g(bin) CROSS JOIN e LEFT JOIN c ON c.bin = g.bin)"""


@register("length_histogram", f"""
SELECT * FROM {_hist_sql(f"(SELECT {TC} AS x FROM documents) r", 80, 'raw')}
UNION ALL
SELECT * FROM {_hist_sql(f"(SELECT token_count AS x FROM {KEPT}) k", 80, 'filtered')}
""")
def q_length_histogram(spark, sf):
    return P.length_histogram(_docs(spark, sf))


@register("length_stats", f"""
SELECT count(*) AS n, round(avg(token_count), 4) AS mean_tokens,
       round(quantile_cont(token_count, 0.5), 4) AS median_tokens, round(stddev_samp(token_count), 4) AS std_tokens
FROM {KEPT}
""")
def q_length_stats(spark, sf):
    return P.length_stats(_docs(spark, sf))


@register("frequency_histogram", f"""
WITH d AS {DEDUP}, top AS (SELECT least(max(frequency), 50) AS m FROM d),
c AS (SELECT frequency, count(*) AS n FROM d GROUP BY frequency)
SELECT g.f::BIGINT AS frequency, coalesce(c.n, 0)::BIGINT AS n_unique
FROM range(1, 51) g(f) JOIN top ON g.f <= top.m LEFT JOIN c ON c.frequency = g.f
""")
def q_frequency_histogram(spark, sf):
    return P.frequency_histogram(_dedup(spark, sf))


@register("frequency_summary", f"""
SELECT count(*) AS n_unique_texts, count(*) FILTER (WHERE frequency = 1) AS n_freq_1,
       round(count(*) FILTER (WHERE frequency = 1) / count(*) * 100.0, 4) AS pct_freq_1,
       count(*) FILTER (WHERE frequency > 1) AS n_duplicated,
       round(count(*) FILTER (WHERE frequency > 1) / count(*) * 100.0, 4) AS pct_duplicated,
       max(frequency)::BIGINT AS max_frequency
FROM {DEDUP} d
""")
def q_frequency_summary(spark, sf):
    return P.frequency_summary(_dedup(spark, sf))


@register("top_frequent", f"""
SELECT doc_id, frequency::BIGINT AS frequency,
       CASE WHEN length(text) > 50 THEN substring(text, 1, 50) || '...' ELSE text END AS label
FROM {DEDUP} d ORDER BY frequency DESC, doc_id LIMIT 15
""")
def q_top_frequent(spark, sf):
    return P.top_frequent(_dedup(spark, sf))


def _share_sql(col: str) -> str:
    return f"""
SELECT {col} AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents) * 100.0, 4) AS pct
FROM documents GROUP BY {col} ORDER BY n DESC, value LIMIT 15"""


@register("value_share_source", _share_sql("source"))
def q_value_share_source(spark, sf):
    return P.value_share(_docs(spark, sf), "source")


@register("value_share_lang", _share_sql("lang"))
def q_value_share_lang(spark, sf):
    return P.value_share(_docs(spark, sf), "lang")


@register("binary_share", """
SELECT count(*) FILTER (WHERE lang = 'en') AS n_match, count(*) FILTER (WHERE lang IS DISTINCT FROM 'en') AS n_other,
       round(count(*) FILTER (WHERE lang = 'en') / count(*) * 100.0, 4) AS pct_match
FROM documents
""")
def q_binary_share(spark, sf):
    return P.binary_share(_docs(spark, sf), "lang", "en")


@register("turn_stats", """
WITH t AS (SELECT conv_id, count(*) AS num_turns FROM conversations GROUP BY conv_id)
SELECT count(*) AS n_conversations, round(avg(num_turns), 4) AS mean_turns,
       round(quantile_cont(num_turns, 0.5), 4) AS median_turns, max(num_turns)::BIGINT AS max_turns FROM t
""")
def q_turn_stats(spark, sf):
    return P.turn_stats(T(spark, sf, "conversations"))


@register("turn_histogram", """
WITH t AS (SELECT conv_id, count(*) AS num_turns FROM conversations GROUP BY conv_id),
top AS (SELECT least(max(num_turns), 30) AS m FROM t),
c AS (SELECT num_turns, count(*) AS n FROM t GROUP BY num_turns)
SELECT g.f::BIGINT AS num_turns, coalesce(c.n, 0)::BIGINT AS n_conversations
FROM range(1, 31) g(f) JOIN top ON g.f <= top.m LEFT JOIN c ON c.num_turns = g.f
""")
def q_turn_histogram(spark, sf):
    return P.turn_histogram(T(spark, sf, "conversations"))


@register("preprocess_funnel", f"""
WITH r AS (SELECT text, {TC} AS tc FROM documents),
a AS (SELECT count(*) AS raw, count(*) FILTER (WHERE tc BETWEEN 3 AND 512) AS filtered,
             count(DISTINCT CASE WHEN tc BETWEEN 3 AND 512 THEN text END) AS dedup FROM r)
SELECT 0 AS step, 'raw' AS stage, raw::BIGINT AS n, round(raw / raw * 100.0, 4) AS pct_of_raw, NULL::BIGINT AS drop FROM a
UNION ALL SELECT 1, 'after_length_filter', filtered, round(filtered / raw * 100.0, 4), (raw - filtered)::BIGINT FROM a
UNION ALL SELECT 2, 'after_dedup', dedup, round(dedup / raw * 100.0, 4), (filtered - dedup)::BIGINT FROM a
""")
def q_preprocess_funnel(spark, sf):
    return P.preprocess_funnel(_docs(spark, sf))


NORM = "sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))"


@register("norm_stats", f"""
WITH n AS (SELECT {NORM} AS v FROM embeddings)
SELECT count(*) AS n, round(avg(v), 6) AS mean_norm, round(stddev_pop(v), 6) AS std_norm,
       round(min(v), 6) AS min_norm, round(max(v), 6) AS max_norm, (max(v) - min(v)) < 1e-6 AS single_bar FROM n
""")
def q_norm_stats(spark, sf):
    return P.norm_stats(T(spark, sf, "embeddings"))


@register("norm_histogram", f"SELECT * FROM {_hist_sql(f'(SELECT {NORM} AS x FROM embeddings) n', 50)}")
def q_norm_histogram(spark, sf):
    return P.norm_histogram(T(spark, sf, "embeddings"))


@register("dimension_stats", """
WITH x AS (SELECT unnest(generate_series(0, len(embedding) - 1)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT dim::INTEGER AS dim, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM x GROUP BY dim
""")
def q_dimension_stats(spark, sf):
    return P.dimension_stats(T(spark, sf, "embeddings"))


@register("pivot_mean_length", f"""
WITH d AS (SELECT source, lang, {TC} AS token_count FROM documents),
tr AS (SELECT source FROM d GROUP BY source ORDER BY count(*) DESC, source LIMIT 10),
tl AS (SELECT lang FROM d GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 8)
SELECT source, lang, round(avg(token_count), 4) AS mean_tokens FROM d
WHERE source IN (SELECT source FROM tr) AND lang IN (SELECT lang FROM tl) GROUP BY source, lang
""")
def q_pivot_mean_length(spark, sf):
    return P.pivot_mean_length(_docs(spark, sf))


@register("dataset_summary", f"""
WITH r AS (SELECT text, source, lang, {TC} AS tc FROM documents),
a AS (SELECT count(*) AS raw_rows, count(DISTINCT CASE WHEN tc BETWEEN 3 AND 512 THEN text END) AS processed_rows,
             count(DISTINCT source) AS n_models, count(DISTINCT lang) AS n_languages,
             round(avg(CASE WHEN tc BETWEEN 3 AND 512 THEN tc END), 4) AS mean_tokens FROM r),
e AS (SELECT max(len(embedding))::INTEGER AS dim, count(*) AS n_vectors FROM embeddings)
SELECT a.*, e.dim, e.n_vectors, (e.dim::BIGINT * e.n_vectors * 4) AS embedding_bytes,
       round((1.0 - processed_rows / raw_rows) * 100.0, 4) AS dedup_rate_pct
FROM a, e
""")
def q_dataset_summary(spark, sf):
    return P.dataset_summary(_docs(spark, sf), T(spark, sf, "embeddings"))



def _sketched():
    """Columns whose distinct values are counted by merged sketches; counts must lie within four standard errors."""
    return {"doc_id": F.col("doc_id"), "text": text_digest(F.col("text")), "lang": F.col("lang")}


@register("distinct_sketches", """
SELECT 'doc_id' AS column_name, count(*) AS n_rows, count(DISTINCT doc_id) AS n_exact, true AS within FROM documents
UNION ALL SELECT 'text', count(*), count(DISTINCT text), true FROM documents
UNION ALL SELECT 'lang', count(*), count(DISTINCT lang), true FROM documents""")
def q_distinct_sketches(spark, sf):
    """H2, H11 over many tables: one sketch per source is stored, all sources are counted by merging; exact counts beside them."""
    docs = _docs(spark, sf)
    stored = materialize(K.distinct_sketches(docs, F.col("source"), _sketched()), "sketches")
    both = K.merged_counts(stored).join(K.exact_counts(docs, _sketched()), "column_name")
    near = F.abs(F.col("n_distinct") - F.col("n_exact")) <= 4 * K.ERROR * F.col("n_exact")
    return both.select("column_name", "n_rows", "n_exact", near.alias("within"))
