"""Registered scans/sinks (A1-A4, A6, A7), nested extraction (B1), encoder (B5, B6),
latency/throughput metrics (F2, F3) and the streaming queries (S1-S3)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from cachelens.functions.encoder import embed_text, sql_text_vector
from cachelens.functions.text import strip_text
from cachelens.operators import metrics as M
from cachelens.operators import text as X
from cachelens.operators.vectors import validate_embeddings
from cachelens.plans import sqlfrag as S
from cachelens.plans.catalog import T, register
from cachelens.plans.q_routing import BENCH_SQL, NN, bench_runs, flat_params
from cachelens.plans.q_text import DEDUP, STRIP
from cachelens.plans.routing_eval import flagship
from cachelens.session import checkpoint_dir, table_path
from cachelens.sources import tables as src
from cachelens.streaming import lookup_stream as st


def _scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


@register("scan_queries", "SELECT doc_id, lang, source, n_chars FROM documents")
def q_scan_queries(spark, sf):
    return src.scan_queries(spark, table_path(sf, "documents")).select("doc_id", "lang", "source", "n_chars")


@register("scan_conversations", "SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def q_scan_conversations(spark, sf):
    turns = src.scan_conversations(spark, table_path(sf, "conversations")).select("conv_id", "turn", "role", F.lit(None).cast("string").alias("text"))
    return src.nest_conversations(turns).select("conv_id", F.transform("conversation", lambda t: t["role"]).alias("roles"))


@register("first_user_turn_nested", f"""
WITH a AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS fu, count(*) AS num_turns
           FROM conversations GROUP BY conv_id)
SELECT conv_id::BIGINT AS query_id, {STRIP.format(c='fu')} AS query_text, num_turns::INTEGER AS num_turns
FROM a WHERE fu IS NOT NULL AND length({STRIP.format(c='fu')}) > 0""")
def q_first_user_turn_nested(spark, sf):
    """The nested form needs all roles but one text: the other texts do not enter the lists."""
    turns = T(spark, sf, "conversations")
    first = turns.filter("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("_first"))
    slim = turns.join(first, "conv_id", "left").withColumn("text", F.when(F.col("turn") == F.col("_first"), F.col("text"))).drop("_first")
    nested = src.nest_conversations(slim)
    told = F.get(F.filter("conversation", lambda t: t["role"] == "user"), 0)
    out = nested.select(F.col("conv_id").alias("query_id"), strip_text(told["content"]).alias("query_text"),
                        F.size("conversation").cast("int").alias("num_turns"))
    return out.filter(F.col("query_text").isNotNull() & (F.length("query_text") > 0))


@register("write_queries", f"""
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS query_id, doc_id, token_count, frequency FROM {DEDUP} d""")
def q_write_queries(spark, sf):
    pre = X.preprocess(T(spark, sf, "documents").select("doc_id", "text")) \
        .select("query_id", "doc_id", "token_count", "frequency")
    path = src.write_table(pre, _scratch(spark, "queries"))
    return spark.read.parquet(path)


@register("write_results", f"""
WITH {NN}, {S.sweep_select('nn', [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2, 1.5])}""")
def q_write_results(spark, sf):
    sweep = flagship(T(spark, sf, "embeddings"))
    nested = sweep.select(F.struct(*sweep.columns).alias("row"))
    path = src.write_results_json(nested, _scratch(spark, "results"))
    back = spark.read.schema(nested.schema).json(path)
    return back.select("row.*")


@register("scan_benchmark_results", BENCH_SQL)
def q_scan_benchmark_results(spark, sf):
    runs = bench_runs(spark, sf)
    folder = _scratch(spark, "bench")
    src.write_benchmark_files(runs, folder)
    back = src.scan_benchmark_results(spark, os.path.join(folder, "index_benchmark_*.json"))
    return flat_params(back).drop("search_p50_ms", "build_time_s", "memory_mb")  # not measured here


@register("latency_stats", """
SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean_ms, round(stddev_pop(value), 4) AS std_ms,
       round(quantile_cont(value, 0.5), 4) AS p50_ms, round(quantile_cont(value, 0.95), 4) AS p95_ms,
       round(quantile_cont(value, 0.99), 4) AS p99_ms, round(min(value), 4) AS min_ms, round(max(value), 4) AS max_ms
FROM events GROUP BY event_type""")
def q_latency_stats(spark, sf):
    return M.latency_stats(T(spark, sf, "events"), "value", ["event_type"])


@register("throughput", """
SELECT event_type, count(*) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS elapsed_s,
       round(CASE WHEN epoch_us(max(ts)) - epoch_us(min(ts)) > 0
                  THEN count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) ELSE 'inf'::DOUBLE END, 6) AS per_second
FROM events GROUP BY event_type""")
def q_throughput(spark, sf):
    return M.throughput(T(spark, sf, "events"), "ts", ["event_type"])


SQL_VEC = sql_text_vector("documents")
LEN2 = "list_sum(list_transform(s, lambda x: x * x))"


@register("embed_text", f"""
WITH {SQL_VEC}
SELECT doc_id, list_transform(s, lambda x: CASE WHEN {LEN2} > 0 THEN x / sqrt({LEN2}) ELSE 0.0 END)::FLOAT[] AS embedding FROM vec""")
def q_embed_text(spark, sf):
    docs = T(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", embed_text(F.col("text")).alias("embedding"))


@register("validate_text_embeddings", f"WITH {SQL_VEC} SELECT doc_id, {LEN2} > 0 AS unit_norm FROM vec")
def q_validate_text_embeddings(spark, sf):
    docs = T(spark, sf, "documents").select("doc_id", "text")
    emb = docs.select("doc_id", embed_text(F.col("text")).alias("embedding"))
    return validate_embeddings(emb, dim=64).select("doc_id", "unit_norm")


NEAR_SQL = f"""
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, {S.sq_l2('a.embedding', 'b.embedding')} AS dist
          FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
near AS (SELECT query_id, neighbor_id, dist, dist <= 1.3 AS hit FROM pairs
         QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, neighbor_id) = 1)"""


@register("stream_semantic_tag", f"WITH {NEAR_SQL} SELECT query_id, neighbor_id, round(dist, 6) AS dist, hit FROM near")
def q_stream_semantic_tag(spark, sf):
    """The embeddings as a stream, tagged by their nearest other entry of the whole table."""
    live = st.file_stream(spark, sf, "embeddings").select("vec_id", "embedding")
    cache = T(spark, sf, "embeddings").select("vec_id", "embedding")
    tagged = st.tag_by_vector(live, cache, 1.3, q_id="vec_id", c_id="vec_id", exclude_self=True)
    return tagged.withColumn("dist", F.round("dist", 6))


KEY_SQL = """
keys AS (SELECT user_id AS key, min(ts::TIMESTAMP) AS since FROM events WHERE event_type = 'signup' GROUP BY user_id),
tagged AS (SELECT e.event_id, e.user_id, e.ts::TIMESTAMP AS ts, coalesce(k.since < e.ts::TIMESTAMP, false) AS hit
           FROM events e LEFT JOIN keys k ON k.key = e.user_id)"""


def _key_tags(spark, sf):
    def rows(df):
        return df.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))

    keys = rows(T(spark, sf, "events")).filter("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("since"))
    return st.tag_by_key(rows(st.file_stream(spark, sf, "events")).drop("event_type"), keys, "user_id", "ts", "since")


@register("stream_key_cache", f"WITH {KEY_SQL} SELECT event_id, user_id, hit FROM tagged")
def q_stream_key_cache(spark, sf):
    """S3: the events as a stream against the table of users that have signed up before."""
    return st.run_to_table(_key_tags(spark, sf), "keys").select("event_id", "user_id", "hit")


@register("stream_hit_rate", f"""
WITH {KEY_SQL}
SELECT (epoch_us(ts) // 3600000000)::BIGINT AS hour, count(*) AS lookups, count(*) FILTER (WHERE hit) AS hits FROM tagged GROUP BY 1""")
def q_stream_hit_rate(spark, sf):
    """Hits and lookups per hour of the same stream, a watermarked aggregation."""
    return st.run_updates_to_table(st.hit_rate_by_hour(_key_tags(spark, sf)), "rate", ["hour"])
