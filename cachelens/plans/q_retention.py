"""Registered retention and upkeep queries (G1-G8) over events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cachelens.operators import retention as R
from cachelens.operators.ordering import dense_ids
from cachelens.operators.sampling import holdout_split
from cachelens.plans import sqlfrag as S
from cachelens.plans.catalog import T, register

LOG = """log AS (SELECT user_id AS key, event_id, event_type, value, ts,
                   row_number() OVER (ORDER BY ts, event_id) - 1 AS seq FROM events)"""
KS = """ks AS (SELECT key, min(seq) AS inserted_seq, max(seq) AS last_touch, count(*) - 1 AS reads
              FROM log GROUP BY key)"""


def _log(spark, sf):
    return R.access_log(T(spark, sf, "events"))


def _emb(spark, sf):
    return T(spark, sf, "embeddings")


@register("access_log", f"WITH {LOG} SELECT key, event_id, seq FROM log")
def q_access_log(spark, sf):
    return _log(spark, sf).select("key", "event_id", "seq")


@register("rank_lru", f"""
WITH {LOG}, {KS}
SELECT row_number() OVER (ORDER BY last_touch, key) AS victim_rank, key, last_touch FROM ks QUALIFY victim_rank <= 10
""")
def q_rank_lru(spark, sf):
    return R.rank_lru(_log(spark, sf), 10)


@register("rank_lfu", f"""
WITH {LOG}, {KS}
SELECT row_number() OVER (ORDER BY reads, inserted_seq, key) AS victim_rank, key, reads, inserted_seq
FROM ks QUALIFY victim_rank <= 10
""")
def q_rank_lfu(spark, sf):
    return R.rank_lfu(_log(spark, sf), 10)


def _red_sql(threshold: float) -> str:
    return f"""
nall AS (SELECT count(*) AS n FROM embeddings),
cnt AS (SELECT e.vec_id, count(a.vec_id) AS c FROM embeddings e LEFT JOIN embeddings a
          ON a.vec_id <> e.vec_id AND {S.sq_l2('a.embedding', 'e.embedding')} <= {threshold!r}
        GROUP BY e.vec_id),
red AS (SELECT vec_id, c / greatest(n - 1, 1)::DOUBLE AS redundancy FROM cnt, nall)"""


@register("redundancy", f"WITH {_red_sql(1.5)} SELECT vec_id, round(redundancy, 6) AS redundancy FROM red")
def q_redundancy(spark, sf):
    out = R.redundancy(_emb(spark, sf).select("vec_id", "embedding"), 1.5, id_col="vec_id")
    return out.withColumn("redundancy", F.round("redundancy", 6))


@register("rank_semantic", f"""
WITH {LOG}, {KS}, {_red_sql(1.5)},
base AS (SELECT e.vec_id, coalesce(ks.last_touch, -1) AS last_touch, coalesce(ks.reads, 0) AS reads,
                coalesce(red.redundancy, 0.0) AS redundancy
         FROM embeddings e LEFT JOIN ks ON ks.key = e.vec_id LEFT JOIN red ON red.vec_id = e.vec_id),
r AS (SELECT *, (row_number() OVER (ORDER BY last_touch, vec_id) - 1)
                 / greatest((SELECT count(*) FROM base) - 1, 1)::DOUBLE AS recency,
             reads / greatest((SELECT max(reads) FROM base)::DOUBLE, 1.0) AS frequency FROM base),
s AS (SELECT *, redundancy / (1.0 * recency + 1.0 * frequency + 1e-9) AS score FROM r)
SELECT row_number() OVER (ORDER BY score DESC, vec_id) AS victim_rank, vec_id, round(score, 6) AS score,
       round(redundancy, 6) AS redundancy, round(recency, 6) AS recency, round(frequency, 6) AS frequency
FROM s QUALIFY victim_rank <= 10
""")
def q_rank_semantic(spark, sf):
    return R.rank_semantic(_emb(spark, sf).select("vec_id", "embedding"), _log(spark, sf), threshold=1.5,
                           n=10, id_col="vec_id")


NSQ = S.norm_sq("embedding")


@register("adaptive_alpha", f"""
WITH s AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS seq, embedding FROM embeddings),
steps AS (SELECT range AS step FROM range(1, (SELECT count(*) FROM s) // 200 + 1)),
w AS (SELECT st.step, s.seq, s.embedding FROM steps st JOIN s ON s.seq < st.step * 200 AND s.seq >= st.step * 200 - 500),
mom AS (SELECT step, count(*) AS n, avg({NSQ}) AS msq, avg(sqrt({NSQ})) AS mnorm FROM w GROUP BY step),
dims AS (SELECT step, i, avg(v) AS m FROM (SELECT step, unnest(generate_series(0, len(embedding) - 1)) AS i,
                                                  unnest(embedding)::DOUBLE AS v FROM w) GROUP BY step, i),
ms AS (SELECT step, sum(m * m) AS mean_sq FROM dims GROUP BY step),
d AS (SELECT mom.step, n, round(CASE WHEN mnorm > 0 THEN least(1.0, (CASE WHEN n > 1 THEN 2.0 * n / (n - 1) * (msq - mean_sq)
                                   ELSE 0.0 END) / (2.0 * mnorm * mnorm)) ELSE 0.0 END, 4) AS diversity
      FROM mom JOIN ms ON ms.step = mom.step WHERE n >= 50),
a AS (SELECT *, 0.3 + {2.5 - 0.3!r}::DOUBLE * diversity AS new_alpha FROM d)
SELECT (row_number() OVER (ORDER BY step))::INTEGER AS adaptation_step, step::INTEGER AS at_step, n AS n_queries_seen,
       diversity, round(coalesce(lag(new_alpha) OVER (ORDER BY step), 1.0), 4) AS old_alpha, round(new_alpha, 4) AS new_alpha
FROM a""")
def q_adaptive_alpha(spark, sf):
    emb = _emb(spark, sf).select("vec_id", "embedding")
    return R.adaptive_alpha(dense_ids(emb.select("vec_id"), ["vec_id"], out_col="seq").join(emb, "vec_id"))


@register("rank_victims", f"""
WITH {LOG}, {KS},
fut AS (SELECT key, min(seq) AS nu FROM log WHERE seq >= (SELECT count(*) // 2 FROM events) GROUP BY key)
SELECT 'lru' AS policy, row_number() OVER (ORDER BY last_touch, key) AS victim_rank, key FROM ks QUALIFY victim_rank <= 10
UNION ALL SELECT 'lfu', row_number() OVER (ORDER BY reads, inserted_seq, key) AS victim_rank, key FROM ks QUALIFY victim_rank <= 10
UNION ALL SELECT 'oracle', row_number() OVER (ORDER BY coalesce(nu::DOUBLE, 'inf'::DOUBLE) DESC, ks.key) AS victim_rank, ks.key
FROM ks LEFT JOIN fut ON fut.key = ks.key QUALIFY victim_rank <= 10
""")
def q_rank_victims(spark, sf):
    """The ranking of each key policy by its name; ``none`` gives no victims."""
    log, cut = _log(spark, sf), T(spark, sf, "events").count() // 2
    out = None
    for policy in ("lru", "lfu", "oracle", "none"):
        r = R.rank_victims(policy, log, n=10, **({"cut": cut} if policy == "oracle" else {}))
        r = r.select(F.lit(policy).alias("policy"), "victim_rank", "key")
        out = r if out is None else out.unionByName(r)
    return out


@register("next_use", f"""
WITH {LOG},
fut AS (SELECT key, min(seq) AS nu FROM log WHERE seq >= (SELECT count(*) // 2 FROM events) GROUP BY key),
k AS (SELECT DISTINCT key FROM log)
SELECT row_number() OVER (ORDER BY coalesce(fut.nu::DOUBLE, 'inf'::DOUBLE) DESC, k.key) AS victim_rank, k.key,
       coalesce(fut.nu::DOUBLE, 'inf'::DOUBLE) AS next_use
FROM k LEFT JOIN fut ON fut.key = k.key
""")
def q_next_use(spark, sf):
    """G8 over all keys: next access at or after the middle of the log, furthest first."""
    return R.next_use_keys(_log(spark, sf), T(spark, sf, "events").count() // 2, None)


@register("next_access", f"""
WITH {LOG}
SELECT key, seq, coalesce((lead(seq) OVER (PARTITION BY key ORDER BY seq))::DOUBLE, 'inf'::DOUBLE) AS next_use FROM log
""")
def q_next_access(spark, sf):
    return R.next_access(_log(spark, sf))


@register("next_use_vectors", f"""
WITH {S.holdout()},
st AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS seq, embedding FROM hs WHERE is_q),
pairs AS (SELECT st.vec_id AS query_id, st.seq, d.vec_id AS nn_id, {S.sq_l2('st.embedding', 'd.embedding')} AS dist
          FROM st JOIN hs d ON NOT d.is_q),
nn AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, nn_id) = 1),
first AS (SELECT nn_id, min(seq) AS nu FROM nn WHERE dist <= 1.3 GROUP BY nn_id),
e AS (SELECT d.vec_id, coalesce(first.nu::DOUBLE, 'inf'::DOUBLE) AS next_use FROM hs d LEFT JOIN first ON first.nn_id = d.vec_id
      WHERE NOT d.is_q)
SELECT row_number() OVER (ORDER BY next_use DESC, vec_id) AS victim_rank, vec_id, next_use FROM e
""")
def q_next_use_vectors(spark, sf):
    split = holdout_split(_emb(spark, sf).select("vec_id", "embedding"), id_col="vec_id")
    asked = split.filter(F.col("split") == "query")
    stream = dense_ids(asked.select("vec_id"), ["vec_id"], out_col="seq").join(asked, "vec_id")
    entries = split.filter(F.col("split") == "database")
    return R.next_use_vectors(stream, entries, threshold=1.3, q_id="vec_id", e_id="vec_id")


@register("cache_build", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS cache_id, doc_id, true AS is_active, md5(text) AS response_md5,
       'lang=' || coalesce(lang, '') || ' source=' || coalesce(source, '') AS metadata,
       row_number() OVER (ORDER BY doc_id) - 1 AS inserted_seq
FROM r WHERE pos >= (SELECT count(*) FROM documents) - 100
""")
def q_cache_build(spark, sf):
    docs = T(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    meta = [F.concat(F.lit(f"{k}="), F.coalesce(F.col("metadata")[k], F.lit(""))) for k in ("lang", "source")]
    return R.cache_build(docs, "doc_id", max_size=100, metadata_cols=("lang", "source")) \
        .select("cache_id", "doc_id", "is_active", F.md5("response").alias("response_md5"),
                F.concat_ws(" ", *meta).alias("metadata"), "inserted_seq")


@register("cache_upkeep", f"""
WITH {S.holdout()},
c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cache_id FROM hs WHERE NOT is_q),
ins AS (SELECT (SELECT count(*) FROM c) + row_number() OVER (ORDER BY vec_id) - 1 AS cache_id FROM hs WHERE is_q),
al AS (SELECT cache_id FROM c UNION ALL SELECT cache_id FROM ins),
st AS (SELECT cache_id, NOT (row_number() OVER (ORDER BY cache_id) - 1 < (SELECT count(*) FROM al) - (SELECT count(*) FROM c))
              AS is_active FROM al),
cmp AS (SELECT (count(*) FILTER (WHERE NOT is_active))::DOUBLE / count(*) >= 0.2 AS compact FROM st),
live AS (SELECT cache_id, row_number() OVER (ORDER BY cache_id) - 1 AS nid FROM st WHERE is_active)
SELECT st.cache_id AS old_id, CASE WHEN compact THEN live.nid WHEN st.is_active THEN st.cache_id END AS new_id,
       st.is_active, compact AS compacted
FROM st LEFT JOIN live ON live.cache_id = st.cache_id CROSS JOIN cmp
""")
def q_cache_upkeep(spark, sf):
    split = holdout_split(_emb(spark, sf).select("vec_id"), id_col="vec_id")
    db = split.filter(F.col("split") == "database")
    cache = dense_ids(db, ["vec_id"], out_col="cache_id").withColumn("is_active", F.lit(True))
    inserts = split.filter(F.col("split") == "query").withColumnRenamed("vec_id", "src_id")
    max_size = db.count()
    return R.cache_upkeep(cache, inserts, max_size)
