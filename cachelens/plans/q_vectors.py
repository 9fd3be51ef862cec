"""Registered vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from cachelens.operators import ann, lsh
from cachelens.operators import vectors as V
from cachelens.operators.sampling import fill_split, holdout_split
from cachelens.operators.vector_join import knn
from cachelens.plans import sqlfrag as S
from cachelens.plans.catalog import T, register
from cachelens.plans.routing_eval import holdout_nn


def _emb(spark, sf):
    return T(spark, sf, "embeddings")


def _holdout(spark, sf):
    split = holdout_split(_emb(spark, sf), id_col="vec_id")
    return split.filter(F.col("split") == "query"), split.filter(F.col("split") == "database")


def _r6(df, col):
    return df.withColumn(col, F.round(col, 6))


PAIRS_L2 = """
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id AS nn_id, {dist} AS dist
  FROM hs q JOIN hs d ON q.is_q AND NOT d.is_q)""".format(dist=S.sq_l2("q.embedding", "d.embedding"))


@register("knn_exact_l2", f"WITH {S.holdout()},{PAIRS_L2} {S.topk('pairs', 10)}")
def q_knn_exact_l2(spark, sf):
    q, db = _holdout(spark, sf)
    return _r6(knn(q, db, 10, q_id="vec_id", d_id="vec_id"), "dist")


@register("knn_exact_ip", f"""
WITH {S.holdout()},
pairs AS (SELECT q.vec_id AS query_id, d.vec_id AS nn_id, {S.dot('q.embedding', 'd.embedding')} AS score
          FROM hs q JOIN hs d ON q.is_q AND NOT d.is_q)
{S.topk('pairs', 10, 'score', desc=True)}""")
def q_knn_exact_ip(spark, sf):
    q, db = _holdout(spark, sf)
    return _r6(knn(q, db, 10, metric="ip", q_id="vec_id", d_id="vec_id"), "score")


LSH_SQL = f"""
WITH {S.holdout()},{S.lsh_bits('hs')},
pairs AS (
  SELECT qb.vec_id AS query_id, db.vec_id AS nn_id, sum(CASE WHEN qb.bit <> db.bit THEN 1 ELSE 0 END)::DOUBLE AS hamming
  FROM bits qb JOIN hs q ON q.vec_id = qb.vec_id AND q.is_q
  JOIN bits db ON db.p = qb.p JOIN hs d ON d.vec_id = db.vec_id AND NOT d.is_q
  GROUP BY 1, 2)"""


@register("knn_lsh", LSH_SQL + S.topk("pairs", 10, "hamming"))
def q_knn_lsh(spark, sf):
    q, db = _holdout(spark, sf)
    return ann.knn_lsh(q, db, 10, nbits=64, q_id="vec_id", d_id="vec_id")


#: Banded search: bits of a code, bands, and bits that may differ in a band.
BANDED = (128, 16, 1)


def banded_pairs(rows: str, nbits: int, bands: int, radius: int) -> str:
    """CTE ``banded`` (query_id, nn_id, hamming): pairs of ``hs`` that share a band of their codes."""
    return f"""
bandbits AS (
  SELECT qb.vec_id AS query_id, db.vec_id AS nn_id, qb.p // {nbits // bands} AS band, sum(CASE WHEN qb.bit <> db.bit THEN 1 ELSE 0 END) AS n
  FROM bits qb JOIN {rows} q ON q.vec_id = qb.vec_id AND q.is_q
  JOIN bits db ON db.p = qb.p JOIN {rows} d ON d.vec_id = db.vec_id AND NOT d.is_q
  GROUP BY 1, 2, 3),
banded AS (SELECT query_id, nn_id, sum(n)::DOUBLE AS hamming FROM bandbits GROUP BY 1, 2 HAVING min(n) <= {radius})"""


@register("knn_lsh_banded", f"WITH {S.holdout()},{S.lsh_bits('hs', BANDED[0])},{banded_pairs('hs', *BANDED)} {S.topk('banded', 10, 'hamming')}")
def q_knn_lsh_banded(spark, sf):
    """E4 by bands: an equi join on (band, bits), whole codes compared for what meets there."""
    q, db = _holdout(spark, sf)
    return lsh.knn_lsh_banded(q, db, 10, *BANDED, q_id="vec_id", d_id="vec_id")


@register("recall_lsh_banded", f"""
WITH {S.holdout()},{S.lsh_bits('hs', BANDED[0])},{banded_pairs('hs', *BANDED)},
allpairs AS (SELECT query_id, nn_id, sum(n)::DOUBLE AS hamming FROM bandbits GROUP BY 1, 2),
approx AS ({S.topk('banded', 10, 'hamming')}), exact AS ({S.topk('allpairs', 10, 'hamming')}),
ks AS (SELECT * FROM (VALUES (1), (5), (10)) t(k)),
per_q AS (
  SELECT ks.k, e.query_id, count(a.neighbor_id)::DOUBLE / count(*) AS r
  FROM ks JOIN exact e ON e.rank <= ks.k
  LEFT JOIN approx a ON a.query_id = e.query_id AND a.neighbor_id = e.neighbor_id AND a.rank <= ks.k
  GROUP BY ks.k, e.query_id)
SELECT k, round(avg(r), 6) AS recall, count(*) AS n_queries FROM per_q GROUP BY k""")
def q_recall_lsh_banded(spark, sf):
    """How much of the exhaustive Hamming result the banded search finds."""
    q, db = _holdout(spark, sf)
    approx = lsh.knn_lsh_banded(q, db, 10, *BANDED, q_id="vec_id", d_id="vec_id")
    return V.recall_at_k(approx, ann.knn_lsh(q, db, 10, nbits=BANDED[0], q_id="vec_id", d_id="vec_id"))


@register("recall_at_k", LSH_SQL + f""",
approx AS ({S.topk('pairs', 10, 'hamming')}),
{PAIRS_L2.replace('pairs AS', 'epairs AS')},
exact AS ({S.topk('epairs', 10)}),
ks AS (SELECT * FROM (VALUES (1), (5), (10)) t(k)),
per_q AS (
  SELECT ks.k, e.query_id, count(a.neighbor_id)::DOUBLE / count(*) AS r
  FROM ks JOIN exact e ON e.rank <= ks.k
  LEFT JOIN approx a ON a.query_id = e.query_id AND a.neighbor_id = e.neighbor_id AND a.rank <= ks.k
  GROUP BY ks.k, e.query_id)
SELECT k, round(avg(r), 6) AS recall, count(*) AS n_queries FROM per_q GROUP BY k""")
def q_recall_at_k(spark, sf):
    q, db = _holdout(spark, sf)
    approx = ann.knn_lsh(q, db, 10, nbits=64, q_id="vec_id", d_id="vec_id")
    exact = knn(q, db, 10, q_id="vec_id", d_id="vec_id")
    return V.recall_at_k(approx, exact)


def label_centers(spark, sf):
    """Given centres for the inverted-file queries: the mean vector of every label."""
    return V.collect_centroids(_emb(spark, sf), "label")[1]


def _ivf(spark, sf, db):
    centers = label_centers(spark, sf)
    return ann.IVFIndex.build(db, nlist=len(centers), id_col="vec_id", centers=centers)


IVF_SQL = f"""
WITH {S.holdout()}, hq AS (SELECT * FROM hs WHERE is_q), hd AS (SELECT * FROM hs WHERE NOT is_q),{S.label_cells('hs')},
{S.ivf_pairs('hq', 'hd', 4)}"""


@register("knn_ivf", f"{IVF_SQL} {S.topk('ivf', 10)}")
def q_knn_ivf(spark, sf):
    q, db = _holdout(spark, sf)
    return _r6(_ivf(spark, sf, db).search(q, 10, nprobe=4, q_id="vec_id"), "dist")


@register("recall_ivf", f"""{IVF_SQL},
approx AS ({S.topk('ivf', 10)}),
{PAIRS_L2.replace('pairs AS', 'epairs AS')},
exact AS ({S.topk('epairs', 10)}),
ks AS (SELECT * FROM (VALUES (1), (5), (10)) t(k)),
per_q AS (
  SELECT ks.k, e.query_id, count(a.neighbor_id)::DOUBLE / count(*) AS r
  FROM ks JOIN exact e ON e.rank <= ks.k
  LEFT JOIN approx a ON a.query_id = e.query_id AND a.neighbor_id = e.neighbor_id AND a.rank <= ks.k
  GROUP BY ks.k, e.query_id)
SELECT k, round(avg(r), 6) AS recall, count(*) AS n_queries FROM per_q GROUP BY k""")
def q_recall_ivf(spark, sf):
    q, db = _holdout(spark, sf)
    return V.recall_at_k(_ivf(spark, sf, db).search(q, 10, nprobe=4, q_id="vec_id"), knn(q, db, 10, q_id="vec_id", d_id="vec_id"))


@register("knn_index_dispatch", f"""{IVF_SQL},
{PAIRS_L2.replace('pairs AS', 'epairs AS')},{S.lsh_bits('hs')},
hpairs AS (
  SELECT qb.vec_id AS query_id, db.vec_id AS nn_id, sum(CASE WHEN qb.bit <> db.bit THEN 1 ELSE 0 END)::DOUBLE AS hamming
  FROM bits qb JOIN hq q ON q.vec_id = qb.vec_id JOIN bits db ON db.p = qb.p JOIN hd d ON d.vec_id = db.vec_id GROUP BY 1, 2)
SELECT query_id, rank, neighbor_id, dist AS value, 'flat' AS index_type FROM ({S.topk('epairs', 5)})
UNION ALL SELECT query_id, rank, neighbor_id, dist, 'ivf' FROM ({S.topk('ivf', 5)})
UNION ALL SELECT query_id, rank, neighbor_id, hamming, 'lsh' FROM ({S.topk('hpairs', 5, 'hamming')})""")
def q_knn_index_dispatch(spark, sf):
    """E5: the same search through the factory for every listed index type."""
    q, db = _holdout(spark, sf)
    centers = label_centers(spark, sf)
    out = None
    for kind in ann.list_index_types():
        params = {"nlist": len(centers), "nprobe": 4, "centers": centers} if kind == "ivf" else {}
        r = ann.knn_index(kind, q, db, 5, q_id="vec_id", d_id="vec_id", **params)
        val = "hamming" if kind == "lsh" else "dist"
        r = r.select("query_id", "rank", "neighbor_id", F.round(F.col(val), 6).alias("value"),
                     F.lit(kind).alias("index_type"))
        out = r if out is None else out.unionByName(r)
    return out


def _label_centers(emb):
    return V.collect_centroids(emb, "label")


@register("kmeans_assign", f"""
WITH x AS {S.explode_vec('embeddings', ', label')},
c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY label, i),
d AS (SELECT x.vec_id, c.label AS cell, sum((x.v - c.m) * (x.v - c.m)) AS dist
      FROM x JOIN c ON x.i = c.i GROUP BY x.vec_id, c.label)
SELECT vec_id, cell, round(dist, 6) AS dist FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cell) AS r FROM d) WHERE r = 1
""")
def q_kmeans_assign(spark, sf):
    emb = _emb(spark, sf)
    labels, centers = _label_centers(emb)
    lab = spark.createDataFrame([(i, int(l)) for i, l in enumerate(labels)], "cell int, label int")
    out = ann.kmeans_assign(emb, centers, id_col="vec_id").join(lab, "cell")
    return out.select("vec_id", F.col("label").alias("cell"), F.round("dist", 6).alias("dist"))


FIT_CENTRES = 10


def kmeans_fit_sql(k: int, batches: int, epochs: int, seed: int = 42) -> str:
    """The steps of ``ann.kmeans_centers`` one by one, and the cell sizes under the last centres."""
    ctes = [f"""
x AS MATERIALIZED (SELECT x.vec_id, x.i, x.v, floor({S.uniform(seed, 'kmeans_batch', 'x.vec_id')} * {batches})::INTEGER AS batch FROM {S.explode_vec('embeddings')} x),
o AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY {S.md5_key(seed, 'kmeans_init', 'vec_id')}, vec_id) - 1 AS cell FROM embeddings),
c0 AS MATERIALIZED (SELECT o.cell, x.i, x.v AS c, 0 AS n FROM x JOIN o ON o.vec_id = x.vec_id WHERE o.cell < {k})"""]

    def nearest(name, where):
        return f"""SELECT vec_id, cell FROM (
  SELECT x.vec_id, c.cell, row_number() OVER (PARTITION BY x.vec_id ORDER BY sum((x.v - c.c) * (x.v - c.c)), c.cell) AS r
  FROM x JOIN {name} c ON c.i = x.i WHERE {where} GROUP BY x.vec_id, c.cell) WHERE r = 1"""

    for t in range(batches * epochs):
        ctes.append(f"""
a{t} AS MATERIALIZED ({nearest(f'c{t}', f'x.batch = {t % batches}')}),
s{t} AS MATERIALIZED (SELECT a.cell, x.i, count(*) AS n, sum(x.v) AS s FROM a{t} a JOIN x ON x.vec_id = a.vec_id GROUP BY a.cell, x.i),
c{t + 1} AS MATERIALIZED (SELECT c.cell, c.i, c.n + coalesce(s.n, 0) AS n, CASE WHEN s.n IS NULL THEN c.c ELSE c.c + (s.s - s.n * c.c) / (c.n + s.n) END AS c
  FROM c{t} c LEFT JOIN s{t} s ON s.cell = c.cell AND s.i = c.i)""")
    last = f"c{batches * epochs}"
    return f"WITH {','.join(ctes)} SELECT cell::INTEGER AS cell, count(*) AS n FROM ({nearest(last, 'true')}) GROUP BY cell"


@register("kmeans_fit", kmeans_fit_sql(FIT_CENTRES, ann.KMEANS_BATCHES, ann.KMEANS_EPOCHS))
def q_kmeans_fit(spark, sf):
    """E8 with trained centres (mini-batch k-means); cluster sizes."""
    emb = _emb(spark, sf)
    centers = ann.kmeans_centers(emb, FIT_CENTRES, seed=42, id_col="vec_id")
    return ann.kmeans_assign(emb, centers, id_col="vec_id").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@register("vectors_append", f"""
WITH {S.holdout()},
base AS (SELECT vec_id, vec_id AS src_id FROM hs WHERE NOT is_q),
new AS (SELECT (SELECT max(vec_id) FROM hs WHERE NOT is_q) + row_number() OVER (ORDER BY vec_id) AS vec_id,
               vec_id AS src_id FROM hs WHERE is_q)
SELECT * FROM base UNION ALL SELECT * FROM new
""")
def q_vectors_append(spark, sf):
    q, db = _holdout(spark, sf)
    out = V.vectors_append(db.select("vec_id"), q.select("vec_id"), id_col="vec_id")
    return out.select("vec_id", "src_id")


@register("vectors_remove", f"""
WITH {S.holdout()},
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id AS nn_id, {S.sq_l2('q.embedding', 'd.embedding')} AS dist
  FROM hs q JOIN hs d ON q.is_q AND NOT d.is_q AND d.label <> 0)
{S.topk('pairs', 1)}""")
def q_vectors_remove(spark, sf):
    q, db = _holdout(spark, sf)
    removed = db.filter(F.col("label") == 0).select("vec_id")
    kept = V.vectors_remove(db, removed, id_col="vec_id")
    return _r6(knn(q, kept, 1, q_id="vec_id", d_id="vec_id"), "dist")


@register("threshold_neighbors", f"""
WITH c AS (SELECT a.vec_id, count(*) AS n FROM embeddings a JOIN embeddings b
             ON a.vec_id <> b.vec_id AND {S.sq_l2('a.embedding', 'b.embedding')} <= 1.5 GROUP BY a.vec_id)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_within FROM embeddings e LEFT JOIN c ON c.vec_id = e.vec_id
""")
def q_threshold_neighbors(spark, sf):
    return V.threshold_neighbors(_emb(spark, sf), 1.5, id_col="vec_id")


def _cache(db):
    return db.select(F.col("vec_id").alias("cache_id"), "embedding", (F.col("label") != 0).alias("is_active"))


@register("lookup", f"""
WITH {S.holdout()},
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id AS nn_id, {S.sq_l2('q.embedding', 'd.embedding')} AS dist
  FROM hs q JOIN hs d ON q.is_q AND NOT d.is_q AND d.label <> 0),
t AS ({S.topk('pairs', 3)})
SELECT t.*, min(dist) OVER (PARTITION BY query_id) <= 1.3 AS hit FROM t
""")
def q_lookup(spark, sf):
    q, db = _holdout(spark, sf)
    return _r6(V.lookup(q, _cache(db), 3, 1.3, q_id="vec_id"), "dist")


@register("batch_lookup", f"WITH {S.holdout()},{PAIRS_L2} {S.topk('pairs', 3)}")
def q_batch_lookup(spark, sf):
    """Unlike ``lookup``, entries that are not active are found too (label 0 is inactive)."""
    q, db = _holdout(spark, sf)
    return _r6(V.batch_lookup(q, _cache(db), 3, q_id="vec_id"), "dist")


SAMPLE_SQL = f"""
pc AS (SELECT {S.dot('a.embedding', 'b.embedding')} AS c FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"""


@register("pairwise_cosine", f"""
WITH {SAMPLE_SQL}
SELECT count(*) AS n_pairs, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std,
       round(min(c), 6) AS min, round(max(c), 6) AS max FROM pc""")
def q_pairwise_cosine(spark, sf):
    return V.pairwise_cosine(_emb(spark, sf), "vec_id")


@register("pairwise_histogram", f"""
WITH {SAMPLE_SQL},
e AS (SELECT min(c) AS lo, max(c) AS hi, count(*)::DOUBLE AS n FROM pc),
b AS (SELECT greatest(0, least(floor((c - lo) / ((hi - lo) / 100.0))::INTEGER, 99)) AS bin, count(*) AS cnt
      FROM pc, e GROUP BY 1),
g AS (SELECT g.bin::INTEGER AS bin, coalesce(b.cnt, 0)::BIGINT AS count FROM range(100) g(bin) LEFT JOIN b ON b.bin = g.bin)
SELECT g.bin, round(lo + g.bin * ((hi - lo) / 100.0), 6) AS bin_lo, count,
       round(count / (n * ((hi - lo) / 100.0)), 6) AS density,
       round(sum(count) OVER (ORDER BY g.bin ROWS UNBOUNDED PRECEDING) / n, 6) AS cdf
FROM g, e""")
def q_pairwise_histogram(spark, sf):
    return V.pairwise_histogram(_emb(spark, sf), "vec_id")


@register("pairwise_distribution", f"""
WITH {SAMPLE_SQL},
b AS (SELECT greatest(0, least(floor((c + 1.0) / 0.02::DOUBLE)::INTEGER, 99)) AS bin, count(*) AS cnt FROM pc GROUP BY 1),
g AS (SELECT g.bin::INTEGER AS bin, coalesce(b.cnt, 0)::BIGINT AS count FROM range(100) g(bin) LEFT JOIN b ON b.bin = g.bin)
SELECT bin, round(-1.0 + bin * 0.02::DOUBLE, 6) AS bin_lo, count, round(count / (sum(count) OVER () * 0.02::DOUBLE), 6) AS density,
       round(sum(count) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) / sum(count) OVER (), 6) AS cdf FROM g""")
def q_pairwise_distribution(spark, sf):
    """E13, E14 in one pass over the pairs: fixed bins on [-1, 1]."""
    return V.pairwise_distribution(_emb(spark, sf), "vec_id").drop("examined")


@register("pairwise_cdf", f"""
WITH {SAMPLE_SQL}
SELECT cut, round(count(*) FILTER (WHERE c >= cut) / (SELECT count(*) FROM pc), 6) AS share_ge
FROM pc, (VALUES (0.85::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) t(cut) GROUP BY cut""")
def q_pairwise_cdf(spark, sf):
    return V.pairwise_cdf(_emb(spark, sf), "vec_id")


NSQ = S.norm_sq("embedding")


@register("validate_embeddings", f"""
SELECT vec_id, abs(sqrt({NSQ}) - 1.0) <= 1e-5 AS unit_norm FROM embeddings
WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x)))
""")
def q_validate_embeddings(spark, sf):
    return V.validate_embeddings(_emb(spark, sf)).select("vec_id", "unit_norm")


@register("embedding_table", "SELECT vec_id, len(embedding)::INTEGER AS dim, label FROM embeddings")
def q_embedding_table(spark, sf):
    emb = _emb(spark, sf)
    et = emb.schema["embedding"].dataType
    if not (isinstance(et, Ty.ArrayType) and isinstance(et.elementType, Ty.FloatType)):
        raise TypeError(f"embedding column must be ARRAY<FLOAT>, got {et.simpleString()}")
    return emb.select("vec_id", F.size("embedding").alias("dim"), "label")


@register("align_embeddings", """
SELECT e.vec_id, d.lang, d.source, e.label FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
""")
def q_align_embeddings(spark, sf):
    docs = T(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    return _emb(spark, sf).select("vec_id", "label").join(docs, "vec_id")


@register("distance_analysis", f"""
WITH {S.holdout_nn()}
SELECT count(*) AS n, round(avg(dist), 4) AS mean, round(stddev_pop(dist), 4) AS std,
       round(quantile_cont(dist, 0.5), 4) AS median, round(min(dist), 4) AS min, round(max(dist), 4) AS max,
       round(quantile_cont(dist, 0.05), 4) AS p5, round(quantile_cont(dist, 0.25), 4) AS p25,
       round(quantile_cont(dist, 0.75), 4) AS p75, round(quantile_cont(dist, 0.95), 4) AS p95
FROM nn""")
def q_distance_analysis(spark, sf):
    return V.distance_analysis(holdout_nn(_emb(spark, sf)))


@register("distance_histogram", f"""
WITH {S.holdout_nn()},
c AS (SELECT least(floor(dist / (2.0::DOUBLE / 20.0))::INTEGER, 19) AS bin, count(*) AS n
      FROM nn WHERE dist BETWEEN 0.0 AND 2.0 GROUP BY 1)
SELECT g.bin::INTEGER AS bin, round(g.bin * (2.0::DOUBLE / 20.0), 6) AS bin_lo,
       round((g.bin + 1) * (2.0::DOUBLE / 20.0), 6) AS bin_hi,
       coalesce(c.n, 0)::BIGINT AS count FROM range(20) g(bin) LEFT JOIN c ON c.bin = g.bin""")
def q_distance_histogram(spark, sf):
    return V.distance_histogram(holdout_nn(_emb(spark, sf)))


@register("workload_diversity", f"""
WITH b AS (SELECT count(*) AS n, avg({NSQ}) AS msq, avg(sqrt({NSQ})) AS mnorm FROM embeddings),
dims AS (SELECT i, avg(v) AS m FROM {S.explode_vec('embeddings')} x GROUP BY i),
ms AS (SELECT sum(m * m) AS mean_sq FROM dims),
lab AS (SELECT label, count(*)::DOUBLE AS c FROM embeddings GROUP BY label),
ent AS (SELECT -sum((c / tot) * ln(c / tot)) AS h, count(*) AS used FROM lab, (SELECT sum(c) AS tot FROM lab) t),
ap AS (SELECT b.*, CASE WHEN n > 1 THEN 2.0 * n / (n - 1) * (msq - mean_sq) ELSE 0.0 END AS avg_pair FROM b, ms)
SELECT n AS n_queries, round(avg_pair, 4) AS avg_pairwise_distance,
       round(CASE WHEN mnorm > 0 THEN least(1.0, avg_pair / (2.0 * mnorm * mnorm)) ELSE 0.0 END, 4) AS pair_diversity,
       round(h / ln(10), 4) AS label_entropy, round(exp(h), 2) AS effective_clusters, used AS n_clusters_used
FROM ap, ent""")
def q_workload_diversity(spark, sf):
    return V.workload_diversity(_emb(spark, sf), n_clusters=10)


@register("semantic_coverage", f"""
WITH {S.fill_nn(table='embeddings')}
SELECT count(*) AS n_rows, round(avg(dist), 6) AS semantic_coverage_avg_dist FROM nn""")
def q_semantic_coverage(spark, sf):
    parts = fill_split(_emb(spark, sf).select("vec_id", "embedding"), id_col="vec_id")
    stream = parts.filter(F.col("part") == "eval")
    cache = parts.filter(F.col("part") == "cache")
    return V.semantic_coverage(stream, cache, q_id="vec_id", c_id="vec_id")


@register("cache_stats", f"""
WITH {S.holdout()},
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id AS nn_id, {S.sq_l2('q.embedding', 'd.embedding')} AS dist
  FROM hs q JOIN hs d ON q.is_q AND NOT d.is_q AND d.label <> 0),
best AS (SELECT query_id, min(dist) AS d FROM pairs GROUP BY query_id)
SELECT count(*) FILTER (WHERE label <> 0) AS size, count(*) AS total_entries,
       count(*) FILTER (WHERE label <> 0) AS active_entries, count(*) FILTER (WHERE label = 0) AS dead_entries,
       (SELECT count(*) FROM best) AS total_lookups, (SELECT count(*) FILTER (WHERE d <= 1.3) FROM best) AS total_hits,
       count(*) AS total_inserts, count(*) FILTER (WHERE label = 0) AS total_evictions
FROM hs WHERE NOT is_q""")
def q_cache_stats(spark, sf):
    q, db = _holdout(spark, sf)
    cache = _cache(db)
    lk = V.lookup(q, cache, 1, 1.3, q_id="vec_id")
    return V.cache_stats(cache, lk)


@register("vector_table_roundtrip", f"{IVF_SQL} {S.topk('ivf', 5)}")
def q_vector_table_roundtrip(spark, sf):
    """Save the vector table partitioned by cell + centres, load, search the four nearest cells (the others are not read)."""
    q, db = _holdout(spark, sf)
    idx = _ivf(spark, sf, db)
    path = ann.roundtrip_path(spark, "ivf")
    idx.save(path)
    back = ann.IVFIndex.load(spark, path, "vec_id")
    return _r6(back.search(q, 5, nprobe=4, q_id="vec_id"), "dist")


@register("lsh_table_roundtrip", f"""
WITH {S.holdout()},{S.lsh_bits('hs', BANDED[0])}, kept AS (SELECT * FROM hs WHERE is_q OR label <> 1),{banded_pairs('kept', *BANDED)}
{S.topk('banded', 5, 'hamming')}""")
def q_lsh_table_roundtrip(spark, sf):
    """E6, E7, E9 for codes: save the rows of some labels as a bucketed table, load it, append the others, remove label 1, search."""
    q, db = _holdout(spark, sf)
    path = ann.roundtrip_path(spark, "lsh")
    lsh.LSHTable.save(db.filter("label < 5"), path, *BANDED[:2], id_col="vec_id").drop()
    table = lsh.LSHTable.load(spark, path)
    table.append(db.filter("label >= 5 OR label IS NULL"), id_col="vec_id").remove(db.filter("label = 1"), id_col="vec_id")
    return table.search(q, 5, BANDED[2], q_id="vec_id")
