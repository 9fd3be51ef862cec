"""Registered split, subset and workload-draw queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cachelens.operators import sampling as Smp
from cachelens.operators import text as X
from cachelens.operators.ordering import dense_ids
from cachelens.plans import sqlfrag as S
from cachelens.plans.catalog import T, register
from cachelens.plans.q_text import DEDUP


def _emb(spark, sf):
    return T(spark, sf, "embeddings")


def _dense_emb(spark, sf):
    """Embeddings with dense ids 0..Q-1 in vec_id order."""
    return dense_ids(_emb(spark, sf).select("vec_id", "label"), ["vec_id"], out_col="query_id")


DENSE = "(SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS query_id FROM embeddings)"


@register("holdout_split", f"""
WITH {S.holdout()} SELECT vec_id, CASE WHEN is_q THEN 'query' ELSE 'database' END AS split FROM hs""")
def q_holdout_split(spark, sf):
    return Smp.holdout_split(_emb(spark, sf).select("vec_id"), id_col="vec_id").select("vec_id", "split")


def _fill_sql(order: str, table: str, id_col: str) -> str:
    return f"""
SELECT {id_col}, CASE WHEN row_number() OVER (ORDER BY {order})
                         <= (SELECT floor(count(*) * 0.5::DOUBLE) FROM {table} t0) THEN 'cache' ELSE 'eval' END AS part
FROM {table} t"""


@register("fill_split_random", _fill_sql(f"{S.md5_key(42, 'fill', 'vec_id')}, vec_id", "embeddings", "vec_id"))
def q_fill_split_random(spark, sf):
    return Smp.fill_split(_emb(spark, sf).select("vec_id"), "vec_id", 0.5, "random").select("vec_id", "part")


@register("fill_split_chronological", _fill_sql("vec_id", "embeddings", "vec_id"))
def q_fill_split_chronological(spark, sf):
    return Smp.fill_split(_emb(spark, sf).select("vec_id"), "vec_id", 0.5, "chronological").select("vec_id", "part")


PRE = f"(SELECT row_number() OVER (ORDER BY doc_id) - 1 AS query_id, doc_id, frequency FROM {DEDUP} d)"


@register("fill_split_frequency", _fill_sql("-coalesce(frequency, 1)::DOUBLE, query_id", PRE, "query_id"))
def q_fill_split_frequency(spark, sf):
    pre = X.preprocess(T(spark, sf, "documents").select("doc_id", "text")).select("query_id", "frequency")
    return Smp.fill_split(pre, "query_id", 0.5, "frequency").select("query_id", "part")


@register("calibration_split", f"""
WITH {S.holdout()}, q AS (SELECT vec_id FROM hs WHERE is_q)
SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY {S.md5_key(43, 'calibration', 'vec_id')}, vec_id)
                        <= (SELECT greatest(10, floor(count(*) * 0.2::DOUBLE)) FROM q) THEN 'calibration' ELSE 'test' END AS role
FROM q""")
def q_calibration_split(spark, sf):
    split = Smp.holdout_split(_emb(spark, sf).select("vec_id"), id_col="vec_id")
    q = split.filter(F.col("split") == "query").select("vec_id")
    return Smp.calibration_split(q, "vec_id", 0.2, seed=42).select("vec_id", "role")


@register("warmup_split", f"""
WITH d AS {DENSE}, n AS (SELECT count(*) AS n FROM d)
SELECT vec_id, CASE WHEN query_id < least(floor(n * 0.3::DOUBLE), floor(n * 0.1::DOUBLE)) THEN 'warmup'
                    WHEN query_id >= floor(n * 0.3::DOUBLE) THEN 'stream' END AS phase
FROM d, n""")
def q_warmup_split(spark, sf):
    return Smp.warmup_split(_dense_emb(spark, sf), seq_col="query_id").select("vec_id", "phase")


SUBSET_SIZES = {"100": 100, "500": 500, "5k": 5000}


def _subsets_sql() -> str:
    parts = []
    for name, size in sorted(SUBSET_SIZES.items(), key=lambda kv: kv[1]):
        key = S.md5_key(42, f"subset:{name}", "doc_id")
        parts.append(f"""
SELECT '{name}' AS subset, row_number() OVER (ORDER BY doc_id) - 1 AS query_id, doc_id FROM (
  SELECT doc_id FROM p ORDER BY {key}, doc_id LIMIT {size}) s
WHERE (SELECT count(*) FROM p) >= {size}""")
    parts.append("SELECT 'full' AS subset, row_number() OVER (ORDER BY doc_id) - 1 AS query_id, doc_id FROM p")
    return f"WITH p AS {PRE} " + " UNION ALL ".join(parts)


def _subsets(spark, sf):
    pre = X.preprocess(T(spark, sf, "documents").select("doc_id", "text")).select("doc_id")
    return Smp.fixed_subsets(pre, "doc_id", SUBSET_SIZES, seed=42)


@register("fixed_subsets", _subsets_sql())
def q_fixed_subsets(spark, sf):
    return _subsets(spark, sf).select("subset", "query_id", "doc_id")


@register("embedding_subsets", f"""
WITH s AS ({_subsets_sql()})
SELECT s.subset, s.query_id, e.vec_id, e.label FROM s JOIN embeddings e ON e.vec_id = s.doc_id""")
def q_embedding_subsets(spark, sf):
    out = Smp.embedding_subsets(_emb(spark, sf).select("vec_id", "label"), _subsets(spark, sf))
    return out.select("subset", "query_id", "vec_id", "label")


@register("no_leakage_check", f"""
WITH {S.holdout()} SELECT count(*) AS n_leaked FROM hs q JOIN hs d ON q.vec_id = d.vec_id AND q.is_q AND NOT d.is_q""")
def q_no_leakage_check(spark, sf):
    split = Smp.holdout_split(_emb(spark, sf).select("vec_id"), id_col="vec_id")
    return Smp.leakage_count(split.filter(F.col("split") == "query"), split.filter(F.col("split") == "database"))


N_DRAWS = "(SELECT count(*) FROM embeddings)"


@register("sample_uniform", f"""
WITH d AS {DENSE},
dr AS (SELECT range AS draw_id, floor({S.uniform(42, 'uniform', 'range')} * (SELECT count(*) FROM d))::BIGINT AS pos
       FROM range({N_DRAWS}))
SELECT dr.draw_id, d.query_id FROM dr JOIN d ON d.query_id = dr.pos""")
def q_sample_uniform(spark, sf):
    rows = _dense_emb(spark, sf)
    return Smp.sample_uniform(rows, rows.count(), seed=42)


def _zipf_sql(exponent: float, salt: str = "zipf") -> str:
    return f"""
WITH d AS {DENSE},
sz AS (SELECT label, count(*) AS size FROM d GROUP BY label),
wr AS (SELECT label, size, row_number() OVER (ORDER BY label) AS r FROM sz),
ww AS (SELECT *, pow(r::DOUBLE, -{float(exponent)!r}::DOUBLE) AS w FROM wr),
wp AS (SELECT *, w / sum(w) OVER () AS p FROM ww),
cw AS (SELECT *, sum(p) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS hi FROM wp),
cb AS (SELECT *, hi - p AS lo FROM cw),
dr AS (SELECT range AS draw_id, {S.uniform(42, salt, 'range')} AS u, {S.uniform(42, 'member', 'range')} AS u2
       FROM range({N_DRAWS})),
pk AS (SELECT dr.draw_id, cb.label, floor(dr.u2 * cb.size)::BIGINT AS m FROM dr JOIN cb
         ON dr.u >= cb.lo AND (dr.u < cb.hi OR cb.hi >= 1.0 - 1e-12)
       QUALIFY row_number() OVER (PARTITION BY dr.draw_id ORDER BY cb.lo) = 1),
mem AS (SELECT label, query_id, row_number() OVER (PARTITION BY label ORDER BY query_id) - 1 AS m FROM d)
SELECT pk.draw_id, pk.label, mem.query_id FROM pk JOIN mem ON mem.label = pk.label AND mem.m = pk.m"""


@register("sample_zipf_clusters", _zipf_sql(1.0))
def q_sample_zipf_clusters(spark, sf):
    rows = _dense_emb(spark, sf)
    return Smp.sample_zipf_clusters(rows, rows.count(), seed=42)


@register("sample_concentrated", _zipf_sql(1.0 + 3.0 * 0.5))
def q_sample_concentrated(spark, sf):
    rows = _dense_emb(spark, sf)
    return Smp.sample_concentrated(rows, rows.count(), gamma=0.5, seed=42)


BURSTY_SQL = f"""
WITH d AS {DENSE},
cl AS (SELECT label, count(*) AS size, row_number() OVER (ORDER BY label) - 1 AS c FROM d GROUP BY label),
k AS (SELECT count(*) AS k FROM cl),
b AS (SELECT range AS burst_id, floor({S.uniform(42, 'burst_cluster', 'range')} * (SELECT k FROM k))::BIGINT AS c,
             greatest(1, ceil(ln(1.0 - {S.uniform(42, 'burst_len', 'range')}) / {math.log(1.0 - 1.0 / 20)!r}::DOUBLE))::BIGINT AS len
      FROM range({N_DRAWS})),
bs AS (SELECT *, coalesce(sum(len) OVER (ORDER BY burst_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM b),
ex AS (SELECT bs.burst_id, cl.label, cl.size, bs.start + unnest(generate_series(0, bs.len - 1)) AS draw_id
       FROM bs JOIN cl ON cl.c = bs.c WHERE bs.start < {N_DRAWS}),
dm AS (SELECT *, floor({S.uniform(42, 'burst_member', 'draw_id')} * size)::BIGINT AS m FROM ex WHERE draw_id < {N_DRAWS}),
mem AS (SELECT label, query_id, row_number() OVER (PARTITION BY label ORDER BY query_id) - 1 AS m FROM d)
SELECT dm.draw_id, dm.burst_id, dm.label, mem.query_id FROM dm JOIN mem ON mem.label = dm.label AND mem.m = dm.m"""


@register("sample_bursty", BURSTY_SQL)
def q_sample_bursty(spark, sf):
    rows = _dense_emb(spark, sf)
    return Smp.sample_bursty(rows, rows.count(), seed=42)


def _reordered(draw_sql: str) -> str:
    """``seq, query_id, vec_id`` of a draw (draw_id, query_id)."""
    return f"""
SELECT w.draw_id AS seq, w.query_id, d.vec_id FROM ({draw_sql}) w JOIN {DENSE} d ON d.query_id = w.query_id"""


UNIFORM_SQL = f"""
WITH d AS {DENSE},
dr AS (SELECT range AS draw_id, floor({S.uniform(42, 'uniform', 'range')} * (SELECT count(*) FROM d))::BIGINT AS pos
       FROM range({N_DRAWS}))
SELECT dr.draw_id, d.query_id FROM dr JOIN d ON d.query_id = dr.pos"""


def _reorder(spark, sf, workload):
    rows = _dense_emb(spark, sf)
    return Smp.reorder_stream(rows.withColumn("seq", F.col("query_id")), workload, seed=42).select("seq", "query_id", "vec_id")


@register("reorder_stream", _reordered(_zipf_sql(1.0)))
def q_reorder_stream(spark, sf):
    return _reorder(spark, sf, "clustered")


@register("reorder_stream_uniform", _reordered(UNIFORM_SQL))
def q_reorder_stream_uniform(spark, sf):
    return _reorder(spark, sf, "uniform")


@register("reorder_stream_bursty", _reordered(BURSTY_SQL))
def q_reorder_stream_bursty(spark, sf):
    return _reorder(spark, sf, "bursty")


@register("reorder_stream_temporal", f"SELECT query_id AS seq, query_id, vec_id FROM {DENSE} d")
def q_reorder_stream_temporal(spark, sf):
    return _reorder(spark, sf, "temporal")


@register("sample_concentrated_uniform", f"SELECT w.draw_id, d.label, w.query_id FROM ({UNIFORM_SQL}) w JOIN {DENSE} d ON d.query_id = w.query_id")
def q_sample_concentrated_uniform(spark, sf):
    """D4 at gamma 0: the uniform branch."""
    rows = _dense_emb(spark, sf)
    return Smp.sample_concentrated(rows, rows.count(), gamma=0.0, seed=42)


# Draws over nearest-centre cells (the label means as given centres) instead of the label column.
CELL_DENSE = f"""(SELECT p.vec_id, p.cell AS label, row_number() OVER (ORDER BY p.vec_id) - 1 AS query_id
                 FROM (WITH {S.label_cells('embeddings').lstrip()} SELECT * FROM probe WHERE place = 1) p)"""


@register("sample_zipf_cells", _zipf_sql(1.0).replace(DENSE, CELL_DENSE))
def q_sample_zipf_cells(spark, sf):
    from cachelens.operators.ann import kmeans_assign
    from cachelens.operators.vectors import collect_centroids

    emb = _emb(spark, sf)
    cells = kmeans_assign(emb, collect_centroids(emb, "label")[1], id_col="vec_id").select("vec_id", F.col("cell").alias("label"))
    rows = dense_ids(cells, ["vec_id"], out_col="query_id")
    return Smp.sample_zipf_clusters(rows, rows.count(), seed=42)
