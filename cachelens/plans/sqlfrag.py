"""SQL fragments for the DuckDB oracles of the registered queries."""

from __future__ import annotations

from cachelens.functions.draws import DRAW_DIGITS


def sq_l2(a: str, b: str) -> str:
    return (f"list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), "
            f"lambda x: (x[1] - x[2]) * (x[1] - x[2])))")


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda x: x[1] * x[2]))"


def norm_sq(a: str) -> str:
    return f"list_sum(list_transform({a}::DOUBLE[], lambda x: x * x))"


def md5_key(seed, salt, id_sql: str) -> str:
    prefix = f"{seed}:{salt}:" if salt else f"{seed}:"
    return f"md5('{prefix}' || CAST({id_sql} AS VARCHAR))"


def uniform(seed, salt, id_sql: str) -> str:
    return f"(('0x' || substr({md5_key(seed, salt, id_sql)}, 1, {DRAW_DIGITS}))::BIGINT / {16.0**DRAW_DIGITS!r}::DOUBLE)"


def values(rows, names: str, alias: str = "v") -> str:
    body = ", ".join("(" + ", ".join(_lit(v) for v in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({names})"


def _lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    return str(v)


def cosine_quality(d: str) -> str:
    return f"greatest(0.0, least(1.0, 1.0 - {d} / 2.0))"


def holdout(query_count: int = 1000, seed: int = 42) -> str:
    """CTE ``hs``: embeddings with ``is_q`` for the C6 holdout split."""
    return f"""
hs AS (
  SELECT vec_id, embedding, label,
         row_number() OVER (ORDER BY {md5_key(seed, 'holdout', 'vec_id')}, vec_id)
           <= (SELECT least({query_count}, count(*) // 5) FROM embeddings) AS is_q
  FROM embeddings)"""


def holdout_nn(query_count: int = 1000, seed: int = 42) -> str:
    """CTEs ``hs`` (split), ``nn`` (query_id, nn_id, dist, gt_id, gt_dist) for the C6 holdout."""
    return f"""{holdout(query_count, seed)},
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id AS nn_id, {sq_l2('q.embedding', 'd.embedding')} AS dist
  FROM hs q JOIN hs d ON q.is_q AND NOT d.is_q),
nn AS (
  SELECT query_id, nn_id, dist, nn_id AS gt_id, dist AS gt_dist FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, nn_id) AS r FROM pairs)
  WHERE r = 1)"""


def fill_nn(strategy: str = "random", ratio: float = 0.5, seed: int = 42, table: str = "emb") -> str:
    """CTEs ``fs`` and ``nn`` for the C7 fill split of ``table`` (vec_id, embedding[, frequency])."""
    if strategy == "frequency":
        order = "-coalesce(frequency, 1)::DOUBLE, vec_id"
    elif strategy == "chronological":
        order = "vec_id"
    else:
        order = f"{md5_key(seed, 'fill', 'vec_id')}, vec_id"
    return f"""
fs AS (
  SELECT vec_id, embedding,
         row_number() OVER (ORDER BY {order}) <= (SELECT floor(count(*) * {ratio!r}::DOUBLE) FROM {table}) AS is_cache
  FROM {table}),
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id AS nn_id, {sq_l2('q.embedding', 'd.embedding')} AS dist
  FROM fs q JOIN fs d ON NOT q.is_cache AND d.is_cache),
nn AS (
  SELECT query_id, nn_id, dist, nn_id AS gt_id, dist AS gt_dist FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, nn_id) AS r FROM pairs)
  WHERE r = 1)"""


def savings(h: str, cache_ms: float = 0.5, llm_ms: float = 500.0, llm_usd: float = 0.01) -> str:
    lat = f"({h} * {cache_ms!r}::DOUBLE + (1.0 - {h}) * {cache_ms + llm_ms!r}::DOUBLE)"
    lat_pct = f"round(({llm_ms!r}::DOUBLE - {lat}) / {llm_ms!r}::DOUBLE * 100.0, 2)"
    cost = f"((1.0 - {h}) * {llm_usd!r}::DOUBLE)"
    mon_pct = f"round(({llm_usd!r}::DOUBLE - {cost}) / {llm_usd!r}::DOUBLE * 100.0, 2)"
    return lat, lat_pct, cost, mon_pct


def sweep_select(nn: str, thresholds, cache_ms: float = 0.5) -> str:
    """Full F5 select over CTE ``nn`` for the given thresholds."""
    h = "(CASE WHEN n > 0 THEN n_hits / n ELSE 0.0 END)"
    lat, lat_pct, cost, mon_pct = savings(h, cache_ms)
    return f"""
sw AS (
  SELECT t.threshold,
         (SELECT count(*) FROM {nn})::DOUBLE AS n,
         count(x.query_id) AS n_hits,
         sum({cosine_quality('x.dist')}) AS sq,
         sum(CASE WHEN x.nn_id = x.gt_id THEN 1 ELSE 0 END) AS ss,
         sum(CASE WHEN x.dist <= x.gt_dist * 2.0 + 0.01 THEN 1 ELSE 0 END) AS sd
  FROM {values([float(t) for t in thresholds], 'threshold', 't')}
  LEFT JOIN {nn} x ON x.dist <= t.threshold
  GROUP BY t.threshold)
SELECT round(threshold, 4) AS threshold,
       round({h}, 4) AS hit_rate,
       round(CASE WHEN n_hits > 0 THEN sq / n_hits ELSE 1.0 END, 4) AS retrieval_similarity,
       round(CASE WHEN n_hits > 0 THEN ss / n_hits ELSE 1.0 END, 4) AS recall_at_1,
       round(CASE WHEN n_hits > 0 THEN sd / n_hits ELSE 1.0 END, 4) AS distance_quality,
       n_hits::BIGINT AS n_hits,
       (n - n_hits)::BIGINT AS n_misses,
       round({lat}, 6) AS avg_latency_ms,
       {lat_pct} AS latency_saving_pct,
       round({cost}, 8) AS avg_cost_usd,
       {mon_pct} AS monetary_saving_pct
FROM sw"""


def topk(pairs: str, k: int, val: str = "dist", desc: bool = False, digits: int = 6) -> str:
    """Select ``(query_id, rank, neighbor_id, <val>)`` top-k from a pairs CTE with nn_id."""
    order = f"{val} DESC" if desc else val
    return f"""
SELECT query_id, rank::INTEGER AS rank, neighbor_id, round({val}, {digits}) AS {val} FROM (
  SELECT query_id, nn_id AS neighbor_id, {val},
         row_number() OVER (PARTITION BY query_id ORDER BY {order}, nn_id) AS rank FROM {pairs})
WHERE rank <= {k}"""


def explode_vec(table: str, extra: str = "") -> str:
    return (f"(SELECT vec_id{extra}, unnest(generate_series(0, len(embedding) - 1)) AS i, "
            f"unnest(embedding)::DOUBLE AS v FROM {table})")


def lsh_bits(table: str, nbits: int = 64, seed: int = 42) -> str:
    """CTEs ``hp`` (hyperplanes) and ``bits`` (vec_id, p, bit) for the rows of ``table``."""
    dim = "(SELECT max(len(embedding)) FROM embeddings)"
    a = uniform(seed, "lsh_a", "p * dimv + i")
    b = uniform(seed, "lsh_b", "p * dimv + i")
    return f"""
hp AS (
  SELECT p, i, sqrt(-2.0 * ln(1.0 - {a})) * cos(2.0 * pi() * {b}) AS h
  FROM range({nbits}) t1(p),
       (SELECT {dim} AS dimv) dd,
       (SELECT unnest(generate_series(0, {dim} - 1)) AS i) t2),
bits AS (
  SELECT ex.vec_id, hp.p, sum(ex.v * hp.h) > 0 AS bit
  FROM {explode_vec(table)} ex JOIN hp ON ex.i = hp.i GROUP BY ex.vec_id, hp.p)"""


def label_cells(rows: str, name: str = "") -> str:
    """CTE ``probe<name>`` (vec_id, cell, dist, place): the per-label means of ``embeddings`` by distance from
    each vector of ``rows`` (nearest is place 1, ties by label)."""
    return f"""
cx{name} AS (SELECT label, i, avg(v) AS m FROM {explode_vec('embeddings', ', label')} GROUP BY label, i),
cd{name} AS (SELECT x.vec_id, c.label AS cell, sum((x.v - c.m) * (x.v - c.m)) AS dist
        FROM {explode_vec(rows)} x JOIN cx{name} c ON x.i = c.i GROUP BY x.vec_id, c.label),
probe{name} AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cell) AS place FROM cd{name})"""


def ivf_pairs(queries: str, database: str, nprobe: int, probe: str = "probe", name: str = "ivf") -> str:
    """CTE ``<name>`` (query_id, nn_id, dist): pairs whose database row lies in one of the query's
    ``nprobe`` nearest cells."""
    return f"""
{name} AS (
  SELECT q.vec_id AS query_id, d.vec_id AS nn_id, {sq_l2('q.embedding', 'd.embedding')} AS dist
  FROM {queries} q JOIN {probe} pq ON pq.vec_id = q.vec_id AND pq.place <= {nprobe}
  JOIN {probe} pd ON pd.cell = pq.cell AND pd.place = 1 JOIN {database} d ON d.vec_id = pd.vec_id)"""
