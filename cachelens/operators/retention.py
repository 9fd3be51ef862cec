"""Cache-table upkeep and retention ranking (G1-G9) over an access log.

The reference keeps an in-memory cache and asks a policy for one victim at a time. Here
each policy is a *ranking query*: given an access log ``(key, seq)`` (the first log row of
a key is its insertion, later rows are reads) and an entry table, "which n entries would
be dropped now, in which order?". Rankings over all entries use range-partitioned
numbering, never a single-partition window.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelens.operators.ordering import dense_ids, previous_value
from cachelens.operators.range_prune import neighbor_counts
from cachelens.operators.vector_join import knn
from cachelens.operators.vectors import dimension_sums, partial_moments

INF = float("inf")


# ------------------------------------------------------------------------------ access log

def access_log(events: DataFrame, key_col: str = "user_id", ts_col: str = "ts", id_col: str = "event_id",
               keep=()) -> DataFrame:
    """``(key, ts, event id, *keep, seq)``: ``seq`` = position in (ts, event id) order, 0-based.
    Only the named columns enter the range shuffle (the numbering persists its input, and
    column pruning does not cross a persisted boundary)."""
    cols = [F.col(key_col).alias("key"), F.col(ts_col), F.col(id_col), *[F.col(c) for c in keep]]
    return dense_ids(events.select(*cols), [ts_col, id_col], out_col="seq")


def key_stats(log: DataFrame) -> DataFrame:
    """Per key: insertion position, last touch, number of reads (insertion counts 0)."""
    return log.groupBy("key").agg(F.min("seq").alias("inserted_seq"), F.max("seq").alias("last_touch"),
                                  (F.count(F.lit(1)) - 1).alias("reads"))


def _victims(ranked: DataFrame, order, n: int | None) -> DataFrame:
    out = dense_ids(ranked, order, out_col="victim_rank", start=1)
    return out.filter(F.col("victim_rank") <= n) if n is not None else out


# ------------------------------------------------------------------------------ G3, G4

def rank_lru(log: DataFrame, n: int | None = 10) -> DataFrame:
    """Least recently touched first (never read: its insertion is the last touch)."""
    return _victims(key_stats(log), ["last_touch", "key"], n).select("victim_rank", "key", "last_touch")


def rank_lfu(log: DataFrame, n: int | None = 10) -> DataFrame:
    """Fewest reads first, ties by earliest insertion."""
    return _victims(key_stats(log), ["reads", "inserted_seq", "key"], n) \
        .select("victim_rank", "key", "reads", "inserted_seq")


# ------------------------------------------------------------------------------ G5

def redundancy(entries: DataFrame, threshold: float = 0.30, id_col: str = "id", vec_col: str = "embedding",
               **options) -> DataFrame:
    """Share of the other entries within squared L2 ``<= threshold`` per entry, over all entries
    (a pruned threshold join, see ``range_prune``)."""
    near = neighbor_counts(entries, threshold, id_col, vec_col, **options)
    others = entries.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).cast("double")).scalar()
    return near.select(F.col("query_id").alias(id_col), (F.col("n_within") / others).alias("redundancy"))


# ------------------------------------------------------------------------------ G6

def rank_semantic(entries: DataFrame, log: DataFrame, threshold: float = 0.30, alpha: float = 1.0,
                  beta: float = 1.0, n: int | None = 10, id_col: str = "id", vec_col: str = "embedding",
                  eps: float = 1e-9) -> DataFrame:
    """score = redundancy / (alpha * recency + beta * frequency + eps); highest first, ties id asc.

    recency = rank of the last touch among entries / (n - 1) (0 = oldest); frequency =
    reads / max(max reads, 1); entries without any log row count as oldest, 0 reads."""
    red = redundancy(entries, threshold, id_col, vec_col)
    acc = key_stats(log).withColumnRenamed("key", id_col)
    base = entries.select(id_col).join(acc, id_col, "left").join(red, id_col, "left") \
        .withColumn("last_touch", F.coalesce("last_touch", F.lit(-1))) \
        .withColumn("reads", F.coalesce("reads", F.lit(0))) \
        .withColumn("redundancy", F.coalesce("redundancy", F.lit(0.0)))
    n_active = base.select(F.count(F.lit(1))).scalar()
    max_reads = base.agg(F.greatest(F.max("reads").cast("double"), F.lit(1.0))).scalar()
    ranked = dense_ids(base, ["last_touch", id_col], out_col="_rec_rank")
    recency = F.col("_rec_rank") / F.greatest(n_active - 1, F.lit(1)).cast("double")
    freq = F.col("reads") / max_reads
    score = F.col("redundancy") / (F.lit(alpha) * recency + F.lit(beta) * freq + F.lit(eps))
    scored = ranked.withColumn("recency", recency).withColumn("frequency", freq) \
        .withColumn("score", F.when(F.isnan(score), F.lit(0.0)).otherwise(score))
    return _victims(scored, [F.col("score").desc(), F.col(id_col)], n) \
        .select("victim_rank", id_col, F.round("score", 6).alias("score"), F.round("redundancy", 6).alias("redundancy"),
                F.round("recency", 6).alias("recency"), F.round("frequency", 6).alias("frequency"))


# ------------------------------------------------------------------------------ G7

def adaptive_alpha(stream: DataFrame, seq_col: str = "seq", vec_col: str = "embedding", window: int = 500,
                   interval: int = 200, min_window: int = 50, alpha_min: float = 0.3, alpha_max: float = 2.5,
                   base_alpha: float = 1.0) -> DataFrame:
    """Every ``interval`` rows, diversity of the last ``window`` rows -> alpha; one row per step.

    Sums are taken once per slice of gcd(window, interval) rows, with one short row per Arrow
    batch and slice leaving a task; a step adds up the slices of its window. Diversity is the
    closed-form normalised mean pair distance per window."""
    size = math.gcd(window, interval)
    n_rows = stream.select(F.count(F.lit(1))).scalar()
    max_step = F.floor(n_rows / F.lit(interval)).cast("int")
    parts = partial_moments(stream.select(F.floor(F.col(seq_col) / size).cast("long").alias("_slice"), vec_col), vec_col, "_slice")
    # slice i belongs to the steps t with t * interval - window <= i * size < t * interval
    lo = F.floor(F.col("key") * size / interval).cast("int") + 1
    hi = F.floor((F.col("key") * size + window) / interval).cast("int")
    tagged = parts.withColumn("step", F.explode(F.sequence(lo, F.greatest(lo, hi)))) \
        .filter((F.col("step") <= hi) & (F.col("step") <= max_step))
    mom = tagged.groupBy("step").agg(F.sum("n").alias("n"), (F.sum("nsq") / F.sum("n")).alias("msq"), (F.sum("norm") / F.sum("n")).alias("mnorm"))
    mean_sq = dimension_sums(tagged, ["step"]).groupBy("step").agg(F.sum(F.pow(F.col("s") / F.col("n"), 2)).alias("mean_sq"))
    n = F.col("n")
    avg_pair = F.when(n > 1, F.lit(2.0) * n / (n - 1) * (F.col("msq") - F.col("mean_sq"))).otherwise(F.lit(0.0))
    div = F.when(F.col("mnorm") > 0, F.least(F.lit(1.0), avg_pair / (F.lit(2.0) * F.col("mnorm") * F.col("mnorm")))) \
        .otherwise(F.lit(0.0))
    steps = mom.join(mean_sq, "step").filter(n >= min_window) \
        .withColumn("diversity", F.round(div, 4)) \
        .withColumn("new_alpha", F.lit(alpha_min) + F.lit(alpha_max - alpha_min) * F.col("diversity"))
    # window sizes never shrink (min(window, step * interval)), so the adapting steps are all
    # steps from the first one whose window reaches min_window: the adaptation number and the
    # previous alpha follow from the step number (an equi join on step - 1, no global window)
    first = max(1, -(-min_window // interval)) if min_window <= window else None
    if first is None:
        steps = steps.filter(F.lit(False))
        first = 1
    prev = steps.select((F.col("step") + 1).alias("step"), F.col("new_alpha").alias("_prev"))
    return steps.join(prev, "step", "left").select(
        (F.col("step") - first + 1).cast("int").alias("adaptation_step"), F.col("step").alias("at_step"),
        n.cast("long").alias("n_queries_seen"), "diversity",
        F.round(F.coalesce(F.col("_prev"), F.lit(base_alpha)), 4).alias("old_alpha"),
        F.round("new_alpha", 4).alias("new_alpha"))


# ------------------------------------------------------------------------------ G8

def next_use_keys(log: DataFrame, cut: int = 0, n: int | None = None) -> DataFrame:
    """Per key: first access at or after ``cut`` (inf if none); victims furthest first."""
    keys = log.select("key").distinct()
    future = log.filter(F.col("seq") >= cut).groupBy("key").agg(F.min("seq").alias("_nu"))
    nu = keys.join(future, "key", "left") \
        .withColumn("next_use", F.coalesce(F.col("_nu").cast("double"), F.lit(INF))).drop("_nu")
    return _victims(nu, [F.col("next_use").desc(), F.col("key")], n).select("victim_rank", "key", "next_use")


def next_access(log: DataFrame) -> DataFrame:
    """For every access row, the position of the next access to the same key (inf if none)."""
    desc = log.select("key", "seq", (-F.col("seq")).alias("_neg"))
    nxt = previous_value(desc, ["key"], ["_neg"], "seq", "_next")
    return nxt.select("key", "seq", F.coalesce(F.col("_next").cast("double"), F.lit(INF)).alias("next_use"))


def next_use_vectors(stream: DataFrame, entries: DataFrame, threshold: float = 0.90, cut: int = 0,
                     q_id: str = "query_id", seq_col: str = "seq", e_id: str = "id", vec_col: str = "embedding",
                     n: int | None = None) -> DataFrame:
    """An access = the nearest entry within ``threshold`` of a stream row; per entry the first
    access position >= cut (inf if none); victims furthest first, ties by id."""
    hits = knn(stream.filter(F.col(seq_col) >= cut), entries, 1, q_id=q_id, q_vec=vec_col, d_id=e_id, d_vec=vec_col) \
        .filter(F.col("dist") <= threshold)
    pos = stream.select(F.col(q_id).cast("long").alias("query_id"), F.col(seq_col).alias("_seq"))
    first = hits.join(pos, "query_id").groupBy(F.col("neighbor_id").alias(e_id)).agg(F.min("_seq").alias("_nu"))
    nu = entries.select(e_id).join(first, e_id, "left") \
        .withColumn("next_use", F.coalesce(F.col("_nu").cast("double"), F.lit(INF))).drop("_nu")
    return _victims(nu, [F.col("next_use").desc(), F.col(e_id)], n).select("victim_rank", e_id, "next_use")


# ------------------------------------------------------------------------------ G1, G2

def cache_build(rows: DataFrame, order_col: str, max_size: int | None = None, text_col: str = "text",
                response_col: str | None = None, metadata_cols=()) -> DataFrame:
    """Entry table ``(cache_id, ..., response, metadata, is_active, inserted_seq)``; with
    ``max_size`` only the last ``max_size`` rows are kept; ids from 0; the response defaults
    to the text; ``metadata_cols`` are packed into a ``MAP<STRING,STRING>``. Only ``order_col``
    (unique) is numbered; the kept rows join their texts by it."""
    numbered = dense_ids(rows.select(order_col), [order_col], out_col="cache_id")
    first = F.lit(0)
    if max_size is not None and max_size > 0:
        n = numbered.select(F.count(F.lit(1))).scalar()
        first = F.greatest(n - F.lit(max_size), F.lit(0))
        numbered = numbered.filter(F.col("cache_id") >= first)
    kept = numbered.select(order_col, (F.col("cache_id") - first).cast("long").alias("cache_id"))
    resp = F.coalesce(F.col(response_col), F.col(text_col)) if response_col else F.col(text_col)
    meta = F.create_map(*[x for c in metadata_cols for x in (F.lit(c), F.col(c).cast("string"))]) \
        if metadata_cols else F.create_map().cast("map<string,string>")
    out = rows.withColumn("response", resp).withColumn("metadata", meta).join(kept, order_col)
    return out.withColumn("is_active", F.lit(True)).withColumn("inserted_seq", F.col("cache_id"))


def cache_upkeep(cache: DataFrame, inserts: DataFrame, max_size: int, victim_order=None,
                 compact_ratio: float = 0.20, id_col: str = "cache_id", order_col: str = "src_id") -> DataFrame:
    """Insert (ids continue), tombstone victims so that active <= max_size, and compact when
    dead / total >= ``compact_ratio``: ``(old_id, new_id, is_active)`` (new ids dense in old-id order
    over the surviving entries; the map is a table to join to dependents)."""
    start = cache.agg(F.coalesce(F.max(id_col) + 1, F.lit(0))).scalar()
    new = dense_ids(inserts, [order_col], out_col="_n").withColumn(id_col, F.col("_n") + start).drop("_n")
    allrows = cache.select(id_col, "is_active").unionByName(new.select(id_col, F.lit(True).alias("is_active")))
    from cachelens.operators.sampling import first_n_flag

    active = allrows.filter("is_active")
    n_victims = max(0, active.count() - max_size)
    order = (victim_order or [F.col(id_col)]) + [F.col(id_col)]
    # the victims are the first n_victims active entries in victim order: a cut-off key
    victims = active.filter(first_n_flag(active, order, n_victims)).select(id_col, F.lit(True).alias("_dead"))
    state = allrows.join(victims, id_col, "left") \
        .withColumn("is_active", F.col("is_active") & F.col("_dead").isNull()).drop("_dead")
    total = state.select(F.count(F.lit(1))).scalar()
    dead = state.select(F.count_if(~F.col("is_active"))).scalar()
    compact = (dead / total) >= F.lit(compact_ratio)
    live = dense_ids(state.filter("is_active").select(id_col), [id_col], out_col="_new")
    return state.join(live, id_col, "left").select(
        F.col(id_col).alias("old_id"),
        F.when(compact, F.col("_new")).otherwise(F.when(F.col("is_active"), F.col(id_col))).alias("new_id"),
        "is_active", compact.alias("compacted"))


# ------------------------------------------------------------------------------ G9

POLICIES = ("lru", "lfu", "semantic", "oracle", "adaptive", "none")


def rank_victims(policy: str, log: DataFrame, entries: DataFrame | None = None, n: int | None = 10, **params) -> DataFrame:
    """Dispatch a retention ranking by policy name; ``none`` evicts nothing."""
    p = policy.strip().lower()
    if p == "lru":
        return rank_lru(log, n)
    if p == "lfu":
        return rank_lfu(log, n)
    if p in ("semantic", "adaptive"):
        if entries is None:
            raise ValueError(f"policy {p!r} needs an entry table with vectors")
        return rank_semantic(entries, log, n=n, **params)
    if p == "oracle":
        return next_use_keys(log, params.get("cut", 0), n)
    if p == "none":
        return log.sparkSession.createDataFrame([], "victim_rank long, key long")
    raise ValueError(f"unknown policy {policy!r}; available: {', '.join(POLICIES)}")
