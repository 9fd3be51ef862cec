"""Dataset profiling aggregates (H1-H11): histograms, shares, pivots, vector statistics.

Histograms follow numpy's equal-width rule: ``bins`` bins over ``[lo, hi]`` of the data,
``[a, b)`` except the last bin which includes ``hi``; empty bins are kept (right join to a
``range(bins)`` table). The bin edges come from a one-row aggregate used as a scalar
subquery, so no value is pulled to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cachelens.functions.vector import norm
from cachelens.functions.text import text_digest
from cachelens.operators.text import length_filter, with_token_count


def equal_width_histogram(df: DataFrame, value: Column, bins: int, lo: Column | None = None,
                          hi: Column | None = None, discrete: bool = False, weight: Column | None = None) -> DataFrame:
    """``(bin, bin_lo, bin_hi, count)`` for every bin; edges default to the data's min/max
    (a zero-width range becomes ``[v - 0.5, v + 0.5]`` like numpy).

    ``discrete=True`` (integer-like values such as token counts) first aggregates the input
    to one row per distinct value in a single pass; edges and bins are then computed on that
    small table, so the input is read once."""
    spark = df.sparkSession
    vals = df.select(value.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if discrete:
        # one row per distinct value (bounded by the value range of integer-like data)
        every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        if weight is not None:  # input already aggregated: (value, count) rows
            vals = df.select(value.cast("double").alias("_v"), weight.alias("_win")).filter(F.col("_v").isNotNull()) \
                .groupBy("_v").agg(F.sum("_win").alias("_w"))
        else:
            vals = vals.groupBy("_v").agg(F.count(F.lit(1)).alias("_w"))
        vals = vals.withColumn("_first", F.col("_v") == F.min("_v").over(every))
        if lo is None or hi is None:
            mn, mx = F.min("_v").over(every), F.max("_v").over(every)
            vals = vals.withColumn("_lo", F.when(mn == mx, mn - 0.5).otherwise(mn)) \
                .withColumn("_hi", F.when(mn == mx, mx + 0.5).otherwise(mx))
        else:
            vals = vals.withColumn("_lo", lo).withColumn("_hi", hi)
        lo_c, hi_c = F.col("_lo"), F.col("_hi")
        width = (hi_c - lo_c) / F.lit(float(bins))
        b = F.least(F.floor((F.col("_v") - lo_c) / width).cast("int"), F.lit(bins - 1))
        binned = vals.filter((F.col("_v") >= lo_c) & (F.col("_v") <= hi_c)) \
            .groupBy(b.alias("bin")).agg(F.sum("_w").alias("count"))
        # the bin grid is generated from the one row holding the smallest value (it carries the edges)
        grid = vals.filter("_first").select("_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")) \
            .withColumn("_width", (F.col("_hi") - F.col("_lo")) / F.lit(float(bins)))
        return (grid.join(binned, "bin", "left")
                .select("bin", F.round(F.col("_lo") + F.col("bin") * F.col("_width"), 6).alias("bin_lo"),
                        F.round(F.col("_lo") + (F.col("bin") + 1) * F.col("_width"), 6).alias("bin_hi"),
                        F.coalesce("count", F.lit(0)).cast("long").alias("count")))
    if lo is None or hi is None:
        mm = vals.agg(F.min("_v").alias("mn"), F.max("_v").alias("mx"))
        same = F.col("mn") == F.col("mx")
        edges = mm.select(F.struct(F.when(same, F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
                                   F.when(same, F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi")))
        e = edges.scalar()  # one scalar subquery, reused for both edges
        lo, hi = e.getField("lo"), e.getField("hi")
    width = (hi - lo) / F.lit(float(bins))
    b = F.least(F.floor((F.col("_v") - lo) / width).cast("int"), F.lit(bins - 1))
    counts = (vals.filter((F.col("_v") >= lo) & (F.col("_v") <= hi))
              .select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin",
                    F.round(lo + F.col("bin") * width, 6).alias("bin_lo"),
                    F.round(lo + (F.col("bin") + 1) * width, 6).alias("bin_hi"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


# ------------------------------------------------------------------------------ H1

def length_histogram(df: DataFrame, text_col: str = "text", bins: int = 80, min_tokens: int = 3,
                     max_tokens: int = 512) -> DataFrame:
    """Token-count histograms before and after the length filter from ONE pass over the texts:
    rows are aggregated to (token count, kept?) counts, both histograms read that small table."""
    tc = F.col("token_count")
    keep = tc.between(max(1, min_tokens), max_tokens)  # blank texts have no tokens
    counts = with_token_count(df.select(text_col), text_col) \
        .groupBy(tc.alias("_v"), keep.alias("_keep")).agg(F.count(F.lit(1)).alias("_n"))
    a = equal_width_histogram(counts, F.col("_v"), bins, discrete=True, weight=F.col("_n")) \
        .withColumn("stage", F.lit("raw"))
    b = equal_width_histogram(counts.filter("_keep"), F.col("_v"), bins, discrete=True, weight=F.col("_n")) \
        .withColumn("stage", F.lit("filtered"))
    return a.unionByName(b)


def length_stats(df: DataFrame, text_col: str = "text", min_tokens: int = 3, max_tokens: int = 512) -> DataFrame:
    tc = F.col("token_count")
    return length_filter(df, text_col, min_tokens, max_tokens).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(tc), 4).alias("mean_tokens"),
        F.round(F.percentile(tc, 0.5), 4).alias("median_tokens"),
        F.round(F.stddev_samp(tc), 4).alias("std_tokens"))


# ------------------------------------------------------------------------------ H2, H3

def frequency_histogram(dedup: DataFrame, freq_col: str = "frequency", cap: int = 50) -> DataFrame:
    """Unique texts per frequency value, unit bins 1..min(max, cap). One aggregation of the
    input (per distinct frequency); the cut-off and the empty bins come from that small table."""
    counts = dedup.groupBy(F.col(freq_col).cast("long").alias("frequency")).agg(F.count(F.lit(1)).alias("n_unique"))
    grid = dedup.sparkSession.range(1, cap + 1).select(F.col("id").alias("frequency"))
    full = grid.join(counts, "frequency", "full")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = F.least(F.max(F.when(F.col("n_unique").isNotNull(), F.col("frequency"))).over(every), F.lit(cap))
    return (full.withColumn("_top", top)
            .filter((F.col("frequency") >= 1) & (F.col("frequency") <= F.col("_top")))
            .select("frequency", F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique")))


def frequency_summary(dedup: DataFrame, freq_col: str = "frequency") -> DataFrame:
    f = F.col(freq_col)
    n = F.count(F.lit(1))
    return dedup.agg(
        n.alias("n_unique_texts"),
        F.count_if(f == 1).alias("n_freq_1"),
        F.round(F.count_if(f == 1) / n * 100.0, 4).alias("pct_freq_1"),
        F.count_if(f > 1).alias("n_duplicated"),
        F.round(F.count_if(f > 1) / n * 100.0, 4).alias("pct_duplicated"),
        F.max(f).cast("long").alias("max_frequency"))


def top_frequent(dedup: DataFrame, n: int = 15, text_col: str = "text", id_col: str = "doc_id",
                 freq_col: str = "frequency", width: int = 50) -> DataFrame:
    """Top-n by frequency (first occurrence wins ties), label cut to ``width`` chars + '...'."""
    t = F.col(text_col)
    label = F.when(F.length(t) > width, F.concat(F.substring(t, 1, width), F.lit("..."))).otherwise(t)
    return (dedup.orderBy(F.col(freq_col).desc(), F.col(id_col)).limit(n)
            .select(id_col, F.col(freq_col).cast("long").alias("frequency"), label.alias("label")))


# ------------------------------------------------------------------------------ H4, H5

def value_share(df: DataFrame, col: str, n: int = 15) -> DataFrame:
    """Value counts, top n (count desc, value asc), percent of all rows."""
    total = df.select(F.count(F.lit(1))).scalar()
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return (counts.orderBy(F.col("n").desc(), F.col("value")).limit(n)
            .select("value", "n", F.round(F.col("n") / total * 100.0, 4).alias("pct")))


def binary_share(df: DataFrame, col: str, value: str) -> DataFrame:
    hit = F.count_if(F.col(col) == value)
    n = F.count(F.lit(1))
    return df.agg(hit.alias("n_match"), (n - hit).alias("n_other"),
                  F.round(hit / n * 100.0, 4).alias("pct_match"))


def group_top_n_other(df: DataFrame, col: str, n: int = 8, whitelist: list | None = None,
                      out_col: str = "group") -> DataFrame:
    """Keep the ``n`` most frequent values (count desc, value asc) or a fixed ``whitelist``;
    every other value becomes ``Other``. The kept list has at most ``n`` (or whitelist) rows,
    so it is broadcast."""
    if whitelist is not None:
        return df.withColumn(out_col, F.when(F.col(col).isin(list(whitelist)), F.col(col)).otherwise(F.lit("Other")))
    top = (df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
           .orderBy(F.col("_n").desc(), F.col(col)).limit(n)
           .select(col, F.col(col).alias("_keep")))
    return df.join(F.broadcast(top), col, "left") \
        .withColumn(out_col, F.coalesce("_keep", F.lit("Other"))).drop("_keep")


# ------------------------------------------------------------------------------ H6

def turns_per_conversation(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    return conversations.groupBy(conv_col).agg(F.count(F.lit(1)).alias("num_turns"))


def turn_stats(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    t = F.col("num_turns")
    return turns_per_conversation(conversations, conv_col).agg(
        F.count(F.lit(1)).alias("n_conversations"),
        F.round(F.avg(t), 4).alias("mean_turns"),
        F.round(F.percentile(t, 0.5), 4).alias("median_turns"),
        F.max(t).cast("long").alias("max_turns"))


def turn_histogram(conversations: DataFrame, conv_col: str = "conv_id", cap: int = 30) -> DataFrame:
    per = turns_per_conversation(conversations, conv_col).withColumnRenamed("num_turns", "frequency")
    return frequency_histogram(per, "frequency", cap).withColumnRenamed("frequency", "num_turns") \
        .withColumnRenamed("n_unique", "n_conversations")


# ------------------------------------------------------------------------------ H7

def preprocess_funnel(df: DataFrame, text_col: str = "text", min_tokens: int = 3,
                      max_tokens: int = 512) -> DataFrame:
    """raw -> after length filter -> after dedup: count, percent of raw, drop from previous."""
    tc = F.col("token_count")
    inside = (tc >= min_tokens) & (tc <= max_tokens)
    one = with_token_count(df, text_col).agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if(inside).alias("filtered"),
        F.count_distinct(F.when(inside, text_digest(F.col(text_col)))).alias("dedup"))
    stages = F.array(
        F.struct(F.lit(0).alias("step"), F.lit("raw").alias("stage"), F.col("raw").alias("n"),
                 F.lit(None).cast("long").alias("drop")),
        F.struct(F.lit(1).alias("step"), F.lit("after_length_filter").alias("stage"), F.col("filtered").alias("n"),
                 (F.col("raw") - F.col("filtered")).alias("drop")),
        F.struct(F.lit(2).alias("step"), F.lit("after_dedup").alias("stage"), F.col("dedup").alias("n"),
                 (F.col("filtered") - F.col("dedup")).alias("drop")))
    return one.select("raw", F.inline(stages)).select(
        "step", "stage", F.col("n").cast("long").alias("n"),
        F.round(F.col("n") / F.col("raw") * 100.0, 4).alias("pct_of_raw"),
        F.col("drop").cast("long").alias("drop"))


# ------------------------------------------------------------------------------ H8, H9

def norm_stats(emb: DataFrame, vec_col: str = "embedding") -> DataFrame:
    nrm = norm(F.col(vec_col))
    return emb.select(nrm.alias("nrm")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("nrm"), 6).alias("mean_norm"),
        F.round(F.stddev_pop("nrm"), 6).alias("std_norm"),
        F.round(F.min("nrm"), 6).alias("min_norm"),
        F.round(F.max("nrm"), 6).alias("max_norm"),
        ((F.max("nrm") - F.min("nrm")) < 1e-6).alias("single_bar"))


def norm_histogram(emb: DataFrame, vec_col: str = "embedding", bins: int = 50) -> DataFrame:
    return equal_width_histogram(emb, norm(F.col(vec_col)), bins)


def dimension_stats(emb: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Mean and population std per dimension (partial sums per Arrow batch)."""
    from cachelens.operators.vectors import dimension_sums, partial_moments

    mean = F.col("s") / F.col("n")
    var = F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean)
    return dimension_sums(partial_moments(emb, vec_col)).select(
        "dim", F.round(mean, 6).alias("mean"), F.round(F.sqrt(var), 6).alias("std"))


# ------------------------------------------------------------------------------ H10

def pivot_mean_length(df: DataFrame, row_col: str = "source", col_col: str = "lang",
                      text_col: str = "text", top_rows: int = 10, top_cols: int = 8) -> DataFrame:
    """Mean token count for the top rows x top columns (by count), one row per cell that has
    rows: ``(row, col, mean_tokens)``. The top-n lists are the feature; they are joined, not collected."""
    tc = with_token_count(df.select(row_col, col_col, text_col), text_col).select(row_col, col_col, "token_count")

    def top(c: str, n: int) -> DataFrame:
        return df.groupBy(c).count().orderBy(F.col("count").desc(), F.col(c)).limit(n).select(c)

    return (tc.join(top(row_col, top_rows), row_col, "left_semi").join(top(col_col, top_cols), col_col, "left_semi")
            .groupBy(row_col, col_col).agg(F.round(F.avg("token_count"), 4).alias("mean_tokens")))


# ------------------------------------------------------------------------------ H11

def dataset_summary(docs: DataFrame, emb: DataFrame, text_col: str = "text", src_col: str = "source",
                    lang_col: str = "lang", vec_col: str = "embedding", min_tokens: int = 3,
                    max_tokens: int = 512) -> DataFrame:
    tc = F.col("token_count")
    inside = (tc >= min_tokens) & (tc <= max_tokens)
    # one distinct count per aggregate (several in one would copy every row, text and all); the
    # distinct texts are counted by digest
    d = with_token_count(docs.select(text_col), text_col).select("token_count", text_digest(F.col(text_col)).alias("_digest")).agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_distinct(F.when(inside, F.col("_digest"))).alias("processed_rows"),
        F.round(F.avg(F.when(inside, tc)), 4).alias("mean_tokens"))
    d = d.select("raw_rows", "processed_rows", docs.agg(F.count_distinct(src_col)).scalar().alias("n_models"),
                 docs.agg(F.count_distinct(lang_col)).scalar().alias("n_languages"), "mean_tokens")
    dim = emb.agg(F.max(F.size(vec_col))).scalar()
    n_vec = emb.agg(F.count(F.lit(1))).scalar()
    return d.select(
        "*", dim.alias("dim"), n_vec.alias("n_vectors"),
        (dim.cast("long") * n_vec * 4).alias("embedding_bytes"),
        F.round((F.lit(1.0) - F.col("processed_rows") / F.col("raw_rows")) * 100.0, 4).alias("dedup_rate_pct"))
