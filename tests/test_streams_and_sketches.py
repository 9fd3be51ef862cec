"""Streaming first user turns and running rates in several micro-batches; mergeable distinct counts."""

import random

from pyspark.sql import functions as F

from cachelens.operators import results as R
from cachelens.operators import sketches as K
from cachelens.operators.text import first_user_turn_flat
from cachelens.streaming.conversations import first_user_turn_updates, first_user_turns
from cachelens.streaming.running_rates import run_running_rates

TURNS = "conv_id long, turn long, role string, text string"


def stream_of(spark, folder, parts, schema):
    """A file stream that takes the given lists of rows in turn, one a micro-batch."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_first_turns_arrive_late_and_out_of_order(spark, tmp_path):
    rows = [(c, t, "assistant" if (c + t) % 3 == 0 else "user", None if (c, t) == (4, 2) else f" turn {c}.{t} ") for c in range(30) for t in range(1, 6)]
    rows += [(40, 1, "assistant", "hello"), (41, 1, "user", "   "), (41, 2, "user", "later"), (42, 3, "user", None), (43, 9, "user", "only")]
    random.Random(2).shuffle(rows)
    turns = stream_of(spark, str(tmp_path / "turns"), [rows[:60], rows[60:61], rows[61:]], TURNS).withColumn("started", F.timestamp_seconds(F.col("conv_id") * 60 + 86_400))
    got = first_user_turns(turns, "started", "1 hour").collect()
    want = first_user_turn_flat(spark.createDataFrame(rows, TURNS)).select(got[0].__fields__).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_state_is_bounded_by_the_watermark(spark, tmp_path):
    """Conversations older than the watermark leave the state: 20 batches of an hour each keep a few hours' worth."""
    parts = [[(h * 10 + c, 1, "user", "x") for c in range(10)] for h in range(20)]
    turns = stream_of(spark, str(tmp_path / "turns"), parts, TURNS).withColumn("started", F.timestamp_seconds(F.floor(F.col("conv_id") / 10) * 3600 + 86_400))
    query = (first_user_turn_updates(turns, "started", "2 hours").writeStream.outputMode("update").format("noop")
             .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start())
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) <= 50 and kept[-1] <= 50


def test_running_rates_over_batches_equal_the_table(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.random() < 0.4) for i in range(2300)]
    schema = "seq long, event_type string, hit boolean"
    cuts = [0, 500, 501, 1499, 2300]
    parts = []
    for a, b in zip(cuts, cuts[1:]):
        part = rows[a:b]
        rng.shuffle(part)
        parts.append(part)
    for interval in (100, 7):
        got = run_running_rates(stream_of(spark, str(tmp_path / f"log{interval}"), parts, schema), "event_type", interval).collect()
        want = []
        for stream in ("a", "b", None):
            hits = [h for _, e, h in rows if e == stream]
            want += [(stream, n, round(sum(hits[:n]) / n, 6)) for n in range(1, len(hits) + 1) if n % interval == 0 or n == len(hits)]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    table = R.cumulative_hit_rate(spark.createDataFrame([r for r in rows if r[1]], schema), "event_type", 7)
    assert {tuple(r) for r in table.collect()} == {tuple(r) for r in got if r[0]}


def test_sketches_of_parts_merge(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("part"), (F.col("id") % 20_011).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("b"), F.lit(None).cast("string").alias("c"))
    columns = {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}
    sketches = K.distinct_sketches(df, F.col("part"), columns)
    exact = {r.column_name: r.n_exact for r in K.exact_counts(df, columns).collect()}
    assert exact == {"a": 20_011, "b": 30_000, "c": 0}
    for r in K.merged_counts(sketches).collect():
        assert r.n_rows == 60_000 and abs(r.n_distinct - exact[r.column_name]) <= 4 * K.ERROR * exact[r.column_name]
    whole = {r.column_name: r.n_distinct for r in K.merged_counts(K.distinct_sketches(df, F.lit("all"), columns)).collect()}
    merged = {r.column_name: r.n_distinct for r in K.merged_counts(sketches).collect()}
    assert all(abs(whole[c] - merged[c]) <= 2 * K.ERROR * max(1, exact[c]) for c in columns)  # no data is read again for a merge
