import numpy as np
from pyspark.sql import functions as F

from cachelens.functions.text import model_family
from cachelens.operators import text as X
from cachelens.operators.ordering import dense_ids, previous_value, running_sum


def _queries(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, query_text string")


def test_blank_filter(spark):
    df = _queries(spark, ["valid query here", "", "   ", "another valid one", None])
    out = X.length_filter(df, "query_text", 1, 100)
    assert sorted(r.query_id for r in out.collect()) == [0, 3]


def test_length_filter_bounds(spark):
    df = _queries(spark, ["hi", "this is a valid query", "a " * 600, "one two three", "\tone  two\nthree "])
    out = {r.query_id: r.token_count for r in X.length_filter(df, "query_text", 3, 512).collect()}
    assert out == {1: 5, 3: 3, 4: 3}


def test_token_count_matches_python_split(spark):
    texts = ["  a  b\tc\n", "", "x", "é ü  ß", "one two"]
    df = _queries(spark, texts)
    got = {r.query_id: r.token_count for r in X.with_token_count(df, "query_text").collect()}
    assert got == {i: len(t.split()) for i, t in enumerate(texts)}


def test_dedup_keeps_first_and_counts(spark):
    df = _queries(spark, ["hello", "world", "hello", "hello"])
    out = {r.query_text: (r.query_id, r.frequency) for r in X.dedup_exact(df, "query_text", "query_id").collect()}
    assert out == {"hello": (0, 3), "world": (1, 1)}


def test_preprocess_renumbers_dense(spark):
    df = _queries(spark, ["a b c", "x", "a b c", "d e f g", "h i j"])
    out = X.preprocess(df.withColumnRenamed("query_id", "doc_id"), "query_text", "doc_id").orderBy("query_id").collect()
    assert [r.query_id for r in out] == [0, 1, 2]
    assert [r.doc_id for r in out] == [0, 3, 4]
    assert out[0].frequency == 2


def test_first_user_turn_nested_rules(spark):
    rows = [
        (0, [("system", "be nice"), ("user", "  first question "), ("user", "second")], "vicuna-13b", "English", 3, "a"),
        (1, [], "m", "English", 0, "b"),
        (2, [("assistant", "hi")], "m", "English", 1, "c"),
        (3, [("user", "   "), ("user", "later non blank")], "m", "English", 2, "d"),
    ]
    schema = ("row_id long, conversation array<struct<role:string,content:string>>, model string, "
              "language string, turn int, conversation_id string")
    out = X.first_user_turn_nested(spark.createDataFrame(rows, schema)).collect()
    assert [(r.query_id, r.query_text) for r in out] == [(0, "first question")]


def test_first_user_turn_flat(spark):
    rows = [(0, 0, "system", "s"), (0, 1, "user", " q0 "), (0, 2, "user", "later"),
            (1, 0, "user", "  "), (1, 1, "user", "not tried"), (2, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = X.first_user_turn_flat(df).collect()
    assert [(r.query_id, r.query_text, r.num_turns) for r in out] == [(0, "q0", 3)]


def test_model_family_order(spark):
    names = ["vicuna-13b", "llama-2-7b", "gpt-4", "pythia-12b", "unknown", "vicuna-llama", "flan-t5"]
    df = spark.createDataFrame([(n,) for n in names], "model string")
    got = [r.f for r in df.select(model_family(F.col("model")).alias("f")).collect()]
    assert got == ["Vicuna", "LLaMA", "GPT", "OpenAssistant", "Other", "Vicuna", "FastChat-T5"]


def test_dense_ids_global_and_grouped_with_hot_group(spark):
    rng = np.random.default_rng(0)
    n = 3000
    groups = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 50, n))  # one group holds a third
    ids = rng.permutation(n)
    df = spark.createDataFrame([(int(i), int(g)) for i, g in zip(ids, groups)], "id long, g long")
    flat = {r.id: r.rn for r in dense_ids(df, ["id"], "rn", num_partitions=7).collect()}
    assert flat == {i: i for i in range(n)}
    grouped = dense_ids(df, ["id"], "rn", num_partitions=7, partition_by=["g"]).toPandas()
    exp = grouped.sort_values("id").groupby("g").cumcount()
    assert (grouped.sort_values("id")["rn"].values == exp.values).all()


def test_running_sum_and_previous_value(spark):
    rng = np.random.default_rng(1)
    n = 2000
    g = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 5, n))
    v = rng.integers(0, 10, n)
    df = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(g, v))], "seq long, g long, v long")
    rs = running_sum(df, ["seq"], "v", "cum", partition_by=["g"], num_partitions=5).toPandas().sort_values("seq")
    exp = rs.groupby("g")["v"].cumsum() - rs["v"]
    assert (rs["cum"].values == exp.values).all()
    mx = running_sum(df, ["seq"], "v", "pm", agg="max", num_partitions=5).toPandas().sort_values("seq")
    exp_mx = mx["v"].cummax().shift(1)
    assert np.allclose(mx["pm"].values[1:], exp_mx.values[1:]) and np.isnan(mx["pm"].values[0])
    pv = previous_value(df, ["g"], ["seq"], "seq", "prev", num_partitions=5).toPandas().sort_values("seq")
    exp_p = pv.groupby("g")["seq"].shift(1)
    assert np.array_equal(pv["prev"].fillna(-1).values, exp_p.fillna(-1).values)
