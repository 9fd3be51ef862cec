"""Query-text preparation (B1-B4, C1-C3): extract, count, filter, deduplicate, renumber."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cachelens.functions.text import strip_text, text_digest, token_count
from cachelens.operators.ordering import dense_ids
from cachelens.session import materialize


# ------------------------------------------------------------------------------ B1

def first_user_turn_flat(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Exploded turns -> one query per conversation: the first ``user`` turn, stripped.

    A conversation whose first user turn is blank, or without user turn, is dropped
    (later user turns are not tried). ``query_id`` / ``original_index`` keep the
    conversation position, gaps included. The first turn's number is aggregated (numbers
    only, combined map-side) and its text joined back, so a very long conversation does not
    pile texts in one task; turn numbers are unique in a conversation."""
    user = F.col(role_col) == "user"
    agg = conversations.groupBy(conv_col).agg(F.min(F.when(user, F.col(turn_col))).alias(turn_col),
                                              F.count(F.lit(1)).alias("num_turns"))
    texts = conversations.filter(user).select(conv_col, turn_col, F.col(text_col).alias("_text"))
    return (agg.join(texts, [conv_col, turn_col])
            .select(F.col(conv_col).cast("long").alias("query_id"),
                    strip_text(F.col("_text")).alias("query_text"),
                    F.col(conv_col).cast("long").alias("original_index"),
                    F.col("num_turns").cast("int").alias("num_turns"),
                    F.col(conv_col).cast("string").alias("conversation_id"))
            .filter(F.length("query_text") > 0))


def first_user_turn_nested(df: DataFrame, conv_col: str = "conversation", id_col: str = "row_id") -> DataFrame:
    """Nested form: ``conversation ARRAY<STRUCT<role, content>>`` per row."""
    first = F.get(F.filter(F.col(conv_col), lambda t: t["role"] == "user"), 0)
    out = df.select(
        F.col(id_col).cast("long").alias("query_id"),
        strip_text(first["content"]).alias("query_text"),
        F.col(id_col).cast("long").alias("original_index"),
        F.coalesce(F.col("model"), F.lit("unknown")).alias("model"),
        F.coalesce(F.col("language"), F.lit("unknown")).alias("language"),
        F.coalesce(F.col("turn"), F.lit(0)).cast("int").alias("num_turns"),
        F.coalesce(F.col("conversation_id"), F.lit("")).alias("conversation_id"),
    )
    return out.filter(F.col("query_text").isNotNull() & (F.length("query_text") > 0))


# ------------------------------------------------------------------------------ B2

def max_rows(df: DataFrame, n: int | None, order_col: str) -> DataFrame:
    """First ``n`` input rows (input order = ``order_col``); ``None`` keeps everything."""
    return df if n is None else df.orderBy(order_col).limit(n)


# ------------------------------------------------------------------------------ B3, B4

def with_token_count(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``token_count`` once per row: the generator keeps the optimiser from repeating the text
    scans in every filter and projection above."""
    return df.withColumn("token_count", F.explode(F.array(token_count(F.col(text_col)))))


def length_filter(df: DataFrame, text_col: str = "text", min_tokens: int = 3,
                  max_tokens: int = 512) -> DataFrame:
    """Drop blank/null texts (they have no tokens), keep ``min_tokens <= token_count <= max_tokens``."""
    return with_token_count(df, text_col).filter(F.col("token_count").between(max(1, min_tokens), max_tokens))


# ------------------------------------------------------------------------------ C1

def dedup_keys(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(<id_col>, _digest, frequency)`` of the first row in ``id_col`` order per distinct text.

    Grouped on a 256-bit digest with fixed-width buffers (a hash aggregation, combined
    map-side): a text repeated a billion times ships one short row per task and no text is
    sorted or shuffled. The digest stands for the text: no two texts are known to share one."""
    return df.groupBy(text_digest(F.col(text_col)).alias("_digest")).agg(
        F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("frequency"))


def dedup_exact(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per distinct text: the first row in ``id_col`` order, plus ``frequency``. The other
    columns are joined back by id (unique per row)."""
    first = dedup_keys(df, text_col, id_col).select(F.col(id_col).alias("_first"), "frequency")
    return df.join(first, F.col(id_col).eqNullSafe(F.col("_first"))).drop("_first")


# ------------------------------------------------------------------------------ C2, C3

def renumber(df: DataFrame, order_col: str, out_col: str = "query_id") -> DataFrame:
    """Dense ids 0..n-1 in ``order_col`` order (range-partitioned, no global window)."""
    return dense_ids(df, [order_col], out_col=out_col)


def preprocess(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_tokens: int = 3,
               max_tokens: int = 512) -> DataFrame:
    """B4 -> C1 -> C2: the surviving rows of ``df`` with ``token_count``, ``frequency`` and
    ``query_id``. The texts are read once for the keys; these are written, numbered, and only
    then joined to the other columns."""
    narrow = length_filter(df.select(id_col, text_col), text_col, min_tokens, max_tokens) \
        .select(id_col, "token_count", text_digest(F.col(text_col)).alias("_digest"))
    first = narrow.groupBy("_digest", "token_count").agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("frequency"))
    keys = materialize(first.select(id_col, "token_count", "frequency"), "kept-ids")
    others = [c for c in df.columns if c != id_col]
    return renumber(keys, id_col).join(df.select(id_col, *others), id_col)
