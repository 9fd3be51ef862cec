"""Deterministic pseudo-random draws that depend only on (seed, salt, row id).

A draw is ``u = first 52 bits of md5("seed:salt:id") / 2^52``, all that a double below 1 holds
without rounding, so every row of a table of up to 2^52 rows can be drawn; Spark and DuckDB compute the
same value, so sampled rows are reproducible across engines and across re-executions of
a lost task (no stateful RNG lives in any executor).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


DRAW_DIGITS = 13


def _key(seed, salt, id_col) -> Column:
    parts = [F.lit(str(seed))]
    if salt is not None and salt != "":
        parts += [F.lit(":"), F.lit(str(salt))]
    parts += [F.lit(":"), F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")]
    return F.concat(*parts)


def md5_order_key(seed, salt, id_col) -> Column:
    """Hex md5 of ``seed:salt:id``: a random but reproducible sort key (ties broken by id)."""
    return F.md5(_key(seed, salt, id_col))


def uniform_draw(seed, salt, id_col) -> Column:
    """Uniform double in [0, 1) from the first ``DRAW_DIGITS`` hex digits of the md5 key."""
    h = F.substring(md5_order_key(seed, salt, id_col), 1, DRAW_DIGITS)
    return F.conv(h, 16, 10).cast("double") / F.lit(16.0**DRAW_DIGITS)


def sql_md5_key(seed, salt, id_sql: str) -> str:
    """DuckDB / Spark SQL spelling of :func:`md5_order_key`."""
    prefix = f"{seed}:{salt}:" if salt not in (None, "") else f"{seed}:"
    return f"md5('{prefix}' || CAST({id_sql} AS VARCHAR))"


def sql_uniform(seed, salt, id_sql: str) -> str:
    """DuckDB spelling of :func:`uniform_draw`."""
    return f"(('0x' || substr({sql_md5_key(seed, salt, id_sql)}, 1, {DRAW_DIGITS}))::BIGINT / {16.0**DRAW_DIGITS!r})"
