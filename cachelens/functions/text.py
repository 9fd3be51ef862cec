"""Text column expressions: whitespace handling, token counts, model families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode-aware whitespace, like Python's str.split()/str.strip().
_WS = r"(?U)\s+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_text(c) -> Column:
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def is_blank(c) -> Column:
    """True for null, empty or whitespace-only text (one regex find, stops at the first
    non-space character)."""
    return _c(c).isNull() | ~_c(c).rlike(r"(?U)\S")


def token_count(c) -> Column:
    """Whitespace word count (``len(text.split())``): every non-space run becomes one
    character, the spaces go, and the length is left; no token array; null or blank -> 0."""
    marks = F.regexp_replace(F.regexp_replace(_c(c), r"(?U)\S+", "x"), r"(?U)\s+", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("int")


def text_digest(c) -> Column:
    """SHA-256 of a text as 32 bytes (null stays null): a fixed-width key for equal texts."""
    return F.unhex(F.sha2(_c(c), 256))


# Model-family rules, tested in this order on the lower-cased name.
MODEL_FAMILY_RULES = [
    (("vicuna",), "Vicuna"),
    (("llama",), "LLaMA"),
    (("alpaca",), "Alpaca"),
    (("chatglm",), "ChatGLM"),
    (("koala",), "Koala"),
    (("oasst", "pythia"), "OpenAssistant"),
    (("dolly",), "Dolly"),
    (("fastchat", "t5"), "FastChat-T5"),
    (("gpt",), "GPT"),
    (("palm", "bard"), "PaLM/Bard"),
    (("claude",), "Claude"),
    (("mpt",), "MPT"),
    (("stablelm",), "StableLM"),
    (("guanaco",), "Guanaco"),
]
MODEL_FAMILY_OTHER = "Other"


def model_family(c) -> Column:
    low = F.lower(_c(c))
    expr = None
    for needles, family in MODEL_FAMILY_RULES:
        cond = None
        for n in needles:
            test = low.contains(n)
            cond = test if cond is None else (cond | test)
        expr = F.when(cond, F.lit(family)) if expr is None else expr.when(cond, F.lit(family))
    return expr.otherwise(F.lit(MODEL_FAMILY_OTHER))


def sql_model_family(col: str) -> str:
    parts = []
    for needles, family in MODEL_FAMILY_RULES:
        cond = " OR ".join(f"contains(lower({col}), '{n}')" for n in needles)
        parts.append(f"WHEN {cond} THEN '{family}'")
    return "CASE " + " ".join(parts) + f" ELSE '{MODEL_FAMILY_OTHER}' END"
