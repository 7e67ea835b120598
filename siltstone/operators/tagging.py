"""Content tags from counts of marks and keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalars import keyword_hits
from siltstone.operators import rules as R

TAGS = ("receipt", "code", "chat", "transient_ui", "document")


def word_count(text: Column) -> Column:
    """Words split by white space."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def scores(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns with one score for each tag; blank texts score 0 everywhere."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.withColumn("_t", t).withColumn("_l", F.lower("_t")).withColumn("_w", word_count(F.col("_t")))
    rows = rows.withColumn("_lines", F.filter(F.split("_t", r"\r\n|[\n\r]"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")) != ""))
    text, low, words, lines = F.col("_t"), F.col("_l"), F.col("_w"), F.col("_lines")
    n = lambda regex: F.regexp_count(text, F.lit(regex))
    symbols = n(r"[{}();=<>]")
    short = F.size(F.filter(lines, lambda x: word_count(x) <= 8))
    found = {
        "receipt": n(r"[$€£]\s?\d+[.,]\d{2}\b") * 1.5 + keyword_hits(low, R.RECEIPT_KEYWORDS),
        "code": symbols * 0.3 + keyword_hits(low, R.CODE_KEYWORDS) * 1.5 + F.when((words > 0) & (symbols / F.greatest(words, F.lit(1)) > 0.15), 2.0).otherwise(0.0),
        "chat": n(r"\b\d{1,2}:\d{2}\s?(?:AM|PM|am|pm)?\b") * 1.0 + keyword_hits(low, R.CHAT_KEYWORDS) * 1.5 + F.when((F.size(lines) >= 3) & (short / F.size(lines) > 0.6), 1.5).otherwise(0.0),
        "transient_ui": keyword_hits(low, R.TRANSIENT_KEYWORDS) * 2.0 + F.when((words > 0) & (words <= 8), 1.0).when(words <= 15, 0.5).otherwise(0.0),
        "document": keyword_hits(low, R.DOCUMENT_KEYWORDS) * 1.0 + F.when((words >= 25) & (n(r"[.!?]\s|[.!?]$") >= 2), 1.5).otherwise(0.0),
    }
    blank = words == 0
    out = rows.select(*df.columns, *(F.when(blank, F.lit(0.0)).otherwise(s.cast("double")).alias(f"score_{k}") for k, s in found.items()))
    return out


def tagged(df: DataFrame, text_col: str = "text", least: float = R.LEAST_TAG_SCORE) -> DataFrame:
    """The columns with tag and score: the best, the first of the order on ties; unknown below the least."""
    s = scores(df, text_col)
    best = F.greatest(*(F.col(f"score_{k}") for k in TAGS))
    tag = F.when(best < least, "unknown")
    for k in TAGS:
        tag = tag.when(F.col(f"score_{k}") == best, k)
    return s.select(*df.columns, tag.alias("tag"), best.alias("tag_score"))
