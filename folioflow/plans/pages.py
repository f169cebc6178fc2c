"""Web pages to translated segments, by expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import DEMO_TAGS, SKIP_TAGS
from ..functions import text as X
from ..operators.runs import greedy_batches

_BODY = r"(?is)<body[^>]*>(.*?)</body>"


def body(html: Column) -> Column:
    """What the first body element holds, or the whole text without one that is closed."""
    return F.when(html.rlike(_BODY), F.regexp_extract(html, _BODY, 1)).otherwise(html)


def styles(html: Column) -> Column:
    return F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<style[^>]*>(.*?)</style>"), F.lit(1)), "\n")


def imported_html(html: Column) -> Column:
    """An HTML file as imported: its style elements' text in one element, then its body."""
    css = styles(html)
    return F.concat(F.when(css != "", F.concat(F.lit("<style>"), css, F.lit("</style>"))).otherwise(F.lit("")), body(html))


def segments(pages: DataFrame) -> DataFrame:
    """(page_id, idx, text): text between tags outside style, script, code and pre, that is to be translated."""
    text = F.regexp_replace(body(F.col("html")), "(?is)<!--.*?-->", "")
    for tag in SKIP_TAGS:
        text = F.regexp_replace(text, f"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    parts = pages.select("page_id", F.posexplode(F.split(text, "<[^>]*>")).alias("idx", "text"))
    parts = parts.filter(F.col("text").rlike(r"\S") & ~X.not_translatable(F.col("text")))
    return parts.select("page_id", (F.col("idx") + 1).cast("long").alias("idx"), "text")


def translate_segments(parts: DataFrame, target: str) -> DataFrame:
    """Adds batch_id and ``raw``, the translation with the source's blanks before it is escaped."""
    batched = greedy_batches(parts.withColumn("n", X.utf16_length(F.col("text"))), ["page_id"], ["idx"], "n").drop("n")
    return batched.withColumn("raw", F.concat(F.lit(DEMO_TAGS[target]), "text"))
