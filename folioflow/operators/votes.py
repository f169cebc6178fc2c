"""Votes, ratios and other reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import MOST_WARNINGS, RETRYABLE


def majority_color(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r, g, b, votes) of samples (keys, ord, r, g, b): score votes * 1000 + r + g + b, the
    earlier of equals. Two aggregations with map-side combine."""
    counted = samples.groupBy(*keys, "r", "g", "b").agg(F.count(F.lit(1)).alias("votes"), F.min("ord").alias("first"))
    score = F.col("votes") * 1000 + F.col("r") + F.col("g") + F.col("b")
    best = counted.groupBy(*keys).agg(F.max_by(F.struct("r", "g", "b", "votes"), F.struct(score, -F.col("first"))).alias("w"))
    return best.select(*keys, "w.*")


def contrast_color(samples: DataFrame, keys: list[str], dark: int = 17, least: int = 90) -> DataFrame:
    """(keys, r, g, b): of samples (keys, step, r, g, b, br, bg, bb), the colour farthest from the
    ground (br, bg, bb), the earlier of equals, if farther than ``least``; else near-black, or white on a dark ground."""
    away = F.abs(F.col("r") - F.col("br")) + F.abs(F.col("g") - F.col("bg")) + F.abs(F.col("b") - F.col("bb"))
    best = samples.groupBy(*keys).agg(
        F.max_by(F.struct("r", "g", "b"), F.struct(away, -F.col("step"))).alias("w"), F.max(away).alias("d"),
        F.max(F.abs(F.lit(dark) - F.col("br")) + F.abs(F.lit(dark) - F.col("bg")) + F.abs(F.lit(dark) - F.col("bb"))).alias("k"),
    )
    pick = lambda c: F.when(F.col("d") > least, F.col(f"w.{c}")).when(F.col("k") > least, dark).otherwise(255)
    return best.select(*keys, *[pick(c).alias(c) for c in "rgb"])


def cyrillic_share(bytes_: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, codepage) of rows (keys, b): windows-1251 if at least half of the bytes from 0x80 on are
    at or above 0xC0, or 0xA8 or 0xB8; else windows-1252."""
    high = F.col("b") >= 0x80
    hit = high & ((F.col("b") >= 0xC0) | F.col("b").isin(0xA8, 0xB8))
    most = (F.count_if(high) > 0) & (2 * F.count_if(hit) >= F.count_if(high))
    return bytes_.groupBy(*keys).agg(F.when(most, "windows-1251").otherwise("windows-1252").alias("codepage"))


def warning_list(counts: list[tuple[str, str]]):
    """Array of ``code:count`` for counters above 0, in the given order, as a column."""
    return F.filter(F.array(*[F.when(F.col(c) > 0, F.concat(F.lit(f"{code}:"), F.col(c).cast("string"))) for code, c in counts]), lambda x: x.isNotNull())


def batch_outcome(batches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_batches, n_failed, doc_failed, first_error) of rows (keys, batch_id, failed, error): a document
    fails when all its batches did; else failed batches keep their source text."""
    n, bad = F.count(F.lit(1)), F.count_if("failed")
    return batches.groupBy(*keys).agg(
        n.alias("n_batches"), bad.alias("n_failed"), (n == bad).alias("doc_failed"), F.min_by("error", F.when(F.col("failed"), F.col("batch_id"))).alias("first_error")
    )


def warnings_of(messages: Column) -> Column:
    """Messages (type, message) of type warning."""
    return F.transform(F.filter(messages, lambda m: m["type"] == "warning"), lambda m: m["message"])


def first_warnings(warnings: Column) -> Column:
    return F.slice(warnings, 1, MOST_WARNINGS)


def retryable(status: Column) -> Column:
    """Whether an answer of a service says that it may work later."""
    return F.coalesce(status.isin(*RETRYABLE), F.lit(False))
