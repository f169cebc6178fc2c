"""Small documents with every odd case, and plain Python versions of what operators count."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def odd_rows():
    """Nulls, empty, blank, very long, repeated rows, ties, other scripts."""
    long_ = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
    base = " ".join(f"term{i}" for i in range(60))
    return [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 4), (4, "one", "en", "b", 3), (5, base, "en", "b", len(base)),
        (6, base, "en", "c", len(base)), (7, base + " tail", "fr", None, 1), (8, long_, "en", "a", len(long_)), (9, "Ünï cødé 日本語 text\nwith lines\nwith lines", None, "a", 9),
        (10, base, "en", "b", 1), (10, base, "en", "b", 1), (11, "# * $ % & | < >  double  spaces \x0b end", "de", "é", 2),
        (12, "spam spam spam " * 40, "en", "a", 3), (None, "a row without id but with some words in it", "en", "a", 4),
    ]


def frame(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)


def clashing(df):
    """Columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = ("hash", "bucket", "items", "at", "n", "row_no", "copies", "copy", "rank", "size", "key", "kept", "component_id", "th", "gone")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
