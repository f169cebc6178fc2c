"""Tables that results, failures and drafts go to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import DRAFT_CHARS
from ..functions.text import utf16_length, visible
from ..operators.runs import latest


def write_imported(imported: DataFrame, folder: str) -> None:
    """Good rows to ``<folder>/documents``, others to ``<folder>/quarantine``, partitioned by kind."""
    ok = F.col("status") == "ok"
    for name, part in (("documents", imported.filter(ok)), ("quarantine", imported.filter(~ok))):
        part.write.mode("append").partitionBy("kind").parquet(f"{folder}/{name}")


def drafts_to_keep(writes: DataFrame) -> DataFrame:
    """The last write (key, src, ja, en, t) of each key, unless its texts are too long together or
    nothing can be seen in its source."""
    last = latest(writes, ["key"], [F.col("t")])
    size = sum((F.coalesce(utf16_length(F.col(c)), F.lit(0)) for c in ("ja", "en")), F.coalesce(utf16_length(F.col("src")), F.lit(0)))
    return last.filter((size <= DRAFT_CHARS) & visible(F.coalesce("src", F.lit(""))))


def last_errors(log: DataFrame, n: int = 20) -> DataFrame:
    """The newest ``n`` rows of an error log (ts, id, stack), with four lines of their stack."""
    lines = F.array_join(F.slice(F.split("stack", "\n"), 1, 4), "\n")
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(n).withColumn("stack", lines)
