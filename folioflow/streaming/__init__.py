"""Streaming forms of import and drafts: extensions, with the batch operators inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import MAX_UPLOAD
from ..plans.importing import External, import_files


def file_stream(spark: SparkSession, folder: str, glob: str = "*", per_trigger: int = 100) -> DataFrame:
    """Files as they arrive in a folder: (doc_id, name, content, mime, modificationTime); content is null above the size limit."""
    raw = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(folder)
    )
    return raw.select(F.xxhash64("path").alias("doc_id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.when(F.col("length") <= MAX_UPLOAD, F.col("content")).alias("content"), F.lit(None).cast("string").alias("mime"), "modificationTime")


def first_copies(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """One of the files with equal content within ``delay``; state is bounded by the watermark."""
    hashed = files.withColumn("content_hash", F.sha2("content", 256))
    return hashed.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["content_hash"])


def import_stream(files: DataFrame, external: External | None = None) -> DataFrame:
    return import_files(files, external)


def draft_sessions(writes: DataFrame, key: str, ts: str, gap: str = "600 milliseconds", delay: str = "10 minutes") -> DataFrame:
    """(key, start, end, n_writes): a draft is saved when ``gap`` has passed without another write."""
    w = F.session_window(ts, gap)
    out = writes.withWatermark(ts, delay).groupBy(key, w).agg(F.count(F.lit(1)).alias("n_writes"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_writes")
