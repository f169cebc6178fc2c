"""What the operators share: words in SQL, tables in the shared folder, skew-safe prefix sums."""

from __future__ import annotations

import atexit
import gc
import os
import re
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a longest run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session on this
    machine alone (master local) gets a folder of its own; on a cluster that is an error, as no local folder is shared."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", f"folioflow-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", given)
    return given


def shared_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, its lineage ends here,
    and it outlives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*cuts: DataFrame) -> None:
    """Delete tables made by :func:`cut` that no later result reads."""
    for df in cuts:
        if path := getattr(df, "_cut_path", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written[:] = [x for x in _written if x[1] != path]


@contextmanager
def small_batches(spark: SparkSession, megabytes: int = 4):
    """What is written meanwhile goes to Python in Arrow batches of so many bytes (or one longer row),
    of which a worker and its executor hold a batch or two each, however many rows that is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(megabytes << 20))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of tables that are written down and no longer referred to: it
    does so when the driver's garbage is collected, which a long step may not wait for."""
    for _ in range(2):  # Python's references go first
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


@atexit.register
def _clean() -> None:
    for spark, path in list(_written):
        try:
            remove(spark, path)
        except Exception:  # the session may be gone at exit
            return


def n_words(text: Column) -> Column:
    """Number of words. Each word, with the blanks behind it, becomes one character; no array of words is made."""
    begun = F.ltrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.length(F.regexp_replace(begun, WORD + r"+[\x20\x09-\x0D]*+", "x")).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name, one that no column of ``df`` has (columns compare without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered_prefix(
    df: DataFrame, keys: list[str], order: list[Column], values: dict[str, str], rank: str = "rank"
) -> DataFrame:
    """Rows of ``df`` with ``rank`` (from 0) and exclusive running sums ``values`` (new name: column)
    within ``keys``, in ``order``, which should be total up to equal rows.

    No key meets in one task: rows are dealt in ranges of (keys, order), which split a hot key, the
    dealing is written down, ranks are counted within a range, and the totals of the ranges before
    (as many rows as ranges, or keys) are added.
    """
    n = shuffle_partitions(df.sparkSession)
    dealt = cut(
        df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_pid", F.spark_partition_id()), "ranges"
    )
    # null keys are keys too: joined by a null-safe comparison
    totals = dealt.groupBy("_pid", *keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{new}") for new, c in values.items()]
    )
    before = (
        Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        if keys
        else Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = totals.select(
        F.col("_pid").alias("_p"),
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_s_{new}") for new in values],
    )
    within = Window.partitionBy("_pid", *keys).orderBy(*order)
    running = within.rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select(
        "*",
        (F.row_number().over(within) - 1).alias("_r"),
        *[F.coalesce(F.sum(c).over(running), F.lit(0)).alias(f"_v_{new}") for new, c in values.items()],
    )
    on = F.col("_pid") == F.col("_p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return local.join(starts, on).select(
        *df.columns,
        (F.col("_r") + F.col("_n0")).cast("long").alias(rank),
        *[(F.col(f"_v_{new}") + F.col(f"_s_{new}")).alias(new) for new in values],
    )
