"""Sharding by a two-pass external shuffle. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, shared_path

SHARDS, SEED = 40, 20240607
#: Rows of one key that share a bucket.
EQUAL_ROWS = 4096


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def bucket_size(spark) -> int:
    """Bytes of a bucket: 1/256 of a task's share of an executor's memory, 4 to 64 MB. A bucket is held as objects,
    sorted, shuffled and written at once, by each of an executor's tasks, beside what they fetch."""
    memory = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.executor.memory", "1g"))
    return min(64 << 20, max(4 << 20, memory // int(spark.conf.get("spark.executor.cores", "1")) // 256))


def two_pass_shuffle(
    rows: DataFrame, size: Column, key: list[Column], shards: int = SHARDS, seed: int = SEED, bucket_bytes: int | None = None
) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard); where columns of these names are
    there, ours have underscores before them.

    Pass one scatters whole rows over buckets by a seeded hash of ``key``: it is an exchange, whose map tasks write a row into
    its bucket's part of their files, and there are as many buckets as keep a bucket near ``bucket_bytes`` (:func:`bucket_size`), and ``shards`` at
    least. Pass two takes a bucket a task, puts it in an order that depends only on its rows, applies a
    Fisher-Yates shuffle (``shuffle`` with a seed) in memory, and lays buckets one after
    another; that order is cut into shards whose counts differ by one at most. So the permutation is a function of seed, bucket
    and rows: lost tasks and reruns repeat it.

    Rows equal in ``key`` share a bucket unless there are more than EQUAL_ROWS: then they are dealt over as many more
    buckets by their place in the input, so no bucket outgrows memory. Null keys are keys like others; an empty table gives no rows.
    """
    h, bucket, items, at, n_col, share = fresh(rows, "hash", "bucket", "items", "at", "n", "share")
    shard, slot = fresh(rows, "shard", "slot")
    hashed = rows.withColumn(h, F.xxhash64(F.lit(seed), *key))
    hot = hashed.groupBy(h).agg(F.ceil(F.count(F.lit(1)) / EQUAL_ROWS).alias(share)).filter(F.col(share) > 1)
    if hot.head(1):
        place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(share))
        hashed = hashed.join(hot, h, "left").withColumn(h, F.when(F.col(share).isNull(), F.col(h)).otherwise(F.xxhash64(h, place))).drop(share)
        hashed = cut(hashed, "scatter")  # the places are drawn once
    total = rows.agg(F.sum(size).alias("b")).first()["b"] or 0
    buckets = max(shards, -(-int(total) // (bucket_bytes or bucket_size(rows.sparkSession))))
    scattered = hashed.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed + 1), h), F.lit(buckets)).cast("int"))
    counts = scattered.groupBy(bucket).agg(F.count(F.lit(1)).alias(n_col))
    # one row a bucket: its first place in the whole order, and the number of rows in all
    before = Window.partitionBy(F.lit(0)).orderBy(bucket)
    starts = cut(counts.select(
        F.col(bucket).alias("_b"),
        (F.sum(n_col).over(before) - F.col(n_col)).alias("_start"),
        F.sum(n_col).over(Window.partitionBy(F.lit(0))).alias("_all"),
    ), "starts")
    whole = F.struct(F.col(h), *[F.col(f"`{c}`") for c in rows.columns])
    ordered = F.array_sort(F.collect_list(whole)) if _sortable(rows) else F.array_sort(F.collect_list(whole), _by_hash)
    gathered = (
        scattered.repartitionById(buckets, F.col(bucket))
        .groupBy(bucket)
        .agg(ordered.alias(items))
        .withColumn(items, F.shuffle(items, seed))
    )
    placed = gathered.select(bucket, F.posexplode(items).alias(at, "_row")).join(F.broadcast(starts), F.col(bucket) == F.col("_b"))
    base, extra = F.floor(F.col("_all") / F.lit(shards)), F.col("_all") % F.lit(shards)
    place = F.col("_start") + F.col(at)
    wide = extra * (base + 1)  # the first ``extra`` shards have one row more
    first = place < wide
    number = F.when(first, F.floor(place / (base + 1))).otherwise(extra + F.floor((place - wide) / F.greatest(base, F.lit(1))))
    within = F.when(first, place % (base + 1)).otherwise((place - wide) % F.greatest(base, F.lit(1)))
    return placed.select("_row.*", number.cast("int").alias(shard), within.cast("long").alias(slot)).drop(h)


def _by_hash(a: Column, b: Column) -> Column:
    """For rows with columns that have no order, such as maps."""
    x, y = a.getField(0), b.getField(0)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def _sortable(rows: DataFrame) -> bool:
    return not any("map<" in kind or kind == "variant" for _, kind in rows.dtypes)


def write_shards(rows: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int | None = None) -> None:
    """Write whole ``rows`` (doc_id, text, ...) as Parquet folders ``shard=0`` ... in slot order.

    A bucket holds consecutive slots of one shard or of neighbours, so its task writes them as they are and
    texts are shuffled once; the files of a folder are in slot order by name and within. Null ids and texts, repeated rows
    and empty tables are rows, or none, like others."""
    key = [F.col("doc_id"), F.xxhash64("text")]
    laid = two_pass_shuffle(rows, size_of(F.col("text")), key, shards, seed, bucket_bytes)
    shard, slot = laid.columns[-2:]
    laid.sortWithinPartitions(shard, slot).write.option("compression", "zstd").partitionBy(shard).parquet(path)


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of shard files: whole ``documents`` are shuffled and written by
    :func:`write_shards`, and the digest is taken from what is read back. Null text: size 16, crc32 of no
    bytes (0). Rows with one doc_id stay rows of their own; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = shared_path(spark, "shards")
    write_shards(docs, path)
    written = spark.read.schema(T.StructType([*docs.schema, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])).parquet(path)
    return written.select(
        "doc_id",
        size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
