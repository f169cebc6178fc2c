"""Order-dependent logic: greedy batches, runs, first matches, debounce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import BATCH_CHARS, BATCH_ITEMS


class Filling:
    """Numbers of batches that items fill in order: a batch is full when it has ``count`` items, or when it
    has something in it and the next item would take its size above ``most``. Something is an item, or, where ``sized``,
    an item with a size."""

    def __init__(self, most: int, count: int | None, sized: bool = False):
        self.most, self.count, self.sized = most, count, sized
        self.restart()

    def restart(self) -> None:
        self.batch = self.held = self.total = 0

    def place(self, size: float) -> int:
        begun = self.total > 0 if self.sized else self.held > 0
        if (self.count is not None and self.held >= self.count) or (begun and self.total + size > self.most):
            self.batch, self.held, self.total = self.batch + 1, 0, 0
        self.held, self.total = self.held + 1, self.total + size
        return self.batch


def greedy_batches(
    items: DataFrame, keys: list[str], order: list[str], size: str, most: int = BATCH_CHARS, count: int | None = BATCH_ITEMS, out: str = "batch_id", sized: bool = False
) -> DataFrame:
    """Adds ``out``: items of a key in order fill a batch until it has ``count`` items or the next would
    take its size above ``most``; an item larger than that has a batch of its own (:class:`Filling`).

    The sum starts again at each batch, which no window frame can say. One state per key is folded over
    the key's rows in order, in one shuffle whose rows stream through Python in Arrow batches; columns are passed on as they are.
    Null keys are a key, rows with equal keys and order stay rows of their own, a null size counts 0.
    """
    schema = items.schema
    names = [f.name for f in schema]

    def fold(batches):
        import pyarrow as pa

        now, state = None, Filling(most, count, sized)
        for rb in batches:
            ids = []
            cols = [rb.column(names.index(c)).to_pylist() for c in (*keys, size)]
            for *key, n in zip(*cols, strict=True):
                if key != now:
                    now = key
                    state.restart()
                ids.append(state.place(n or 0))
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(ids, pa.int64())], [*names, out])

    import pyspark.sql.types as T

    dealt = items.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(fold, T.StructType([*schema.fields, T.StructField(out, T.LongType())]))


def islands(rows: DataFrame, keys: list[str], order: list[str], kind: Column, out: str = "run_id") -> DataFrame:
    """Adds ``out``: number of the run of equal ``kind`` (nulls equal too) that a row belongs to, from 1 in its key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.row_number().over(w) == 1, 1).otherwise((~kind.eqNullSafe(F.lag(kind).over(w))).cast("int"))
    return rows.withColumn("_new", new).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def first_match(rows: DataFrame, keys: list[str], order: list[str], test: Column, out: str = "is_first") -> DataFrame:
    """Adds ``out``: whether the row is the first of its key for which ``test`` holds."""
    ok = F.coalesce(test, F.lit(False))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, ok & (F.coalesce(F.max(ok.cast("int")).over(w), F.lit(0)) == 0))


def fenced(lines: DataFrame, keys: list[str], order: list[str], text: str = "line") -> DataFrame:
    """Adds ``in_fence``: between ``` lines, themselves included; an open fence takes all that follows."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.col(text).startswith("```")
    n = F.sum(mark.cast("int")).over(w)
    return lines.withColumn("in_fence", mark | (n % 2 == 1))


def debounced(events: DataFrame, keys: list[str], ts: str, tie: str, millis: int = 600) -> DataFrame:
    """The events that no other of their key follows within ``millis``: what a trailing timer fires for."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = micros(F.lead(ts).over(w)) - micros(F.col(ts))
    return events.withColumn("_gap", gap).filter(F.col("_gap").isNull() | (F.col("_gap") > millis * 1000)).drop("_gap")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: an aggregate, whose map side leaves one row a key and task."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    return best.select("_r.*")
