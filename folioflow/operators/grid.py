"""Spreadsheet grids as relations: cells, rows, columns, merges, anchors.

Sheets are keyed by the columns ``sheet``; all windows are partitioned by sheet and axis, whose
lengths the format limits (5000 rows, 256 columns), so no partition is unbounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import MAX_COLS, MAX_ROWS
from ..functions.text import trim


def merge_cells(merges: DataFrame, sheet: list[str]) -> DataFrame:
    """Every cell of every merge (r1, c1, r2, c2, ord): (sheet, ord, row, col, is_anchor)."""
    rows = F.explode(F.sequence("r1", F.least("r2", F.lit(MAX_ROWS - 1))))
    cols = F.explode(F.sequence("c1", F.least("c2", F.lit(MAX_COLS - 1))))
    grid = merges.filter(f"r1 <= r2 and c1 <= c2 and r1 < {MAX_ROWS} and c1 < {MAX_COLS}")
    return (
        grid.withColumn("row", rows).withColumn("col", cols)
        .select(*sheet, "ord", "row", "col", ((F.col("row") == F.col("r1")) & (F.col("col") == F.col("c1"))).alias("is_anchor"))
    )


def uncovered(cells: DataFrame, merges: DataFrame, sheet: list[str]) -> DataFrame:
    """Cells that no merge hides: all but the merged ones that aren't a merge's top left."""
    hidden = merge_cells(merges, sheet).filter("not is_anchor").select(*sheet, "row", "col").distinct()
    return cells.join(hidden, [*sheet, "row", "col"], "left_anti")


def anchor_merge(anchors: DataFrame, merges: DataFrame, sheet: list[str]) -> DataFrame:
    """Adds ``merge_ord``: of the merges that hold the anchor's cell (row, col), the first; else null.
    Merges are exploded to cells, so it is an equi-join and not a nested loop over boxes."""
    first = merge_cells(merges, sheet).groupBy(*sheet, "row", "col").agg(F.min("ord").alias("merge_ord"))
    return anchors.join(first, [*sheet, "row", "col"], "left")


def nearest_visible(axis: DataFrame, sheet: list[str]) -> DataFrame:
    """(sheet, i, visible): for each line i the next visible one from it on, else the last before, else 0."""
    shown = F.when(~F.col("hidden"), F.col("i"))
    order = Window.partitionBy(*sheet).orderBy("i")
    on = F.min(shown).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    before = F.max(shown).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return axis.select(*sheet, "i", F.coalesce(on, before, F.lit(0)).cast("long").alias("visible"))


def offsets(axis: DataFrame, sheet: list[str]) -> DataFrame:
    """Adds ``start``: pixels of the visible lines before."""
    px = F.when(F.col("hidden"), 0).otherwise(F.col("px"))
    before = Window.partitionBy(*sheet).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return axis.withColumn("start", F.coalesce(F.sum(px).over(before), F.lit(0)).cast("long"))


def locate(points: DataFrame, axis: DataFrame, sheet: list[str], at: str, out: str) -> DataFrame:
    """Adds ``out``: the last line whose start is at or before the pixel ``at``; else 0.

    An as-of join as one window: points and starts are merged in order of pixels and each point
    takes the last line before it, so no range of pairs is made."""
    starts = offsets(axis, sheet).select(*sheet, F.col("start").alias("_px"), F.col("i").alias("_line"), F.lit(0).alias("_kind"))
    keyed = points.withColumn("_row", F.struct(*points.columns))
    asked = keyed.select(*sheet, F.col(at).alias("_px"), F.lit(None).cast("long").alias("_line"), F.lit(1).alias("_kind"), "_row")
    both = starts.withColumn("_line", F.col("_line").cast("long")).unionByName(asked, allowMissingColumns=True)
    last = Window.partitionBy(*sheet).orderBy("_px", "_kind", F.col("_line").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_found", F.max("_line").over(last)).filter("_kind = 1").select("_row.*", F.coalesce("_found", F.lit(0)).cast("long").alias(out))


def used_range(sources: list[DataFrame], sheet: list[str]) -> DataFrame:
    """(sheet, rows, cols): extent over tables of (sheet, row, col), clipped to the limits."""
    every = sources[0].select(*sheet, "row", "col")
    for s in sources[1:]:
        every = every.unionByName(s.select(*sheet, "row", "col"))
    return every.groupBy(*sheet).agg(
        F.least(F.max("row"), F.lit(MAX_ROWS - 1)).cast("long").alias("last_row"), F.least(F.max("col"), F.lit(MAX_COLS - 1)).cast("long").alias("last_col")
    )


def trimmed_range(cells: DataFrame, extents: DataFrame, sheet: list[str]) -> DataFrame:
    """(sheet, last_row, last_col, trimmed): last row and column with a value that isn't blank, extended by
    ``extents`` (sheet, row, col, absolute); an absolute extent forbids trimming. No content: nulls."""
    v = trim(F.coalesce("value", F.lit(""))) != ""
    a = cells.select(*sheet, F.when(v, F.col("row")).alias("row"), F.when(v, F.col("col")).alias("col"), F.col("row").alias("all_row"), F.col("col").alias("all_col"), F.lit(False).alias("absolute"))
    b = extents.select(*sheet, "row", "col", F.col("row").alias("all_row"), F.col("col").alias("all_col"), "absolute")
    g = a.unionByName(b).groupBy(*sheet).agg(
        F.max("row").alias("r"), F.max("col").alias("c"), F.max("all_row").alias("ar"), F.max("all_col").alias("ac"), F.bool_or("absolute").alias("abs")
    )
    return g.select(*sheet, F.when(F.col("abs"), F.col("ar")).otherwise(F.col("r")).alias("last_row"), F.when(F.col("abs"), F.col("ac")).otherwise(F.col("c")).alias("last_col"), (~F.col("abs")).alias("trimmed"))


def spans(merges: DataFrame, rows: DataFrame, cols: DataFrame, sheet: list[str]) -> DataFrame:
    """(sheet, ord, rowspan, colspan): visible rows and columns of each merge, 1 at least. Lines that the sheet doesn't describe are
    visible, so only hidden ones are looked up, by line."""
    m = merges
    for axis, a, b, limit in ((rows, "r1", "r2", MAX_ROWS), (cols, "c1", "c2", MAX_COLS)):
        end = F.least(F.col(b), F.lit(limit - 1))
        lines = merges.filter(F.col(a) <= end).select(*sheet, "ord", F.explode(F.sequence(F.col(a).cast("long"), end.cast("long"))).alias("i"))
        gone = lines.join(axis.filter("hidden").select(*sheet, F.col("i").cast("long").alias("i")), [*sheet, "i"]).groupBy(*sheet, "ord").agg(F.count(F.lit(1)).alias(f"_{a}"))
        m = m.join(gone, [*sheet, "ord"], "left").withColumn(f"_{a}", F.greatest(F.lit(1), end - F.col(a) + 1 - F.coalesce(f"_{a}", F.lit(0))).cast("long"))
    return m.select(*sheet, "ord", F.col("_r1").alias("rowspan"), F.col("_c1").alias("colspan"))


def full_grid(rows: DataFrame, cols: DataFrame, cells: DataFrame, sheet: list[str]) -> DataFrame:
    """Every visible row and column of a sheet with its cell's value or ''. Rows meet columns by
    sheet, within the format's limits."""
    shown = rows.filter("not hidden").select(*sheet, F.col("i").alias("row"))
    wide = cols.filter("not hidden").select(*sheet, F.col("i").alias("col"))
    return shown.join(wide, sheet).join(cells.select(*sheet, "row", "col", "value"), [*sheet, "row", "col"], "left").withColumn("value", F.coalesce("value", F.lit("")))


def style_of(xfs: DataFrame, fonts: DataFrame, fills: DataFrame, borders: DataFrame, book: list[str] | None = None) -> DataFrame:
    """A cell format with its font (default: the first, if there is one), fill and border by position, within the workbook
    ``book``. The format bounds the three tables at 64 K styles a workbook."""
    book = book or []

    def beside(left: DataFrame, right: DataFrame, key: str, given, prefix: str) -> DataFrame:
        values = [c for c in right.columns if c != key and c not in book]
        r = right.select(*[F.col(c).alias(f"_{c}") for c in (*book, key)], *[F.col(c).alias(f"{prefix}{c}") for c in values])
        on = F.col(f"_{key}") == given
        for c in book:
            on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return left.join(r, on, "left").drop(*[f"_{c}" for c in (*book, key)])

    joined = xfs
    for right, key in ((fonts, "font_id"), (fills, "fill_id"), (borders, "border_id")):
        joined = beside(joined, right, key, F.col(key), "")
    own = [c for c in fonts.columns if c != "font_id" and c not in book]
    joined = beside(joined, fonts.filter("font_id = 0"), "font_id", F.lit(0), "base_")
    others = [c for t, k in ((fills, "fill_id"), (borders, "border_id")) for c in t.columns if c != k and c not in book]
    return joined.select(*xfs.columns, *[F.coalesce(c, f"base_{c}").alias(c) for c in own], *others)
