"""Page layout decisions, all as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import CHUNK_PX, CHUNK_TRIGGER, MARGINS, NO_HEIGHT_PX, PAGES
from ..functions.numbers import mm_px
from ..functions.text import trim
from .runs import greedy_batches


def _pick(table: dict[str, tuple[float, float]], key: Column, i: int, default: str) -> Column:
    out = F.lit(table[default][i])
    for name, v in table.items():
        out = F.when(key == name, F.lit(v[i])).otherwise(out)
    return out


def options(page: Column, margin: Column, orientation: Column, scale: Column) -> Column:
    """Options as given where they are allowed, else null: the default."""
    ok = scale.isNotNull() & ~F.isnan(scale) & scale.between(0.5, 1.5) & (scale != 1)
    return F.struct(
        F.when(page.isin(*PAGES), page).alias("page"), F.when(margin.isin(*MARGINS), margin).alias("margin"),
        F.when(orientation.isin("portrait", "landscape"), orientation).alias("orientation"), F.when(ok, scale).alias("scale"),
    )


def printable(page: Column, margin: Column, landscape: Column) -> Column:
    """Printable width in whole pixels; defaults A4 and normal."""
    width = F.when(landscape, _pick(PAGES, page, 1, "A4")).otherwise(_pick(PAGES, page, 0, "A4"))
    return F.floor(mm_px(width - 2 * _pick(MARGINS, margin, 1, "normal"))).cast("long")


def orientation(option: Column, content: Column, portrait: Column) -> Column:
    """The option, else landscape iff the content is wider than 1.25 times a portrait page."""
    return F.coalesce(option, F.when(content > portrait * 1.25, "landscape").otherwise("portrait"))


def block_zoom(width: Column, limit: Column) -> Column:
    return F.when(width > limit + 1, F.greatest(F.lit(0.3), limit / width)).otherwise(F.lit(1.0))


def page_scale(limit: Column, remaining: Column, user: Column) -> Column:
    fit = F.greatest(F.lit(0.35), F.least(F.lit(1.0), limit / remaining))
    return F.greatest(F.lit(0.1), F.least(F.lit(2.0), fit * F.coalesce(user, F.lit(1.0))))


def n_pages(height: Column) -> Column:
    return F.ceil(height / 1050).cast("long")


def height_chunks(blocks: DataFrame, keys: list[str], order: list[str], target: int = CHUNK_PX) -> DataFrame:
    """Adds ``chunk``: blocks in order fill a chunk up to ``target`` pixels of ``height``. A chunk without height
    is never full, however many blocks it has."""
    return greedy_batches(blocks, keys, order, "height", target, None, "chunk", sized=True)


def row_groups(rows: DataFrame, table: list[str], order: list[str], target: int = CHUNK_PX) -> DataFrame:
    """Adds ``group``: the rows of tables taller than ``target`` fill groups of up to ``target`` pixels, each of which becomes a
    table with the head of the first; a row without height counts NO_HEIGHT_PX. Tables that fit, of one row, or that make
    one group have group 0 alone. ``height`` is a row's, ``table_height`` the table's own."""
    size = F.when(F.coalesce("height", F.lit(0)) == 0, NO_HEIGHT_PX).otherwise(F.col("height"))
    grouped = greedy_batches(rows.withColumn("_size", size), table, order, "_size", target, None, "group").drop("_size")
    return grouped.withColumn("group", F.when(F.col("table_height") > target, F.col("group")).otherwise(F.lit(0)).cast("long"))


def in_chunks(height: Column) -> Column:
    """Whether a document is printed in chunks."""
    return F.coalesce(height > CHUNK_TRIGGER, F.lit(False))


def without_empty_tail(rows: DataFrame, table: list[str], order: list[str]) -> DataFrame:
    """Table rows (``text``, ``n_images``) up to the last of each table that has a text or an image."""
    full = (trim(F.coalesce("text", F.lit(""))) != "") | (F.coalesce("n_images", F.lit(0)) > 0)
    behind = Window.partitionBy(*table).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_full", F.max(full.cast("int")).over(behind)).filter("_full = 1").drop("_full")


def widest(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content_width): the widest box of a document in whole pixels."""
    return boxes.groupBy(*keys).agg(F.ceil(F.max("width")).cast("long").alias("content_width"))
