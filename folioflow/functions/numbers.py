"""Numbers: spreadsheet references, units, colours, geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import INDEXED, THEME
from .text import collapse_blanks, escape_html, trim


def half_up(x: Column) -> Column:
    """Rounded with halves towards plus infinity; ``round`` takes them away from 0."""
    return F.floor(x + F.lit(0.5))


def column_letter(index: Column) -> Column:
    """0: A, 25: Z, 26: AA ... up to 18277: ZZZ, bijective base 26."""
    letter = lambda n: F.char((F.lit(65) + n % 26).cast("int"))
    one, two = letter(index), letter(F.floor(index / 26) - 1)
    three = letter(F.floor((F.floor(index / 26) - 1) / 26) - 1)
    return F.when(index < 26, one).when(index < 702, F.concat(two, one)).otherwise(F.concat(three, two, one))


def address(row: Column, col: Column) -> Column:
    return F.concat(column_letter(col), (row + 1).cast("long").cast("string"))


def reference(ref: Column) -> Column:
    """A1 to struct(row, col) from 0; null if it is none."""
    up = F.upper(F.trim(ref))
    letters = F.regexp_extract(up, r"^([A-Z]+)(\d+)$", 1)
    col = F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64))
    row = F.regexp_extract(up, r"^([A-Z]+)(\d+)$", 2).try_cast("long")
    return F.when(letters != "", F.struct((row - 1).alias("row"), (col - 1).alias("col")))


def cell_range(ref: Column) -> Column:
    """A1:B2 to struct(r1, c1, r2, c2); one cell is a range; null if either end is none."""
    a = reference(F.split_part(ref, F.lit(":"), F.lit(1)))
    end = F.split_part(ref, F.lit(":"), F.lit(2))
    b = reference(F.when(end == "", F.split_part(ref, F.lit(":"), F.lit(1))).otherwise(end))
    box = F.struct(a["row"].alias("r1"), a["col"].alias("c1"), b["row"].alias("r2"), b["col"].alias("c2"))
    return F.when(a.isNotNull() & b.isNotNull(), box)


def truncated(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")


def digit_width(points: Column) -> Column:
    """Pixels of the widest digit of the base font."""
    return F.greatest(F.lit(5), F.least(F.lit(20), half_up(points / 11 * 7))).cast("long")


def column_px(chars: Column, digit: Column) -> Column:
    return truncated((F.lit(256) * chars + truncated(F.lit(128) / digit)) / 256 * digit)


def points_px(points: Column) -> Column:
    return half_up(F.coalesce(points, F.lit(0.0)) * 96 / 72).cast("long")


def emu_px(emu: Column) -> Column:
    return half_up(F.coalesce(emu, F.lit(0)) / 9525).cast("long")


def mm_px(mm: Column) -> Column:
    return mm * 96 / 25.4


def leading_number(text: Column, default: Column | None = None) -> Column:
    """The number a text begins with ("12px": 12), else the default."""
    found = F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double")
    return found if default is None else F.coalesce(found, default)


def css_number(x: Column, fallback: Column) -> Column:
    """Two decimals; the fallback for what is no number."""
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(ok, half_up(x * 100) / 100).otherwise(fallback)


def text_box(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column, width: Column, scale: Column) -> Column:
    """Place of a text item under the affine transform (a b c d e f): font size (of the vertical
    axis, else the horizontal, else 10), left, top, width."""
    size = F.coalesce(F.nullif(F.hypot(c, d), F.lit(0.0)), F.nullif(F.hypot(a, b), F.lit(0.0)), F.lit(10.0))
    size, zero = css_number(size, F.lit(10.0)), F.lit(0.0)
    return F.struct(
        size.alias("font_size"), css_number(e, zero).alias("left"), css_number(f - size, zero).alias("top"),
        css_number(width * scale, zero).alias("width"),
    )


def text_span(text: Column, box: Column, serif: Column) -> Column:
    """A text item of a page at its place (:func:`text_box`), as it can be edited and translated; '' for blank texts."""
    clean = collapse_blanks(F.coalesce(text, F.lit("")))
    number = lambda c: F.regexp_replace(F.format_string("%.2f", c), r"\.?0+$", "")
    style = F.concat(
        F.lit("position:absolute; left:"), number(box["left"]), F.lit("px; top:"), number(box["top"]), F.lit("px; width:"), number(box["width"]), F.lit("px; font-size:"), number(box["font_size"]),
        F.lit("px; line-height:1.05; font-family:"), F.when(serif, "serif").otherwise("sans-serif"), F.lit("; white-space:pre; transform-origin:left top;"),
    )
    return F.when(trim(clean) == "", F.lit("")).otherwise(F.concat(F.lit('<span class="pdf-text" style="'), style, F.lit('">'), escape_html(clean), F.lit("</span>")))


# --- colours


def argb(color: Column) -> Column:
    """Six hex digits after #, from eight (alpha first) or six; else null."""
    hex_ = F.upper(F.regexp_replace(color, "[^0-9a-fA-F]", ""))
    return F.when(F.length(hex_) == 8, F.concat(F.lit("#"), F.substring(hex_, 3, 6))).when(F.length(hex_) == 6, F.concat(F.lit("#"), hex_))


def rgb(color: Column) -> tuple[Column, Column, Column]:
    return tuple(F.conv(F.substring(color, i, 2), 16, 10).cast("int") for i in (2, 4, 6))


def hex_of(r: Column, g: Column, b: Column) -> Column:
    two = lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), half_up(x))).cast("long")), 2, "0")
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def tint(color: Column, amount: Column) -> Column:
    """Lightness in HSL scaled towards black (amount < 0) or white (> 0).

    Hue and saturation stay, so each channel keeps its place between the extremes: with lightness l
    and chroma d, channel v becomes l2 + (v - l) * d2 / d, with d2 from the same saturation. Lightness
    is taken from the bytes: taken from fractions, its last bit turns some halves the other way."""
    r, g, b = rgb(color)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    light, d = (top + low) / F.lit(2.0) / 255, top - low
    full = F.lit(1.0) - F.abs(light * 2 - 1)
    after = F.when(amount < 0, light * (amount + 1)).otherwise(light * (F.lit(1.0) - amount) + amount)
    scale = F.when(d == 0, F.lit(0.0)).otherwise((F.lit(1.0) - F.abs(after * 2 - 1)) / full)
    return F.when(F.coalesce(amount, F.lit(0.0)) == 0, color).otherwise(hex_of(*[(after + (v / F.lit(255.0) - light) * scale) * 255 for v in (r, g, b)]))


def theme_color(index: Column, amount: Column) -> Column:
    colors = F.array(*[F.lit(f"#{x}") for x in THEME])
    return tint(F.get(colors, index.cast("int")), amount)


def indexed_color(index: Column) -> Column:
    return F.get(F.array(*[F.lit(f"#{x}") for x in INDEXED]), index.cast("int"))


def cell_color(auto: Column, argb_: Column, theme: Column, amount: Column, index: Column) -> Column:
    """auto: none; else the given colour, else the theme's, else the palette's."""
    return (
        F.when(F.coalesce(auto == "1", F.lit(False)), F.lit(None).cast("string"))
        .when(F.coalesce(argb_, F.lit("")) != "", argb(argb_))
        .when(theme.isNotNull(), theme_color(theme, amount))
        .otherwise(indexed_color(index))
    )


def color_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.abs(a[0] - b[0]) + F.abs(a[1] - b[1]) + F.abs(a[2] - b[2])
