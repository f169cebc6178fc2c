"""Queries on spreadsheet grids, made from order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import grid
from . import query, table

# a sheet for each 500 orders; a merge from each line item
_MERGES = """m AS (SELECT (l_orderkey // 500)::BIGINT AS sheet, (l_orderkey * 10 + l_linenumber)::BIGINT AS ord, (l_partkey % 60)::BIGINT AS r1, (l_suppkey % 20)::BIGINT AS c1,
  (l_partkey % 60 + l_linenumber % 3)::BIGINT AS r2, (l_suppkey % 20 + l_orderkey % 3)::BIGINT AS c2 FROM lineitem)"""
_CELLS = """k AS (SELECT (o_orderkey // 500)::BIGINT AS sheet, (o_custkey % 60)::BIGINT AS row, (o_orderkey % 20)::BIGINT AS col, max(o_orderkey)::VARCHAR AS value FROM orders GROUP BY 1, 2, 3)"""
_COVER = "x AS (SELECT sheet, ord, unnest(range(r1, r2 + 1)) AS row, r1, c1, c2 FROM m), y AS (SELECT sheet, ord, row, unnest(range(c1, c2 + 1)) AS col, r1, c1 FROM x)"
# rows and columns of each sheet with sizes and some hidden
_AXIS = "a AS (SELECT (p_partkey // 40)::BIGINT AS sheet, (p_partkey % 40)::BIGINT AS i, p_size::BIGINT AS px, p_size % 4 = 0 AS hidden FROM part)"


def merges(spark, d):
    li, n = table(spark, d, "lineitem"), F.col
    return li.select(
        F.floor(n("l_orderkey") / 500).alias("sheet"), (n("l_orderkey") * 10 + n("l_linenumber")).alias("ord"), (n("l_partkey") % 60).alias("r1"), (n("l_suppkey") % 20).alias("c1"),
        (n("l_partkey") % 60 + n("l_linenumber") % 3).alias("r2"), (n("l_suppkey") % 20 + n("l_orderkey") % 3).alias("c2"),
    )


def cells(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.floor(F.col("o_orderkey") / 500).alias("sheet"), (F.col("o_custkey") % 60).alias("row"), (F.col("o_orderkey") % 20).alias("col")).agg(F.max("o_orderkey").cast("string").alias("value"))


def axis(spark, d):
    p = F.col("p_partkey")
    return table(spark, d, "part").select(F.floor(p / 40).alias("sheet"), (p % 40).alias("i"), F.col("p_size").cast("long").alias("px"), (F.col("p_size") % 4 == 0).alias("hidden"))


@query(f"WITH {_MERGES}, {_CELLS}, {_COVER} SELECT k.sheet, k.row, k.col, k.value FROM k WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.sheet = k.sheet AND y.row = k.row AND y.col = k.col AND NOT (y.row = y.r1 AND y.col = y.c1))")
def q_merge_cover(spark, d):
    """JON08: cells that no merge hides."""
    return grid.uncovered(cells(spark, d), merges(spark, d), ["sheet"])


@query(f"WITH {_MERGES}, {_CELLS} SELECT k.sheet, k.row, k.col, min(m.ord) AS merge_ord FROM k LEFT JOIN m ON m.sheet = k.sheet AND k.row BETWEEN r1 AND r2 AND k.col BETWEEN c1 AND c2 GROUP BY 1, 2, 3")
def q_anchor_in_merge(spark, d):
    """JON07: the first merge that holds an anchor."""
    return grid.anchor_merge(cells(spark, d).drop("value"), merges(spark, d), ["sheet"])


@query(f"""WITH {_AXIS}, s AS (SELECT sheet, sheet AS ord, 0 AS r1, sheet % 7 AS r2, 3 + sheet % 5 AS c1, 6 + sheet % 9 AS c2 FROM (SELECT DISTINCT sheet FROM a))
SELECT s.sheet, s.ord, greatest(1, r2 - r1 + 1 - (SELECT count(*) FROM a WHERE a.sheet = s.sheet AND a.i BETWEEN r1 AND r2 AND hidden))::BIGINT AS rowspan,
  greatest(1, c2 - c1 + 1 - (SELECT count(*) FROM a WHERE a.sheet = s.sheet AND a.i BETWEEN c1 AND c2 AND hidden))::BIGINT AS colspan FROM s""")
def q_span_count(spark, d):
    """AGG16: visible rows and columns of a merge."""
    a = axis(spark, d)
    s = a.select("sheet").distinct().select("sheet", F.col("sheet").alias("ord"), F.lit(0).cast("long").alias("r1"), (F.col("sheet") % 7).alias("r2"), (F.col("sheet") % 5 + 3).alias("c1"), (F.col("sheet") % 9 + 6).alias("c2"))
    return grid.spans(s, a, a, ["sheet"])


@query(f"""WITH {_AXIS} SELECT b.sheet, b.i, coalesce((SELECT min(a.i) FROM a WHERE a.sheet = b.sheet AND a.i >= b.i AND NOT a.hidden),
  (SELECT max(a.i) FROM a WHERE a.sheet = b.sheet AND a.i <= b.i AND NOT a.hidden), 0)::BIGINT AS visible FROM a b""")
def q_nearest_visible(spark, d):
    """JON09, WIN09."""
    return grid.nearest_visible(axis(spark, d), ["sheet"])


@query(f"""WITH {_AXIS}, o AS (SELECT *, coalesce(sum(CASE WHEN hidden THEN 0 ELSE px END) OVER (PARTITION BY sheet ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM a),
p AS (SELECT sheet, i AS point, i * 23 AS x FROM a)
SELECT p.sheet, p.point, p.x, coalesce((SELECT max(o.i) FROM o WHERE o.sheet = p.sheet AND o.start <= p.x), 0)::BIGINT AS line FROM p""")
def q_abs_anchor(spark, d):
    """JON10, WIN01: the line at a pixel offset."""
    a = axis(spark, d)
    points = a.select("sheet", F.col("i").alias("point"), (F.col("i") * 23).alias("x"))
    return grid.locate(points, a, ["sheet"], "x", "line")


@query(f"""WITH {_MERGES}, {_CELLS}, u AS (SELECT sheet, row, col FROM k UNION ALL SELECT sheet, r2, c2 FROM m)
SELECT sheet, least(max(row), 4999)::BIGINT AS last_row, least(max(col), 255)::BIGINT AS last_col FROM u GROUP BY 1""")
def q_used_range(spark, d):
    """AGG01."""
    m = merges(spark, d).select("sheet", F.col("r2").alias("row"), F.col("c2").alias("col"))
    return grid.used_range([cells(spark, d), m], ["sheet"])


@query(f"""WITH {_CELLS}, c AS (SELECT sheet, row, col, CASE WHEN col > 15 THEN chr(10) || chr(160) WHEN col > 12 OR row > 40 THEN ' ' ELSE value END AS value FROM k),
e AS (SELECT sheet, 45 AS row, 3 AS col, sheet % 5 = 0 AS absolute FROM (SELECT DISTINCT sheet FROM k) WHERE sheet % 2 = 0),
u AS (SELECT sheet, CASE WHEN trim(value, ' ' || chr(10) || chr(160)) <> '' THEN row END AS row, CASE WHEN trim(value, ' ' || chr(10) || chr(160)) <> '' THEN col END AS col, row AS ar, col AS ac, false AS ab FROM c
  UNION ALL SELECT sheet, row, col, row, col, absolute FROM e)
SELECT sheet, CASE WHEN bool_or(ab) THEN max(ar) ELSE max(row) END::BIGINT AS last_row, CASE WHEN bool_or(ab) THEN max(ac) ELSE max(col) END::BIGINT AS last_col, NOT bool_or(ab) AS trimmed FROM u GROUP BY 1""")
def q_trim_tail(spark, d):
    """AGG02: the range without blank rows and columns at its end; blanks of every kind."""
    k = cells(spark, d)
    c = k.withColumn("value", F.when(F.col("col") > 15, "\n\u00a0").when((F.col("col") > 12) | (F.col("row") > 40), " ").otherwise(F.col("value")))
    e = k.select("sheet").distinct().filter("sheet % 2 = 0").select("sheet", F.lit(45).cast("long").alias("row"), F.lit(3).cast("long").alias("col"), (F.col("sheet") % 5 == 0).alias("absolute"))
    return grid.trimmed_range(c, e, ["sheet"])


@query(f"""WITH {_AXIS}, {_CELLS} SELECT r.sheet, r.i AS row, c.i AS col, coalesce(k.value, '') AS value FROM a r JOIN a c ON r.sheet = c.sheet LEFT JOIN k ON k.sheet = r.sheet AND k.row = r.i AND k.col = c.i
WHERE NOT r.hidden AND NOT c.hidden""")
def q_full_grid(spark, d):
    """JON11."""
    a = axis(spark, d)
    return grid.full_grid(a, a, cells(spark, d), ["sheet"])


@query("""
SELECT c_custkey AS xf, c_nationkey % 2 AS book, CASE WHEN c_nationkey % 2 = 0 THEN coalesce('style ' || n.n_name, 'style ' || b.n_name) WHEN n.n_nationkey > 0 THEN 'other ' || n.n_name END AS font, r_name AS fill, s_name AS border FROM customer
LEFT JOIN nation n ON n.n_nationkey = c_custkey % 30 LEFT JOIN nation b ON b.n_nationkey = 0 LEFT JOIN region ON r_regionkey = c_custkey % 7 LEFT JOIN supplier ON s_suppkey = c_custkey % 13
""")
def q_style_cascade(spark, d):
    """JON06: a format's font (or its workbook's first font, if there is one), fill and border by position, in two workbooks."""
    c = F.col("c_custkey")
    book = F.col("c_nationkey") % 2
    xfs = table(spark, d, "customer").select(c.alias("xf"), book.alias("book"), (c % 30).alias("font_id"), (c % 7).alias("fill_id"), (c % 13).alias("border_id"))
    n, books = table(spark, d, "nation"), lambda t: t.withColumn("book", F.explode(F.array(F.lit(0), F.lit(1))))
    fonts = books(n.select(F.col("n_nationkey").cast("long").alias("font_id"), "n_name")).filter("book = 0 or font_id > 0")  # the second has no first font
    fonts = fonts.select("book", "font_id", F.concat(F.when(F.col("book") == 0, "style ").otherwise("other "), "n_name").alias("font"))
    fills = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("fill_id"), F.col("r_name").alias("fill"))
    borders = table(spark, d, "supplier").select(F.col("s_suppkey").alias("border_id"), F.col("s_name").alias("border"))
    return grid.style_of(xfs, fonts, books(fills), books(borders), ["book"]).select("xf", "book", "font", "fill", "border")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 700 < 26 THEN chr((65 + p_partkey % 700)::INT) ELSE chr((64 + (p_partkey % 700) // 26)::INT) || chr((65 + (p_partkey % 700) % 26)::INT) END AS letter,
  (p_partkey - 1)::BIGINT AS r1, (p_partkey % 26)::BIGINT AS c1, (p_partkey + 2)::BIGINT AS r2, (26 + p_partkey % 26)::BIGINT AS c2 FROM part
""")
def q_col_letter(spark, d):
    """NUM01, NUM02, ARR03."""
    p = F.col("p_partkey")
    box = N.cell_range(F.concat(N.address(p - 1, p % 26), F.lit(":"), F.lower(N.address(p + 2, 26 + p % 26))))
    return table(spark, d, "part").select("p_partkey", N.column_letter(p % 700).alias("letter"), box.alias("b")).select("p_partkey", "letter", "b.*")


@query("""
SELECT p_partkey, trunc(((256 * (p_size + 0.43) + 18) / 256) * 7)::BIGINT AS col_px, floor(p_size::DOUBLE * 96 / 72 + 0.5)::BIGINT AS row_px,
  floor(p_retailprice * 1000 / 9525 + 0.5)::BIGINT AS emu_px, greatest(5, least(20, floor(p_size::DOUBLE / 11 * 7 + 0.5)))::BIGINT AS digit,
  floor((-p_size / 4.0::DOUBLE) + 0.5)::BIGINT AS half, p_size::DOUBLE AS lead FROM part
""")
def q_units(spark, d):
    """NUM03, NUM04, NUM11."""
    s = F.col("p_size").cast("double")
    return table(spark, d, "part").select(
        "p_partkey", N.column_px(s + 0.43, F.lit(7)).alias("col_px"), N.points_px(s).alias("row_px"), N.emu_px(F.col("p_retailprice") * 1000).alias("emu_px"),
        N.digit_width(s).alias("digit"), N.half_up(-s / 4).alias("half"), N.leading_number(F.concat(F.col("p_size").cast("string"), F.lit("px"))).alias("lead"),
    )


@query("""
WITH c AS (SELECT p_partkey, (p_partkey * 7919) % 256 AS r, (p_partkey * 104729) % 256 AS g, (p_partkey * 1299709) % 256 AS b, (p_size % 19 - 9) / 10.0::DOUBLE AS t FROM part),
h AS (SELECT *, (greatest(r, g, b) + least(r, g, b)) / 2.0::DOUBLE / 255 AS l, (greatest(r, g, b) - least(r, g, b)) / 255.0::DOUBLE AS d FROM c),
k AS (SELECT *, CASE WHEN t < 0 THEN l * (1 + t) ELSE l * (1 - t) + t END AS l2 FROM h),
s AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (1 - abs(2 * l2 - 1)) / (1 - abs(2 * l - 1)) END AS q FROM k)
SELECT p_partkey, abs(r - 17) + abs(g - 17) + abs(b - 17) AS dist, t = 0 AS same,
  floor(floor(CASE WHEN t = 0 THEN r ELSE (l2 + (r / 255.0::DOUBLE - l) * q) * 255 END + 0.5) / 8)::BIGINT AS r8 FROM s
""")
def q_tint(spark, d):
    """NUM05, NUM06, NUM10: tinted colours, compared by eighths of a channel's bytes."""
    p = F.col("p_partkey")
    c = [(p * k % 256).cast("long") for k in (7919, 104729, 1299709)]
    t = (F.col("p_size") % 19 - 9) / F.lit(10.0)
    color = N.hex_of(*c)
    out = table(spark, d, "part").select("p_partkey", color.alias("c"), t.alias("t"), N.color_distance(tuple(c), (F.lit(17), F.lit(17), F.lit(17))).alias("dist"))
    tinted = N.tint(F.col("c"), F.col("t"))
    r = N.rgb(tinted)[0]
    return out.select("p_partkey", "dist", (F.col("t") == 0).alias("same"), F.floor(r / 8).alias("r8"))


@query("SELECT p_partkey, unnest(range(0, least(p_size, 20)))::BIGINT AS k FROM part")
def q_repeat_expand(spark, d):
    """ARR01: repeats, up to a limit."""
    return table(spark, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(0).cast("long"), F.least("p_size", F.lit(20)).cast("long") - 1)).alias("k"))
