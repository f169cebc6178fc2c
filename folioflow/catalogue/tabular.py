"""Queries on runs, votes, sorting, limits, layout and drafts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import layout, runs, votes
from . import query, table


@query("""
WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type IN ('click', 'view') THEN 'ul' ELSE 'ol' END AS kind FROM events),
n AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS nw FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run_id FROM n)
SELECT user_id, run_id::BIGINT AS run_id, min(kind) AS kind, count(*)::BIGINT AS items FROM r GROUP BY 1, 2
""")
def q_list_islands(spark, d):
    """WIN04: runs of one list kind."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type").isin("click", "view"), "ul").otherwise("ol").alias("kind"))
    return runs.islands(e, ["user_id"], ["ts", "event_id"], F.col("kind")).groupBy("user_id", "run_id").agg(F.min("kind").alias("kind"), F.count(F.lit(1)).alias("items"))


@query("""
SELECT o_custkey AS slide, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 50000), o_orderdate, o_orderkey)::BIGINT AS place FROM orders
""")
def q_reading_order(spark, d):
    """SRT01: by y, then x, then place in the tree, so that ties keep their order."""
    from pyspark.sql import Window

    w = Window.partitionBy("slide").orderBy("y", "x", "ord")
    items = table(spark, d, "orders").select(F.col("o_custkey").alias("slide"), F.col("o_orderkey").alias("ord"), F.floor(F.col("o_totalprice") / 50000).alias("y"), F.col("o_orderdate").alias("x"))
    return items.select("slide", "ord", F.row_number().over(w).cast("long").alias("place"))


@query("""
WITH o AS (SELECT o_custkey AS slide, o_orderkey AS ord, o_orderpriority LIKE '1%' AS is_title FROM orders),
f AS (SELECT slide, min(ord) AS first FROM o WHERE is_title GROUP BY 1)
SELECT o.slide, o.ord, coalesce(o.ord = f.first, false) AS is_first FROM o LEFT JOIN f ON o.slide = f.slide
""")
def q_first_title(spark, d):
    """WIN03: one title a slide."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("slide"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").startswith("1").alias("is_title"))
    return runs.first_match(o, ["slide"], ["ord"], F.col("is_title")).select("slide", "ord", "is_first")


_SAMPLES = "s AS (SELECT event_id // 4 AS item, event_id % 4 AS ord, (user_id % 3 * 100)::INT AS r, (length(event_type) % 3 * 100)::INT AS g, 50 AS b FROM events)"


def samples(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(
        F.floor(e / 4).alias("item"), (e % 4).alias("ord"), (F.col("user_id") % 3 * 100).cast("int").alias("r"), (F.length("event_type") % 3 * 100).cast("int").alias("g"), F.lit(50).alias("b")
    )


@query(f"""WITH {_SAMPLES}, c AS (SELECT item, r, g, b, count(*) AS votes, min(ord) AS f FROM s GROUP BY 1, 2, 3, 4),
k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY votes * 1000 + r + g + b DESC, f) AS n FROM c) SELECT item, r, g, b, votes::BIGINT AS votes FROM k WHERE n = 1""")
def q_majority_color(spark, d):
    """AGG05."""
    return votes.majority_color(samples(spark, d), ["item"])


@query(f"""WITH {_SAMPLES}, a AS (SELECT *, abs(r - 100) + abs(g - 100) + abs(b - 60) AS dd FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY dd DESC, ord) AS n FROM a)
SELECT item, CASE WHEN dd > 90 THEN r ELSE 17 END::INT AS r, CASE WHEN dd > 90 THEN g ELSE 17 END::INT AS g, CASE WHEN dd > 90 THEN b ELSE 17 END::INT AS b FROM k WHERE n = 1""")
def q_contrast_color(spark, d):
    """AGG06, NUM10."""
    s = samples(spark, d).select("item", F.col("ord").alias("step"), "r", "g", "b", F.lit(100).alias("br"), F.lit(100).alias("bg"), F.lit(60).alias("bb"))
    return votes.contrast_color(s, ["item"])


@query("""
WITH b AS (SELECT c_nationkey::BIGINT AS doc, unnest(range(1, length(c_mktsegment) + 1)) AS i, c_mktsegment AS s, c_custkey FROM customer),
v AS (SELECT doc, CASE WHEN c_custkey % 2 = 0 THEN 192 + ascii(s[i]) % 60 ELSE 128 + ascii(s[i]) % 30 END AS b FROM b)
SELECT doc, CASE WHEN sum((b >= 192 OR b IN (168, 184))::INT) * 2 >= sum((b >= 128)::INT) THEN 'windows-1251' ELSE 'windows-1252' END AS codepage FROM v GROUP BY 1
""")
def q_codepage(spark, d):
    """AGG07, SRC09: the vote on a code page."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("doc"), "c_custkey", F.explode(F.split("c_mktsegment", "")).alias("ch")).filter("ch <> ''")
    b = F.when(F.col("c_custkey") % 2 == 0, F.ascii("ch") % 60 + 192).otherwise(F.ascii("ch") % 30 + 128)
    return votes.cyrillic_share(c.select("doc", b.alias("b")), ["doc"])


@query("""
WITH RECURSIVE n AS (SELECT p_partkey // 50 AS doc, p_partkey AS i, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) AS k, (CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_size % 9 = 0 THEN 60000 ELSE p_size * 400 END)::BIGINT AS h FROM part),
r AS (SELECT doc, k, i, h AS t, 0 AS chunk FROM n WHERE k = 1 UNION ALL
  SELECT n.doc, n.k, n.i, CASE WHEN r.t > 0 AND r.t + n.h > 50000 THEN n.h ELSE r.t + n.h END, CASE WHEN r.t > 0 AND r.t + n.h > 50000 THEN r.chunk + 1 ELSE r.chunk END FROM r JOIN n ON n.doc = r.doc AND n.k = r.k + 1)
SELECT doc::BIGINT AS doc, i, chunk::BIGINT AS chunk FROM r
""")
def q_chunks(spark, d):
    """AGG10: blocks in chunks of bounded height; some have none, some are taller than a chunk."""
    size = F.col("p_size")
    height = F.when(size % 5 == 0, 0).when(size % 9 == 0, 60_000).otherwise(size * 400)
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 50).alias("doc"), F.col("p_partkey").alias("i"), height.cast("long").alias("height"))
    return layout.height_chunks(p, ["doc"], ["i"]).select("doc", "i", "chunk")


@query("""
WITH RECURSIVE n AS (SELECT p_partkey // 50 AS tab, p_partkey AS i, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) AS k,
  (CASE WHEN p_size % 5 = 0 THEN 20 ELSE p_size * 300 END)::BIGINT AS h, (CASE WHEN (p_partkey // 50) % 3 = 0 THEN 50000 ELSE 120000 END) AS whole FROM part),
r AS (SELECT tab, k, i, h AS t, 0 AS grp, whole FROM n WHERE k = 1 UNION ALL
  SELECT n.tab, n.k, n.i, CASE WHEN r.t + n.h > 50000 THEN n.h ELSE r.t + n.h END, CASE WHEN r.t + n.h > 50000 THEN r.grp + 1 ELSE r.grp END, n.whole FROM r JOIN n ON n.tab = r.tab AND n.k = r.k + 1)
SELECT tab::BIGINT AS tab, i, CASE WHEN whole > 50000 THEN grp ELSE 0 END::BIGINT AS "group", whole > 100000 AS chunked FROM r
""")
def q_row_groups(spark, d):
    """AGG09, LAY06: rows of tall tables in groups; a row without height counts 20. Whether a document is printed in chunks."""
    key, size = F.col("p_partkey"), F.col("p_size")
    tab = F.floor(key / 50)
    height = F.when(size % 5 == 0, 0).otherwise(size * 300).cast("long")
    p = table(spark, d, "part").select(tab.alias("tab"), key.alias("i"), height.alias("height"), F.when(tab % 3 == 0, 50_000).otherwise(120_000).alias("table_height"))
    return layout.row_groups(p, ["tab"], ["i"]).select("tab", "i", "group", layout.in_chunks(F.col("table_height")).alias("chunked"))


@query("""
WITH r AS (SELECT o_custkey AS tab, o_orderkey AS i, o_orderkey % 4 = 0 AS has_text, o_orderkey % 9 = 0 AS has_img FROM orders),
l AS (SELECT tab, max(i) FILTER (WHERE has_text OR has_img) AS last FROM r GROUP BY 1)
SELECT r.tab, r.i FROM r JOIN l ON r.tab = l.tab AND r.i <= l.last
""")
def q_empty_tail(spark, d):
    """LAY05: table rows without the empty ones at the end."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("tab"), k.alias("i"), F.when(k % 4 == 0, "x").when(k % 4 == 1, "\u00a0\n").alias("text"), F.when(k % 9 == 0, 1).otherwise(0).alias("n_images"))
    return layout.without_empty_tail(rows, ["tab"], ["i"]).select("tab", "i")


@query("SELECT p_size AS doc, ceil(max(p_retailprice))::BIGINT AS content_width FROM part GROUP BY 1")
def q_widest(spark, d):
    """AGG13: the widest element of a document."""
    return layout.widest(table(spark, d, "part").select(F.col("p_size").alias("doc"), F.col("p_retailprice").alias("width")), ["doc"])


@query("""
WITH m AS (SELECT l_orderkey AS doc, list(l_returnflag || l_linenumber ORDER BY l_linenumber, l_returnflag) FILTER (WHERE l_linestatus = 'O') AS w FROM lineitem GROUP BY 1)
SELECT doc, array_to_string(w[1:5], ';') AS warnings, coalesce(len(w), 0)::BIGINT AS n FROM m
""")
def q_first_warnings(spark, d):
    """FLT15, LIM03: the messages of type warning, the first five of each document."""
    li = table(spark, d, "lineitem")
    m = li.groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("i"), F.col("l_linestatus").alias("type"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("message"))).alias("m"))
    some = votes.warnings_of(F.transform(F.array_sort("m"), lambda x: F.struct(F.when(x["type"] == "O", "warning").otherwise("info").alias("type"), x["message"].alias("message"))))
    return m.select("doc", F.nullif(F.array_join(votes.first_warnings(some), ";"), F.lit("")).alias("warnings"), F.size(some).cast("long").alias("n"))


@query("SELECT event_id, [200, 429, 404, 500, 503, 529, 401][event_id % 7 + 1] IN (429, 500, 503, 529) AS retry FROM events")
def q_retryable(spark, d):
    """FLT16: answers after which a call is tried again."""
    status = F.element_at(F.array(*map(F.lit, (200, 429, 404, 500, 503, 529, 401))), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", votes.retryable(status).alias("retry"))


@query("""
SELECT doc_id, CASE WHEN text IS NULL OR text = '' OR doc_id % 4 = 0 THEN 'no text' END AS error FROM documents
""")
def q_required(spark, d):
    """FLT12: rows without a required field are rejected with a message."""
    from ..plans.importing import required

    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 8 == 0, "").when(F.col("doc_id") % 4 != 0, F.col("text")).alias("text"))
    good, bad = required(docs, "text")
    return good.select("doc_id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("doc_id", "error"))


@query("""
WITH o AS (SELECT p_partkey, ['A4', 'A3', 'A5', 'Letter', 'B5'][p_partkey % 5 + 1] AS pg, ['normal', 'narrow', 'wide', 'x'][p_partkey % 4 + 1] AS mg, p_retailprice AS w, p_size / 25.0::DOUBLE AS sc FROM part),
v AS (SELECT p_partkey, CASE WHEN pg <> 'B5' THEN pg END AS page, CASE WHEN mg <> 'x' THEN mg END AS margin, CASE WHEN sc BETWEEN 0.5 AND 1.5 AND sc <> 1 THEN sc END AS scale, w FROM o),
m AS (SELECT *, CASE page WHEN 'A3' THEN 297.0 WHEN 'A5' THEN 148.0 WHEN 'Letter' THEN 215.9 ELSE 210.0 END::DOUBLE AS pw, CASE page WHEN 'A3' THEN 420.0 WHEN 'A5' THEN 210.0 WHEN 'Letter' THEN 279.4 ELSE 297.0 END::DOUBLE AS ph,
  CASE margin WHEN 'narrow' THEN 6.0 WHEN 'wide' THEN 20.0 ELSE 12.0 END::DOUBLE AS side FROM v),
l AS (SELECT *, floor((pw - 2 * side) * 96 / 25.4::DOUBLE)::BIGINT AS portrait FROM m), k AS (SELECT *, w > portrait * 1.25::DOUBLE AS land FROM l)
SELECT p_partkey, page, margin, scale, CASE WHEN land THEN 'landscape' ELSE 'portrait' END AS orientation,
  CASE WHEN land THEN floor((ph - 2 * side) * 96 / 25.4::DOUBLE)::BIGINT ELSE portrait END AS printable, ceil(w * 40 / 1050)::BIGINT AS pages FROM k
""")
def q_layout(spark, d):
    """LAY01-04, FLT11, AGG12: options, orientation, printable width, pages."""
    p = F.col("p_partkey")
    page = F.element_at(F.array(*map(F.lit, ("A4", "A3", "A5", "Letter", "B5"))), (p % 5 + 1).cast("int"))
    margin = F.element_at(F.array(*map(F.lit, ("normal", "narrow", "wide", "x"))), (p % 4 + 1).cast("int"))
    o = table(spark, d, "part").select(p, layout.options(page, margin, F.lit(None).cast("string"), F.col("p_size") / F.lit(25.0)).alias("o"), F.col("p_retailprice").alias("w")).select("p_partkey", "o.*", "w")
    portrait = layout.printable(F.col("page"), F.col("margin"), F.lit(False))
    o = o.withColumn("orientation", layout.orientation(F.col("orientation"), F.col("w"), portrait))
    return o.select("p_partkey", "page", "margin", "scale", "orientation", layout.printable(F.col("page"), F.col("margin"), F.col("orientation") == "landscape").alias("printable"), layout.n_pages(F.col("w") * 40).alias("pages"))


@query("""
SELECT p_partkey, CASE WHEN p_retailprice > 1001 THEN greatest(0.3, 1000 / p_retailprice) ELSE 1.0 END::DOUBLE AS zoom,
  greatest(0.1, least(2.0, greatest(0.35, least(1.0, 1000 / p_retailprice)) * (p_size / 25.0::DOUBLE)))::DOUBLE AS scale FROM part
""")
def q_zoom(spark, d):
    """LAY02, LAY03."""
    w = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", layout.block_zoom(w, F.lit(1000.0)).alias("zoom"), layout.page_scale(F.lit(1000.0), w, F.col("p_size") / F.lit(25.0)).alias("scale"))


@query("""
WITH c AS (SELECT source, count(*) FILTER (WHERE quality = 0) AS poor, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE l.doc_id IS NULL) AS unlabelled
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1)
SELECT source, array_to_string(list_filter([CASE WHEN poor > 0 THEN 'poor:' || poor END, CASE WHEN toxic > 0 THEN 'toxic:' || toxic END, CASE WHEN unlabelled > 0 THEN 'unlabelled:' || unlabelled END], lambda x: x IS NOT NULL), ';') AS warnings FROM c
""")
def q_warning_counts(spark, d):
    """AGG03: counters become warnings in a fixed order, if above 0."""
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").withColumnRenamed("doc_id", "lid"), F.col("doc_id") == F.col("lid"), "left")
    c = j.groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("poor"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("lid").isNull()).alias("unlabelled"))
    return c.select("source", F.array_join(votes.warning_list([("poor", "poor"), ("toxic", "toxic"), ("unlabelled", "unlabelled")]), ";").alias("warnings"))


@query("SELECT event_id, user_id, left(props, 300) AS props FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id DESC LIMIT 20")
def q_last_errors(spark, d):
    """LIM01, LIM05: the last twenty, newest first; a limit that is the feature."""
    e = table(spark, d, "events")
    kind = e.agg(F.min("event_type").alias("k"))
    return e.join(F.broadcast(kind), F.col("event_type") == F.col("k")).orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id", F.left("props", F.lit(300)).alias("props"))


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1
""")
def q_latest_draft(spark, d):
    """SNK07, AGG14: the last write of each key."""
    return runs.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("""
SELECT event_id FROM (SELECT event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap FROM events) WHERE gap IS NULL OR gap > 3600000000
""")
def q_debounce(spark, d):
    """WIN10: writes that none follows within an hour."""
    return runs.debounced(table(spark, d, "events"), ["user_id"], "ts", "event_id", 3_600_000).select("event_id")


@query("""
SELECT conv_id, count(*)::BIGINT AS n_batches, count(*) FILTER (WHERE turn % 3 = 0)::BIGINT AS n_failed, bool_and(turn % 3 = 0) AS doc_failed,
  min(CASE WHEN turn % 3 = 0 THEN turn END)::VARCHAR AS first_error FROM conversations GROUP BY 1
""")
def q_batch_failures(spark, d):
    """AGG11: a document fails only if all its batches do."""
    b = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("batch_id"), (F.col("turn") % 3 == 0).alias("failed"), F.col("turn").cast("string").alias("error"))
    return votes.batch_outcome(b, ["conv_id"])


@query("""
SELECT o.o_orderkey, coalesce(c_name, 'xl/worksheets/sheet' || (o.o_orderkey % 7 + 1) || '.xml') AS part FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END AS k FROM orders) o
LEFT JOIN customer ON k = c_custkey
""")
def q_rel_lookup(spark, d):
    """JON02-05: relationship lookup with a default part."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(F.col("o_custkey")).alias("k"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    default = F.concat(F.lit("xl/worksheets/sheet"), (F.col("o_orderkey") % 7 + 1).cast("string"), F.lit(".xml"))
    return o.join(c, "k", "left").select("o_orderkey", F.coalesce("c_name", default).alias("part"))


@query("""
SELECT c_custkey, 'ppt/slides/slide' || c_custkey || '.xml' AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::BIGINT AS place FROM customer
""")
def q_slide_files(spark, d):
    """SRT02: slide files of a package sort by their number; a package for each nation."""
    from pyspark.sql import Window

    named = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.concat(F.lit("ppt/slides/slide"), F.col("c_custkey").cast("string"), F.lit(".xml")).alias("name"))
    number = F.regexp_extract("name", r"(\d+)\.xml$", 1).cast("int")
    return named.withColumn("place", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(number)).cast("long")).drop("c_nationkey")


@query("""
SELECT doc_id, trim(replace(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN '<p>&nbsp; </p>' ELSE '<p>' || text || '</p>' END, '<[^>]+>', '', 'g'), '&nbsp;', ' '), ' ' || chr(10)) <> '' AS visible,
  length(text) <= 3500000 AS fits FROM documents
""")
def q_visible_draft(spark, d):
    """FLT14, SNK07, LIM04: drafts with something to see and within the limit."""
    html = F.when(F.col("doc_id") % 3 == 0, F.lit("<p>&nbsp; </p>")).otherwise(F.concat(F.lit("<p>"), "text", F.lit("</p>")))
    return table(spark, d, "documents").select("doc_id", X.visible(html).alias("visible"), (X.utf16_length(F.col("text")) <= 3_500_000).alias("fits"))
