"""Queries on text: escaping, paragraphs, Markdown, replies, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import runs
from . import query, table

_ESC = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"SELECT doc_id, {_ESC.format('text')} AS html, replace({_ESC.format('text')}, '''', '&#39;') AS html5, length(text)::BIGINT AS n FROM documents")
def q_escape(spark, d):
    """STR01-03: the three escapes."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.escape_html(t).alias("html"), X.escape_all(t).alias("html5"), X.utf16_length(t).alias("n"))


_BR = f"replace({_ESC.format('p')}, chr(10), '<br/>')"


@query(f"""
WITH t AS (SELECT doc_id, replace(text, '. ', '.' || chr(13) || chr(10) || chr(10)) AS text FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n{{2,}}'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS ps FROM t)
SELECT doc_id, len(ps)::BIGINT AS n_paragraphs, CASE WHEN len(ps) = 0 THEN '<p></p>' ELSE array_to_string(list_transform(ps, lambda p: '<p>' || {_BR} || '</p>'), '') END AS html FROM p
""")
def q_text_to_html(spark, d):
    """SRC21, STR09-10: plain text to paragraphs, with blank lines put in after sentences."""
    docs = table(spark, d, "documents").withColumn("text", F.replace("text", F.lit(". "), F.lit(".\r\n\n")))
    return docs.select("doc_id", F.size(X.paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"), X.text_to_html(F.col("text")).alias("html"))


@query("""
SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line, replace(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '"', '&quot;'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '&lt;', '<') AS decoded,
  left(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), 120) AS title FROM documents
""")
def q_collapse_decode(spark, d):
    """STR06, STR08, STR23."""
    t = F.col("text")
    once = X.swap(t, ("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"))
    return table(spark, d, "documents").select(
        "doc_id", F.trim(X.collapse_blanks(t)).alias("line"), X.decode_reply_entities(once).alias("decoded"), X.title_of(t).alias("title")
    )


@query("""
WITH l AS (SELECT p_partkey, p_name, p_brand, p_type FROM part)
SELECT p_partkey,
  '<strong>' || p_brand || '</strong> and <em>' || p_type || '</em> <code>' || p_name || '</code> <s>x</s> <a href="http://h/' || p_partkey || '" target="_blank">' || p_brand || '</a>' AS html,
  [p_name, p_brand, p_type]::VARCHAR[] AS cells FROM l
""")
def q_md_inline(spark, d):
    """STR11, STR12: inline marks and table cells, on Markdown made from ``part``."""
    src = F.concat(
        F.lit("**"), "p_brand", F.lit("** and *"), "p_type", F.lit("* `"), "p_name", F.lit("` ~~x~~ ["), "p_brand", F.lit("](http://h/"), F.col("p_partkey").cast("string"), F.lit(")")
    )
    row = F.concat(F.lit(" | "), "p_name", F.lit(" | "), "p_brand", F.lit("|"), "p_type", F.lit(" |"))
    return table(spark, d, "part").select("p_partkey", X.md_inline(src).alias("html"), X.md_cells(row).alias("cells"))


_MD = """
WITH l AS (SELECT p_partkey AS i, CASE p_partkey % 12 WHEN 0 THEN '# ' || p_name WHEN 1 THEN 'a|b' WHEN 2 THEN '-|-' WHEN 3 THEN '---' WHEN 4 THEN '----'
  WHEN 5 THEN '- ' || p_brand WHEN 6 THEN '1. ' || p_brand WHEN 7 THEN '> ' || p_name WHEN 8 THEN '```' WHEN 9 THEN '' WHEN 10 THEN '* * *' ELSE p_name END AS line,
  p_partkey // 50 AS doc FROM part),
n AS (SELECT *, lead(line) OVER (PARTITION BY doc ORDER BY i) AS nx, sum((line LIKE '```%')::INT) OVER (PARTITION BY doc ORDER BY i) AS f FROM l)
SELECT i, CASE WHEN line LIKE '```%' THEN 'fence' WHEN contains(line, '|') AND coalesce(regexp_matches(nx, '^\\s*\\|?[\\s:-]*-[\\s|:-]*$') AND contains(nx, '|'), false) THEN 'table'
  WHEN regexp_matches(line, '^(#{1,6})\\s+(.*)$') THEN 'heading'
  WHEN regexp_matches(line, '^\\s*(-\\s*-\\s*-|\\*\\s*\\*\\s*\\*|_\\s*_\\s*_)\\s*$') THEN 'hr' WHEN regexp_matches(line, '^>\\s?(.*)$') THEN 'quote'
  WHEN regexp_matches(line, '^\\s*[-*+]\\s+(.*)$') THEN 'ul' WHEN regexp_matches(line, '^\\s*\\d+[.)]\\s+(.*)$') THEN 'ol' WHEN trim(line) = '' THEN 'blank' ELSE 'paragraph' END AS class,
  line LIKE '```%' OR f % 2 = 1 AS in_fence FROM n
"""


def markdown_lines(spark, d):
    p, n, b = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    forms = [F.concat(F.lit("# "), n), F.lit("a|b"), F.lit("-|-"), F.lit("---"), F.lit("----"), F.concat(F.lit("- "), b), F.concat(F.lit("1. "), b), F.concat(F.lit("> "), n), F.lit("```"), F.lit(""), F.lit("* * *"), n]
    line = F.element_at(F.array(*forms), (p % 12 + 1).cast("int"))
    return table(spark, d, "part").select(p.alias("i"), line.alias("line"), F.floor(p / 50).alias("doc"))


@query(_MD)
def q_md_classify(spark, d):
    """STR13-14, WIN06-07: what each line begins, and whether a fence holds it."""
    from pyspark.sql import Window

    lines = runs.fenced(markdown_lines(spark, d), ["doc"], ["i"])
    nxt = F.lead("line").over(Window.partitionBy("doc").orderBy("i"))
    return lines.withColumn("_n", nxt).select("i", X.md_class(F.col("line"), F.col("_n")).alias("class"), "in_fence")


@query("""
SELECT c_custkey, regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') AS key,
  CASE WHEN c_custkey % 3 = 0 THEN [c_name, c_mktsegment]::VARCHAR[] END AS items, '<b>' || c_name || '</b>' AS fenced FROM customer
""")
def q_replies(spark, d):
    """STR15-17: keys as pasted, JSON replies of the right length, fenced HTML."""
    tick = F.lit("```")
    name = F.regexp_replace("c_name", "[^A-Za-z0-9]", "")
    pasted = F.concat(F.lit("  \"Bearer "), name, F.lit("\" "))
    reply = F.concat(tick, F.lit('json\n["'), "c_name", F.lit('", "'), "c_mktsegment", F.lit('"]\n'), tick)
    want = F.when(F.col("c_custkey") % 3 == 0, 2).otherwise(3)
    html = F.concat(tick, F.lit("html\n<b>"), "c_name", F.lit("</b>\n"), tick)
    return table(spark, d, "customer").select("c_custkey", X.clean_key(pasted).alias("key"), X.reply_list(reply, want).alias("items"), X.strip_fences(html).alias("fenced"))


@query("""
SELECT c_custkey, '\\textbackslash\\{\\}' || replace(replace(c_name, '#', '\\#'), '_', '\\_') || '\\%' AS tex,
  'document-' || CASE c_custkey % 4 WHEN 0 THEN 'src' WHEN 1 THEN 'ja' WHEN 2 THEN 'en' ELSE 'src' END || '.pdf' AS file,
  '''Calibri'', ''Carlito'', ''Noto Sans'', ''Noto Sans CJK JP'', sans-serif' AS fonts,
  'data:image/png;base64,' || to_base64(encode(c_name)) AS uri FROM customer
""")
def q_names(spark, d):
    """STR18, STR22, STR25, SNK06."""
    lang = F.element_at(F.array(*map(F.lit, ("src", "ja", "en", "xx"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select(
        "c_custkey", X.tex_escape(F.concat(F.lit("\\"), "c_name", F.lit("%"))).alias("tex"), X.download_name(F.lit("document"), lang, F.lit("pdf")).alias("file"),
        X.font_stack(F.lit('"Calibri"')).alias("fonts"), X.data_uri(F.lit("image/png"), F.col("c_name").cast("binary")).alias("uri"),
    )


_BATCH = """
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
n AS (SELECT doc_id, i, length(s) AS n FROM l),
r AS (SELECT doc_id, i, n, 0 AS b, 1 AS k, n AS t FROM n WHERE i = 1
  UNION ALL SELECT n.doc_id, n.i, n.n, CASE WHEN r.k >= 60 OR r.t + n.n > 4000 THEN r.b + 1 ELSE r.b END, CASE WHEN r.k >= 60 OR r.t + n.n > 4000 THEN 1 ELSE r.k + 1 END,
  CASE WHEN r.k >= 60 OR r.t + n.n > 4000 THEN n.n ELSE r.t + n.n END FROM r JOIN n ON n.doc_id = r.doc_id AND n.i = r.i + 1)
"""


def line_items(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "s"))
    return docs.select("doc_id", (F.col("i") + 1).cast("long").alias("i"), "s", X.utf16_length(F.col("s")).alias("n"))


@query(_BATCH + "SELECT doc_id, b::BIGINT AS batch_id, count(*)::BIGINT AS items, sum(n)::BIGINT AS chars FROM r GROUP BY 1, 2")
def q_batches(spark, d):
    """AGG08, WIN05: greedy batches of lines, 60 items or 4000 characters."""
    b = runs.greedy_batches(line_items(spark, d).select("doc_id", "i", "n"), ["doc_id"], ["i"], "n")
    return b.groupBy("doc_id", "batch_id").agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("chars"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS i FROM documents)
SELECT doc_id, i, ' ' || '[EN]' || replace(replace(replace(trim(s), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '  ' AS en FROM l
WHERE NOT regexp_matches(s, '^[\\s0-9.,:;/\\\\%$€₮¥+()\\-–—_*#@|\\[\\]{}<>=~^&"''`№]*$')
""")
def q_demo_translate(spark, d):
    """FLT02, UDF02, STR24: the demonstration translation keeps the blanks at both ends."""
    s = F.concat(F.lit(" "), F.trim("s"), F.lit("  "))
    lines = line_items(spark, d).filter(~X.not_translatable(F.col("s")))
    return lines.select("doc_id", "i", X.with_edges(s, F.concat(F.lit("[EN]"), F.trim("s"))).alias("en"))


@query("""
SELECT event_id, regexp_replace(CASE WHEN event_id % 2 = 0 THEN 'color: red; font-family: ' || event_type || ' ; top: 1px' ELSE 'font-family: Noto Sans' END, 'font-family: ([a-z_]+) ;',
 'font-family: \\1, "Carlito", "Liberation Sans", "Noto Sans", "Noto Sans CJK JP", "Hiragino Sans", Arial, sans-serif;') AS style FROM events
""")
def q_fallback_fonts(spark, d):
    """STR21."""
    s = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("color: red; font-family: "), "event_type", F.lit(" ; top: 1px"))).otherwise("font-family: Noto Sans")
    return table(spark, d, "events").select("event_id", X.with_fallback_fonts(s).alias("style"))


@query("""
SELECT p_partkey, replace(replace(replace(replace(replace('&lt;' || p_brand || '&amp;lt; &nbsp;&quot;', '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"') AS decoded,
  ['left', 'center', 'right', NULL][p_partkey % 4 + 1] AS align, CASE WHEN p_partkey % 3 > 0 THEN 'img' || p_partkey || CASE p_partkey % 3 WHEN 1 THEN '.jpg' ELSE '.svgxml' END END AS file,
  CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS content, 'page-' || CASE WHEN p_size < 10 THEN '0' ELSE '' END || p_size || '.png' AS page,
  list_concat([p_brand]::VARCHAR[], list_transform(range(1, p_size % 5), lambda x: '')) AS cells, 'An error occurred on the server.' AS masked FROM part
""")
def q_tex_parts(spark, d):
    """STR05, STR19, STR20, STR27, ARR05, SNK03: parts of LaTeX and of replies."""
    p = F.col("p_partkey")
    style = F.element_at(F.array(*map(F.lit, ("text-align:left", "a:b; TEXT-ALIGN : Center", "text-align: right", "color:red"))), (p % 4 + 1).cast("int"))
    mime = F.element_at(F.array(*map(F.lit, ("x", "jpeg", "svg+xml"))), (p % 3 + 1).cast("int"))
    uri = F.when(p % 3 == 0, "http://x").otherwise(F.concat(F.lit("data:image/"), mime, F.lit(";base64,"), F.base64(F.col("p_brand").cast("binary"))))
    file = X.image_file(uri, p)
    return table(spark, d, "part").select(
        "p_partkey", X.decode_tex_entities(F.concat(F.lit("&lt;"), "p_brand", F.lit("&amp;lt; &nbsp;&quot;"))).alias("decoded"), X.text_align(style).alias("align"),
        file["file"].alias("file"), file["content"].cast("string").alias("content"), X.page_file(F.col("p_size")).alias("page"), X.padded(F.array("p_brand"), F.col("p_size") % 5).alias("cells"), X.masked(F.col("p_name"), True).alias("masked"),
    )


@query("""
SELECT n_nationkey::BIGINT AS doc_id, chr(10) || chr(10) || '{\\centering\\LARGE\\bfseries ' || replace(n_name, '_', '\\_') || '\\par}\\vspace{6pt}' || chr(10) || chr(10) || chr(10) || chr(10) || 'a \\& \\textbf{b}\\par' || chr(10) || chr(10)
  || chr(10) || '\\begin{center}' || chr(10) || '\\begin{tabular}{|l|l|}' || chr(10) || '\\hline' || chr(10) || '1 & 2 \\\\ \\hline' || chr(10) || '3 &  \\\\ \\hline' || chr(10) || '\\end{tabular}' || chr(10) || '\\end{center}' || chr(10)
  || '\\includegraphics[max width=\\linewidth,max height=0.4\\textheight]{img0.png}' AS body, 'img0.png:' || n_name AS image FROM nation
""")
def q_latex(spark, d):
    """BLD11, AGG04, ARR05: HTML as LaTeX source, with its images."""
    from ..sinks.latex import latex

    image = F.concat(F.lit('<img src="data:image/png;base64,'), F.base64(F.col("n_name").cast("binary")), F.lit('"/>'))
    html = F.concat(F.lit("<h1>"), "n_name", F.lit("</h1><p>a &amp; <b>b</b></p><table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>"), image)
    out = latex(table(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), html.alias("html")))
    inside = F.split_part(F.split_part("tex", F.lit("\\begin{document}\n"), F.lit(2)), F.lit("\n\\end{document}"), F.lit(1))
    return out.select("doc_id", inside.alias("body"), F.concat(F.col("images")[0]["file"], F.lit(":"), F.col("images")[0]["content"].cast("string")).alias("image"))


def _px(x: str) -> str:
    return f"regexp_replace(printf('%.2f', {x}), '\\.?0+$', '')"


@query(f"""
WITH b AS (SELECT p_partkey, p_size, p_size::DOUBLE AS s, p_retailprice::DOUBLE AS x, replace(p_name || ' <' || p_brand, '<', '&lt;') AS t FROM part)
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '' ELSE '<span class="pdf-text" style="position:absolute; left:' || {_px('floor(x * 100 + 0.5) / 100')} || 'px; top:' || {_px('200 - s')} || 'px; width:' || {_px('2 * s')} || 'px; font-size:' || {_px('s')}
  || 'px; line-height:1.05; font-family:' || CASE WHEN p_partkey % 2 = 0 THEN 'serif' ELSE 'sans-serif' END || '; white-space:pre; transform-origin:left top;">' || t || '</span>' END AS html FROM b
""")
def q_text_spans(spark, d):
    """NUM08, NUM09, BLD12: text items of a page at their places."""
    from ..functions import numbers as N

    s, zero = F.col("p_size").cast("double"), F.lit(0.0)
    box = N.text_box(F.lit(1.0), zero, zero, s, F.col("p_retailprice"), F.lit(200.0), s, F.lit(2.0))
    text = F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.concat("p_name", F.lit(" \n <"), "p_brand"))
    return table(spark, d, "part").select("p_partkey", N.text_span(text, box, F.col("p_partkey") % 2 == 0).alias("html"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '#1F497D' WHEN 2 THEN ['#000000', '#FFFFFF', '#FF0000', '#00FF00', '#0000FF', '#FFFF00', '#FF00FF', '#00FFFF'][p_size % 8 + 1] ELSE '#ABCDEF' END AS color FROM part
""")
def q_cell_colors(spark, d):
    """NUM07: automatic, theme, indexed and given colours of a cell."""
    from ..functions import numbers as N

    p = F.col("p_partkey") % 4
    color = N.cell_color(F.when(p == 0, "1"), F.when(p == 3, "FFABCDEF"), F.when(p == 1, F.lit(3)), F.lit(0.0), F.when(p == 2, F.col("p_size") % 8))
    return table(spark, d, "part").select("p_partkey", color.alias("color"))
