"""Queries on web pages: body, styles, segments, translation, links, policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import classify, policy
from ..plans import pages as P
from . import query, table

_BODY = "SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<body[^>]*>(.*?)</body>') THEN regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1) ELSE html END AS body, html FROM pages"


@query(f"WITH b AS ({_BODY}) SELECT page_id, body, array_to_string(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1), chr(10)) AS styles FROM b")
def q_html_body(spark, d):
    """SRC20: the body, or all of a page without one, and the text of its style elements."""
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", P.body(h).alias("body"), P.styles(h).alias("styles"))


_SEG = f"""b AS ({_BODY}), c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '(?is)<!--.*?-->', '', 'g'), '(?is)<script[^>]*>.*?</script>', '', 'g'),
 '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?is)<pre[^>]*>.*?</pre>', '', 'g'), '(?is)<code[^>]*>.*?</code>', '', 'g') AS t FROM b),
s AS (SELECT page_id, unnest(string_split_regex(t, '<[^>]*>')) AS x, generate_subscripts(string_split_regex(t, '<[^>]*>'), 1) AS idx FROM c),
t AS (SELECT page_id, idx::BIGINT AS idx, x AS text FROM s WHERE regexp_matches(x, '\\S') AND NOT regexp_matches(x, '^[\\s0-9.,:;/\\\\%$€₮¥+()\\-–—_*#@|\\[\\]{{}}<>=~^&"''`№]*$'))"""


@query(f"WITH {_SEG} SELECT page_id, idx, text FROM t")
def q_text_segments(spark, d):
    """FLT01, FLT02: text between tags that is to be translated."""
    return P.segments(table(spark, d, "pages"))


@query(f"""
WITH RECURSIVE {_SEG}, n AS (SELECT page_id, text, length(text) AS n, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS k FROM t),
r AS (SELECT page_id, k, 0 AS b, 1 AS c, n AS s FROM n WHERE k = 1 UNION ALL SELECT n.page_id, n.k, CASE WHEN r.c >= 60 OR r.s + n.n > 4000 THEN r.b + 1 ELSE r.b END,
  CASE WHEN r.c >= 60 OR r.s + n.n > 4000 THEN 1 ELSE r.c + 1 END, CASE WHEN r.c >= 60 OR r.s + n.n > 4000 THEN n.n ELSE r.s + n.n END FROM r JOIN n ON n.page_id = r.page_id AND n.k = r.k + 1)
SELECT r.page_id, count(*)::BIGINT AS n_segments, (max(b) + 1)::BIGINT AS n_batches, sum(n.n)::BIGINT AS n_chars, sum(length(n.text) + 4)::BIGINT AS n_translated
FROM r JOIN n ON n.page_id = r.page_id AND n.k = r.k GROUP BY 1
""")
def q_page_pipeline(spark, d):
    """The flagship: pages to segments to batches to a translation, counted by page."""
    t = P.translate_segments(P.segments(table(spark, d, "pages")), "en")
    return t.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_segments"), (F.max("batch_id") + 1).alias("n_batches"), F.sum(X.utf16_length(F.col("text"))).alias("n_chars"), F.sum(F.length("raw")).cast("long").alias("n_translated")
    )


_A = "a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS url, generate_subscripts(regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1), 1)::BIGINT AS i FROM pages)"


@query(f"WITH {_A} SELECT page_id, i, url, regexp_matches(trim(url), '(?i)^(https?:|mailto:|tel:|#)') OR (url LIKE '/%' AND url NOT LIKE '//%') AS safe FROM a")
def q_links(spark, d):
    """FLT05, FLT08: links and whether their target may stay."""
    a = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("i", "url"))
    return a.select("page_id", (F.col("i") + 1).cast("long").alias("i"), "url", policy.safe_url(F.col("url"), F.lit("a"), F.lit("href")).alias("safe"))


@query("""
WITH v AS (SELECT p_partkey, ['http://a', '/a', '//a', 'javascript:x', '#f', 'mailto:x@y', ' HTTPS://b', 'ftp://c', '', 'data:image/png;base64,AAAA'][p_partkey % 10 + 1] AS url, p_partkey % 2 = 0 AS img FROM part)
SELECT p_partkey, CASE WHEN img THEN url LIKE 'data:image/png;base64,%' ELSE regexp_matches(trim(url), '(?i)^(https?:|mailto:|tel:|#)') OR (url LIKE '/%' AND url NOT LIKE '//%') END AS safe FROM v
""")
def q_safe_url(spark, d):
    """FLT05 on made URLs."""
    urls = ("http://a", "/a", "//a", "javascript:x", "#f", "mailto:x@y", " HTTPS://b", "ftp://c", "", "data:image/png;base64,AAAA")
    p = F.col("p_partkey")
    img = p % 2 == 0
    url = F.element_at(F.array(*map(F.lit, urls)), (p % 10 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", policy.safe_url(url, F.when(img, "img").otherwise("a"), F.when(img, "src").otherwise("href")).alias("safe"))


@query("""
SELECT p_partkey, 'color: ' || p_brand || CASE WHEN p_size % 2 = 0 THEN '; width: ' || p_size || 'px' ELSE '' END AS style,
  '.a{color:' || p_size || '}' || CASE WHEN p_size % 3 = 0 THEN '' ELSE '.b{top:1px}' END AS css FROM part
""")
def q_safe_css(spark, d):
    """FLT06, FLT07."""
    n = F.col("p_size").cast("string")
    style = F.concat(F.lit(" Color : "), "p_brand", F.lit(";foo:1;background:url(x); noise"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(";width:"), n, F.lit("px"))).otherwise(F.lit(";width: expression (1)")))
    css = F.concat(F.lit("/* c */@import 'x';.a{color:"), n, F.lit("}"), F.when(F.col("p_size") % 3 == 0, ".b{background:url(x)}").otherwise(".b{top:1px}"))
    return table(spark, d, "part").select("p_partkey", policy.safe_style(style).alias("style"), policy.safe_css(css).alias("css"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '/' || c_name END AS href, 'noopener noreferrer' AS rel, CASE WHEN c_custkey % 3 = 0 THEN '_blank' END AS target, c_mktsegment AS title, 2::BIGINT + (c_custkey % 2 = 0)::BIGINT + (c_custkey % 3 = 0)::BIGINT AS n FROM customer
""")
def q_attr_policy(spark, d):
    """FLT04, FLT08: attributes of links."""
    c = F.col("c_custkey")
    attrs = F.create_map(
        F.lit("href"), F.when(c % 2 == 0, F.concat(F.lit("/"), "c_name")).otherwise(F.lit("javascript:1")), F.lit("onclick"), F.lit("x"), F.lit("rel"), F.lit("me"),
        F.lit("target"), F.when(c % 3 == 0, "_blank").otherwise("_top"), F.lit("title"), F.col("c_mktsegment"),
    )
    m = policy.safe_attrs(F.lit("a"), attrs)
    get = lambda k: F.try_element_at(m, F.lit(k)).alias(k)
    return table(spark, d, "customer").select("c_custkey", get("href"), get("rel"), get("target"), get("title"), F.size(m).cast("long").alias("n"))


_T = "t AS (SELECT page_id, unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)"


@query(f"""WITH {_T} SELECT page_id, tag, count(*)::BIGINT AS n, CASE WHEN tag IN ('script','noscript','iframe','object','embed','svg','math') THEN 'drop'
 WHEN tag IN ('a','b','blockquote','br','caption','code','col','colgroup','dd','div','dl','dt','em','figcaption','figure','h1','h2','h3','h4','h5','h6','hr','i','img','li','ol','p','pre','s','section','small','span','strong','style','sub','sup','table','tbody','td','tfoot','th','thead','tr','u','ul') THEN 'keep' ELSE 'unwrap' END AS action FROM t GROUP BY 1, 2""")
def q_tag_policy(spark, d):
    """FLT03, JON13, SET02: what becomes of each tag."""
    t = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all(F.lower("html"), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return t.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n")).withColumn("action", policy.tag_action(F.col("tag")))


@query(f"WITH {_T} SELECT page_id, count(*)::BIGINT AS nodes, count(*) FILTER (WHERE tag = 'table')::BIGINT AS tables, count(*) FILTER (WHERE tag = 'tr')::BIGINT AS rows, count(*) FILTER (WHERE tag = 'img')::BIGINT AS images FROM t GROUP BY 1")
def q_page_stats(spark, d):
    """AGG12."""
    t = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all(F.lower("html"), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    count = lambda tag: F.count_if(F.col("tag") == tag)
    return t.groupBy("page_id").agg(F.count(F.lit(1)).alias("nodes"), count("table").alias("tables"), count("tr").alias("rows"), count("img").alias("images"))


@query("SELECT page_id, lower(regexp_extract(url, '\\.([^.]*)$', 1)) AS ext, CASE WHEN regexp_matches(url, '(?i)\\.x?html?$') THEN 'html' END AS kind FROM pages")
def q_kind_by_ext(spark, d):
    """SRC03, JON01."""
    e = classify.extension(F.col("url"))
    return table(spark, d, "pages").select("page_id", e.alias("ext"), classify.kind_of_extension(e).alias("kind"))


@query("""
SELECT n_nationkey, [NULL, 'pdf', 'rtf', 'image', 'image', 'image', 'image', 'image', 'ppt'][n_nationkey % 9 + 1] AS sniffed,
  CASE n_nationkey % 9 WHEN 0 THEN 'docx' WHEN 8 THEN 'ppt' WHEN 1 THEN 'pdf' WHEN 2 THEN 'rtf' ELSE 'image' END AS kind FROM nation
""")
def q_magic_sniff(spark, d):
    """SRC04-06, BIN01: leading bytes, compound files, and what wins over the name."""
    heads = ("616263", "255044462D", "7B5C72746631", "89504E470D", "FFD8FFE0", "4749463839", "424D3638", "52494646000000005745425000", "D0CF11E0" + "00" * 8 + "00".join(f"{ord(c):02X}" for c in "PowerPoint"))
    content = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("n_nationkey") % 9 + 1).cast("int")))
    s, cfb = classify.sniff(content), classify.cfb_kind(content)
    return table(spark, d, "nation").select("n_nationkey", F.when(s == "cfb", cfb).otherwise(s).alias("sniffed"), classify.resolve(F.lit("docx"), s, cfb).alias("kind"))


@query(name="q_sanitize")
def q_sanitize(spark, d):
    """FLT03-09: sanitised pages. Tree repair of any page is beyond SQL; q_sanitize_made has pages whose result is known."""
    from ..sources.html import sanitize

    return sanitize(table(spark, d, "pages"), "page_id", "html").select("page_id", F.length("html").cast("long").alias("n_chars"), F.crc32(F.col("html").cast("binary")).alias("crc"))


@query(name="q_html_nodes")
def q_html_nodes(spark, d):
    """FLT01, WIN08: nodes in document order with the skip flag carried down."""
    from ..sources.html import nodes

    return nodes(table(spark, d, "pages"), "page_id", "html").drop("attrs")


@query(name="q_translate_html")
def q_translate_html(spark, d):
    """UDF06: whole pages translated by the demonstration provider, node by node, and put together again."""
    from ..plans.translate import translate_html

    out = translate_html(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "html"), "ja")
    return out.select("doc_id", "n_batches", "doc_failed", F.length("html").cast("long").alias("n_chars"))


def _made(spark, d, html):
    """A page for each nation."""
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), html.alias("html"))


@query("""SELECT n_nationkey::BIGINT AS doc_id, '<p class="k" style="color: red">' || n_name || '<b>c</b></p><a rel="noopener noreferrer">z</a><img alt="i"><style>.a{top:1px}</style><ul><li>1</li><li>2</li></ul>' AS html FROM nation""")
def q_sanitize_made(spark, d):
    """FLT03-09: attributes, styles, links, unwrapped and dropped elements, open and overlapping tags."""
    from ..sources.html import sanitize

    head = F.lit('<form onsubmit=x><p onclick="y" class="k" style="color: red; foo:1; background:url(x)">')
    tail = F.lit('<b>c</form><script>alert(1)</script><a href="javascript:1" target="_top">z</a><svg><p>x</p></svg><!-- c --><img src="http://a/x.png" alt="i"><style>/* c */.a{top:1px}.b{behavior:y}</style><ul><li>1<li>2</ul>')
    return sanitize(_made(spark, d, F.concat(head, "n_name", tail)), "doc_id", "html")


@query("""
WITH v(idx, parent, depth, node_type, tag, text, in_skip) AS (VALUES (0, -1, 0, 'element', 'p', NULL, false), (1, 0, 1, 'text', NULL, '@ & ', false), (2, 0, 1, 'element', 'b', NULL, false),
  (3, 2, 2, 'text', NULL, 'x&copy;', false), (4, -1, 0, 'element', 'pre', NULL, false), (5, 4, 1, 'text', NULL, '1', true), (6, 4, 1, 'element', 'i', NULL, true), (7, 6, 2, 'text', NULL, '2', true), (8, -1, 0, 'text', NULL, ' end', false))
SELECT n_nationkey::BIGINT AS doc_id, idx::BIGINT AS idx, parent::BIGINT AS parent, depth, node_type, tag, replace(text, '@', n_name) AS text, in_skip FROM nation, v
""")
def q_nodes_made(spark, d):
    """FLT01, WIN08, STR04, BLD: nodes in document order; entities are decoded once, six of them by name."""
    from ..sources.html import nodes

    page = F.concat(F.lit("<p>"), "n_name", F.lit(" &amp; <b>x&copy;</b></p><pre>&#49;<i>2</i></pre> end"))
    return nodes(_made(spark, d, page), "doc_id", "html").drop("attrs")


@query("""
SELECT n_nationkey::BIGINT AS doc_id, CASE WHEN n_nationkey % 3 = 0 THEN '<p>2024-01-01</p>' ELSE '<p> 【JA】 ' || n_name || ' &amp; co </p><pre>code</pre>12<b>【JA】x</b>' END AS html,
  (n_nationkey % 3 <> 0)::BIGINT AS n_batches, 0::BIGINT AS n_failed, false AS doc_failed, NULL::VARCHAR AS first_error FROM nation
""")
def q_translate_made(spark, d):
    """UDF06, AGG17, FLT13: text nodes translated in place; a page without any comes back as it is."""
    from ..plans.translate import translate_html

    page = F.concat(F.lit("<p> "), "n_name", F.lit(" &amp; co </p><pre>code</pre>12<b>x</b>"))
    return translate_html(_made(spark, d, F.when(F.col("n_nationkey") % 3 == 0, "<p>2024-01-01</p>").otherwise(page)), "ja")


@query("""
SELECT n_nationkey::BIGINT AS doc_id, '<h1>' || n_name || '</h1><ul><li>a</li><li><strong>b</strong></li></ul><ol><li>c</li></ol><p>text ' || n_name || '<br/>----</p><hr/><pre><code>&lt;x&gt;' || chr(10) || '# no</code></pre>'
  || '<table class="doc-datatable"><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table><blockquote>q</blockquote><h2>全角</h2>' AS html FROM nation
""")
def q_markdown_made(spark, d):
    """SRC19, STR11-14, WIN04, WIN06-07: blocks of every kind."""
    from ..sources.markdown import markdown_html

    text = F.concat(F.lit("# "), "n_name", F.lit("\n\n- a\n* **b**\n1. c\ntext "), "n_name", F.lit("\n----\n\n- - -\n```\n<x>\n# no\n```\n|a|b|\n|-|:-|\n|1|2|\n> q\n##\u3000全角"))
    return markdown_html(_made(spark, d, text).withColumnRenamed("html", "text"), "doc_id", "text")


@query(name="q_markdown_html")
def q_markdown_html(spark, d):
    """SRC19: Markdown to HTML; the line machine is beyond SQL, its rules are queried above."""
    from ..sources.markdown import markdown_html

    return markdown_html(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


