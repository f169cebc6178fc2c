"""Readers, sanitiser, translation and sinks on small files made here."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow import fixed
from folioflow.plans import importing, printing, services, translate
from folioflow.sinks import docx as docx_sink
from folioflow.sinks import samples, tables
from folioflow.sources import docx, html, legacy, markdown, numfmt, odf, opc, plain, pptx, styles, xlsx


def walk_tags(markup):
    return [n for n, *_ in html.walk(html.parse(markup)) if n.tag]


@pytest.mark.parametrize(("text", "want"), [
    ("---", "<hr/>"), ("----", "<p>----</p>"), ("- - -", "<hr/>"), ("**a** and *b*", "<p><strong>a</strong> and <em>b</em></p>"), ("1. a\n- b", "<ol><li>a</li></ol><ul><li>b</li></ul>"),
    ("a|b\n-|-\n1|2", '<table class="doc-datatable"><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>'),
    ("```\n<x>\n# no\n", "<pre><code>&lt;x&gt;\n# no\n</code></pre>"), ("## T\n> q\ntext\nmore", "<h2>T</h2><blockquote>q</blockquote><p>text<br/>more</p>"), ("", ""), ("_em_ ~~s~~", "<p>_em_ <s>s</s></p>"),
])
def test_markdown(text, want):
    assert markdown.to_html(text) == want


def test_sanitiser_goldens():
    assert html.sanitize_html('<form onsubmit=x><p onclick="y" class="k">a<b>c</form>') == '<p class="k">a<b>c</b></p>'
    assert html.sanitize_html("<script>alert(1)</script><svg><p>x</p></svg>ok<!-- c -->") == "ok"
    assert html.sanitize_html('<a href="//a" target="_top">x</a>') == '<a rel="noopener noreferrer">x</a>'
    assert html.sanitize_html('<img src="http://a/x.png" alt="z">') == '<img alt="z">'
    assert html.sanitize_html('<p style="color: red; foo:1; background:url(x)">t</p>') == '<p style="color: red">t</p>'
    assert html.sanitize_html("<article><nav><a href='/x'>n</a></nav></article>") == '<a href="/x" rel="noopener noreferrer">n</a>'


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b onclick=1>", "</b>", "<script>", "</script>", "x & y", "<a href='javascript:1'>", "</a>", "<form>", "<img src=x>", "<!-- c", "-->", "<td style='a:b'>", "&lt;i", "<style>a{b:url(c)}", "</style>"]), max_size=25))
def test_sanitising_keeps_to_the_policy_and_is_idempotent(parts):
    once = html.sanitize_html("".join(parts))
    assert html.sanitize_html(once) == once
    for n in walk_tags(once):
        assert n.tag in fixed.TAGS
        for k, v in n.attrs.items():
            assert not k.startswith("on") and (k in fixed.ATTRS or k in fixed.TAG_ATTRS.get(n.tag, "").split())
            assert k != "href" or html.safe_url(v, n.tag, k)


def test_text_decoding():
    assert plain.decode("Привет".encode("cp1251") * 3) == "Привет" * 3
    assert [plain.decode(b) for b in ("é".encode("utf-8-sig"), b"\xff\xfe" + "é".encode("utf-16-le"), b"\xfe\xff" + "é".encode("utf-16-be"), "é".encode())] == ["é"] * 4
    assert plain.text_html("a\nb\n\nc") == "<p>a<br/>b</p><p>c</p>" and plain.text_html("") == "<p></p>"
    assert plain.text_html('{"b":1,"a":[2]}', "json").startswith("<pre>{\n  &quot;b&quot;: 1")


def test_paths_numbers_colours():
    assert opc.resolve("xl/drawings/drawing1.xml", "../media/image1.png") == "xl/media/image1.png" and opc.resolve("a/b.xml", "/c.xml") == "c.xml"
    assert opc.number("12px") == 12 and opc.number("x", 3) == 3 and opc.emu_px("914400") == 96
    assert xlsx.reference("AA10") == (9, 26) and xlsx.box("B2:C4") == (1, 1, 3, 2) and xlsx.box("x") is None and xlsx.column_px(8.43, 7) == 59
    assert styles.tint("#4F81BD", 0) == "#4F81BD" and styles.tint("#000000", 1) == "#FFFFFF" and styles.argb("FF112233") == "#112233" and styles.argb("1") is None


def test_tolerant_xml():
    root = opc.parse_xml(b"<a><b x='1>2'>t</c></b><d>")
    assert opc.attr(opc.find(root, "b"), "x") == "1>2"


def test_sheets():
    page, warnings = xlsx.to_html(samples.xlsx("T", 3))
    assert warnings == ["sheets_hidden:1"] and "note" not in page and page.count("<tr") == 5 and ">1/4/21</td>" in page and ">3.50%</td>" in page and ">(3,234.50)</td>" in page
    assert '<td colspan="2" style="padding: 2px 4px; overflow-wrap: break-word">T &amp; co</td>' in page
    sheet = xlsx.Sheet(0, "S", {(0, 0): xlsx.Cell("n", "1", "1", None), (9, 9): xlsx.Cell("n", " ", " ", None)}, {1: (10, True, None)}, {}, [(0, 0, 0, 2)], {}, [], 50, 20)
    sheet.anchors = [{"kind": "shape", "text": "note", "from": (0, 1, 0, 0), "to": None, "pos": None, "ext": ("0", "0")}]
    page = xlsx.sheet_html(sheet, styles.Styles(None, None), {"images_placed": 0})
    assert 'colspan="2"' in page and page.count("<tr") == 1 and '1<div class="xl-shape">note</div>' in page


def test_sheet_styles():
    xml = opc.parse_xml(b'<styleSheet><fonts><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="14"/><color theme="4" tint="-0.25"/><name val="Arial"/></font></fonts><fills><fill/><fill><patternFill patternType="solid"><fgColor indexed="10"/></patternFill></fill></fills><borders><border><top style="thin"/></border></borders><cellXfs><xf fontId="1" fillId="1" borderId="0"><alignment horizontal="center" wrapText="1" indent="2"/></xf></cellXfs></styleSheet>')
    css, wrap = styles.Styles(xml, None).css(0, True)
    assert wrap and css.startswith("font-weight: 700; font-size: 14pt; color: #") and "background-color: #FF0000" in css and "border-top: 1px solid #000000" in css
    assert css.endswith("text-align: center; vertical-align: bottom; padding-left: 22px") and styles.Styles(None, None).css(5, True) == ("text-align: right", False)


def test_slides_documents_and_rich_text():
    page, _ = pptx.to_html(samples.pptx("Head", 1))
    assert page.index("Head") < page.index("point") and '<li style="margin-left:16px">' in page
    page, _ = odf.to_html(samples.odt("Head", 5))
    assert page == '<h2>Head</h2><p>a&nbsp;&nbsp;&nbsp;b<br/>c</p><table class="doc-datatable"><tbody><tr><td><p>5</p></td><td><p>5</p></td></tr></tbody></table>'
    assert legacy.doc_html(samples.doc("Привет\x13 HYPERLINK \x14там\x15\rдва\x0bстрока\r"))[0] == "<p>Приветтам</p><p>два<br/>строка</p>"
    assert legacy.doc_html(samples.doc("café\r", "cp1252"))[0] in ("<p>café</p>", "<p>cafй</p>")
    page, _ = legacy.rtf_html(rb"{\rtf1{\fonttbl{\f0 X;}}{\b bold} \u1078?\'41\par\trowd a\cell b\cell\row after\par}")
    assert page == '<p><strong>bold</strong> жA</p><table class="doc-datatable"><tbody><tr><td>a</td><td>b</td></tr></tbody></table><p>after</p>'
    with pytest.raises(ValueError):
        legacy.doc_html(b"no")


def test_docx_round_trip():
    source = '<h2>T</h2><p>a <strong>b</strong><em>c</em> <a href="http://x/">l</a></p><ul><li>i</li></ul><table><tr><td colspan="2">w</td></tr></table><img src="data:image/png;base64,AAAA">'
    page, _ = docx.to_html(docx_sink.to_docx(source, "t" * 300))
    for part in ("<h2>T</h2>", "<strong>b</strong><em>c</em>", '<a href="http://x/">l</a>', '<td colspan="2">', "data:image/png;base64,AAAA"):
        assert part in page


def test_import_of_every_kind(spark):
    files = [(i, n, b, None) for i, (n, b) in enumerate(samples.one_of_each("Peru", 7).items())]
    rows = spark.createDataFrame([*files, (99, None, None, None)], "doc_id long, name string, content binary, mime string")
    got = {r["name"]: r for r in importing.import_files(rows).collect()}
    kinds = {"a.docx": "docx", "b.xlsx": "xlsx", "c.pptx": "pptx", "d.odt": "odf", "e.doc": "doc", "q.bin": None, "r": "pdf", "s.docx": "doc", "p.docx": "docx", "o.ppt": "ppt", "n.pdf": "pdf"}
    assert {n: got[n]["kind"] for n in kinds} == kinds
    assert {n: got[n]["status"] for n in ("n.pdf", "o.ppt", "r", "p.docx", "s.docx", "q.bin")} == {"n.pdf": "unsupported", "o.ppt": "unsupported", "r": "unsupported", "p.docx": "error", "s.docx": "ok", "q.bin": "ok"}
    assert "Привет" in got["q.bin"]["html"] and got["q.bin"]["warnings"] == ["unknown_kind:bin"]
    assert "onclick" not in got["j.html"]["html"] and got[None]["status"] == "error"
    seen = importing.import_files(rows.filter("name = 'n.pdf'"), {"pdf": lambda b, m: (f"<p>{len(b)}</p>", ["fake"])}).first()
    assert (seen["status"], seen["html"], seen["warnings"]) == ("ok", "<p>13</p>", ["fake"])


def test_translation_keeps_markup_and_blanks(spark):
    pages = spark.createDataFrame([(1, "<p> Hello <b>you</b></p><pre>code</pre>12"), (2, "<p>2024-01-01</p>"), (3, "<i>x&amp;y</i>"), (4, None)], "doc_id long, html string")
    got = {r["doc_id"]: r for r in translate.translate_html(pages, "en").collect()}
    assert got[1]["html"] == "<p> [EN] Hello <b>[EN]you</b></p><pre>code</pre>12" and got[2]["html"] == "<p>2024-01-01</p>"
    assert got[3]["html"] == "<i>[EN]x&amp;y</i>" and got[4]["html"] is None

    def broken(texts, target):
        if any("x" in t for t in texts):
            raise RuntimeError("down")
        return [t.upper() for t in texts]

    got = {r["doc_id"]: r for r in translate.translate_html(pages, "ja", broken).collect()}
    assert got[3]["doc_failed"] and got[3]["first_error"] == "down" and got[3]["html"] == "<i>x&amp;y</i>" and "HELLO" in got[1]["html"]
    with pytest.raises(ValueError):
        translate.translate_html(pages, "fr")
    with pytest.raises(ValueError):
        translate.provider_of("nobody")


def test_drafts_and_errors(spark):
    rows = [("k", "<p>a</p>", None, None, 1), ("k", "<p>b</p>", None, None, 2), ("e", "<p>&nbsp;</p>", None, None, 1), ("l", "<p>a</p>", "x" * 3_500_001, None, 1)]
    got = tables.drafts_to_keep(spark.createDataFrame(rows, "key string, src string, ja string, en string, t long")).collect()
    assert [(r["key"], r["src"]) for r in got] == [("k", "<p>b</p>")]
    log = spark.createDataFrame([(i, i, "a\nb\nc\nd\ne") for i in range(30)], "ts long, id long, stack string")
    got = tables.last_errors(log).collect()
    assert [r["ts"] for r in got] == list(range(29, 9, -1)) and got[0]["stack"] == "a\nb\nc\nd"


def test_greedy_batches(spark):
    from folioflow.operators.runs import greedy_batches

    rows = [(1, i, n) for i, n in enumerate((3000, 1500, 10))] + [(2, i, n) for i, n in enumerate((5000, 1))] + [(3, i, 1) for i in range(61)]
    got = greedy_batches(spark.createDataFrame(rows, "d long, i long, n long"), ["d"], ["i"], "n").orderBy("d", "i").collect()
    assert [r["batch_id"] for r in got if r["d"] == 1] == [0, 1, 1] and [r["batch_id"] for r in got if r["d"] == 2] == [0, 1]
    assert [r["batch_id"] for r in got if r["d"] == 3] == [0] * 60 + [1]


def test_streams(spark, tmp_path):
    from folioflow import streaming

    for name, body in (("a.txt", b"one"), ("b.txt", b"one"), ("c.md", b"# two")):
        (tmp_path / name).write_bytes(body)
    files = streaming.first_copies(streaming.file_stream(spark, str(tmp_path)))
    q = streaming.import_stream(files).writeStream.format("memory").queryName("imported").option("checkpointLocation", str(tmp_path / "_cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {re.sub(r"^[ab]", "x", r["name"]): r["html"] for r in spark.table("imported").collect()}
    assert got == {"x.txt": "<p>one</p>", "c.md": "<h1>two</h1>"}
    e = spark.createDataFrame([("u", 0.0), ("u", 0.5), ("u", 5.0)], "user string, s double").selectExpr("user", "timestamp_millis(cast(s * 1000 as long)) ts")
    assert sorted(r["n_writes"] for r in streaming.draft_sessions(e, "user", "ts").collect()) == [1, 2]


@pytest.mark.parametrize(("value", "code", "want"), [
    (1234.5, "#,##0.00", "1,234.50"), (0.256, "0%", "26%"), (44197, "m/d/yy", "1/1/21"), (44197.75, "yyyy-mm-dd hh:mm:ss", "2021-01-01 18:00:00"), (44197.5, "h:mm AM/PM", "12:00 PM"),
    (1.5, "[h]:mm:ss", "36:00:00"), (-3.2, "0.0;(0.0)", "(3.2)"), (0, '0;-0;"zero"', "zero"), (1234567, "0.00E+00", "1.23E+06"), (1.25, "# ??/??", "1  1/4 "), (12345678, "#,##0,", "12,346"), (5, "000", "005"),
    (3, '0 "kg"', "3 kg"), (0.1 + 0.2, "General", "0.3"), (123456789012, "General", "1.23457E+11"), (1 / 3, "General", "0.333333333"), (60, "d mmm yyyy", "29 Feb 1900"), (61, "d mmm yyyy", "1 Mar 1900"),
    (-0.001, "0.0", "0.0"), (2.5, "0", "3"), (150, '[>=100]"big" 0;0.0', "big 150"), (1234.5, "[$\u20ac-407] #,##0.00", "\u20ac 1,234.50"), (-1, "yyyy", "########"), (44197, "dddd, mmmm d", "Friday, January 1"), (0, "", "0"),
])
def test_number_formats(value, code, want):
    assert numfmt.shown(value, code) == want


def test_number_formats_of_texts_and_the_other_date_system():
    assert numfmt.shown_text("a", '0;-0;0;"<"@">"') == "<a>" and numfmt.shown_text("a", "0.00") == "a" and numfmt.shown_text("a", "@ !") == "a !"
    assert numfmt.shown(0, "yyyy-mm-dd", True) == "1904-01-01" and numfmt.shown(1, "yyyy-mm-dd") == "1900-01-01"


def test_calls_are_retried_and_pooled_in_order():
    waits, tries = [], []

    def busy(*refusals):
        todo = list(refusals)

        def call():
            tries.append(1)
            if todo:
                raise services.Refused(todo.pop(0))
            return "done"

        return call

    assert services.retried(busy(429, 503), waits.append) == "done" and waits == [2.5, 5.0]
    with pytest.raises(services.Refused):
        services.retried(busy(500, 500, 529), waits.append)
    tries.clear()
    with pytest.raises(services.Refused):
        services.retried(busy(401), waits.append)
    assert len(tries) == 1
    assert services.pooled(lambda x: x * 2, range(20)) == [x * 2 for x in range(20)] and services.pooled(str, []) == []
    assert services.available("Claude", {"claude": "k"}) and not services.available("claude", {"claude": ""}) and not services.available(None, {"claude": "k"})


def test_reconstruction_strips_fences_and_sanitises():
    assert services.reconstructed("text", lambda t: f"```html\n<p onclick=x>{t}</p><script>y</script>\n```") == "<p>text</p>"
    for text, reply in ((" ", "<p>x</p>"), ("text", "``` \n```")):
        with pytest.raises(ValueError):
            services.reconstructed(text, lambda t, reply=reply: reply)


def test_page_translation_batches_failures_and_blanks():
    page = "<p> one &amp; two </p><pre>code</pre><p>2024</p><b>three</b>"
    assert translate.translate_page(page, "en", translate.demo) == ("<p> [EN] one &amp; two</p><pre>code</pre><p>2024</p><b>[EN]three</b>".replace("two</p>", "two </p>").replace("[EN] one", "[EN] one"), 1, 0, None)
    many = "".join(f"<p>text {i}</p>" for i in range(150))

    def some(texts, target):
        if "text 60" in texts:
            raise RuntimeError("down")
        return [t.upper() for t in texts]

    html_, n, failed, error = translate.translate_page(many, "ja", some)
    assert (n, failed, error) == (3, 1, "down") and "<p>TEXT 0</p>" in html_ and "<p>text 60</p>" in html_ and "<p>TEXT 149</p>" in html_
    assert translate.translate_page("<p>a</p>", "ja", lambda t, x: t[:0]) == ("<p>a</p>", 1, 1, "wrong number of texts")


def test_translated_rows_with_null_and_repeated_ids(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>"), (1, "<p>b</p>"), (None, "<p>c</p>"), (2, None), (3, ""), (4, "<p>1</p>")], "doc_id long, html string")
    got = sorted(((r["doc_id"] or 0, r["html"] or "", r["n_batches"], r["doc_failed"]) for r in translate.translate_html(pages, "en").collect()))
    assert got == [(0, "<p>[EN]c</p>", 1, False), (1, "<p>[EN]a</p>", 1, False), (1, "<p>[EN]b</p>", 1, False), (2, "", 0, False), (3, "", 0, False), (4, "<p>1</p>", 0, False)]
    noted = translate.translate_html(pages, "en", note=True).filter("doc_id = 1").collect()
    assert all(r["html"].startswith(translate.DEMO_NOTE) for r in noted)


def test_expressions_and_readers_follow_the_same_policy(spark):
    from pyspark.sql import functions as F

    from folioflow.functions import text as X
    from folioflow.operators import policy

    css = ["/* c */@import 'x';.a{color:1}", ".a{b:url(x)}.c{d:e}", "@media x{.c{top:1px}.d{behavior:y}}", "}x{", "@IMPORT y", "/* open", "a{b:c", ""]
    style = ["color: red; foo:1; background:url(x)", " Color : a:b ;width: expression (1)", ";;", "margin:1px"]
    urls = ["http://a", "/a", "//a", "javascript:x", " #f", "data:image/png;base64,AA==", "data:image/svg+xml;base64,AA", ""]
    lines = ["# a", "#\u3000\u984c", "####### x", "> q", "- x", "1) y", "\u0661. z", "- - -", "----", "***", "a|b", "", "\u3000", "```", "text"]
    df = lambda values: spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")
    one = lambda values, c: [r[0] for r in df(values).select(c).collect()]
    assert one(css, policy.safe_css(F.col("v"))) == [html.safe_css(x) for x in css]
    assert one(style, policy.safe_style(F.col("v"))) == [html.safe_style(x) for x in style]
    for tag, name in (("a", "href"), ("img", "src")):
        assert one(urls, policy.safe_url(F.col("v"), F.lit(tag), F.lit(name))) == [bool(x.strip()) and html.safe_url(x, tag, name) for x in urls]
    for after in ("-|-", "x"):
        assert one(lines, X.md_class(F.col("v"), F.lit(after))) == [markdown.line_class(x, after)[0] for x in lines]
    inline = ["**a** `b*c*` [x](http://y) ~~z~~ <q>", "*a**b* ![i](data:image/png;base64,AA==)", "a*b*c*d*"]
    assert one(inline, X.md_inline(F.col("v"))) == [markdown.inline(x) for x in inline]


def test_small_text_rules(spark):
    from pyspark.sql import functions as F

    from folioflow.functions import text as X

    got = spark.range(1).select(
        X.text_align(F.lit("color:red; Text-Align : CENTER")).alias("a"), X.text_align(F.lit("x")).alias("b"), X.page_file(F.lit(7)).alias("c"), X.page_file(F.lit(123)).alias("d"),
        X.image_file(F.lit("data:image/jpeg;base64,QUI="), F.lit(2)).alias("e"), X.image_file(F.lit("http://x"), F.lit(2)).alias("f"), X.masked(F.lit("secret"), True).alias("g"), X.masked(F.lit("secret"), False).alias("h"),
        X.padded(F.array(F.lit("a")), F.lit(3)).alias("i"), X.padded(F.array(F.lit("a")), F.lit(0)).alias("j"), X.trim(F.lit("\u3000 a b\u00a0\n")).alias("k"), X.trim(F.lit(" \n")).alias("l"),
    ).first()
    assert tuple(got) == ("center", None, "page-07.png", "page-123.png", ("img2.jpg", bytearray(b"AB")), None, "An error occurred on the server.", "secret", ["a", "", ""], ["a"], "a b", "")


def test_import_reports_files_that_are_too_large(spark):
    rows = [(1, "a.txt", bytearray(b"x"), None), (2, "b.bin", None, None)]
    got = {r["doc_id"]: (r["status"], r["error"]) for r in importing.import_files(spark.createDataFrame(rows, "doc_id long, name string, content binary, mime string")).collect()}
    assert got[1] == ("ok", None) and got[2][0] == "error" and "no content" in got[2][1]


def test_services_build_requests_and_read_replies():
    import json
    from urllib.parse import parse_qsl

    sent = []

    def post(reply, status=200):
        return lambda url, headers, body: sent.append((url, headers, body.decode())) or (status, reply if isinstance(reply, str) else json.dumps(reply))

    model = services.message_model("k", "m", "http://x/messages", {"v": "1"}, post({"content": [{"text": "```json\n[\"A\", "}, {"text": "2]\n```"}]}))
    assert services.json_array_provider(model)(["a", "b"], "en") == ["A", "2"]
    assert json.loads(json.loads(sent[-1][2])["messages"][0]["content"]) == ["a", "b"] and sent[-1][1]["x-api-key"] == "k" and sent[-1][1]["v"] == "1"
    with pytest.raises(ValueError):
        services.json_array_provider(lambda task, text: "[1]")(["a", "b"], "en")
    form = services.form_provider("k", "http://y/translate", {"ja": "JA"}, post({"translations": [{"text": "\u3042"}, {"text": "&"}]}))
    assert form(["a", "b&c"], "ja") == ["\u3042", "&"] and parse_qsl(sent[-1][2]) == [("text", "a"), ("text", "b&c"), ("target_lang", "JA")]
    query = services.query_provider("k", "http://z", {"en": "en"}, post({"data": {"translations": [{"translatedText": "&amp;lt; &#39;q&#39;"}]}}))
    assert query(["x"], "en") == ["< 'q'"] and sent[-1][0] == "http://z?key=k" and json.loads(sent[-1][2])["q"] == ["x"]
    with pytest.raises(services.Refused) as e:
        services.query_provider("k", "http://z", {"en": "en"}, post("busy", 429))(["x"], "en")
    assert e.value.status == 429 and "busy" in str(e.value)


def test_ways_to_a_service_configuration_and_health():
    tried = []

    def way(name, status=None):
        def call():
            tried.append(name)
            if status:
                raise services.Refused(status)
            return name

        return call

    call = services.first_that_answers(way("header", 401), way("bearer"), way("other"))
    assert call() == call() == "bearer" and tried == ["header", "bearer", "bearer"]
    with pytest.raises(services.Refused):
        services.first_that_answers(way("a", 500), way("b"))()
    known = services.configuration(None, "x", "1")
    assert known["provider"] == "demo" and known["formats"][:2] == ["docx", "docm"] and "key" not in str(known)
    assert services.health(None)["ok"] is False and services.health(lambda h: b"p")["ok"] is True

    def broken(markup):
        raise RuntimeError("down")

    assert services.health(broken)["error"] == "down"


def test_printing_in_chunks(spark):
    import io
    import zipfile

    high = lambda markups: [sum(int(x) for x in re.findall(r"h=\"?(\d+)", m)) for m in markups]
    assert printing.chunks("<p>a</p>b", lambda m: [10] * len(m)) == ["<p>a</p>b"]
    flat = '<p title="h=0">0</p><p title="h=60000">1</p><p title="h=10">2</p><p title="h=50000">3</p>'
    got = printing.chunks(flat, high)
    assert ["".join(re.findall(r">(\d)<", c)) for c in got] == ["01", "2", "3"]
    rows = "".join(f'<tr title="h=20000"><td>{i}</td></tr>' for i in range(6))
    got = printing.chunks(f'<table class="t"><colgroup><col></colgroup><thead><tr><th>h</th></tr></thead><tbody>{rows}</tbody></table>', high)
    assert len(got) == 3 and all(c.startswith('<table class="t"><colgroup><col></colgroup><thead><tr><th>h</th></tr></thead><tbody><tr') for c in got)
    assert ["".join(re.findall(r"<td>(\d)", c)) for c in got] == ["01", "23", "45"]
    renderer = printing.Renderer(lambda m: [100] * len(m), lambda m: [m.encode()] * m.count("<p>"))
    pages = spark.createDataFrame([(1, "<p onclick=x>a</p>"), (2, "<p>a</p><p>b</p>"), (None, " "), (3, None)], "doc_id long, html string")
    out = {r["doc_id"] or 0: r for r in printing.print_images(pages, renderer).collect()}
    assert (out[1]["ext"], bytes(out[1]["content"])) == ("png", b"<p>a</p>") and out[0]["status"] == out[3]["status"] == "error"
    assert out[2]["ext"] == "zip" and zipfile.ZipFile(io.BytesIO(out[2]["content"])).namelist() == ["page-01.png", "page-02.png"]


def test_expressions_equal_the_readers_own_rules(spark):
    from pyspark.sql import functions as F

    from folioflow.functions import numbers as N
    from folioflow.functions import text as X
    from folioflow.operators import votes

    def both(values, column, own):
        got = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], ["i", *(f"v{k}" for k in range(len(values[0])))]).orderBy("i").select(column).collect()
        assert [r[0] for r in got] == [own(*v) for v in values]

    both([(f"#{c}", a / 10) for c in ("000000", "FFFFFF", "4F81BD", "1F497D", "808080", "FF0000") for a in range(-9, 10, 3)], N.tint(F.col("v0"), F.col("v1")), styles.tint)
    both([(n,) for n in ("Calibri", " 'Arial' ", "Unknown Sans", "TIMES NEW ROMAN")], X.font_stack(F.col("v0")), styles.font_stack)
    both([(x,) for x in ("a\nb\n\nc", "", " \n\n ", "x\r\n\r\ny <&>\"", "\u3000one\u00a0\n\n\n\ntwo ")], X.text_to_html(F.col("v0")), plain.text_html)
    both([(c, 8.43 + c / 7, 7) for c in range(5)], N.column_px(F.col("v1"), F.col("v2")), lambda c, w, d: xlsx.column_px(w, d))
    both([(x,) for x in ("  ```html\n<b>x</b>\n``` ", "```json\n[1]```", "plain", "``` x")], X.strip_fences(F.col("v0")), services.without_fences)
    texts = ["\u041f\u0440\u0438\u0432\u0435\u0442".encode("cp1251"), "caf\u00e9 \u201cx\u201d".encode("cp1252"), b"ascii", "\u0451\u0401".encode("cp1251"), b"\x80\xc0"]
    rows = spark.createDataFrame([(i, b) for i, t in enumerate(texts) for b in t], "doc int, b int")
    got = dict(votes.cyrillic_share(rows, ["doc"]).collect())
    assert got == {i: {"cp1251": "windows-1251", "cp1252": "windows-1252"}[legacy.codepage([t])] for i, t in enumerate(texts)}
