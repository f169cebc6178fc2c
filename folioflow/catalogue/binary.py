"""Queries on files: packages are made from tables, then read. What they hold is known, so SQL can say what comes out."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query, table


def files(spark, d):
    """One small file of each kind for every nation, made on the executors."""
    from ..sinks.samples import sample_files

    return sample_files(table(spark, d, "nation"))


_PAD = "padding: 2px 4px; overflow-wrap: break-word"
_FONT = "font-family: ''Calibri'', ''Carlito'', ''Noto Sans'', ''Noto Sans CJK JP'', sans-serif"
_RIGHT = f"{_FONT}; text-align: right; vertical-align: bottom; {_PAD}"
_TD = f"<td style=\"{_PAD}\">' || n_name || ' &amp; co</td>"
_BOOK = (
    "<h2 class=\"xl-sheet-title\">Main</h2><table class=\"xl-sheet\" style=\"width: 118px; table-layout: fixed; border-collapse: collapse\"><colgroup><col style=\"width: 59px\"><col style=\"width: 59px\"></colgroup><tbody>"
    f"<tr style=\"height: 20px\"><td colspan=\"2\" style=\"{_PAD}\">' || n_name || ' &amp; co</td></tr>"
    f"<tr style=\"height: 20px\">{_TD}<td style=\"text-align: right; {_PAD}\">' || n_nationkey * 2 || '</td></tr><tr style=\"height: 20px\">{_TD}<td style=\"text-align: right; {_PAD}\">' || n_nationkey * 3 || '</td></tr>"
    f"<tr style=\"height: 20px\"><td style=\"{_RIGHT}\">' || day || '</td><td style=\"{_RIGHT}\">' || share || '</td></tr><tr style=\"height: 20px\"><td style=\"{_RIGHT}\">(' || money || ')</td><td style=\"{_PAD}\">TRUE</td></tr></tbody></table>"
)
#: Dates, shares and amounts as their number formats show them.
_SHOWN = """n AS (SELECT n_nationkey, n_name, strftime(DATE '2021-01-01' + n_nationkey, '%-m/%-d/%y') AS day, n_nationkey || '.50%' AS share,
  CASE WHEN n_nationkey = 0 THEN '234.50' ELSE n_nationkey || ',234.50' END AS money FROM nation)"""
#: name, kind and html of each file; html null where there is no reader.
_HTML = {
    ("a.docx", "docx"): "<h1>{}</h1><p>x <strong>y</strong></p><table class=\"doc-datatable\"><tbody><tr><td><p>[]</p></td></tr></tbody></table>",
    ("b.xlsx", "xlsx"): None,
    ("c.pptx", "pptx"): "<section class=\"pptx-slide\"><div class=\"pptx-slide-no\">Slide 1</div><h2 class=\"pptx-title\"><strong>{}</strong></h2><ul><li style=\"margin-left: 16px\"><strong>point</strong></li></ul></section>",
    ("d.odt", "odf"): "<h2>{}</h2><p>a&nbsp;&nbsp;&nbsp;b<br>c</p><table class=\"doc-datatable\"><tbody><tr><td><p>[]</p></td><td><p>[]</p></td></tr></tbody></table>",
    ("e.doc", "doc"): "<p>Привет {}</p><p>line two</p>",
    ("f.rtf", "rtf"): "<p><strong>{}</strong></p><p>second <em>it</em></p>",
    ("g.csv", "csv"): "<table class=\"doc-datatable\"><tbody><tr><td>{}</td><td>x,y</td></tr><tr><td>1</td><td>2</td></tr></tbody></table>",
    ("h.tsv", "csv"): "<table class=\"doc-datatable\"><tbody><tr><td>{}</td><td>z</td></tr></tbody></table>",
    ("i.md", "markdown"): "<h1>{}</h1><ul><li>a</li><li>b</li></ul><table class=\"doc-datatable\"><thead><tr><th>x</th><th>y</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>",
    ("j.html", "html"): "<style>p{top:1px}</style><p>{}</p>",
    ("k.txt", "text"): "<p>{}</p><p>next</p>",
    ("l.json", "text"): "<pre>{\n  &quot;a&quot;: &quot;{}&quot;\n}</pre>",
    ("q.bin", ""): "<p>Привет {}</p>",
    ("s.docx", "doc"): "<p>{}</p>",
}
_WARNED = {"b.xlsx": "sheets_hidden:1", "c.pptx": "slides:1", "e.doc": "text_only", "m.png": "image_text_not_read", "q.bin": "unknown_kind:bin", "s.docx": "text_only"}


def _of(name: str, kind: str, html: str, status: str = "ok") -> str:
    kind = f"'{kind}'" if kind else "NULL"
    return f"SELECT n_nationkey || '-{name}' AS name, {kind} AS kind, '{status}' AS status, {html} AS html, '{_WARNED.get(name, '')}' AS warnings FROM n"


def _sql(text: str) -> str:
    return "'" + text.replace("\n", "' || chr(10) || '").replace("{}", "' || n_name || '").replace("[]", "' || n_nationkey || '") + "'"


_FILES = [_of(name, kind, f"'{_BOOK}'" if html is None else _sql(html)) for (name, kind), html in _HTML.items()]
_FILES.append(_of("m.png", "image", "'<figure><img src=\"data:image/png;base64,' || to_base64(unhex('89504E470D0A1A0A') || encode(n_name)) || '\" style=\"max-width: 100%\"><figcaption>Image</figcaption></figure>'"))
_FILES += [_of(name, kind, "NULL", status) for name, kind, status in (("n.pdf", "pdf", "unsupported"), ("r", "pdf", "unsupported"), ("o.ppt", "ppt", "unsupported"), ("p.docx", "docx", "error"))]


@query("WITH " + _SHOWN + " " + " UNION ALL ".join(_FILES))
def q_import_files(spark, d):
    """SRC02-04, SRC06-10, SRC14-15, SRC17-24, BLD01-10, FLT09: every kind of file through the dispatcher, as clean HTML; errors are data."""
    from ..plans.importing import import_files

    out = import_files(files(spark, d))
    return out.select("name", "kind", "status", "html", F.array_join("warnings", ";").alias("warnings"))


@query(f"""
WITH {_SHOWN}, r AS (SELECT *, unnest(range(0, 3))::INT AS row FROM n),
c AS (SELECT n_nationkey, row, 0 AS col, 's' AS cell_type, n_name || ' & co' AS value, NULL::INT AS style_idx, n_name || ' & co' AS text, n_name || ' &amp; co' AS html FROM r
  UNION ALL SELECT n_nationkey, row, 1, 'n', (n_nationkey * (row + 1))::VARCHAR, NULL, (n_nationkey * (row + 1))::VARCHAR, (n_nationkey * (row + 1))::VARCHAR FROM r
  UNION ALL SELECT n_nationkey, row, 2, 'str', 'note ' || (row + 1), NULL, 'note ' || (row + 1), 'note ' || (row + 1) FROM r
  UNION ALL SELECT n_nationkey, 3, 0, 'n', (44197 + n_nationkey)::VARCHAR, 1, day, day FROM n
  UNION ALL SELECT n_nationkey, 3, 1, 'n', '0.' || lpad(n_nationkey::VARCHAR, 2, '0') || '5', 2, share, share FROM n
  UNION ALL SELECT n_nationkey, 3, 2, 's', 'plain ' || n_name, NULL, 'plain ' || n_name, 'plain <i><b>' || n_name || '</b></i>' FROM n
  UNION ALL SELECT n_nationkey, 4, 0, 'n', '-' || n_nationkey || '234.5', 3, '(' || money || ')', '(' || money || ')' FROM n
  UNION ALL SELECT n_nationkey, 4, 1, 'b', 'TRUE', NULL, 'TRUE', 'TRUE' FROM n)
SELECT (n_nationkey * 100 + 1)::BIGINT AS doc_id, 0 AS sheet_no, row, col, cell_type, value, style_idx, text, html FROM c
""")
def q_sheet_cells(spark, d):
    """SRC10-11, STR26: cells of workbooks as rows, as stored and as their number formats and rich text show them."""
    from ..sources.xlsx import cells

    return cells(files(spark, d).filter("name like '%.xlsx'"))


@query("""
SELECT (n_nationkey * 100 + 2)::BIGINT AS doc_id, 0 AS slide, 0 AS ord, 'text' AS kind, 10::BIGINT AS y, 0::BIGINT AS x, true AS is_title, '<p><strong>' || n_name || '</strong></p>' AS html FROM nation
UNION ALL SELECT n_nationkey * 100 + 2, 0, 1, 'text', 900 + n_nationkey, 0, false, '<ul><li style="margin-left:16px"><strong>point</strong></li></ul>' FROM nation
""")
def q_slide_items(spark, d):
    """SRC14, BLD05-08: items of slides as rows in reading order."""
    from ..sources.pptx import items

    return items(files(spark, d).filter("name like '%.pptx'"))
