"""HTML to Word packages."""

from __future__ import annotations

import base64
import io
import re
import zipfile
from html import unescape
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.html import Node, parse, sanitize_tree

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_REL = "http://schemas.openxmlformats.org/package/2006/relationships"
_MARKS = {"strong": "b", "b": "b", "em": "i", "i": "i", "u": "u", "s": "strike"}
MARGIN = 1440  # twips
_BLOCKS = set("p div h1 h2 h3 h4 h5 h6 li blockquote pre figure figcaption section dt dd caption".split())


class _Writer:
    def __init__(self) -> None:
        self.out: list[str] = []
        self.rels: list[tuple[str, str, bool]] = []
        self.media: list[tuple[str, bytes]] = []
        self.runs: list[str] = []

    def run(self, text: str, marks: tuple[str, ...]) -> None:
        text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
        if text:
            props = "".join('<w:u w:val="single"/>' if m == "u" else f"<w:{m}/>" for m in marks)
            self.runs.append(f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{escape(text)}</w:t></w:r>')

    def rel(self, kind: str, target: str, external: bool) -> str:
        self.rels.append((kind, target, external))
        return f"rId{len(self.rels)}"

    def flush(self, style: str = "") -> None:
        if self.runs:
            props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
            self.out.append(f"<w:p>{props}{''.join(self.runs)}</w:p>")
            self.runs = []

    def walk(self, node: Node, marks: tuple[str, ...] = (), style: str = "", depth: int = 0) -> None:
        for k in node.kids:
            if not k.tag:
                self.run(unescape(k.text) if node.tag == "pre" else re.sub(r"\s+", " ", unescape(k.text)), marks)
            elif k.tag == "style" or depth > 200:
                continue
            elif k.tag == "br":
                self.runs.append("<w:r><w:br/></w:r>")
            elif k.tag == "hr":
                self.flush(style)
                brk = '<w:r><w:br w:type="page"/></w:r>' if "page-break" in k.attrs.get("class", "") else "<w:r><w:t>———</w:t></w:r>"
                self.out.append(f"<w:p>{brk}</w:p>")
            elif k.tag == "img":
                self.image(k.attrs.get("src", ""))
            elif k.tag == "a" and re.match("https?:|mailto:", k.attrs.get("href", "")):
                held, self.runs = self.runs, []
                self.walk(k, marks, style, depth + 1)
                link = self.rel("hyperlink", k.attrs["href"], True)
                self.runs = [*held, f'<w:hyperlink r:id="{link}">{"".join(self.runs)}</w:hyperlink>']
            elif k.tag == "table":
                self.flush(style)
                self.table(k, depth)
            elif k.tag in _BLOCKS:
                self.flush(style)
                own = f"Heading{k.tag[1]}" if re.fullmatch("h[1-6]", k.tag) else {"li": "ListParagraph", "blockquote": "Quote"}.get(k.tag, style)
                if k.tag == "li":
                    self.run("• ", ())
                self.walk(k, marks, own, depth + 1)
                self.flush(own)
            else:
                self.walk(k, (*marks, _MARKS[k.tag]) if k.tag in _MARKS and _MARKS[k.tag] not in marks else marks, style, depth + 1)

    def table(self, node: Node, depth: int) -> None:
        rows, todo = [], [node]
        while todo:
            x = todo.pop()
            if x.tag == "tr":
                rows.append(x)
            else:
                todo.extend(reversed([k for k in x.kids if k.tag in ("tr", "thead", "tbody", "tfoot")]))
        body = ""
        for tr in rows:
            cells = ""
            for td in (k for k in tr.kids if k.tag in ("td", "th")):
                inner = _Writer()
                inner.rels, inner.media = self.rels, self.media
                inner.walk(td, ("b",) if td.tag == "th" else (), "", depth + 1)
                inner.flush()
                n = td.attrs.get("colspan", "1")
                span = f'<w:tcPr><w:gridSpan w:val="{n}"/></w:tcPr>' if n.isdigit() and int(n) > 1 else ""
                cells += f"<w:tc>{span}{''.join(inner.out)}<w:p/></w:tc>"
            body += f"<w:tr>{cells}</w:tr>" if cells else ""
        if body:
            self.out.append(f"<w:tbl><w:tblPr/>{body}</w:tbl>")

    def image(self, src: str) -> None:
        m = re.fullmatch(r"data:image/([a-z]+);base64,([A-Za-z0-9+/=\s]+)", src, re.I)
        if not m:
            return
        name = f"image{len(self.media) + 1}.{m[1].lower()}"
        try:
            self.media.append((name, base64.b64decode(m[2])))
        except ValueError:
            return
        link, size = self.rel("image", f"media/{name}", False), 'cx="2857500" cy="1905000"'
        self.runs.append(
            f'<w:r><w:drawing><wp:inline><wp:extent {size}/><wp:docPr id="{len(self.media)}" name="{name}"/><a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/picture">'
            f'<pic:pic><pic:nvPicPr><pic:cNvPr id="0" name="{name}"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="{link}"/></pic:blipFill>'
            f'<pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext {size}/></a:xfrm><a:prstGeom prst="rect"/></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'
        )


def to_docx(html: str, title: str) -> bytes:
    """Portrait page with margins of one inch; the title is cut to 120 characters."""
    w = _Writer()
    w.walk(sanitize_tree(parse(html or "")))
    w.flush()
    page = f'<w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="{MARGIN}" w:right="{MARGIN}" w:bottom="{MARGIN}" w:left="{MARGIN}"/></w:sectPr>'
    spaces = f'xmlns:w="{_W}" xmlns:r="{_R}" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"'
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{i}"><w:name w:val="heading {i}"/></w:style>' for i in range(1, 7))
    styles += '<w:style w:type="paragraph" w:styleId="Quote"><w:name w:val="Quote"/></w:style><w:style w:type="paragraph" w:styleId="ListParagraph"><w:name w:val="List Paragraph"/></w:style>'
    rel = lambda i, kind, target, external: f'<Relationship Id="{i}" Type="{_R}/{kind}" Target="{escape(target, {chr(34): "&quot;"})}"{" TargetMode=" + chr(34) + "External" + chr(34) if external else ""}/>'
    own = "".join(rel(f"rId{i}", *r) for i, r in enumerate(w.rels, 1)) + rel("rIdStyles", "styles", "styles.xml", False)
    types = "".join(f'<Default Extension="{e}" ContentType="{t}"/>' for e, t in (("rels", "application/vnd.openxmlformats-package.relationships+xml"), ("xml", "application/xml"), ("png", "image/png"), ("jpeg", "image/jpeg"), ("jpg", "image/jpeg"), ("gif", "image/gif"), ("bmp", "image/bmp"), ("webp", "image/webp")))
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">{types}<Override PartName="/word/document.xml" ContentType="{main}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{main}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_REL}">{rel("rId1", "officeDocument", "word/document.xml", False)}</Relationships>',
        "docProps/core.xml": f'<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title or "")[:120]}</dc:title></cp:coreProperties>',
        "word/document.xml": f"<w:document {spaces}><w:body>{''.join(w.out)}{page}</w:body></w:document>",
        "word/styles.xml": f"<w:styles {spaces}>{styles}</w:styles>",
        "word/_rels/document.xml.rels": f'<Relationships xmlns="{_REL}">{own}</Relationships>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), head + text)
        for name, raw in w.media:
            z.writestr(zipfile.ZipInfo(f"word/media/{name}", (1980, 1, 1, 0, 0, 0)), raw)
    return out.getvalue()


def docx_files(pages: DataFrame) -> DataFrame:
    """(doc_id, content) of ``pages`` (doc_id, html, title)."""

    def run(batches):
        for b in batches:
            made = [to_docx(h, t) for h, t in zip(b.column("html").to_pylist(), b.column("title").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "content"])

    return pages.select("doc_id", "html", "title").mapInArrow(run, "doc_id long, content binary")
