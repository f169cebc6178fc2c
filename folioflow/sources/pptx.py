"""Presentations: items of slides as rows, and slides as HTML."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ..fixed import GROUP_DEPTH
from .markdown import escape
from .opc import Package, attr, emu_px, find, find_all, integer, kid, kids, local, text_of


def _run(r) -> str:
    text, props = escape(text_of(kid(r, "t"))), kid(r, "rPr")
    if text and props is not None:
        under = attr(props, "u") or "none"
        for on, tag in ((attr(props, "b") == "1", "strong"), (attr(props, "i") == "1", "em"), (under != "none", "u")):
            text = f"<{tag}>{text}</{tag}>" if on else text
    return text


def blocks(body) -> list[tuple[str, int, bool]]:
    """(html, level, bulleted) of each paragraph."""
    out = []
    for p in kids(body, "p"):
        props = kid(p, "pPr")
        parts = {"r": _run, "br": lambda e: "<br/>", "fld": lambda e: escape(text_of(kid(e, "t")))}
        html = "".join(parts[local(k.tag)](k) for k in kids(p) if local(k.tag) in parts)
        out.append((html, integer(attr(props, "lvl")), props is not None and kid(props, "buNone") is None))
    return out


def blocks_html(items: list[tuple[str, int, bool]]) -> str:
    """Runs of bulleted blocks are lists; blank blocks don't end a run."""
    out, listed = [], False
    for html, level, bulleted in items:
        if not html.strip():
            continue
        if bulleted != listed:
            out.append("<ul>" if bulleted else "</ul>")
            listed = bulleted
        indent = f' style="margin-left:{level * 16}px"' if level else ""
        out.append(f"<li{indent}>{html}</li>" if bulleted else f"<p>{html}</p>")
    return "".join(out) + "</ul>" * listed


def table_html(tbl) -> str:
    rows = []
    for tr in kids(tbl, "tr"):
        row = ""
        for tc in kids(tr, "tc"):
            if "1" in (attr(tc, "hMerge"), attr(tc, "vMerge")):
                continue
            span = "".join(f' {name}="{n}"' for name, key in (("colspan", "gridSpan"), ("rowspan", "rowSpan")) if (n := integer(attr(tc, key), 1)) > 1)
            row += f"<td{span}>{blocks_html(blocks(kid(tc, 'txBody'))) or '&nbsp;'}</td>"
        rows += [f"<tr>{row}</tr>"] * bool(row)
    cols = "".join(f'<col style="width:{emu_px(attr(g, "w"))}px"/>' for g in kids(kid(tbl, "tblGrid"), "gridCol"))
    group = f"<colgroup>{cols}</colgroup>" if cols else ""
    return f'<table class="doc-datatable">{group}<tbody>{"".join(rows)}</tbody></table>' if rows else ""


def _place(e) -> tuple[int, int, int]:
    off, ext = find(e, "off"), find(e, "ext")
    return integer(attr(off, "y")), integer(attr(off, "x")), integer(attr(ext, "cx"))


def shapes(tree, pkg: Package, rels: dict, depth: int = 0) -> list[dict]:
    """Texts, images and tables of a slide, groups opened, in order of the tree."""
    out: list[dict] = []
    if depth > GROUP_DEPTH:
        return out
    for e in kids(tree):
        name = local(e.tag)
        if name == "sp" and kid(e, "txBody") is not None:
            kind = attr(find(find(e, "nvSpPr"), "ph"), "type") or ""
            out.append({"kind": "text", "place": _place(kid(e, "spPr")), "is_title": "title" in kind.lower(), "blocks": blocks(kid(e, "txBody"))})
        elif name == "pic":
            rel = rels.get(attr(find(e, "blip"), "embed"))
            src = pkg.image(rel["target"]) if rel and not rel["external"] else None
            out += [{"kind": "image", "place": _place(kid(e, "spPr")), "src": src}] * bool(src)
        elif name == "graphicFrame" and find(e, "tbl") is not None:
            out.append({"kind": "table", "place": _place(e), "html": table_html(find(e, "tbl"))})
        elif name == "grpSp":
            out += shapes(e, pkg, rels, depth + 1)
    return out


def slides(content: bytes) -> list[tuple[list[dict], str]]:
    """(items in reading order, notes) of each slide."""
    pkg = Package(content)
    rels = pkg.rels("ppt/presentation.xml")
    listed = [rels.get(attr(s, "id")) for s in kids(find(pkg.xml("ppt/presentation.xml"), "sldIdLst"), "sldId")]
    paths = [r["target"] for r in listed if r and not r["external"]]
    if not paths:
        found = [(int(m[1]), n) for n in pkg.names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))]
        paths = [n for _, n in sorted(found)]
    out = []
    for path in paths:
        root = pkg.xml(path)
        if root is None:
            continue
        own = pkg.rels(path)
        items = sorted(shapes(find(root, "spTree"), pkg, own), key=lambda s: s["place"][:2])
        note = next((r["target"] for r in own.values() if r["type"].endswith("notesSlide")), "")
        out.append((items, text_of(find(pkg.xml(note), "spTree")).strip() if note else ""))
    return out


def slide_html(no: int, items: list[dict], notes: str) -> str:
    out, titled = [], False
    for s in items:
        if s["kind"] == "text":
            title = " ".join(b[0] for b in s["blocks"]).strip() if s["is_title"] and not titled else ""
            titled = titled or bool(title)
            out.append(f'<h2 class="pptx-title">{title}</h2>' if title else blocks_html(s["blocks"]))
        elif s["kind"] == "image":
            w = emu_px(str(s["place"][2]))
            size = f"width:{w}px; " if w else ""
            out.append(f'<figure><img src="{s["src"]}" style="{size}max-width:100%"/></figure>')
        else:
            out.append(s["html"])
    if len(notes) > 3:
        out.append(f'<div class="pptx-notes"><em>Notes:</em> {escape(notes)}</div>')
    body = "".join(out) or "<p><em>(empty slide)</em></p>"
    return f'<section class="pptx-slide"><div class="pptx-slide-no">Slide {no}</div>{body}</section>'


def to_html(content: bytes) -> tuple[str, list[str]]:
    found = slides(content)
    html = '<hr class="page-break"/>'.join(slide_html(i + 1, *s) for i, s in enumerate(found))
    return html, [f"slides:{len(found)}"] if found else ["no_slide"]


def items(files: DataFrame) -> DataFrame:
    """(doc_id, slide, ord, kind, y, x, is_title, html) of all slides of ``files`` (doc_id, content)."""
    schema = "doc_id long, slide int, ord int, kind string, y long, x long, is_title boolean, html string"
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            for doc_id, content in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = [
                    (doc_id, n, i, s["kind"], *s["place"][:2], bool(s.get("is_title")), blocks_html(s["blocks"]) if "blocks" in s else s.get("html") or s.get("src"))
                    for n, (found, _) in enumerate(slides(content)) for i, s in enumerate(found)
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("doc_id", "content").mapInArrow(run, schema)
