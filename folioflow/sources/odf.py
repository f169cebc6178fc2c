"""OpenDocument texts, sheets and presentations to HTML."""

from __future__ import annotations

import re

from ..fixed import ODF_DEPTH, ODF_REPEATS, ODF_SPACES
from .markdown import escape
from .opc import Package, attr, find, find_all, integer, kid, kids, local

BLANK_CELL = "<td>&nbsp;</td>"


def inline(e) -> str:
    """Text and inline elements in order; frames and notes are no inline content."""
    out = escape(e.text or "")
    for k in e:
        if isinstance(k.tag, str):
            name = local(k.tag)
            if name == "a":
                out += f'<a href="{escape(attr(k, "href") or "#")}" target="_blank">{inline(k)}</a>'
            elif name == "s":
                out += "&nbsp;" * min(integer(attr(k, "c"), 1), ODF_SPACES)
            elif name in ("line-break", "tab"):
                out += {"line-break": "<br/>", "tab": "&nbsp;" * 4}[name]
            elif name not in ("frame", "note"):
                out += inline(k)
        out += escape(k.tail or "")
    return out


def _figure(frame, pkg: Package) -> str:
    href = attr(find(frame, "image"), "href") or ""
    src = None if not href or re.match("https?:", href, re.I) else pkg.image(re.sub(r"^\.?/", "", href))
    return f'<figure><img src="{src}" style="max-width:100%"/></figure>' if src else ""


def block(e, pkg: Package, depth: int = 0) -> str:
    if depth > ODF_DEPTH:
        return ""
    name = local(e.tag)
    if name == "h":
        level, text = min(max(integer(attr(e, "outline-level"), 1), 1), 6), inline(e).strip()
        return f"<h{level}>{text}</h{level}>" if text else ""
    if name == "p":
        text = inline(e).strip()
        return (f"<p>{text}</p>" if text else "") + "".join(_figure(f, pkg) for f in find_all(e, "frame"))
    if name == "list":
        rows = ["".join(block(k, pkg, depth + 1) for k in kids(i)) for i in kids(e, "list-item")]
        return "<ul>" + "".join(f"<li>{r}</li>" for r in rows) + "</ul>" if rows else ""
    if name == "table":
        return table(e, pkg, depth)
    if name == "frame":
        return _figure(e, pkg)
    return "".join(block(k, pkg, depth + 1) for k in kids(e)) if name == "section" else ""


def _rows(e):
    for k in kids(e):
        if local(k.tag) == "table-row":
            yield k
        elif re.search("header-rows|row-group", k.tag):
            yield from _rows(k)


def table(e, pkg: Package, depth: int = 0) -> str:
    """Repeats are expanded up to a limit; empty cells at a row's end go, then empty rows."""
    out = []
    for tr in _rows(e):
        row: list[str] = []
        for tc in kids(tr, "table-cell"):
            span = "".join(f' {name}="{n}"' for name, key in (("colspan", "number-columns-spanned"), ("rowspan", "number-rows-spanned")) if (n := integer(attr(tc, key), 1)) > 1)
            inner = "".join(block(k, pkg, depth + 1) for k in kids(tc))
            row += [f"<td{span}>{inner or '&nbsp;'}</td>"] * min(integer(attr(tc, "number-columns-repeated"), 1), ODF_REPEATS)
        while row and row[-1] == BLANK_CELL:
            row.pop()
        if row:
            out += [f"<tr>{''.join(row)}</tr>"] * min(integer(attr(tr, "number-rows-repeated"), 1), ODF_REPEATS)
    return f'<table class="doc-datatable"><tbody>{"".join(out)}</tbody></table>' if out else ""


def to_html(content: bytes) -> tuple[str, list[str]]:
    pkg = Package(content)
    body = find(pkg.xml("content.xml"), "body")
    if body is None:
        raise ValueError("no content.xml")
    sheets, show, text = (kid(body, n) for n in ("spreadsheet", "presentation", "text"))
    if sheets is not None:
        parts = [(attr(t, "name") or "", table(t, pkg)) for t in kids(sheets, "table")]
        return "".join(f'<h2 class="xl-sheet-title">{escape(n)}</h2>{h}' for n, h in parts if h), ["sheet_layout_simplified"]
    if show is not None:
        pages = []
        for n, page in enumerate(kids(show, "page"), 1):
            inner = ""
            for f in find_all(page, "frame"):
                inner += _figure(f, pkg) or "".join(block(k, pkg) for k in kids(find(f, "text-box")))
            pages.append(f'<section class="pptx-slide"><div class="pptx-slide-no">Slide {n}</div>{inner or "<p><em>(empty)</em></p>"}</section>')
        return "".join(pages), [f"slides:{len(pages)}"]
    return ("", ["no_content"]) if text is None else ("".join(block(k, pkg) for k in kids(text)), [])
