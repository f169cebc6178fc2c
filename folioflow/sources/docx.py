"""Word documents: paragraphs, runs, lists, tables, links and images to HTML."""

from __future__ import annotations

import re

from .markdown import escape
from .opc import Package, attr, find, find_all, integer, kid, kids, local, text_of


class _Reader:
    def __init__(self, content: bytes):
        self.pkg = Package(content)
        self.rels = self.pkg.rels("word/document.xml")
        self.styles = {attr(s, "styleId"): attr(kid(s, "name"), "val") or "" for s in find_all(self.pkg.xml("word/styles.xml"), "style")}
        numbering = self.pkg.xml("word/numbering.xml")
        formats = {attr(a, "abstractNumId"): attr(find(a, "numFmt"), "val") for a in find_all(numbering, "abstractNum")}
        self.lists = {attr(n, "numId"): formats.get(attr(kid(n, "abstractNumId"), "val")) for n in kids(numbering, "num")}
        self.skipped = 0

    def run(self, r) -> str:
        out = ""
        for k in kids(r):
            name = local(k.tag)
            if name == "t":
                out += escape(text_of(k))
            elif name in ("br", "cr", "tab"):
                out += "&nbsp;&nbsp;&nbsp;&nbsp;" if name == "tab" else "<br/>"
            elif name in ("drawing", "pict"):
                for blip in find_all(k, "blip"):
                    rel = self.rels.get(attr(blip, "embed"))
                    src = self.pkg.image(rel["target"]) if rel and not rel["external"] else None
                    self.skipped += src is None
                    out += f'<img src="{src}" style="max-width:100%; height:auto"/>' if src else ""
        props = kid(r, "rPr")
        for key, tag in (("b", "strong"), ("i", "em"), ("u", "u"), ("strike", "s")):
            e = kid(props, key)
            if out and e is not None and attr(e, "val") not in ("0", "false", "none"):
                out = f"<{tag}>{out}</{tag}>"
        tag = {"superscript": "sup", "subscript": "sub"}.get(attr(kid(props, "vertAlign"), "val") or "")
        return f"<{tag}>{out}</{tag}>" if tag and out else out

    def inline(self, p) -> str:
        out = ""
        for k in kids(p):
            name = local(k.tag)
            if name == "r":
                out += self.run(k)
            elif name == "hyperlink":
                rel = self.rels.get(attr(k, "id"))
                href = rel["target"] if rel else f"#{attr(k, 'anchor') or ''}"
                out += f'<a href="{escape(href)}">{self.inline(k)}</a>'
            elif name in ("ins", "smartTag", "sdt", "sdtContent"):
                out += self.inline(k)
        return out

    def blocks(self, body) -> str:
        """Numbered paragraphs in a row are one list."""
        out, open_ = [], ""
        for e in kids(body):
            name, listed = local(e.tag), ""
            if name == "p":
                props, html = kid(e, "pPr"), self.inline(e)
                style = self.styles.get(attr(kid(props, "pStyle"), "val"), attr(kid(props, "pStyle"), "val") or "")
                num = attr(kid(kid(props, "numPr"), "numId"), "val")
                heading = re.fullmatch(r"heading\s*(\d)", style, re.I)
                if not html:
                    continue
                if num and num != "0":
                    listed = "ul" if self.lists.get(num) in ("bullet", None) else "ol"
                    piece = f"<li>{html}</li>"
                elif heading:
                    piece = "<h{0}>{1}</h{0}>".format(min(int(heading[1]), 6), html)
                else:
                    named = {"title": '<h1 class="doc-title-line">{}</h1>', "subtitle": '<p class="sub">{}</p>', "quote": "<blockquote>{}</blockquote>"}
                    piece = named.get(style.lower(), "<p>{}</p>").format(html)
            elif name == "tbl":
                piece = self.table(e)
            elif name in ("sdt", "sdtContent"):
                piece = self.blocks(e)
            else:
                continue
            if listed != open_:
                out += [f"</{open_}>"] * bool(open_) + [f"<{listed}>"] * bool(listed)
                open_ = listed
            out.append(piece)
        return "".join(out) + (f"</{open_}>" if open_ else "")

    def table(self, tbl) -> str:
        """Cells that continue one above widen its rowspan."""
        grid: list[list[dict]] = []
        above: dict[int, dict] = {}
        for tr in kids(tbl, "tr"):
            row, col = [], 0
            for tc in kids(tr, "tc"):
                props = kid(tc, "tcPr")
                wide, merge = integer(attr(kid(props, "gridSpan"), "val"), 1), kid(props, "vMerge")
                if merge is not None and (attr(merge, "val") or "continue") == "continue" and col in above:
                    above[col]["rows"] += 1
                else:
                    above[col] = {"html": self.blocks(tc), "cols": wide, "rows": 1}
                    row.append(above[col])
                col += wide
            grid.append(row)
        span = lambda c: f' colspan="{c["cols"]}"' * (c["cols"] > 1) + f' rowspan="{c["rows"]}"' * (c["rows"] > 1)
        rows = "".join("<tr>" + "".join(f"<td{span(c)}>{c['html'] or '&nbsp;'}</td>" for c in r) + "</tr>" for r in grid)
        return f'<table class="doc-datatable"><tbody>{rows}</tbody></table>'


def to_html(content: bytes) -> tuple[str, list[str]]:
    r = _Reader(content)
    body = find(r.pkg.xml("word/document.xml"), "body")
    if body is None:
        raise ValueError("no word/document.xml")
    return r.blocks(body), [f"images_skipped:{r.skipped}"] * bool(r.skipped)
