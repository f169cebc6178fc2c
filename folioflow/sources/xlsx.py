"""Workbooks: cells, lines, merges and anchors as rows, and sheets as HTML."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from ..fixed import MAX_COLS, MAX_ROWS, ROW_PX
from .markdown import escape
from .opc import Package, attr, emu_px, find, find_all, integer, kid, kids, number, text_of
from .numfmt import shown, shown_text
from .styles import Styles


def reference(ref: str) -> tuple[int, int] | None:
    m = re.fullmatch(r"([A-Z]+)(\d+)", ref.strip().upper())
    if not m:
        return None
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]) - 1, col - 1


def box(ref: str) -> tuple[int, int, int, int] | None:
    a, _, b = ref.partition(":")
    first, last = reference(a), reference(b or a)
    return (*first, *last) if first and last else None


def column_px(chars: float, digit: int) -> int:
    return int((256 * chars + int(128 / digit)) / 256 * digit)


@dataclass
class Cell:
    """``kind``: n, s, str, b, e or d; ``raw`` as stored, shared strings looked up; ``text`` as shown; ``rich``: markup of runs."""

    kind: str
    raw: str
    text: str
    style: int | None
    rich: str = ""

    def html(self) -> str:
        return re.sub("\r\n|\r|\n", "<br/>", self.rich or escape(self.text))


@dataclass
class Sheet:
    no: int
    name: str
    cells: dict = field(default_factory=dict)  # (row, col): Cell
    cols: dict = field(default_factory=dict)  # col: (px, hidden, style)
    rows: dict = field(default_factory=dict)  # row: (px or None, hidden, style)
    merges: list = field(default_factory=list)
    links: dict = field(default_factory=dict)
    anchors: list = field(default_factory=list)
    col_px: int = 0
    row_px: int = ROW_PX


def _rich(run) -> str:
    """Markup of a run of rich text."""
    style, out = kid(run, "rPr"), escape(text_of(kid(run, "t")))
    on = lambda name: (e := kid(style, name)) is not None and attr(e, "val") not in ("0", "none")
    script = {"superscript": "sup", "subscript": "sub"}.get(attr(kid(style, "vertAlign"), "val") or "")
    for name, tag in (("b", "b"), ("i", "i"), ("u", "u"), ("strike", "s")):
        if out and on(name):
            out = f"<{tag}>{out}</{tag}>"
    return f"<{script}>{out}</{script}>" if script and out else out


def string_item(item) -> tuple[str, str]:
    """(text, markup of its runs or '') of a string item; phonetic readings are left out."""
    runs = kids(item, "r")
    if not runs:
        return text_of(kid(item, "t")), ""
    return "".join(text_of(kid(r, "t")) for r in runs), "".join(map(_rich, runs))


def read_cell(c, shared: list[tuple[str, str]], styles: Styles, since_1904: bool) -> Cell:
    kind, raw, rich = attr(c, "t") or "n", text_of(kid(c, "v")), ""
    style = integer(attr(c, "s")) if attr(c, "s") is not None else None
    if kind == "s":
        i = integer(raw, -1)
        raw, rich = shared[i] if 0 <= i < len(shared) else ("", "")
    elif kind == "inlineStr":
        kind, (raw, rich) = "str", string_item(kid(c, "is"))
    elif kind == "b":
        raw = "TRUE" if raw == "1" else "FALSE"
    text = raw
    if kind == "n" and raw.strip():
        try:
            text = shown(float(raw), styles.code(style), since_1904)
        except (ValueError, OverflowError, ArithmeticError):  # no number after all
            text = raw
    elif kind in ("s", "str"):
        text = shown_text(raw, styles.code(style))
    return Cell(kind, raw, text, style, rich)


def read_sheet(pkg: Package, part: str, no: int, name: str, digit: int, shared: list[tuple[str, str]], counts: dict, styles: Styles, since_1904: bool = False) -> Sheet | None:
    root = pkg.xml(part)
    if root is None:
        return None
    ws, rels = find(root, "worksheet"), pkg.rels(part)
    ws = root if ws is None else ws
    fmt, s = kid(ws, "sheetFormatPr"), Sheet(no, name)
    s.col_px = column_px(number(attr(fmt, "defaultColWidth"), 8.43), digit)
    if attr(fmt, "defaultRowHeight"):
        s.row_px = int(number(attr(fmt, "defaultRowHeight")) * 96 / 72 + 0.5)
    style = lambda e, n: integer(attr(e, n)) if attr(e, n) is not None else None
    for c in kids(kid(ws, "cols"), "col"):
        low = integer(attr(c, "min"), 1)
        px = max(0, column_px(number(attr(c, "width"), 8.43), digit)) if attr(c, "width") is not None else s.col_px
        for i in range(low - 1, min(integer(attr(c, "max"), low), MAX_COLS)):
            s.cols[i] = (px, attr(c, "hidden") == "1" or px == 0, style(c, "style"))
    for row in kids(kid(ws, "sheetData"), "row"):
        r = integer(attr(row, "r"), len(s.rows) + 1) - 1
        if not 0 <= r < MAX_ROWS:
            continue
        px = int(number(attr(row, "ht")) * 96 / 72 + 0.5) if attr(row, "ht") is not None else None
        s.rows[r] = (px, attr(row, "hidden") == "1", style(row, "s") if attr(row, "customFormat") == "1" else None)
        for n, c in enumerate(kids(row, "c")):
            at = reference(attr(c, "r") or "")
            col = at[1] if at else n
            if col >= MAX_COLS:
                continue
            s.cells[r, col] = read_cell(c, shared, styles, since_1904)
    s.merges = [b for m in kids(kid(ws, "mergeCells"), "mergeCell") if (b := box(attr(m, "ref") or ""))]
    for h in kids(kid(ws, "hyperlinks"), "hyperlink"):
        if b := box(attr(h, "ref") or ""):
            rel = rels.get(attr(h, "id"))
            s.links[b[:2]] = rel["target"] if rel else f"#{attr(h, 'location')}" if attr(h, "location") else ""
    drawing = rels.get(attr(kid(ws, "drawing"), "id")) if kid(ws, "drawing") is not None else None
    if drawing:
        s.anchors = read_anchors(pkg, drawing["target"], counts)
    return s


def read_anchors(pkg: Package, part: str, counts: dict) -> list[dict]:
    """Pictures and texts of a drawing with their place: from and to as (row, col, row_off, col_off)."""
    root, rels, out = pkg.xml(part), pkg.rels(part), []
    for a in kids(root):
        if not a.tag.endswith("Anchor"):
            continue
        point = lambda e: None if e is None else tuple(integer(text_of(kid(e, n))) for n in ("row", "col", "rowOff", "colOff"))
        pos, ext = kid(a, "pos"), kid(a, "ext")
        found = {"from": point(kid(a, "from")), "to": point(kid(a, "to")), "pos": None if pos is None else (attr(pos, "x"), attr(pos, "y"))}
        pic, shape = kid(a, "pic"), kid(a, "sp")
        if pic is not None:
            blip, about = find(pic, "blip"), find(pic, "cNvPr")
            rel = rels.get(attr(blip, "embed") or attr(blip, "link"))
            src = pkg.image(rel["target"]) if rel and not rel["external"] else None
            if src is None:
                counts["images_skipped"] += 1
                continue
            ext = ext if ext is not None else kid(find(pic, "xfrm"), "ext")
            out.append(found | {"kind": "pic", "src": src, "name": attr(about, "descr") or attr(about, "name") or "", "ext": (attr(ext, "cx"), attr(ext, "cy"))})
        elif shape is not None:
            if text := text_of(kid(shape, "txBody")).strip():
                out.append(found | {"kind": "shape", "text": text, "ext": (attr(ext, "cx"), attr(ext, "cy"))})
        elif kid(a, "graphicFrame") is not None:
            counts["charts"] += 1
    return out


def read_workbook(content: bytes) -> tuple[list[Sheet], Styles, dict]:
    """Visible sheets, styles, and counters for warnings."""
    pkg = Package(content)
    theme = next((n for n in sorted(pkg.names) if re.fullmatch(r"xl/theme/theme\d*\.xml", n)), "")
    styles = Styles(pkg.xml("xl/styles.xml"), pkg.xml(theme))
    digit = max(5, min(20, int(styles.base["size"] / 11 * 7 + 0.5)))
    shared, rels = [string_item(si) for si in kids(pkg.xml("xl/sharedStrings.xml"), "si")], pkg.rels("xl/workbook.xml")
    since_1904 = attr(find(pkg.xml("xl/workbook.xml"), "workbookPr"), "date1904") in ("1", "true")
    counts = {"charts": 0, "images_skipped": 0, "sheets_hidden": 0, "images_placed": 0}
    sheets = []
    for i, s in enumerate(find_all(pkg.xml("xl/workbook.xml"), "sheet")):
        if (attr(s, "state") or "visible") != "visible":
            counts["sheets_hidden"] += 1
            continue
        part = rels.get(attr(s, "id"), {}).get("target") or f"xl/worksheets/sheet{i + 1}.xml"
        if sheet := read_sheet(pkg, part, i, attr(s, "name") or f"Sheet{i + 1}", digit, shared, counts, styles, since_1904):
            sheets.append(sheet)
    return sheets, styles, counts


def sheet_html(s: Sheet, styles: Styles, counts: dict) -> str:
    title = f'<h2 class="xl-sheet-title">{escape(s.name)}</h2>'
    ends = [(a["to"] or a["from"])[:2] for a in s.anchors if a["from"]]
    extents = [m[2:] for m in s.merges] + ends
    used = [*s.cells, *extents]
    full = [rc for rc, c in s.cells.items() if c.text.strip()]
    floating = any(not a["from"] and a["pos"] for a in s.anchors)
    kept = used if floating else [*full, *extents]
    if not kept:
        return title + "<p><em>(empty sheet)</em></p>"
    last_r, last_c = min(max(r for r, _ in kept), MAX_ROWS - 1), min(max(c for _, c in kept), MAX_COLS - 1)
    px_c = [s.cols[c][0] if c in s.cols else s.col_px for c in range(last_c + 1)]
    px_r = [s.rows[r][0] if r in s.rows and s.rows[r][0] is not None else s.row_px for r in range(last_r + 1)]
    hid_c, hid_r = [c in s.cols and s.cols[c][1] for c in range(last_c + 1)], [r in s.rows and s.rows[r][1] for r in range(last_r + 1)]
    sum_c, sum_r = [0, *accumulate(px_c)], [0, *accumulate(px_r)]

    def shown(hidden: list[bool], i: int) -> int:
        later = next((k for k in range(i, len(hidden)) if not hidden[k]), None)
        return later if later is not None else next((k for k in range(i, -1, -1) if not hidden[k]), 0)

    extras: dict[tuple[int, int], str] = {}
    for a in s.anchors:
        if a["from"]:
            r, c = a["from"][:2]
        elif a["pos"]:
            x, y = map(emu_px, a["pos"])
            c = max((k for k in range(last_c + 1) if sum_c[k] <= x), default=0)
            r = max((k for k in range(last_r + 1) if sum_r[k] <= y), default=0)
        else:
            continue
        r, c = max(0, min(r, last_r)), max(0, min(c, last_c))
        width = 0
        if a["to"] and a["from"]:
            at = lambda p: sum_c[min(p[1], last_c + 1)] + emu_px(str(p[3]))
            width = at(a["to"]) - at(a["from"])
        width = width if width > 1 else emu_px(a["ext"][0])
        r, c = next(((m[0], m[1]) for m in s.merges if m[0] <= r <= m[2] and m[1] <= c <= m[3]), (r, c))
        place = (shown(hid_r, r), shown(hid_c, c))
        if a["kind"] == "pic":
            counts["images_placed"] += 1
            size = f" width:{width}px;" if width > 1 else ""
            item = f'<img class="xl-pic" src="{a["src"]}" alt="{escape(a["name"] or "image")}" style="display:block;{size} max-width:100%; margin:2px 0;"/>'
        else:
            item = '<div class="xl-shape">' + escape(a["text"]).replace("\n", "<br/>") + "</div>"
        extras[place] = extras.get(place, "") + item
    hidden_by_merge = {(r, c) for m in s.merges for r in range(m[0], min(m[2], last_r) + 1) for c in range(m[1], min(m[3], last_c) + 1) if (r, c) != m[:2]}
    tops = {m[:2]: m for m in s.merges}
    cols = [c for c in range(last_c + 1) if not hid_c[c]]
    out = [title, f'<table class="xl-sheet" style="width:{sum(px_c[c] for c in cols)}px; table-layout:fixed; border-collapse:collapse;"><colgroup>']
    out += [f'<col style="width:{px_c[c]}px"/>' for c in cols] + ["</colgroup><tbody>"]
    for r in range(last_r + 1):
        if hid_r[r]:
            continue
        row = []
        for c in cols:
            if (r, c) in hidden_by_merge:
                continue
            span = ""
            if m := tops.get((r, c)):
                wide = max(1, sum(m[1] <= k <= m[3] for k in cols))
                high = max(1, sum(not hid_r[k] for k in range(m[0], min(m[2], last_r) + 1)))
                span = f' colspan="{wide}"' * (wide > 1) + f' rowspan="{high}"' * (high > 1)
            cell = s.cells.get((r, c)) or Cell("", "", "", None)
            own = cell.style
            of_row = s.rows[r][2] if r in s.rows else None
            index = own if own is not None else of_row if of_row is not None else s.cols[c][2] if c in s.cols else None
            css, wrap = styles.css(index, cell.kind == "n")
            inner = cell.html()
            href = s.links.get((r, c), "")
            if inner and re.match("https?:|mailto:", href, re.I):
                inner = f'<a href="{escape(href)}" target="_blank">{inner}</a>'
            inner += extras.get((r, c), "")
            style = "; ".join(x for x in (css, "padding: 2px 4px", "overflow-wrap: break-word", "white-space: pre-wrap" if wrap else "") if x)
            row.append(f'<td{span} style="{style}">{inner or "&nbsp;"}</td>')
        if row:
            out.append(f'<tr style="height:{px_r[r]}px">{"".join(row)}</tr>')
    return "".join([*out, "</tbody></table>"])


def to_html(content: bytes) -> tuple[str, list[str]]:
    sheets, styles, counts = read_workbook(content)
    html = '<hr class="page-break"/>'.join(sheet_html(s, styles, counts) for s in sheets)
    warnings = [f"{k}:{counts[k]}" for k in ("charts", "images_skipped", "sheets_hidden", "images_placed") if counts[k]]
    return html, warnings + ["no_visible_sheet"] * (not sheets)


# --- DataFrames of (doc_id, content)


def _rows(files: DataFrame, schema: str, kinds: list, emit) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            for doc_id, content in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = [(doc_id, *r) for s in read_workbook(content)[0] for r in emit(s)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("doc_id", "content").mapInArrow(run, schema)


def cells(files: DataFrame) -> DataFrame:
    """Cells as stored (value) and as shown (text, html)."""
    schema = "doc_id long, sheet_no int, row int, col int, cell_type string, value string, style_idx int, text string, html string"
    i, s = pa.int32(), pa.string()
    emit = lambda x: [(x.no, r, c, v.kind, v.raw, v.style, v.text, v.html()) for (r, c), v in sorted(x.cells.items())]
    return _rows(files, schema, [pa.int64(), i, i, i, s, s, i, s, s], emit)


def merges(files: DataFrame) -> DataFrame:
    schema = "doc_id long, sheet_no int, ord int, r1 int, c1 int, r2 int, c2 int"
    return _rows(files, schema, [pa.int64(), *[pa.int32()] * 6], lambda x: [(x.no, n, *m) for n, m in enumerate(x.merges)])


def lines(files: DataFrame) -> DataFrame:
    """Rows (axis 'row') and columns ('col') that a sheet describes."""
    schema = "doc_id long, sheet_no int, axis string, i int, px int, hidden boolean, style_idx int"
    k = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32()]
    return _rows(files, schema, k, lambda x: [(x.no, "row", r, *v) for r, v in x.rows.items()] + [(x.no, "col", c, *v) for c, v in x.cols.items()])
