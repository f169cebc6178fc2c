"""Markdown to HTML: lines become blocks (kind, payload), blocks become markup."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from ..fixed import MD_FENCE, MD_INLINE, MD_LINES, MD_SEPARATOR

_INLINE = [(re.compile(form), re.sub(r"\$(\d)", r"\\\1", to)) for form, to in MD_INLINE]
_LINES = {kind: re.compile(form) for kind, form in MD_LINES.items()}
_SEPARATOR = re.compile(MD_SEPARATOR)
_LISTS = ("ul", "ol")


def escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def inline(s: str) -> str:
    s = escape(s)
    for form, to in _INLINE:
        s = form.sub(to, s)
    return s


def cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().removeprefix("|").removesuffix("|").split("|")]


def line_class(line: str, after: str | None) -> tuple[str, tuple[str, ...]]:
    """What a line outside a fence begins, with the groups of its form; ``after`` is the next line."""
    if line.startswith(MD_FENCE):
        return "fence", ()
    if "|" in line and after is not None and "|" in after and _SEPARATOR.fullmatch(after):
        return "table", ()
    for kind, form in _LINES.items():
        if m := form.fullmatch(line):
            return kind, m.groups()
    return ("paragraph", ()) if line.strip() else ("blank", ())


def _interrupts(line: str) -> bool:
    """Whether the line ends a paragraph: a blank one, and what has a mark of its own (a rule's marks alone don't)."""
    own = line.startswith(MD_FENCE) or any(_LINES[kind].fullmatch(line) for kind in ("heading", "quote", *_LISTS))
    return own or not line.strip()


def blocks(lines: list[str]) -> Iterator[tuple[str, object]]:
    """(kind, payload): a fence, table or paragraph takes the lines that belong to it, others are a line each."""

    def upto(start: int, stop) -> int:
        return next((k for k in range(start, len(lines)) if stop(lines[k])), len(lines))

    at = 0
    while at < len(lines):
        kind, groups = line_class(lines[at], lines[at + 1] if at + 1 < len(lines) else None)
        end = at + 1
        if kind == "fence":
            close = upto(end, lambda x: x.startswith(MD_FENCE))
            yield kind, lines[end:close]
            end = close + 1
        elif kind == "table":
            end = upto(at + 2, lambda x: "|" not in x)
            yield kind, [cells(x) for x in (lines[at], *lines[at + 2 : end])]
        elif kind == "paragraph":
            end = upto(end, _interrupts)
            yield kind, lines[at:end]
        else:
            yield kind, groups
        at = end


def _markup(kind: str, payload) -> str:
    row = lambda tag, values: "<tr>" + "".join(f"<{tag}>{inline(v)}</{tag}>" for v in values) + "</tr>"
    match kind:
        case "fence":
            return f"<pre><code>{escape(chr(10).join(payload))}</code></pre>"
        case "table":
            head, *body = payload
            return f'<table class="doc-datatable"><thead>{row("th", head)}</thead><tbody>{"".join(row("td", r) for r in body)}</tbody></table>'
        case "heading":
            return f"<h{len(payload[0])}>{inline(payload[1])}</h{len(payload[0])}>"
        case "hr":
            return "<hr/>"
        case "quote":
            return f"<blockquote>{inline(payload[0])}</blockquote>"
        case "ul" | "ol":
            return f"<li>{inline(payload[0])}</li>"
        case "paragraph":
            return "<p>" + inline("\n".join(payload)).replace("\n", "<br/>") + "</p>"
    return ""


def to_html(text: str) -> str:
    """Blocks one after another; neighbouring items of one kind are a list."""
    out = []
    for kind, group in groupby(blocks(re.sub("\r\n?", "\n", text or "").split("\n")), key=lambda b: b[0]):
        inner = "".join(_markup(*b) for b in group)
        out.append(f"<{kind}>{inner}</{kind}>" if kind in _LISTS else inner)
    return "".join(out)


def markdown_html(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, html) of each row's Markdown."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([to_html(x) for x in b.column(column).to_pylist()], pa.string())], [key, "html"])

    return df.select(key, column).mapInArrow(run, f"{key} {kind}, html string")
