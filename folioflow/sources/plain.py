"""Text, delimited text, JSON and images."""

from __future__ import annotations

import base64
import csv
import io
import json
import re

from .markdown import escape


def decode(b: bytes) -> str:
    """By byte order mark, else UTF-8; if more than 2 in 1000 characters don't decode, windows-1251."""
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if b.startswith(mark):
            return b[len(mark) :].decode(name, "replace")
    text = b.decode("utf-8", "replace")
    return b.decode("cp1251", "replace") if text.count("\ufffd") > 0.002 * max(1, len(text)) else text


def text_html(text: str, ext: str = "txt") -> str:
    if ext == "json":
        try:
            return f"<pre>{escape(json.dumps(json.loads(text), indent=2, ensure_ascii=False))}</pre>"
        except ValueError:
            pass
    if ext == "xml":
        return f"<pre>{escape(text)}</pre>"
    parts = [p.strip() for p in re.split("\n{2,}", re.sub("\r\n?", "\n", text))]
    return "".join("<p>" + escape(p).replace("\n", "<br/>") + "</p>" for p in parts if p) or "<p></p>"


def table_html(text: str, ext: str) -> str:
    rows = csv.reader(io.StringIO(text, newline=""), delimiter="\t" if ext == "tsv" else ",")
    body = "".join("<tr>" + "".join(f"<td>{escape(c)}</td>" for c in r) + "</tr>" for r in rows)
    return f'<table class="doc-datatable"><tbody>{body}</tbody></table>'


def image_html(b: bytes, mime: str) -> str:
    return f'<figure><img src="data:{mime};base64,{base64.b64encode(b).decode()}" style="max-width:100%"/><figcaption>Image</figcaption></figure>'


def file_html(text: str) -> str:
    """An HTML file: its style elements, then its body or all of it."""
    body = re.search(r"<body[^>]*>(.*?)</body>", text, re.I | re.S)
    styles = re.findall(r"<style[^>]*>(.*?)</style>", text, re.I | re.S)
    return "".join(f"<style>{s}</style>" for s in styles) + (body[1] if body else text)
