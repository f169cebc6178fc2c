"""Printing through a renderer that the caller brings: what is printed together, and what files come out."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import CHUNK_PX, CHUNK_TRIGGER, NO_HEIGHT_PX
from ..operators.runs import Filling
from ..sources.html import Node, parse, sanitize_html, serialize


@dataclass(frozen=True)
class Renderer:
    """``heights``: pixels of each block of a document (markups to numbers). ``pages``: the pages of a document as bytes."""

    heights: Callable[[list[str]], list[float]]
    pages: Callable[[str], list[bytes]]


def _markup(node: Node) -> str:
    return serialize(Node("#root", kids=[node]))


def split_table(table: Node, heights: list[float], target: float = CHUNK_PX) -> list[Node]:
    """A table as several, each with its columns and head, whose rows fill up to ``target`` pixels; itself if one is enough."""
    heads = [k for k in table.kids if k.tag in ("colgroup", "thead")]
    rows = [r for k in table.kids for r in (k.kids if k.tag == "tbody" else [k]) if r.tag == "tr"]
    if len(rows) < 2:
        return [table]
    filling, groups = Filling(target, None), []
    for row, height in zip(rows, heights, strict=True):
        if filling.place(height or NO_HEIGHT_PX) == len(groups):
            groups.append([])
        groups[-1].append(row)
    if len(groups) < 2:
        return [table]
    return [Node("table", dict(table.attrs), [*heads, Node("tbody", kids=g)]) for g in groups]


def chunks(markup: str, heights: Callable[[list[str]], list[float]]) -> list[str]:
    """What is printed on its own: the document, or, where that is too tall, its blocks in chunks of bounded height, tall tables
    in parts."""
    blocks = [k if k.tag else Node("span", kids=[k]) for k in parse(markup).kids if k.tag or k.text.strip()]
    tall = heights([_markup(b) for b in blocks]) if blocks else []
    if sum(tall) <= CHUNK_TRIGGER:
        return [markup]
    parts: list[tuple[Node, float]] = []
    for block, height in zip(blocks, tall, strict=True):
        if block.tag == "table" and height > CHUNK_PX:
            rows = [r for k in block.kids for r in (k.kids if k.tag == "tbody" else [k]) if r.tag == "tr"]
            some = split_table(block, heights([_markup(r) for r in rows]))
            parts += zip(some, heights([_markup(t) for t in some]) if len(some) > 1 else [height], strict=True)
        else:
            parts.append((block, height))
    filling, out = Filling(CHUNK_PX, None, sized=True), []
    for block, height in parts:
        if filling.place(height or 0) == len(out):
            out.append("")
        out[-1] += _markup(block)
    return out


def page_images(pages: list[bytes]) -> tuple[str, bytes]:
    """(extension, content): one page is an image, more are stored in an archive under their numbers."""
    if len(pages) == 1:
        return "png", pages[0]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i, page in enumerate(pages, 1):
            z.writestr(zipfile.ZipInfo(f"page-{i:02d}.png", (1980, 1, 1, 0, 0, 0)), page)
    return "zip", out.getvalue()


PRINTED = "doc_id long, n_chunks long, n_pages long, ext string, content binary, status string, error string"


def print_images(documents: DataFrame, renderer: Renderer) -> DataFrame:
    """Rows of PRINTED for ``documents`` (doc_id, html), which are cleaned first. A document that can't be printed is a row with its
    error. A blank or null html is an error as well; ids may be null or repeat; an empty table gives no rows."""

    def run(batches):
        for b in batches:
            out = []
            for markup in b.column("html").to_pylist():
                try:
                    if not (markup or "").strip():
                        raise ValueError("no html")
                    parts = chunks(sanitize_html(markup), renderer.heights)
                    pages = [page for part in parts for page in renderer.pages(part)]
                    out.append((len(parts), len(pages), *page_images(pages), "ok", None))
                except Exception as e:  # one bad document is a row, not a failed job
                    out.append((0, 0, None, None, "error", f"{type(e).__name__}: {e}"[:300]))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string())
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], [x.split()[0] for x in PRINTED.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "html").mapInArrow(run, PRINTED)
