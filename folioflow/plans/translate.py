"""Translation of HTML: select, batch, translate, put back. A page is a task's work; nothing is shuffled."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import BATCH_CHARS, BATCH_ITEMS, DEMO_TAGS, LANGUAGES
from ..functions.text import NOT_TRANSLATABLE
from ..operators.runs import Filling
from .services import pooled

#: (texts of a batch, target) to as many texts.
Provider = Callable[[list[str], str], list[str]]
RESULT = "doc_id long, html string, n_batches long, n_failed long, doc_failed boolean, first_error string"
DEMO_NOTE = '<div class="demo-note">Demonstration: register a translation provider for real translations.</div>'
_PASS = re.compile(NOT_TRANSLATABLE)


def demo(texts: list[str], target: str) -> list[str]:
    return [DEMO_TAGS[target] + t for t in texts]


PROVIDERS: dict[str, Provider] = {"demo": demo}


def provider_of(name: str) -> Provider:
    """A registered provider; an unknown name is an error, not silently the demonstration."""
    if name.lower() not in PROVIDERS:
        raise ValueError(f"no translation provider {name!r}")
    return PROVIDERS[name.lower()]


def batches(texts: list[str]) -> list[list[int]]:
    """Indexes of the texts by batch, by the limits of a request."""
    filling, out = Filling(BATCH_CHARS, BATCH_ITEMS), []
    for i, text in enumerate(texts):
        if filling.place(len(text.encode("utf-16-le")) // 2) == len(out):
            out.append([])
        out[-1].append(i)
    return out


def _escaped(text: str) -> str:
    return text.strip().replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def translate_page(markup: str, target: str, provider: Provider) -> tuple[str, int, int, str | None]:
    """(html, batches, failed batches, first error). Texts that translate keep the blanks around them; a batch that fails
    keeps its texts, and a page with nothing to translate, or no batch that works, is as it was."""
    from ..sources.html import decode, parse, serialize, walk

    root = parse(markup)
    nodes = [x for x, _, _, skip in walk(root) if not x.tag and not skip]
    some = [(x, t) for x, t in ((x, decode(x.text)) for x in nodes) if t.strip() and not _PASS.fullmatch(t)]
    parts = batches([t for _, t in some])

    def call(part: list[int]) -> tuple[list[str] | None, str | None]:
        try:
            out = provider([some[i][1] for i in part], target)
            if not isinstance(out, list) or len(out) != len(part):
                raise ValueError("wrong number of texts")
            return out, None
        except Exception as e:  # a provider's failure is data
            return None, str(e)

    answers = pooled(call, parts)
    errors = [e for _, e in answers if e is not None]
    if len(errors) == len(parts):
        return markup, len(parts), len(errors), errors[0] if errors else None
    for part, (out, _) in zip(parts, answers, strict=True):
        for i, new in zip(part, out or [], strict=False):
            if isinstance(new, str):
                node, old = some[i]
                lead, tail = len(old) - len(old.lstrip()), len(old.rstrip())
                node.text = old[:lead] + _escaped(new) + old[tail:]
    return serialize(root), len(parts), len(errors), errors[0] if errors else None


def translate_html(pages: DataFrame, target: str, provider: str | Provider = "demo", note: bool = False) -> DataFrame:
    """Rows of RESULT for ``pages`` (doc_id, html), each page alone (:func:`translate_page`), with a few calls of its batches at once.

    Where all batches of a page fail, the page has failed and keeps its text. ``note`` puts DEMO_NOTE before what the demonstration
    translated. A null html stays null; null and repeated doc_ids are rows like others; an empty table gives no rows.
    Speculative execution should be off where calls cost money."""
    if target not in LANGUAGES:
        raise ValueError(f"target must be one of {LANGUAGES}")
    call = provider_of(provider) if isinstance(provider, str) else provider
    lead = DEMO_NOTE if note and call is demo else ""

    def run(rows):
        for b in rows:
            out = []
            for markup in b.column("html").to_pylist():
                html, n, failed, error = translate_page(markup, target, call) if markup else (markup, 0, 0, None)
                out.append((lead + html if n > failed else html, n, failed, n > 0 and n == failed, error))
            html, n, failed, lost, error = zip(*out, strict=True) if out else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(html, pa.string()), pa.array(n, pa.int64()), pa.array(failed, pa.int64()), pa.array(lost, pa.bool_()), pa.array(error, pa.string())],
                [x.split()[0] for x in RESULT.split(", ")],
            )

    return pages.select(F.col("doc_id").cast("long").alias("doc_id"), "html").mapInArrow(run, RESULT)
