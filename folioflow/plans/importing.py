"""Import: files of any kind to sanitised HTML. Errors are data."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import MAX_UPLOAD, MOST_WARNINGS, OCR_IMAGE, OCR_PDF
from ..operators import classify

IMPORTED = "doc_id long, name string, kind string, sniffed_kind string, html string, warnings array<string>, status string, error string"


class Unsupported(Exception):
    """A format that no reader here reads."""


#: Readers that need another program or service: (bytes, mime) to (html, warnings). None are built in;
#: keys: "pdf", "xls", "office" (documents that the own reader can't read), "ocr_image", "ocr_pdf".
External = dict[str, Callable[[bytes, str], tuple[str, list[str]]]]


def scan(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(doc_id, name, content, mime, length) of files; doc_id is a hash of the path. Files above the size limit are rows with
    null content, which :func:`import_files` reports."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    # the reader refuses files above its own limit unless their content isn't asked for
    fits = files.filter(F.col("length") <= MAX_UPLOAD).select("path", "length", "content")
    large = files.filter(F.col("length") > MAX_UPLOAD).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return fits.unionByName(large).select(
        F.xxhash64("path").alias("doc_id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content", F.lit(None).cast("string").alias("mime"), "length"
    )


def with_kind(files: DataFrame) -> DataFrame:
    """Adds ext, sniffed and kind. Names inside zip archives come from Python, all else from expressions on the first bytes."""
    from ..sources.opc import members

    schema = files.schema

    def list_members(batches):
        for b in batches:
            names = [members(c) if c[:4] == b"PK\x03\x04" else None for c in (x or b"" for x in b.column("content").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.list_(pa.string()))], [*b.schema.names, "_members"])

    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    listed = files.mapInArrow(list_members, StructType([*schema.fields, StructField("_members", ArrayType(StringType()))]))
    content, sniffed = F.coalesce("content", F.lit(b"")), F.col("sniffed_kind")
    named = listed.withColumn("ext", classify.extension(F.col("name"))).withColumn("sniffed_kind", classify.sniff(content, F.col("_members")))
    kind = classify.resolve(classify.kind_of_extension(F.col("ext")), sniffed, classify.cfb_kind(content))
    return named.withColumn("kind", kind).drop("_members")


def first_warnings(found: list[str]) -> list[str]:
    """The first few of a library's warnings; a reader may have one for each paragraph."""
    return found[:MOST_WARNINGS]


def read(kind: str | None, ext: str, b: bytes, mime: str, external: External) -> tuple[str, list[str]]:
    """HTML, not yet sanitised, and warnings of one file."""
    from ..sources import docx, legacy, markdown, odf, plain, pptx, xlsx

    def outside(key: str) -> tuple[str, list[str]]:
        if key not in external:
            raise Unsupported(f"no reader for {key}")
        return external[key](b, mime)

    if kind == "docx":
        if "office" in external:
            try:
                return outside("office")
            except Exception:  # the own reader is the next choice
                pass
        html, found = docx.to_html(b)
        return html, first_warnings(found)
    if kind == "doc":
        try:
            return legacy.doc_html(b)
        except Exception:
            if "office" in external:
                return outside("office")
            raise
    if kind in ("xlsx", "xls"):
        return outside("xls") if b[:4] != b"PK\x03\x04" else xlsx.to_html(b)
    if kind == "pptx":
        return pptx.to_html(b)
    if kind == "odf":
        return odf.to_html(b)
    if kind == "rtf":
        return legacy.rtf_html(b)
    if kind == "pdf":
        if "ocr_pdf" in external and "pdf" not in external and len(b) <= OCR_PDF:
            html, found = outside("ocr_pdf")
            return html, [*found, "read_by_ocr"]
        return outside("pdf")
    if kind == "ppt":
        raise Unsupported("ppt")
    if kind == "image":
        mime = mime if (mime or "").startswith("image/") else "image/png"
        if "ocr_image" in external and len(b) <= OCR_IMAGE:
            html, warnings = external["ocr_image"](b, mime)
            return html + "<hr/>" + plain.image_html(b, mime), [*warnings, "read_by_ocr"]
        return plain.image_html(b, mime), ["image_text_not_read"]
    text = plain.decode(b)
    if kind == "csv":
        return plain.table_html(text, ext), []
    if kind == "markdown":
        return markdown.to_html(text), []
    if kind == "html":
        return plain.file_html(text), []
    return plain.text_html(text, ext), [] if kind == "text" else [f"unknown_kind:{ext or '?'}"]


def required(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with something in ``column``, the others with ``error``)."""
    kind = dict(rows.dtypes)[column]
    there = F.col(column).isNotNull() & (F.length(column) > 0 if kind in ("string", "binary") else F.lit(True))
    return rows.filter(there), rows.filter(~there).withColumn("error", F.lit(f"no {column}"))


def import_files(files: DataFrame, external: External | None = None) -> DataFrame:
    """``files`` (doc_id, name, content, mime) to rows of IMPORTED; status ok, unsupported or error.

    Contents go to Python in Arrow batches that Spark bounds in bytes (spark.sql.execution.arrow.maxBytesPerBatch; a file
    larger than that is a batch of its own)."""
    outside: Any = external or {}
    typed = with_kind(files.select("doc_id", "name", "content", "mime"))

    def run(batches):
        from ..sources.html import sanitize_html

        for b in batches:
            html, warnings, status, errors = [], [], [], []
            for kind, ext, content, mime in zip(*[b.column(c).to_pylist() for c in ("kind", "ext", "content", "mime")], strict=True):
                try:
                    if content is None:
                        raise ValueError(f"no content, or more than {MAX_UPLOAD} bytes")
                    h, w = read(kind, ext, content, mime or "", outside)
                    row = (sanitize_html(h), w, "ok", None)
                except Unsupported as e:
                    row = (None, [], "unsupported", str(e))
                except Exception as e:  # one bad file is a row, not a failed job
                    row = (None, [], "error", f"{type(e).__name__}: {e}"[:300])
                for out, v in zip((html, warnings, status, errors), row, strict=True):
                    out.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("name"), b.column("kind"), b.column("sniffed_kind"), pa.array(html, pa.string()), pa.array(warnings, pa.list_(pa.string())), pa.array(status), pa.array(errors, pa.string())],
                [x.split()[0] for x in IMPORTED.split(", ")],
            )

    return typed.select(F.col("doc_id").cast("long").alias("doc_id"), "name", "content", "mime", "ext", "sniffed_kind", "kind").mapInArrow(run, IMPORTED)
