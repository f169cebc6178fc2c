"""What a file is: extension, leading bytes, names inside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import EXTENSIONS, ZIP_KINDS


def extension(name: Column) -> Column:
    """Lower-cased text after the last dot; '' without one."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(?s)\.([^.]*)$", 1))


def kind_of_extension(ext: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, exts in reversed(EXTENSIONS.items()):
        out = F.when(ext.isin(*exts.split()), kind).otherwise(out)
    return out


def _starts(content: Column, hex_: str) -> Column:
    return F.startswith(content, F.unhex(F.lit(hex_)))


def sniff(content: Column, members: Column | None = None) -> Column:
    """Kind by leading bytes: fewer than 4 bytes, and unknown ones, null; ``members``: names in the
    zip archive, if it could be read, tested in the order docx, xlsx, pptx, odf."""
    out = F.when(F.octet_length(content) < 4, F.lit(None).cast("string"))
    for hex_, kind in (("25504446", "pdf"), ("7B5C727466", "rtf"), ("89504E47", "image"), ("FFD8FF", "image"), ("47494638", "image"), ("424D", "image")):
        out = out.when(_starts(content, hex_), kind)
    webp = _starts(content, "52494646") & (F.substring(content, 9, 4) == F.unhex(F.lit("57454250")))
    out = out.when(webp, "image").when(_starts(content, "D0CF11E0"), "cfb")
    if members is not None:
        zip_ = _starts(content, "504B0304")
        for part, kind in (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"), ("content.xml", "odf")):
            out = out.when(zip_ & F.array_contains(members, part), kind)
    return out


def cfb_kind(content: Column) -> Column:
    """Which old office file a compound file is, by stream names in its first MiB."""
    head = F.substring(content, 1, 1 << 20)
    has = lambda name: F.contains(head, F.unhex(F.lit("00".join(f"{ord(c):02X}" for c in name))))
    return F.when(has("WordDocument"), "doc").when(has("Workbook") | has("Book"), "xls").when(has("PowerPoint"), "ppt").otherwise("xls")


def resolve(ext_kind: Column, sniffed: Column, cfb: Column) -> Column:
    """The extension decides; bytes decide for unknown extensions, and where a zip-based kind holds
    something else. Null stays: such files are read as text."""
    office = ext_kind.isin(*ZIP_KINDS)
    found = F.when(sniffed == "cfb", cfb).otherwise(sniffed)
    return F.when(ext_kind.isNull(), found).when(office & sniffed.isNotNull() & (sniffed != ext_kind), found).otherwise(ext_kind)
