"""Zip packages of XML parts: trees, relationships, media."""

from __future__ import annotations

import base64
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from functools import cached_property

from ..fixed import IMAGE_MIMES, MAX_IMAGE


def local(name: str) -> str:
    """Name without its namespace."""
    return name.rpartition("}")[2].rpartition(":")[2]


def attr(e: ET.Element | None, name: str, default: str | None = None) -> str | None:
    """An attribute by its local name."""
    if e is not None:
        for k, v in e.attrib.items():
            if local(k) == name:
                return v
    return default


def kids(e: ET.Element | None, name: str | None = None) -> list[ET.Element]:
    return [] if e is None else [k for k in e if isinstance(k.tag, str) and (name is None or local(k.tag) == name)]


def kid(e: ET.Element | None, name: str) -> ET.Element | None:
    return next(iter(kids(e, name)), None)


def find_all(e: ET.Element | None, name: str) -> list[ET.Element]:
    """Elements below (or the element itself) in document order."""
    return [] if e is None else [x for x in e.iter() if isinstance(x.tag, str) and local(x.tag) == name]


def find(e: ET.Element | None, name: str) -> ET.Element | None:
    return next(iter(find_all(e, name)), None)


def text_of(e: ET.Element | None) -> str:
    return "" if e is None else "".join(e.itertext())


def number(s: str | None, default: float = 0.0) -> float:
    m = re.match(r"\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", s or "")
    return float(m[0]) if m else default


def integer(s: str | None, default: int = 0) -> int:
    return int(number(s, default))


def emu_px(s: str | None) -> int:
    return int(number(s) / 9525 + 0.5)


def resolve(base: str, target: str) -> str:
    """Path of a relationship's target, seen from the part ``base``."""
    if not target or re.match(r"[a-z]+://", target, re.I):
        return target or ""
    path = target[1:] if target.startswith("/") else base.rpartition("/")[0] + "/" + target
    out: list[str] = []
    for p in path.split("/"):
        if p == "..":
            del out[-1:]
        elif p not in ("", "."):
            out.append(p)
    return "/".join(out)


def parse_xml(raw: bytes) -> ET.Element | None:
    """The tree; of a part that is no well-formed XML the tolerant HTML reader's tree."""
    try:
        return ET.fromstring(raw)
    except ET.ParseError:
        from .html import parse

        def build(n) -> ET.Element:
            e = ET.Element(n.tag.rpartition(":")[2] or "x", {k.rpartition(":")[2]: v for k, v in n.attrs.items()})
            for k in n.kids:
                if k.tag:
                    e.append(build(k))
                elif len(e):
                    e[-1].tail = (e[-1].tail or "") + k.text
                else:
                    e.text = (e.text or "") + k.text
            return e

        try:
            return build(parse(raw.decode("utf-8", "replace")))
        except RecursionError:
            return None


class Package:
    """An open package; parts, relationships and images are read once each."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.images: dict[str, str | None] = {}

    @cached_property
    def names(self) -> set[str]:
        return set(self.zip.namelist())

    def xml(self, part: str) -> ET.Element | None:
        return parse_xml(self.zip.read(part)) if part in self.names else None

    def rels(self, part: str) -> dict[str, dict]:
        """Relationships of a part by id: type, target, external."""
        folder, _, name = part.rpartition("/")
        root = self.xml(f"{folder}/_rels/{name}.rels".lstrip("/"))
        out = {}
        for r in find_all(root, "Relationship"):
            external = attr(r, "TargetMode") == "External"
            target = attr(r, "Target") or ""
            out[attr(r, "Id")] = {"type": attr(r, "Type") or "", "external": external, "target": target if external else resolve(part, target)}
        return out

    def image(self, part: str) -> str | None:
        """Data URI of an image a browser shows and that isn't too large."""
        if part not in self.images:
            mime = IMAGE_MIMES.get(part.rpartition(".")[2].lower())
            ok = mime and part in self.names and self.zip.getinfo(part).file_size <= MAX_IMAGE
            self.images[part] = f"data:{mime};base64,{base64.b64encode(self.zip.read(part)).decode()}" if ok else None
        return self.images[part]


def members(content: bytes) -> list[str] | None:
    try:
        return zipfile.ZipFile(io.BytesIO(content)).namelist()
    except (zipfile.BadZipFile, OSError, ValueError):
        return None
