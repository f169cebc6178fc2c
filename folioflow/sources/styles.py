"""Spreadsheet styles to CSS."""

from __future__ import annotations

import re

from ..fixed import BORDERS, FONT_FALLBACKS, FONT_SUBSTITUTES, FORMATS, H_ALIGN, INDEXED, THEME, THEME_ORDER, V_ALIGN
from .opc import attr, find, integer, kid, kids, number


def argb(s: str | None) -> str | None:
    h = re.sub("[^0-9a-fA-F]", "", s or "").upper()
    return f"#{h[-6:]}" if len(h) in (6, 8) else None


def tint(color: str, amount: float) -> str:
    """Lightness scaled with hue and saturation kept: each channel keeps its place between the extremes. In the
    order of ``numbers.tint``, so that halves are rounded alike."""
    if not amount:
        return color
    rgb = [int(color[i : i + 2], 16) for i in (1, 3, 5)]
    top, low = max(rgb), min(rgb)
    light = (top + low) / 2 / 255
    after = light * (1 + amount) if amount < 0 else light * (1 - amount) + amount
    scale = (1 - abs(2 * after - 1)) / (1 - abs(2 * light - 1)) if top > low else 0
    return "#" + "".join(f"{max(0, min(255, int((after + (v / 255 - light) * scale) * 255 + 0.5))):02X}" for v in rgb)


def read_theme(root) -> list[str]:
    named = {}
    for e in kids(find(root, "clrScheme")):
        srgb, system = kid(e, "srgbClr"), kid(e, "sysClr")
        given = attr(srgb, "val") if srgb is not None else attr(system, "lastClr") or {"window": "FFFFFF"}.get(attr(system, "val"), "000000") if system is not None else None
        if argb(given):
            named[e.tag.rpartition("}")[2]] = argb(given)
    return [named.get(n, f"#{c}") for n, c in zip(THEME_ORDER, THEME, strict=True)]


def color(e, theme: list[str]) -> str | None:
    if e is None or attr(e, "auto") == "1":
        return None
    if attr(e, "rgb"):
        return argb(attr(e, "rgb"))
    for name, table in (("theme", theme), ("indexed", INDEXED)):
        if attr(e, name) is not None:
            i = integer(attr(e, name), -1)
            found = table[i] if 0 <= i < len(table) else None
            return found and tint(f"#{found.lstrip('#')}", number(attr(e, "tint")) if name == "theme" else 0)
    return None


def font_stack(name: str) -> str:
    clean = re.sub("['\"]", "", name).strip()
    return ", ".join(x for x in (f"'{clean}'", FONT_SUBSTITUTES.get(clean.lower()), FONT_FALLBACKS) if x)


class Styles:
    """CSS of cell formats by their index."""

    def __init__(self, root, theme_root):
        self.theme = read_theme(theme_root)
        on = lambda e: e is not None and attr(e, "val") != "0"
        self.fonts = [
            {
                "bold": on(kid(f, "b")), "italic": on(kid(f, "i")), "strike": on(kid(f, "strike")), "size": number(attr(kid(f, "sz"), "val"), 11),
                "under": kid(f, "u") is not None and attr(kid(f, "u"), "val") != "none", "name": attr(kid(f, "name"), "val") or "",
                "color": color(kid(f, "color"), self.theme), "script": attr(kid(f, "vertAlign"), "val"),
            }
            for f in kids(kid(root, "fonts"), "font")
        ]
        self.base = self.fonts[0] if self.fonts else {"size": 11.0, "name": "Calibri"}
        self.fills = [self._fill(f) for f in kids(kid(root, "fills"), "fill")]
        self.borders = [[(side, self._side(kid(b, side))) for side in ("top", "right", "bottom", "left")] for b in kids(kid(root, "borders"), "border")]
        self.formats = kids(kid(root, "cellXfs"), "xf")
        own = {integer(attr(f, "numFmtId")): attr(f, "formatCode") or "" for f in kids(kid(root, "numFmts"), "numFmt")}
        self.codes = [own.get(i) or FORMATS.get(i, "General") for i in (integer(attr(x, "numFmtId")) for x in self.formats)]
        self.known: dict = {}

    def code(self, index: int | None) -> str:
        """The number format of a cell format."""
        return self.codes[index] if index is not None and 0 <= index < len(self.codes) else "General"

    def _fill(self, f) -> str | None:
        pattern, gradient = kid(f, "patternFill"), kid(f, "gradientFill")
        if gradient is not None:
            return color(kid(kid(gradient, "stop"), "color"), self.theme)
        if pattern is None or (attr(pattern, "patternType") or "none") == "none":
            return None
        return color(kid(pattern, "fgColor"), self.theme) or color(kid(pattern, "bgColor"), self.theme)

    def _side(self, e) -> str | None:
        style = attr(e, "style")
        return None if style in (None, "", "none") else f"{BORDERS.get(style, '1px solid')} {color(kid(e, 'color'), self.theme) or '#000000'}"

    def css(self, index: int | None, is_number: bool) -> tuple[str, bool]:
        """(declarations, whether text wraps)."""
        key = (index, is_number)
        if key not in self.known:
            ok = index is not None and 0 <= index < len(self.formats)
            self.known[key] = self._css(self.formats[index], is_number) if ok else ("text-align: right" if is_number else "", False)
        return self.known[key]

    def _css(self, xf, is_number: bool) -> tuple[str, bool]:
        at = lambda table, name: table[i] if 0 <= (i := integer(attr(xf, name))) < len(table) else None
        out, place = [], kid(xf, "alignment")
        f = at(self.fonts, "fontId") or self.base
        if attr(xf, "applyFont") != "0":
            lines = [n for n, k in (("underline", "under"), ("line-through", "strike")) if f.get(k)]
            out += ["font-weight: 700"] * bool(f.get("bold")) + ["font-style: italic"] * bool(f.get("italic"))
            out += [f"text-decoration: {' '.join(lines)}"] * bool(lines)
            if f["size"] and abs(f["size"] - self.base["size"]) > 0.01:
                out.append(f"font-size: {int(f['size'] * 100 + 0.5) / 100:g}pt")
            if f.get("color") not in (None, "#000000"):
                out.append(f"color: {f['color']}")
            if f["name"]:
                out.append(f"font-family: {font_stack(f['name'])}")
            if f.get("script") in ("superscript", "subscript"):
                out.append(f"vertical-align: {f['script'][:-6]}")
        if attr(xf, "applyFill") != "0" and (fill := at(self.fills, "fillId")):
            out.append(f"background-color: {fill}")
        if attr(xf, "applyBorder") != "0":
            out += [f"border-{side}: {css}" for side, css in at(self.borders, "borderId") or [] if css]
        across = H_ALIGN.get(attr(place, "horizontal") or "", "right" if is_number else "")
        out += [f"text-align: {across}"] * bool(across) + [f"vertical-align: {V_ALIGN.get(attr(place, 'vertical') or '', 'bottom')}"]
        if indent := integer(attr(place, "indent")):
            out.append(f"padding-left: {4 + indent * 9}px")
        out += ["writing-mode: vertical-rl"] * (integer(attr(place, "textRotation")) == 255)
        return "; ".join(out), attr(place, "wrapText") == "1"
