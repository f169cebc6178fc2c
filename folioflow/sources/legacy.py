"""Compound files, old Word documents, and rich text."""

from __future__ import annotations

import re
import struct

from .markdown import escape

_FREE = 0xFFFFFFFA  # sector numbers from here on are marks


class Compound:
    """Streams of a compound file by name."""

    def __init__(self, b: bytes):
        if b[:4] != b"\xd0\xcf\x11\xe0" or len(b) < 512:
            raise ValueError("no compound file")
        self.b, self.size, self.mini_size = b, 1 << struct.unpack_from("<H", b, 30)[0], 1 << struct.unpack_from("<H", b, 32)[0]
        n_fat, dir_at, _, self.cutoff, mini_at, n_mini, difat_at, n_difat = struct.unpack_from("<I I I I I I I I", b, 44)
        table = [x for x in struct.unpack_from("<109I", b, 76) if x < _FREE][:n_fat]
        while difat_at < _FREE and n_difat:
            more = struct.unpack_from(f"<{self.size // 4}I", b, self._at(difat_at))
            table += [x for x in more[:-1] if x < _FREE]
            difat_at, n_difat = more[-1], n_difat - 1
        self.fat = [x for s in table[:n_fat] for x in struct.unpack_from(f"<{self.size // 4}I", b, self._at(s))]
        raw, self.entries = self._chain(dir_at), {}
        self.root = b""
        for i in range(0, len(raw) - 127, 128):
            n, kind = struct.unpack_from("<H", raw, i + 64)[0], raw[i + 66]
            name = raw[i : i + max(0, n - 2)].decode("utf-16-le", "replace")
            start, size = struct.unpack_from("<IQ", raw, i + 116)
            if kind == 5:
                self.root = self._chain(start)
            elif kind == 2:
                self.entries.setdefault(name, (start, size & 0xFFFFFFFF))
        mini = self._chain(mini_at) if n_mini else b""
        self.mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini)

    def _at(self, sector: int) -> int:
        return (sector + 1) * self.size

    def _chain(self, s: int) -> bytes:
        out, seen = [], 0
        while s < _FREE and s < len(self.fat) and seen <= len(self.fat):
            out.append(self.b[self._at(s) : self._at(s) + self.size])
            s, seen = self.fat[s], seen + 1
        return b"".join(out)

    def stream(self, name: str) -> bytes | None:
        if name not in self.entries:
            return None
        s, size = self.entries[name]
        if size >= self.cutoff:
            return self._chain(s)[:size]
        out, seen = [], 0
        while s < _FREE and s < len(self.mini_fat) and seen <= len(self.mini_fat):
            out.append(self.root[s * self.mini_size : (s + 1) * self.mini_size])
            s, seen = self.mini_fat[s], seen + 1
        return b"".join(out)[:size]


def codepage(pieces: list[bytes]) -> str:
    """Cyrillic or Western, by a vote of the bytes from 0x80 on."""
    high = [x for p in pieces for x in p if x >= 0x80]
    cyrillic = sum(x >= 0xC0 or x in (0xA8, 0xB8) for x in high)
    return "cp1251" if high and cyrillic / len(high) >= 0.5 else "cp1252"


def word_text(b: bytes) -> str:
    """Text of a Word 97-2003 file by its piece table."""
    cfb = Compound(b)
    doc = cfb.stream("WordDocument")
    if not doc or len(doc) < 0x200 or struct.unpack_from("<H", doc)[0] != 0xA5EC:
        raise ValueError("no Word 97-2003 document")
    names = ("1Table", "0Table") if struct.unpack_from("<H", doc, 0x0A)[0] & 0x0200 else ("0Table", "1Table")
    table = next((t for n in names if (t := cfb.stream(n))), None)
    if table is None:
        raise ValueError("no table stream")
    u16, u32 = (lambda at: struct.unpack_from("<H", doc, at)[0]), (lambda at: struct.unpack_from("<I", doc, at)[0])
    longs = 0x22 + 2 * u16(0x20)
    pairs = longs + 2 + 4 * u16(longs) + 2
    if pairs + 68 * 4 > len(doc):
        raise ValueError("short header")
    at, size = u32(pairs + 66 * 4), u32(pairs + 67 * 4)
    clx = table[at : at + size]
    if not size or len(clx) < size:
        raise ValueError("no piece table")
    p = 0
    while p < len(clx) and clx[p] == 1:
        p += 3 + struct.unpack_from("<H", clx, p + 1)[0]
    if p >= len(clx) or clx[p] != 2:
        raise ValueError("no pieces")
    plc = clx[p + 5 : p + 5 + struct.unpack_from("<I", clx, p + 1)[0]]
    n = (len(plc) - 4) // 12
    bounds, pieces = struct.unpack_from(f"<{n + 1}I", plc), []
    for i in range(n):
        fc = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * i + 2)[0]
        narrow, chars, place = bool(fc & 0x40000000), bounds[i + 1] - bounds[i], fc & 0x3FFFFFFF
        start, length = (place // 2, chars) if narrow else (place, 2 * chars)
        if chars > 0 and start + length <= len(doc):
            pieces.append((doc[start : start + length], narrow))
    page = codepage([x for x, narrow in pieces if narrow])
    return "".join(x.decode(page if narrow else "utf-16-le", "replace") for x, narrow in pieces)


def doc_html(b: bytes) -> tuple[str, list[str]]:
    text = re.sub("[\x00-\x06\x08\x0e-\x1f]", "", re.sub("\x13.*?\x14", "", word_text(b), flags=re.S))
    lines = [x.replace("\x0b", "\n").strip() for x in re.split("[\r\x07\x0c]", text)]
    html = "".join("<p>" + escape(x).replace("\n", "<br/>").replace("\t", " &nbsp;·&nbsp; ") + "</p>" for x in lines if x)
    if not html:
        raise ValueError("no text")
    return html, ["text_only"]


# --- rich text

_TOKEN = re.compile(rb"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I)
_QUIET = set("fonttbl colortbl stylesheet info generator header footer footnote themedata datastore listtable listoverridetable rsidtbl xmlnstbl".split())
_CHARS = {"tab": "\t", "line": "\n", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}


def rtf_html(b: bytes) -> tuple[str, list[str]]:
    """Paragraphs, bold, italic, tables and embedded PNG and JPEG images. State is kept by group."""
    import base64

    page, state, stack = "cp1252", {"b": False, "i": False, "quiet": False, "pict": "", "uc": 1}, []
    out, para, row, in_row, image, skip = [], [], [], False, [], 0

    def put(s: str) -> None:
        if s and not state["quiet"]:
            if state["pict"]:
                image.append(s)
                return
            html = escape(s).replace("\n", "<br/>").replace("\t", "&nbsp;" * 4)
            html = f"<em>{html}</em>" if state["i"] else html
            para.append(f"<strong>{html}</strong>" if state["b"] else html)

    def table() -> None:
        nonlocal in_row
        if in_row:
            out.append("</tbody></table>")
            in_row = False

    for m in _TOKEN.finditer(b):
        word, arg, hex_, sign, brace, plain = m[1], m[2], m[3], m[4], m[5], m[6]
        if brace == b"{":
            stack.append(dict(state))
        elif brace == b"}":
            if state["pict"] and image and not (stack and stack[-1]["pict"]):
                raw = bytes.fromhex(re.sub("[^0-9a-fA-F]", "", "".join(image))[: 2 * (sum(map(len, image)) // 2)])
                para.append(f'<img src="data:{state["pict"]};base64,{base64.b64encode(raw).decode()}"/>')
                image.clear()
            state = stack.pop() if stack else state
        elif hex_:
            if skip:
                skip -= 1
            else:
                put(bytes([int(hex_, 16)]).decode(page, "replace"))
        elif sign == b"*":
            state["quiet"] = True
        elif sign in (b"\\", b"{", b"}", b"~"):
            put({b"~": "\u00a0"}.get(sign, sign.decode()))
        elif word:
            w, n = word.decode().lower(), int(arg) if arg else None
            if w in _QUIET:
                state["quiet"] = True
            elif w == "pict":
                state |= {"quiet": False, "pict": "image/png"}
            elif w in ("jpegblip", "pngblip"):
                state["pict"] = "image/jpeg" if w[0] == "j" else "image/png"
            elif w in ("b", "i"):
                state[w] = n != 0
            elif w == "plain":
                state |= {"b": False, "i": False}
            elif w == "ansicpg" and n:
                page = f"cp{n}" if n in (1250, 1251, 1252, 1253, 1254, 1257) else page
            elif w == "uc":
                state["uc"] = n or 0
            elif w == "u" and n is not None:
                put(chr(n % 65536) if not 0xD800 <= n % 65536 < 0xE000 else "")
                skip = state["uc"]
            elif w == "cell":
                row.append("".join(para))
                para.clear()
            elif w == "row":
                out += [] if in_row else ['<table class="doc-datatable"><tbody>']
                out.append("<tr>" + "".join(f"<td>{c or '&nbsp;'}</td>" for c in row) + "</tr>")
                in_row = True
                row.clear()
            elif w == "par":
                table()
                out += [f"<p>{''.join(para)}</p>"] * bool("".join(para).strip())
                para.clear()
            elif w in _CHARS:
                put(_CHARS[w])
        elif plain:
            s = plain.decode(page, "replace")
            put(s[skip:])
            skip = max(0, skip - len(s))
    table()
    out += [f"<p>{''.join(para)}</p>"] * bool("".join(para).strip())
    return "".join(out), []
