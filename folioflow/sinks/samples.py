"""Small files of every kind, made from table rows; input for queries and tests of the readers."""

from __future__ import annotations

import io
import struct
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame

from .docx import to_docx


def package(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body)
    return out.getvalue()


def rels(*items: tuple[str, str, str]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="http://x/{t}" Target="{to}"/>' for i, t, to in items) + "</Relationships>"


def xlsx(title: str, n: int) -> bytes:
    rows = "".join(f'<row r="{r}"><c r="A{r}" t="s"><v>0</v></c><c r="B{r}"><v>{n * r}</v></c><c r="C{r}" t="inlineStr"><is><t>note {r}</t></is></c></row>' for r in range(1, 4))
    rows += f'<row r="4"><c r="A4" s="1"><v>{44197 + n}</v></c><c r="B4" s="2"><v>0.{n:02d}5</v></c><c r="C4" t="s"><v>1</v></c></row><row r="5"><c r="A5" s="3"><v>-{n}234.5</v></c><c r="B5" t="b"><v>1</v></c></row>'
    sheet = f'<worksheet><cols><col min="3" max="3" width="0" hidden="1"/></cols><sheetData>{rows}</sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>'
    return package({
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="Main" r:id="rId1"/><sheet name="Old" state="hidden" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(("rId1", "worksheet", "worksheets/sheet1.xml"), ("rId2", "worksheet", "worksheets/sheet2.xml")),
        "xl/sharedStrings.xml": f"<sst><si><t>{title} &amp; co</t></si><si><r><t>plain </t></r><r><rPr><b/><i/></rPr><t>{title}</t></r></si></sst>",
        "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="#,##0.00;[Red]\\(#,##0.00\\)"/></numFmts><cellXfs><xf/><xf numFmtId="14"/><xf numFmtId="10"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet2.xml": "<worksheet><sheetData/></worksheet>",
    })


def pptx(title: str, n: int) -> bytes:
    shape = lambda y, text, kind="", para="": f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p>{para}<a:r><a:rPr b="1"/><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    body = shape(900 + n, "point", para="<a:pPr lvl='1'/>") + shape(10, title, '<p:ph type="title"/>')
    slide = f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>'
    return package({
        "ppt/presentation.xml": '<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId r:id="rId1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("rId1", "slide", "slides/slide1.xml")), "ppt/slides/slide1.xml": slide,
    })


def odt(title: str, n: int) -> bytes:
    cell = f'<table:table-cell table:number-columns-repeated="2"><text:p>{n}</text:p></table:table-cell><table:table-cell table:number-columns-repeated="1000"/>'
    body = f'<text:h text:outline-level="2">{title}</text:h><text:p>a<text:s text:c="3"/>b<text:line-break/>c</text:p><table:table><table:table-row>{cell}</table:table-row></table:table>'
    return package({"content.xml": f'<office:document xmlns:office="o" xmlns:text="t" xmlns:table="b"><office:body><office:text>{body}</office:text></office:body></office:document>'})


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of 512-byte sectors; streams are padded to 4096 bytes, so no mini stream is needed."""
    data = {k: v.ljust(max(4096, -(-len(v) // 512) * 512), b"\0") for k, v in streams.items()}
    fat, body, entries = [0xFFFFFFFD], b"", []
    at = 2  # sector 0: FAT, 1: directory
    for name, v in data.items():
        entries.append((name, at, len(v)))
        n = len(v) // 512
        body, at = body + v, at + n
    fat += [0xFFFFFFFE]
    for _, start, size in entries:
        fat += [*range(start + 1, start + size // 512), 0xFFFFFFFE]
    fat += [0xFFFFFFFF] * (128 - len(fat))

    def entry(name: str, kind: int, start: int, size: int) -> bytes:
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, 1 if kind == 5 else 0xFFFFFFFF) + b"\0" * 36 + struct.pack("<IQ", start, size)

    directory = entry("Root Entry", 5, 0xFFFFFFFE, 0) + b"".join(entry(n, 2, s, z) for n, s, z in entries[:3])
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<IIIIIIII", 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head + struct.pack("<128I", *fat) + directory.ljust(512, b"\0") + body


def doc(text: str, page: str = "cp1251") -> bytes:
    """A Word 97-2003 file of one 8-bit piece."""
    raw = text.encode(page)
    main = bytearray(0x400 + len(raw))
    struct.pack_into("<H", main, 0, 0xA5EC)
    struct.pack_into("<H", main, 0x20, 14)
    struct.pack_into("<H", main, 0x22 + 28, 22)
    pairs = 0x22 + 28 + 2 + 88 + 2
    clx = b"\x02" + struct.pack("<I", 16) + struct.pack("<II", 0, len(raw)) + struct.pack("<HIH", 0, 0x40000000 | 0x400 * 2, 0)
    struct.pack_into("<II", main, pairs + 66 * 4, 0, len(clx))
    main[0x400:] = raw
    return compound({"WordDocument": bytes(main), "0Table": clx})


def one_of_each(title: str, n: int) -> dict[str, bytes]:
    t = title.encode()
    return {
        "a.docx": to_docx(f"<h1>{title}</h1><p>x <b>y</b></p><table><tr><td>{n}</td></tr></table>", title), "b.xlsx": xlsx(title, n), "c.pptx": pptx(title, n), "d.odt": odt(title, n),
        "e.doc": doc(f"Привет {title}\rline two\r"), "f.rtf": b"{\\rtf1\\ansi {\\b " + t + b"}\\par second \\i it\\i0\\par}", "g.csv": t + b',"x,y"\n1,2\n', "h.tsv": t + b"\tz\n",
        "i.md": b"# " + t + b"\n\n- a\n- b\n\n|x|y|\n|-|-|\n|1|2|\n", "j.html": b"<html><style>p{top:1px}</style><body><form><p onclick=x>" + t + b"</p></form></body></html>",
        "k.txt": t + b"\n\nnext", "l.json": b'{"a": "' + t + b'"}', "m.png": b"\x89PNG\r\n\x1a\n" + t, "n.pdf": b"%PDF-1.4 " + t, "o.ppt": compound({"PowerPoint Document": t}),
        "p.docx": b"broken " + t, "q.bin": b"\xcf\xf0\xe8\xe2\xe5\xf2 " + t, "r": b"%PDF-" + t, "s.docx": doc(title + "\r"),
    }


def sample_files(nations: DataFrame) -> DataFrame:
    """(doc_id, name, content, mime): one file of each kind for each row (n_nationkey, n_name)."""

    def run(batches):
        for b in batches:
            rows = []
            for key, name in zip(b.column("n_nationkey").to_pylist(), b.column("n_name").to_pylist(), strict=True):
                rows += [(key * 100 + i, f"{key}-{f}", body, None) for i, (f, body) in enumerate(one_of_each(name, key).items())]
            if rows:
                cols = [*zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.string())], ["doc_id", "name", "content", "mime"])

    return nations.select("n_nationkey", "n_name").mapInArrow(run, "doc_id long, name string, content binary, mime string")
