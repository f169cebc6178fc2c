"""HTML to LaTeX source. Compiling it needs another program."""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.html import Node, parse

# --- fixed values: what stands before and behind the content of an element
AROUND = {
    "h1": ("\n\n{\\centering\\LARGE\\bfseries ", "\\par}\\vspace{6pt}\n\n"),
    "h2": ("\n\n{\\Large\\bfseries ", "}\\par\\vspace{4pt}\n\n"),
    "h3": ("\n\n{\\large\\bfseries ", "}\\par\\vspace{3pt}\n\n"),
    "strong": ("\\textbf{", "}"), "b": ("\\textbf{", "}"), "em": ("\\textit{", "}"), "i": ("\\textit{", "}"), "u": ("\\underline{", "}"),
    "br": ("\\\\\n", ""), "hr": ("\n\\vspace{4pt}\\hrule\\vspace{6pt}\n", ""),
    "ul": ("\n\\begin{itemize}\n", "\\end{itemize}\n"), "ol": ("\n\\begin{enumerate}\n", "\\end{enumerate}\n"), "li": ("\\item ", "\n"),
    "figure": ("\n\n{\\centering ", "\\par}\n\n"), "figcaption": ("\\\\{\\small\\itshape ", "}"),
}
PARAGRAPH = {"center": ("\n\n{\\centering ", "\\par}\n\n"), "right": ("\n\n{\\raggedleft ", "\\par}\n\n")}
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
ESCAPES = (
    ("\\", "\\textbackslash{}"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("{", "\\{"), ("}", "\\}"),
    ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}"), ("\u00a0", "~"),
)
MAIN_FONTS = {"ja": "Noto Serif CJK JP"}
PACKAGES = (
    "[a4paper,top=20mm,bottom=20mm,left=30mm,right=15mm]{geometry}", "{graphicx}", "[export]{adjustbox}", "{array}", "{fancyhdr}", "{setspace}", "{parskip}", "{ragged2e}",
)
SETTINGS = ("\\setlength{\\parindent}{0pt}", "\\onehalfspacing", "\\pagestyle{fancy}", "\\fancyhf{}", "\\renewcommand{\\headrulewidth}{0pt}", "\\cfoot{\\small\\thepage}")


def escape(text: str) -> str:
    """Entities first, in an order that decodes a twice escaped mark twice, then marks of the language in theirs."""
    for pair in (*ENTITIES, *ESCAPES):
        text = text.replace(*pair)
    return text


class Writer:
    """The source of a tree; images are collected as (file, content)."""

    def __init__(self):
        self.images: list[tuple[str, bytes]] = []

    def inside(self, node: Node) -> str:
        return "".join(map(self.of, node.kids))

    def of(self, node: Node) -> str:
        if not node.tag:
            return escape(node.text)
        if node.tag in ("p", "div"):
            align = re.search(r"text-align\s*:\s*(left|center|right)", node.attrs.get("style", ""), re.I)
            body = self.inside(node).strip()
            before, behind = PARAGRAPH.get(align[1].lower() if align else "", ("\n\n", "\\par\n\n"))
            return before + body + behind if body else "\\vspace{6pt}\n"
        if node.tag == "img":
            return self.image(node.attrs.get("src", ""))
        if node.tag == "table":
            return self.table(node)
        before, behind = AROUND.get(node.tag, ("", ""))
        if node.tag in ("ul", "ol"):
            return before + "".join(self.of(k) for k in node.kids if k.tag == "li") + behind
        return before + self.inside(node) + behind

    def image(self, src: str) -> str:
        kind, marked, data = src.partition(";base64,")
        if not marked or not re.fullmatch(r"data:image/[a-z0-9.+-]+", kind, re.I) or not data:
            return ""
        ext = re.sub("[^a-z0-9]", "", kind.rpartition("/")[2].replace("jpeg", "jpg"), flags=re.I) or "png"
        file = f"img{len(self.images)}.{ext}"
        self.images.append((file, base64.b64decode(data + "=" * (-len(data) % 4))))
        return f"\\includegraphics[max width=\\linewidth,max height=0.4\\textheight]{{{file}}}"

    def table(self, node: Node) -> str:
        """Rows of as many cells as the longest has."""
        below = lambda n, tags: [k for k in n.kids if k.tag in tags] + [x for k in n.kids if k.tag and k.tag not in tags for x in below(k, tags)]
        rows = [[self.inside(c).strip() for c in below(r, ("td", "th"))] for r in below(node, ("tr",))]
        wide = max(map(len, rows), default=0)
        if not wide:
            return ""
        lines = "".join(" & ".join(r + [""] * (wide - len(r))) + " \\\\ \\hline\n" for r in rows)
        return f"\n\\begin{{center}}\n\\begin{{tabular}}{{|{'|'.join('l' * wide)}|}}\n\\hline\n{lines}\\end{{tabular}}\n\\end{{center}}\n"


def to_latex(markup: str, lang: str = "en", font: str = "Noto Serif") -> tuple[str, list[tuple[str, bytes]]]:
    """(source of a whole document, its images)."""
    w = Writer()
    body = w.inside(parse(markup))
    head = ["\\documentclass[12pt,a4paper]{article}", "\\usepackage{fontspec}", f"\\setmainfont{{{MAIN_FONTS.get(lang, font)}}}", *(f"\\usepackage{p}" for p in PACKAGES), *SETTINGS]
    return "\n".join([*head, "\\begin{document}", body, "\\end{document}", ""]), w.images


def latex(documents: DataFrame, lang: str = "en") -> DataFrame:
    """(doc_id, tex, images) of ``documents`` (doc_id, html); images: array of (file, content). A null html gives nulls."""
    schema = "doc_id long, tex string, images array<struct<file: string, content: binary>>"
    kind = pa.list_(pa.struct([("file", pa.string()), ("content", pa.binary())]))

    def run(batches):
        for b in batches:
            found = [(None, None) if x is None else to_latex(x, lang) for x in b.column("html").to_pylist()]
            images = [None if i is None else [{"file": f, "content": c} for f, c in i] for _, i in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t for t, _ in found], pa.string()), pa.array(images, kind)], ["doc_id", "tex", "images"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "html").mapInArrow(run, schema)
