"""Tables and limits whose contents are part of the formats and policies, as plain text."""

from __future__ import annotations

# --- fixed values: file extensions of each kind
EXTENSIONS = {
    "docx": "docx docm dotx",
    "doc": "doc dot",
    "xlsx": "xlsx xlsm xltx xltm",
    "xls": "xls xlsb xlt",
    "pptx": "pptx pptm potx",
    "ppt": "ppt",
    "odf": "odt ods odp ott ots otp",
    "pdf": "pdf",
    "rtf": "rtf",
    "csv": "csv tsv",
    "markdown": "md markdown",
    "html": "html htm xhtml",
    "text": "txt log json xml yml yaml srt vtt",
    "image": "png jpg jpeg gif webp bmp",
}
EXT_KIND = {ext: kind for kind, exts in EXTENSIONS.items() for ext in exts.split()}
ZIP_KINDS = ("docx", "xlsx", "pptx", "odf")

# --- fixed values: markup that may stay
TAGS = set(
    "a b blockquote br caption code col colgroup dd div dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hr i img li ol p pre "
    "s section small span strong style sub sup table tbody td tfoot th thead tr u ul".split()
)
DROPPED = set("script noscript iframe object embed svg math".split())
ATTRS = set("align bgcolor class colspan data-page height rowspan style title valign width".split())
TAG_ATTRS = {
    "a": "href target rel",
    "img": "src alt",
    "ol": "start type",
    "table": "border cellpadding cellspacing",
    "td": "colspan rowspan nowrap",
    "th": "colspan rowspan scope nowrap",
}
CSS_PROPS = (
    "align-items background background-color border border-bottom border-bottom-color border-bottom-style border-bottom-width "
    "border-collapse border-color border-left border-left-color border-left-style border-left-width border-radius border-right "
    "border-right-color border-right-style border-right-width border-spacing border-style border-top border-top-color "
    "border-top-style border-top-width border-width bottom box-sizing break-after break-before break-inside clear color display "
    "flex flex-direction flex-wrap float font font-family font-size font-style font-variant font-weight gap height "
    "justify-content left letter-spacing line-height list-style list-style-type margin margin-bottom margin-left margin-right "
    "margin-top max-height max-width min-height min-width object-fit opacity padding padding-bottom padding-left padding-right "
    "padding-top page-break-after page-break-before page-break-inside overflow overflow-wrap overflow-x overflow-y position "
    "right table-layout text-align text-decoration text-indent text-transform top transform transform-origin vertical-align "
    "white-space width word-break word-spacing writing-mode z-index"
).split()

# --- fixed values: text that is not translated, and the limits of a translation batch
NOT_TRANSLATABLE_MARKS = ".,:;/\\%$€₮¥+()-–—_*#@|[]{}<>=~^&\"'`№"
SKIP_TAGS = ("style", "script", "code", "pre")
BATCH_ITEMS, BATCH_CHARS = 60, 4000
LANGUAGES = ("ja", "en")
DEMO_TAGS = {"ja": "【JA】", "en": "[EN]"}

# --- fixed values: limits of readers
MAX_UPLOAD = 80 * 1024 * 1024
MAX_COLS, MAX_ROWS, ROW_PX = 256, 5000, 20
ODF_REPEATS, ODF_SPACES, ODF_DEPTH, GROUP_DEPTH = 200, 20, 20, 12
MAX_IMAGE, OCR_IMAGE, OCR_PDF = 6 * 1024 * 1024, 5 * 1024 * 1024, 30 * 1024 * 1024
DRAFT_CHARS = 3_500_000
RETRYABLE = (429, 500, 503, 529)

# --- fixed values: spreadsheet palette (index 0 to 63), theme order and default theme
INDEXED = (
    "000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF 000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF "
    "800000 008000 000080 808000 800080 008080 C0C0C0 808080 9999FF 993366 FFFFCC CCFFFF 660066 FF8080 0066CC CCCCFF "
    "000080 FF00FF FFFF00 00FFFF 800080 800000 008080 0000FF 00CCFF CCFFFF CCFFCC FFFF99 99CCFF FF99CC CC99FF FFCC99 "
    "3366FF 33CCCC 99CC00 FFCC00 FF9900 FF6600 666699 969696 003366 339966 003300 333300 993300 993366 333399 333333"
).split()
THEME_ORDER = "lt1 dk1 lt2 dk2 accent1 accent2 accent3 accent4 accent5 accent6 hlink folHlink".split()
THEME = "FFFFFF 000000 EEECE1 1F497D 4F81BD C0504D 9BBB59 8064A2 4BACC6 F79646 0000FF 800080".split()

# --- fixed values: spreadsheet borders, alignment and font substitutes
BORDERS = {
    "thin": "1px solid", "hair": "1px solid", "dotted": "1px dotted", "dashed": "1px dashed", "dashDot": "1px dashed",
    "dashDotDot": "1px dotted", "medium": "2px solid", "mediumDashed": "2px dashed", "mediumDashDot": "2px dashed",
    "mediumDashDotDot": "2px dotted", "slantDashDot": "2px dashed", "thick": "3px solid", "double": "3px double",
}
H_ALIGN = {"left": "left", "center": "center", "centerContinuous": "center", "right": "right", "justify": "justify", "distributed": "justify", "fill": "left"}
V_ALIGN = {"top": "top", "center": "middle", "bottom": "bottom", "justify": "middle", "distributed": "middle"}
FONT_SUBSTITUTES = {
    "calibri": "'Carlito'", "cambria": "'Caladea'", "arial": "'Liberation Sans', 'Arimo', Helvetica",
    "helvetica": "'Liberation Sans', 'Arimo'", "times new roman": "'Liberation Serif', 'Tinos'",
    "courier new": "'Liberation Mono', 'Cousine'", "georgia": "'Gelasio'", "verdana": "'DejaVu Sans'", "tahoma": "'DejaVu Sans'",
}
FONT_FALLBACKS = "'Noto Sans', 'Noto Sans CJK JP', sans-serif"

# --- fixed values: page sizes and margins in mm
PAGES = {"A4": (210.0, 297.0), "A3": (297.0, 420.0), "A5": (148.0, 210.0), "Letter": (215.9, 279.4)}
MARGINS = {"normal": (14.0, 12.0), "narrow": (6.0, 6.0), "wide": (22.0, 20.0)}
IMAGE_MIMES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp"}

# --- fixed values: Markdown. Inline marks in their order, with $n for groups; line forms in their order; blanks are those of any script
MD_INLINE = (
    ("`([^`]+)`", "<code>$1</code>"),
    (r"(?i)!\[([^\]]*)\]\((data:image/[a-z]+;base64,[A-Za-z0-9+/=]+)\)", '<img alt="$1" src="$2"/>'),
    (r"\[([^\]]+)\]\((https?://[^\s)]+)\)", '<a href="$2" target="_blank">$1</a>'),
    (r"\*\*([^*]+)\*\*", "<strong>$1</strong>"),
    (r"(^|[^*])\*([^*\n]+)\*", "$1<em>$2</em>"),
    ("~~([^~]+)~~", "<s>$1</s>"),
)
MD_LINES = {
    "heading": r"(#{1,6})\s+(.*)",
    "hr": r"\s*([-*_])\s*\1\s*\1\s*",
    "quote": r">\s?(.*)",
    "ul": r"\s*[-*+]\s+(.*)",
    "ol": r"\s*[0-9]+[.)]\s+(.*)",
}
MD_SEPARATOR = r"\s*\|?[\s:-]*-[\s|:-]*"
MD_FENCE = "```"

# --- fixed values: what URLs and styles may hold
SAFE_IMAGE = r"(?i)data:image/(?:png|jpe?g|gif|webp|bmp);base64,[a-z0-9+/=\s]+"
SAFE_URL = r"(?i)(?:https?:|mailto:|tel:|#|/(?!/))"
UNSAFE_VALUE = r"(?i)expression\s*\(|javascript:|url\s*\("
UNSAFE_RULE = r"(?i)javascript:|expression\s*\(|url\s*\(|behavior\s*:|-moz-binding"

# --- fixed values: entities that are decoded by name, and forms of API keys
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}
KEY_FORMS = r"(AQ\.[A-Za-z0-9_.-]{20,}|AIza[A-Za-z0-9_-]{30,}|sk-ant-[A-Za-z0-9_-]{30,})"

# --- fixed values: calls of services; chunks of a long print; warnings and stored errors
CALLS_AT_ONCE, ATTEMPTS, RETRY_SECONDS = 3, 3, 2.5
CHUNK_TRIGGER, CHUNK_PX, NO_HEIGHT_PX = 100_000, 50_000, 20
MOST_WARNINGS = 5

# --- fixed values: number formats of a spreadsheet by id, where the workbook has none of its own
FORMATS = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)",
    40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
