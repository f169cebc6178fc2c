"""Line deduplication by winnowing over line hashes. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

#: A repeated run of lines counts from so many words on.
LEAST_WORDS = 50
_BLANKS = " \t\x0b\x0c\r"


def _lines(documents: DataFrame, least_words: int) -> DataFrame:
    """Lines with a word and the windows that begin at them.

    doc: (doc_id, hash of the text), at: line number from 0, no: number among the document's lines with a word, h: hash
    of the line less blanks at its ends. The window of a line is the shortest run of lines from it on that has
    ``least_words`` words, if there is one (full). k: its lines, w: hash of them all, mark: its least line hash (the
    first of equals), head: whether no window before chose the same line, more: lines behind it that begin before
    the next line's window has its words, or the document ends."""
    doc = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"))
    line = F.trim(F.col("line"), F.lit(_BLANKS))
    rows = (
        documents.filter("text is not null")
        .select(doc.alias("doc"), F.split("text", "\n").alias("lines"))  # else each line would carry its text along
        .select("doc", F.posexplode("lines").alias("at", "line"))
        .select("doc", "at", F.xxhash64(line).alias("h"), n_words(F.col("line")).alias("n"))
        .filter("n > 0")
    )
    repeated = documents.filter("text is not null").groupBy(doc.alias("doc")).count().filter("count > 1")
    if repeated.head(1):  # equal rows are one document
        rows = rows.dropDuplicates(["doc", "at"])
    by_line = Window.partitionBy("doc").orderBy("at")
    before = F.coalesce(F.sum("n").over(by_line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.select("*", F.row_number().over(by_line).alias("no"), before.alias("before"))
    by_words = Window.partitionBy("doc").orderBy("before")
    frame = by_words.rangeBetween(0, least_words - 1)
    framed = numbered.select(
        "doc", "at", "no", "h", "before",
        (F.sum("n").over(frame) >= least_words).alias("full"),
        F.collect_list("h").over(frame).alias("hs"),  # least_words lines at most
        F.min(F.struct("h", "no")).over(frame).alias("mark"),
    )
    return framed.select(
        "doc", "at", "no", "h", "full", F.size("hs").alias("k"), F.xxhash64("hs").alias("w"), F.col("mark.h").alias("mark"),
        (F.col("mark.no") != F.lag("mark.no", 1, 0).over(by_words)).alias("head"),
        (F.lead(F.size("hs"), 1, 0).over(by_words) - F.size("hs") + 1).alias("more"),
    )


def repeated_lines(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, th, at): the lines to delete; th: hash of the text, at: line number from 0.

    Documents go by (doc_id, th), lines by number; lines without a word don't count. Deleted are all lines of
    every run of ``least_words`` words or more that occurs earlier, in any document or further up in its own.

    1. Winnowing: each window of ``least_words`` words chooses its least line hash, and the distinct lines so chosen
       are the document's fingerprints. Equal runs hold an equal window, so they are guaranteed to share one.
    2. Fingerprints that occur twice or more are the join's key; windows around other lines go no further.
    3. Matches are extended both ways: a joined fingerprint grows to the windows that chose it, which reach some lines to
       its left and right. Where an equal one is earlier, its run is repeated; overlapping windows make up longer runs.
    4. Behind the last window of a run, :func:`_grown` goes on line by line while the longer run occurs earlier
       anywhere, so that every earlier source counts and not the first alone.

    Equal windows are compared with the first of them, not with each other, so neither a passage that very many
    documents share nor a document of equal lines costs more than rows in proportion. Joins are plain equi-joins, whose hot
    keys adaptive execution splits. Null and blank texts have no lines; an empty table gives no rows.
    """
    lines = cut(_lines(documents, least_words), "lines")
    windows = lines.filter("full")
    fingerprints = windows.filter("head").groupBy("mark").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    met = windows.join(fingerprints.select("mark"), "mark").select("mark", "w", "doc", "no", "k", "more")
    same = ["mark", "w"]
    first = met.groupBy(*same).agg(F.min(F.struct("doc", "no")).alias("src"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    repeated = cut(met.join(first.drop("times"), same).withColumn("later", F.struct("doc", "no") > F.col("src")), "repeated")
    runs = repeated.filter("later").select("doc", "no", (F.col("no") + F.col("k") - 1).alias("end"))
    runs = cut(runs.unionByName(_grown(lines, repeated)).groupBy("doc", "no").agg(F.max("end").alias("end")), "runs")
    touched = lines.join(runs.select("doc").distinct(), "doc", "left_semi").select("doc", "no", "at")
    reach = F.max("end").over(Window.partitionBy("doc").orderBy("no").rowsBetween(Window.unboundedPreceding, 0))
    gone = touched.join(runs, ["doc", "no"], "left").withColumn("reach", reach).filter("reach >= no")
    return gone.select(F.col("doc.id").alias("doc_id"), F.col("doc.th").alias("th"), "at")


def _grown(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc, no, end): lines behind a matched window whose next window is not matched, as far as the window
    and the lines up to there occur earlier in any document; no = end.

    All windows equal to such a one grow by each of their next ``more`` lines; a grown window has an earlier
    equal one where it is not the first of its hash."""
    later = Window.partitionBy("doc").orderBy("no")
    same = ["mark", "w"]
    ends = repeated.filter("later").withColumn("then", F.lead("no").over(later)).filter("more > 0 and (then is null or then <> no + 1)")
    members = repeated.filter("more > 0").join(ends.select(*same).distinct(), same, "left_semi")
    last = (F.col("no") + F.col("k") - 1).alias("last")
    wanted = members.select("doc", "no", "w", F.explode(F.sequence(F.lit(1), F.col("more"))).alias("step"), last).alias("g")
    l = lines.alias("l")
    on = (F.col("g.doc") == F.col("l.doc")) & (F.col("g.last") + F.col("g.step") == F.col("l.no"))
    steps = wanted.join(l, on).select("g.doc", "g.no", "g.w", "g.step", F.col("l.no").alias("end"), "l.h")
    so_far = Window.partitionBy("doc", "no").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    grown = cut(steps.select("doc", "no", "end", F.xxhash64("w", F.collect_list("h").over(so_far)).alias("g")), "grown")
    first = grown.groupBy("g").agg(F.min(F.struct("doc", "no")).alias("src"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    found = grown.join(first, "g").filter(F.struct("doc", "no") > F.col("src"))
    return found.select("doc", F.col("end").alias("no"), "end")


def dedupe_lines(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``documents`` with the repeated lines deleted from ``text``; other columns as they are.

    A document may end up with an empty text; null texts stay null. Equal rows (doc_id and text) are
    one document and lose the same lines; a null doc_id comes first in the order of documents. An empty table
    gives no rows. Columns named like ours don't clash.
    """
    gone = repeated_lines(documents, least_words).groupBy("doc_id", "th").agg(F.collect_set("at").alias("gone"))
    d, g = documents.alias("d"), gone.alias("g")
    joined = d.join(g, F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.th")), "left")
    left = F.filter(
        F.transform(F.split("d.text", "\n"), lambda x, i: F.when(~F.array_contains("g.gone", i), x)), lambda x: x.isNotNull()
    )
    text = F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(F.array_join(left, "\n"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in documents.columns])


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """For each of all ``documents``: doc_id, n_lines, n_removed and the removed lines' numbers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    gone = repeated_lines(docs).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("at")).alias("removed"))
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    b, g = base.alias("b"), gone.alias("g")
    out = b.join(g, F.col("b.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("b.th") == F.col("g.th")), "left")
    return out.select(
        "b.doc_id", "b.n_lines", F.coalesce(F.size("g.removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join("g.removed", ","), F.lit("")).alias("removed_lines"),
    )


OP3_SQL = """
WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, pos, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS h, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM a),
l AS (SELECT *, row_number() OVER o AS no, sum(n) OVER o AS upto FROM b WHERE n > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
d AS (SELECT doc_id, list(h ORDER BY no) AS hs, list(upto ORDER BY no) AS u FROM l GROUP BY 1),
s AS (SELECT doc_id, hs, u, unnest(range(1, len(hs) + 1)) AS no FROM d),
e AS (SELECT doc_id, hs, no, len(list_filter(u, lambda x: x < CASE WHEN no = 1 THEN 0 ELSE u[no - 1] END + 50)) + 1 AS last FROM s),
f AS (SELECT *, coalesce(least(lead(last) OVER (PARTITION BY doc_id ORDER BY no), len(hs)), len(hs)) AS next FROM e),
r AS (SELECT doc_id, no, last, hs, unnest(range(last, greatest(last, next) + 1)) AS upto FROM f WHERE last <= len(hs)),
k AS (SELECT doc_id, no, upto, row_number() OVER (PARTITION BY md5(array_to_string(hs[no : upto], chr(10))) ORDER BY doc_id, no) AS nth FROM r),
m AS (SELECT DISTINCT doc_id, unnest(range(no, upto + 1)) AS no FROM k WHERE nth > 1),
g AS (SELECT l.doc_id, list(pos ORDER BY pos) AS gone FROM l JOIN m ON l.doc_id = m.doc_id AND l.no = m.no GROUP BY 1)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  coalesce(array_to_string(gone, ','), '') AS removed_lines FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
