"""Quality rules: how much of a text lies in repeated n-grams and lines."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrowtext import Batch, Rolling, blocks, hash_spans, repeated
from .common import fresh


@dataclass(frozen=True)
class Rules:
    """``ngrams``: for each length, the share of word characters that may lie in n-grams found
    twice or more; ``lines``: the share that may lie in lines equal to an earlier one."""

    least_words: int = 20
    repeat_words: float = 0.30
    ngrams: dict[int, float] = field(default_factory=lambda: {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30})
    lines: float = 0.30


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Bytes that begin a code point.
_LEADS = (np.arange(256) & 0xC0) != 0x80


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of set flags (or sum of numbers) in each span at[i]:at[i+1]."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def measure(texts: pa.Array, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts for each text: the base columns, chars_in_<n> for each n-gram length, dup_line_chars.

    Word hashes are prefix hashes over bytes; n-gram hashes of all lengths roll over the word hashes from one pass of prefix
    sums; the index of the text is mixed into each, so that one sort finds what repeats within a text for a whole batch.
    """
    b = Batch(texts)
    n = len(b.at) - 1
    words, owner = b.hashes(), b.owner().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    leads = np.zeros(len(b.data) + 1, np.int64)
    np.cumsum(_LEADS[b.data] & ~b.blank, out=leads[1:])
    chars = leads[b.ends] - leads[b.starts]
    out = {
        "n_words": b.counts(),
        "word_chars": leads[b.at[1:]] - leads[b.at[:-1]],
        "n_symbols": _per_text(_SYMBOL[b.data], b.at),
    }

    rolling = Rolling(words, b.first, max(8, *lengths) if lengths else 8)

    def covered(length: int) -> np.ndarray:
        """Flags of the words that lie in a window of ``length`` found twice or more in its text."""
        keys, at = rolling.windows(length)
        again = at[repeated(keys ^ owner[at])]
        edge = np.bincount(again, minlength=len(words) + 1) - np.bincount(again + length, minlength=len(words) + 1)
        return np.cumsum(edge[:-1]) > 0

    flags = {k: covered(k) for k in {8, *lengths}}
    out["n_repeat_words"] = _per_text(flags[8], b.first)
    for k in lengths:
        out[f"chars_in_{k}"] = _per_text(np.where(flags[k], chars, 0), b.first)

    # lines: spans between line feeds and the bounds of texts
    feeds = np.flatnonzero(b.data == 10)
    starts = np.sort(np.concatenate([b.at[:-1], feeds + 1]), kind="stable")
    ends = np.sort(np.concatenate([b.at[1:], feeds]), kind="stable")
    worded = np.searchsorted(b.starts, ends) > np.searchsorted(b.starts, starts)
    starts, ends = starts[worded], ends[worded]
    whose = np.searchsorted(b.at, starts, "right") - 1
    keys = hash_spans(b.data, starts, ends) ^ (whose.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")  # equal lines keep their order: the first is no repeat
    dup = np.zeros(len(keys), bool)
    dup[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    out["n_dup_lines"] = np.bincount(whose[dup], minlength=n)
    out["dup_line_chars"] = np.bincount(whose[dup], (leads[ends] - leads[starts])[dup], minlength=n).astype(np.int64)
    return out


def judge(m: dict[str, np.ndarray], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    failed = (m["n_words"] < rules.least_words) | (m["n_repeat_words"] > rules.repeat_words * m["n_words"])
    if rules.repeat_words == 0.30:  # whole numbers have no rounding
        failed = (m["n_words"] < rules.least_words) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    chars, bad = m["word_chars"], failed.copy()
    for k, share in rules.ngrams.items():
        bad |= m[f"chars_in_{k}"] > share * chars
    bad |= m["dup_line_chars"] > rules.lines * chars
    return failed, ~bad


def score(documents: DataFrame, rules: Rules = Rules(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the base columns, base_failed, kept and the measures behind kept.

    One pass without a shuffle; texts go through in blocks of some 4 MB, or one longer text.
    Null, empty and blank texts have no words and fail. Rows are judged alone, so repeated rows
    get equal results; an empty table gives no rows; other columns are not read.
    """
    lengths = tuple(sorted(rules.ngrams))
    names = (*BASE, *(f"chars_in_{k}" for k in lengths), "dup_line_chars")
    schema = T.StructType(
        [documents.schema[c] for c in keep]
        + [T.StructField(c, T.LongType()) for c in BASE]
        + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
        + [T.StructField(c, T.LongType()) for c in names[len(BASE) :]]
    )

    def run(batches):
        for whole in batches:
            for batch in blocks(whole, "text"):
                m = measure(batch.column("text"), lengths)
                failed, kept = judge(m, rules)
                cols = [batch.column(c) for c in keep] + [pa.array(m[c].astype(np.int64)) for c in BASE]
                cols += [pa.array(failed), pa.array(kept)] + [pa.array(m[c].astype(np.int64)) for c in names[len(BASE) :]]
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema])

    return documents.select(*keep, "text").mapInArrow(run, schema)


def good_documents(documents: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``documents`` that the rules keep, in one pass, with their columns."""
    lengths = tuple(sorted(rules.ngrams))

    def run(batches):
        for whole in batches:
            for batch in blocks(whole, "text"):
                _, kept = judge(measure(batch.column("text"), lengths), rules)
                yield batch.filter(pa.array(kept))

    return documents.mapInArrow(run, documents.schema)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, then the measures of the method, for all of ``documents``."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = """
WITH w AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
lc AS (SELECT doc_id, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1, 2),
dl AS (SELECT doc_id, sum(n - 1)::BIGINT AS n_dup_lines,
  sum((n - 1) * length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')))::BIGINT AS dup_line_chars FROM lc GROUP BY 1),
lens AS (SELECT unnest([5, 6, 7, 8, 9, 10]) AS k),
g AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS p, ws FROM w, lens WHERE len(ws) >= k),
h AS (SELECT doc_id, k, p, hash(array_to_string(ws[p : p + k - 1], ' ')) AS x FROM g),
r AS (SELECT doc_id, k, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, x) AS n FROM h) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, k, unnest(range(p, p + k)) AS q FROM r),
s AS (SELECT c.doc_id, c.k, count(*) AS n, sum(length(w.ws[c.q]))::BIGINT AS chars FROM c JOIN w ON c.doc_id = w.doc_id GROUP BY 1, 2),
a AS (SELECT doc_id, max(CASE WHEN k = 8 THEN n ELSE 0 END) AS n_repeat_words,
  max(CASE WHEN k = 5 THEN chars ELSE 0 END) AS chars_in_5, max(CASE WHEN k = 6 THEN chars ELSE 0 END) AS chars_in_6,
  max(CASE WHEN k = 7 THEN chars ELSE 0 END) AS chars_in_7, max(CASE WHEN k = 8 THEN chars ELSE 0 END) AS chars_in_8,
  max(CASE WHEN k = 9 THEN chars ELSE 0 END) AS chars_in_9, max(CASE WHEN k = 10 THEN chars ELSE 0 END) AS chars_in_10 FROM s GROUP BY 1),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  coalesce(chars_in_5, 0)::BIGINT AS chars_in_5, coalesce(chars_in_6, 0)::BIGINT AS chars_in_6, coalesce(chars_in_7, 0)::BIGINT AS chars_in_7,
  coalesce(chars_in_8, 0)::BIGINT AS chars_in_8, coalesce(chars_in_9, 0)::BIGINT AS chars_in_9, coalesce(chars_in_10, 0)::BIGINT AS chars_in_10,
  coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars
  FROM w LEFT JOIN dl ON w.doc_id = dl.doc_id LEFT JOIN a ON w.doc_id = a.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND chars_in_5 <= 0.40::DOUBLE * word_chars AND chars_in_6 <= 0.38::DOUBLE * word_chars AND chars_in_7 <= 0.36::DOUBLE * word_chars
  AND chars_in_8 <= 0.34::DOUBLE * word_chars AND chars_in_9 <= 0.32::DOUBLE * word_chars AND chars_in_10 <= 0.30::DOUBLE * word_chars
  AND dup_line_chars <= 0.30::DOUBLE * word_chars AS kept,
  chars_in_5, chars_in_6, chars_in_7, chars_in_8, chars_in_9, chars_in_10, dup_line_chars FROM f
"""
