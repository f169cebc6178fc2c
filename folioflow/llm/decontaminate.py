"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import Batch, blocks, windows
from .common import cut, ordered_prefix
from .neardup import shingles

SHINGLE, PERCENT = 5, 80
#: Shingle hashes and signature values of test items that one pass over the documents holds (8 bytes each).
BLOCK_HASHES = 2_000_000
#: MinHash values of a signature, and the largest size of the first size partition; each next one is twice as wide.
HASHES, LEAST = 48, 8


def item_sets(benchmark: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(item_id, size, set): distinct shingles of each item that has a word, packed."""

    def run(batches):
        for whole in batches:
            for batch in blocks(whole, "text"):
                sets = list(shingles(batch.column("text"), n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id"), pa.array([len(u) for u in sets], pa.int64()), pa.array([u.tobytes() for u in sets], pa.binary())],
                    ["item_id", "size", "set"],
                )

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, size long, set binary").filter("size > 0")


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(11))
    return rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, HASHES, dtype=np.uint64)


class Searcher:
    """Finds the items of one block in texts.

    Items are partitioned by size: partition u holds sizes above u / 2 up to u, for u = 8, 16, 32, ... A whole document's
    MinHash is of no use against a short item, as their Jaccard similarity goes to 0 with the document's length. So
    for each partition a document is cut into runs of u shingles, and each two neighbouring runs are a window: at most
    2u shingles, in one of which any passage of up to u shingles lies whole. There, a containment of c turns into a
    Jaccard similarity of at least c q / (2u + (1 - c) q), so above c / (5 - c): 0.19 at 80 %. Window and item become candidates
    when one of HASHES MinHash values agrees, which 0.81**48 = 4e-5 of the pairs at that bound miss (1e-6 of
    whole passages). The minima of a partition's runs are made of those of the one before. A candidate is counted exactly, over
    the document's whole set. An item whose shingles are scattered over more than 2u places may be missed.
    """

    def __init__(self, ids: list, sets: list[np.ndarray], percent: int, n: int):
        self.n, self.percent, self.ids, self.sets = n, percent, ids, sets
        size = np.array([len(s) for s in sets], np.int64)
        self.need = -(-size * percent // 100)
        self.a, self.c = _multipliers()
        level = np.ceil(np.log2(np.maximum(size, LEAST) / LEAST)).astype(np.int64)
        self.levels = int(level.max()) + 1 if len(size) else 0
        # for each partition and hash, the items' minima in order, and whose they are
        self.tables: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for l in range(self.levels):
            own = np.flatnonzero(level == l)
            minima = np.array([[(sets[i] * a + c).min() for i in own] for a, c in zip(self.a, self.c, strict=True)], np.uint64).reshape(HASHES, len(own))
            order = np.argsort(minima, axis=1, kind="stable")
            self.tables.append([(m[o], own[o]) for m, o in zip(minima, order, strict=True)] if len(own) else [])

    def _windows(self, h: np.ndarray, bounds: np.ndarray):
        """For each hash and partition: (partition, hash, minima of the windows, the text of each). ``bounds``: where texts begin
        among the shingles ``h``."""
        plans, n, u = [], np.diff(bounds), LEAST
        owner = np.flatnonzero(n > 0)
        for l in range(self.levels):
            runs = -(-n[owner] // u)
            first = np.cumsum(runs) - runs
            inner = np.arange(runs.sum()) - np.repeat(first, runs)
            if l == 0:
                starts = np.repeat(bounds[owner], runs) + inner * u
            else:  # of each two runs of the partition before
                starts = np.repeat(plans[-1][1], runs) + inner * 2
            last = np.zeros(len(inner), bool)
            last[first + runs - 1] = True
            plans.append((starts, first, np.repeat(owner, runs), last))
            u *= 2
        for j in range(HASHES):
            minima = h * self.a[j] + self.c[j]
            for l, (starts, _, texts, last) in enumerate(plans):
                minima = np.minimum.reduceat(minima, starts)
                if self.tables[l]:
                    after = np.append(minima[1:], minima[-1:])
                    yield l, j, np.where(last, minima, np.minimum(minima, after)), texts

    def find(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        """(text, item, common) of each candidate with at least the share of the item's shingles in the text."""
        b = Batch(texts, lower=True)
        h, at = windows(b.hashes(), b.first, self.n)
        bounds = np.searchsorted(at, b.first)
        short = np.flatnonzero((b.counts() > 0) & (b.counts() < self.n))
        if len(short):  # the whole sequence is the only shingle
            tiny = np.array([next(iter(shingles(texts.slice(int(t), 1), self.n)))[0] for t in short], np.uint64)
            h = np.insert(h, bounds[short], tiny)
            bounds = bounds + np.concatenate([[0], np.cumsum(np.isin(np.arange(len(b.at) - 1), short))])
        if not len(h) or not self.levels:
            return []
        pairs = set()
        for l, j, minima, whose in self._windows(h, bounds):
            keys, items = self.tables[l][j]
            p = np.searchsorted(keys, minima)
            p[p == len(keys)] = 0
            hit = np.flatnonzero(keys[p] == minima)
            if len(hit):
                ends = np.searchsorted(keys, minima[hit], "right")
                pairs |= {(int(t), int(i)) for t, x, y in zip(whose[hit], p[hit], ends, strict=True) for i in items[x:y]}
        found, own = [], {}
        for t, i in sorted(pairs):
            if t not in own:
                own = {t: np.unique(h[bounds[t] : bounds[t + 1]])}
            u, s = own[t], self.sets[i]
            p = np.searchsorted(u, s)
            p[p == len(u)] = 0
            common = int((u[p] == s).sum())
            if common >= self.need[i]:
                found.append((t, i, common))
        return found


def searchers(benchmark: DataFrame, percent: int, n: int):
    """Yields a broadcast searcher for each block of items, however many items there are."""
    spark = benchmark.sparkSession
    sets = cut(item_sets(benchmark, n).withColumn("load", F.col("size") + HASHES), "items")
    total = sets.agg(F.sum("load").alias("s")).first()["s"] or 0
    if not total:
        return
    if total <= BLOCK_HASHES:
        numbered, count = sets.withColumn("block", F.lit(0)), 1
    else:
        order = [F.col("item_id"), F.hash("set")]
        numbered = cut(ordered_prefix(sets, [], order, {"before": "load"}).withColumn("block", F.floor(F.col("before") / BLOCK_HASHES)), "items")
        count = numbered.agg(F.max("block").alias("b")).first()["b"] + 1
    for block in range(count):
        # a block has BLOCK_HASHES values at most, or one longer item
        rows = sorted(numbered.filter(F.col("block") == block).select("item_id", "set").collect(), key=lambda r: (r["item_id"] is not None, r["item_id"] or 0, bytes(r["set"])))
        yield spark.sparkContext.broadcast(Searcher([r["item_id"] for r in rows], [np.frombuffer(bytes(r["set"]), np.uint64) for r in rows], percent, n))


HITS = "doc_id long, item_id long, n_item_shingles long, n_common long"


def contaminations(documents: DataFrame, benchmark: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_common): items of which a document holds at least
    ``percent`` of the distinct ``n``-word shingles (lower-cased A-Z). An item, or a document, of fewer words is one
    shingle, so such an item is found in a document of just these words alone. Items are searched (:class:`Searcher`) in
    blocks of bounded size, each in one pass over whole documents without a shuffle.

    Null, empty and blank texts hold and are nothing. Rows with one doc_id or none are searched each, and so is each row
    with one item_id or none. Empty tables give no rows.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = documents.sparkSession.createDataFrame([], HITS)
    for shared in searchers(benchmark, percent, n):

        def run(batches, shared=shared):
            s = shared.value
            for whole in batches:
                for batch in blocks(whole, "text"):
                    found = s.find(batch.column("text"))
                    ids = batch.column("doc_id").take(pa.array([t for t, _, _ in found], pa.int64()))
                    items = [i for _, i, _ in found]
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([s.ids[i] for i in items], pa.int64()), pa.array([len(s.sets[i]) for i in items], pa.int64()), pa.array([c for _, _, c in found], pa.int64())],
                        ["doc_id", "item_id", "n_item_shingles", "n_common"],
                    )

        out = out.unionByName(docs.mapInArrow(run, HITS))
    return out


def clean_documents(documents: DataFrame, benchmark: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """The rows of ``documents`` that hold no item, with their columns; rows are judged alone, by their text.

    Null, empty and blank texts stay, rows without doc_id are judged as others are, repeated rows alike. Items without item_id
    count. Empty tables give all or no rows.
    """
    out, schema = documents, documents.schema
    for shared in searchers(benchmark, percent, n):

        def run(batches, shared=shared):
            for whole in batches:
                for batch in blocks(whole, "text"):
                    keep = np.ones(batch.num_rows, bool)
                    keep[[t for t, _, _ in shared.value.find(batch.column("text"))]] = False
                    yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, schema)
    return out


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every (document, item) hit over all of ``documents`` and ``benchmark``."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return contaminations(read("documents"), read("benchmark"))


OP6_SQL = """
WITH w AS (SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') FROM benchmark),
s AS (SELECT DISTINCT kind, id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda p: array_to_string(ws[p : p + 4], ' ')) END) AS sh FROM w WHERE len(ws) > 0),
i AS (SELECT id AS item_id, sh, count(*) OVER (PARTITION BY id) AS q FROM s WHERE kind = 1)
SELECT s.id AS doc_id, i.item_id, max(i.q)::BIGINT AS n_item_shingles, count(*)::BIGINT AS n_common
FROM s JOIN i ON s.sh = i.sh WHERE s.kind = 0 GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * max(i.q)
"""
