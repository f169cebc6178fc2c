"""Language-model scoring: bigrams by deleted interpolation, on counts of the whole corpus."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import Batch, blocks, mix
from .common import cut, release, remove, shared_path, shuffle_partitions

#: Bytes of text in a block of documents, and for which one slice of the counts stands.
BLOCK_BYTES, COUNT_BYTES = 4 << 20, 16 << 20
#: Tasks that count at most; beyond that, each counts several slices, one after another.
MOST_TASKS = 20_000
#: Of training documents one in so many is deleted from the counts that fit the mixture weights.
DELETED = 8
UNI, BI, DOCS = 0, 1, 2
KEPT, LEFT_OUT, TEST = 0, 1, 2
_END = np.uint64(0x0E2D0E2D0E2D0E2D)
#: Bins of a factor 2**(1/8) for the estimates that the mixture weights are learned from.
_FINE, _LEAST = 8, -40
_TEXTS = pa.schema([("doc_id", pa.int64()), ("split", pa.int32()), ("text", pa.large_string())])
GRAMS = "kind int, block long, p int, h binary, kept binary, deleted binary, doc_id long, split int, ids binary"
TOTALS = "kind int, block long, p int, kept binary, deleted binary, distinct long, all_kept long, all_deleted long"


def _small(x: np.ndarray) -> bytes:
    """Counts as a byte each, then 8 bytes for each of 255 and more; no bytes if all are 0."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype(np.int64).tobytes() if x.any() else b""


def _counts(b: bytes | None, n: int) -> np.ndarray:
    if not b:
        return np.zeros(n, np.int64)
    x = np.frombuffer(b, np.uint8, n).astype(np.int64)
    x[x == 255] = np.frombuffer(b, np.int64, (len(b) - n) // 8, n)
    return x


#: Bits of a hash that tell tokens and bigrams apart within a slice.
BITS = {UNI: 48, BI: 40}


def _place(h: np.ndarray, parts: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slice, place in the slice) of hashes: the integer and the fractional part of h * parts / 2**64."""
    n, half, low = np.uint64(parts), np.uint64(32), np.uint64(0xFFFFFFFF)
    p = ((h >> half) * n + (((h & low) * n) >> half)) >> half
    return p.astype(np.int64), (h * n) >> np.uint64(64 - bits)


def _pack(x: np.ndarray) -> bytes:
    """Ascending places as differences of as few bytes each as hold them all; first the width, then
    all lowest bytes and so on, as the highest are nearly all 0."""
    d = np.diff(x, prepend=np.uint64(0))
    width = max(1, (int(d.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    width = b[0]
    out = np.zeros(((len(b) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8, offset=1).reshape(width, -1).T
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


def _bounds(p: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal slices."""
    return np.concatenate([[0], np.flatnonzero(np.diff(p)) + 1, [len(p)]])


def _names(p: np.ndarray, place: np.ndarray) -> np.ndarray:
    """One number for a slice and a place in it."""
    return mix(place ^ mix(p.astype(np.uint64) + np.uint64(1)))


def _bigrams(ids: np.ndarray, first: np.ndarray, low: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a block's tokens: (context of each token, hashes of the distinct bigrams ascending,
    place of each token's bigram among them, context of each). A text's first context is the end token."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[first] = end
    code, place = np.unique(before * len(low) + ids, return_inverse=True)
    h = mix(mix(low[code // len(low)] + np.uint64(1)) * np.uint64(3) + low[code % len(low)])
    order = np.argsort(h, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return before, h[order], rank[place], code


def gram_rows(documents: DataFrame, split: Column, parts: int) -> DataFrame:
    """Blocks of documents as rows. UNI and BI: what a block asks of partition p of the counts, the
    hashes of its distinct tokens or bigrams with their counts in kept and deleted texts. DOCS: a
    document's tokens as places among its block's distinct tokens. Deleted documents have blocks
    of their own, with odd numbers."""
    names = ["kind", "block", "p", "h", "kept", "deleted", "doc_id", "split", "ids"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]

    def block(batch: pa.RecordBatch, number: int):
        b = Batch(batch.column("text"), lower=True)
        n = len(b.at) - 1
        tokens = np.insert(b.hashes(), b.first[1:], _END)
        first = b.first + np.arange(n + 1)
        distinct, ids = np.unique(tokens, return_inverse=True)
        split = np.asarray(batch.column("split"))
        of = np.repeat(split, np.diff(first))
        low = _names(*_place(distinct, parts, BITS[UNI]))
        end = int(np.searchsorted(distinct, _END))
        _, bi, place, _ = _bigrams(ids, first[:-1], low, end)
        for kind, h, where in ((UNI, distinct, ids), (BI, bi, place)):
            kept, deleted = (np.bincount(where[of == s], minlength=len(h)) for s in (KEPT, LEFT_OUT))
            p, x = _place(h, parts, BITS[kind])
            at = _bounds(p)
            for l, r in zip(at[:-1], at[1:], strict=True):
                yield (kind, number, int(p[l]), _pack(x[l:r]), _small(kept[l:r]), _small(deleted[l:r]), None, None, None)
        # the width of a place follows from the number of distinct tokens
        packed = ids.astype(np.uint16 if len(distinct) <= 65536 else np.uint32)
        for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            yield (DOCS, number, end, None, None, None, doc_id, int(split[i]), packed[first[i] : first[i + 1]].tobytes())

    def run(batches):
        from pyspark import TaskContext

        base, count = TaskContext.get().partitionId() << 32, 0
        waiting: dict[bool, list] = {True: [], False: []}
        held = {True: 0, False: 0}

        def flush(which: bool):
            nonlocal count
            rows = list(block(pa.Table.from_batches(waiting[which]).combine_chunks().to_batches()[0], base + 2 * count + which))
            waiting[which], held[which], count = [], 0, count + 1
            for i in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 2000], strict=True), kinds, strict=True)], names)

        for whole in batches:
            whole = whole.cast(_TEXTS)
            for batch in blocks(whole, "text", BLOCK_BYTES // 2):
                gone = pa.array(np.asarray(batch.column("split")) == LEFT_OUT)
                for which, part in ((True, batch.filter(gone)), (False, batch.filter(pa.array(~np.asarray(gone))))):
                    if part.num_rows:
                        waiting[which].append(part)
                        held[which] += part.nbytes
                        if held[which] >= BLOCK_BYTES:
                            yield from flush(which)
        for which in (True, False):
            if waiting[which]:
                yield from flush(which)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), split.cast("int").alias("split"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, GRAMS)


def count_rows(messages: DataFrame, parts: int) -> DataFrame:
    """Answers to the blocks: counts over all documents, in the order of the question. A slice of the hashes is
    counted at a time; every block has counted it within itself before, so a hash, however frequent, has one entry a block."""
    names = ["kind", "block", "p", "kept", "deleted", "distinct", "all_kept", "all_deleted"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def answers(slice_):
        """Rows of one slice: (kind, p, blocks, hashes, kept, deleted)."""
        kind, p, blocks_, hs, kept, deleted = slice_
        sizes = [len(x) for x in hs]
        distinct, place = np.unique(np.concatenate(hs), return_inverse=True)
        hs.clear()
        k = np.bincount(place, np.concatenate([_counts(x, n) for x, n in zip(kept, sizes, strict=True)])).astype(np.int64)
        d = np.bincount(place, np.concatenate([_counts(x, n) for x, n in zip(deleted, sizes, strict=True)])).astype(np.int64)
        out, at = [(kind, -1, p, None, None, int(((k + d) > 0).sum()), int(k.sum()), int(d.sum()))], 0
        for block, n in zip(blocks_, sizes, strict=True):
            own = place[at : at + n]
            out.append((kind, block, p, _small(k[own]), _small(d[own]), None, None, None))
            at += n
        for i in range(0, len(out), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 2000], strict=True), kinds, strict=True)], names)

    def run(batches):
        now = None
        for batch in batches:
            for kind, block, p, h, k, d in zip(*[batch.column(c).to_pylist() for c in ("kind", "block", "p", "h", "kept", "deleted")], strict=True):
                if now is None or now[:2] != (kind, p):
                    if now:
                        yield from answers(now)
                    now = (kind, p, [], [], [], [])
                for column, value in zip(now[2:], (block, _unpack(h), k, d), strict=True):
                    column.append(value)
        if now:
            yield from answers(now)

    tasks = min(2 * parts, MOST_TASKS)
    dealt = messages.select("kind", "block", "p", "h", "kept", "deleted").repartitionById(tasks, ((F.col("kind") * parts + F.col("p")) % tasks).cast("int"))
    return dealt.sortWithinPartitions("kind", "p").mapInArrow(run, TOTALS)


def block_rows(docs: DataFrame, asked: DataFrame, totals: DataFrame) -> DataFrame:
    """All rows of a block next to each other: hashes of its tokens, answers, documents."""
    none = lambda t, *names: [F.lit(None).cast(t).alias(c) for c in names]
    a = asked.select(F.lit(0).alias("step"), "block", "p", "h", *none("binary", "kept", "deleted"), *none("long", "doc_id"), *none("int", "split"), *none("binary", "ids"))
    t = totals.filter("block >= 0").select((F.col("kind") + 1).alias("step"), "block", "p", *none("binary", "h"), "kept", "deleted", *none("long", "doc_id"), *none("int", "split"), *none("binary", "ids"))
    d = docs.select(F.lit(3).alias("step"), "block", "p", *none("binary", "h", "kept", "deleted"), "doc_id", "split", "ids")
    return a.unionByName(t).unionByName(d).repartition(shuffle_partitions(docs.sparkSession), "block").sortWithinPartitions("block", "step", "p")


def _each_block(batches):
    """(low hashes, token counts, bigram counts, tokens, bounds of documents, doc_ids, splits) block by block;
    counts are pairs (kept, deleted) for each distinct token and each token's bigram and context."""
    now, got = None, []

    def whole(got):
        low, uni, bi, docs = [], [], [], []
        for step, h, k, d, doc_id, split, ids, p in got:
            if step == 0:
                x = _unpack(h)
                low.append(_names(np.full(len(x), p), x))
            elif step == 1:
                n = len(low[len(uni)])
                uni.append((_counts(k, n), _counts(d, n)))
            elif step == 2:
                bi.append((k, d))
            else:
                docs.append((doc_id, split, ids, p))
        low = np.concatenate(low)
        uni = [np.concatenate([u[i] for u in uni]) for i in (0, 1)]
        kind = np.uint16 if len(low) <= 65536 else np.uint32
        tokens = [np.frombuffer(x[2], kind) for x in docs]
        first = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        ids = np.concatenate(tokens).astype(np.int64)
        before, h, place, _ = _bigrams(ids, first[:-1], low, docs[0][3])
        return low, uni, bi, ids, before, h, place, first, [x[0] for x in docs], [x[1] for x in docs]

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("step", "h", "kept", "deleted", "doc_id", "split", "ids", "p")]
        for block, row in zip(batch.column("block").to_pylist(), zip(*cols, strict=True), strict=True):
            if block != now and got:
                yield whole(got)
                got = []
            now = block
            got.append(row)
    if got:
        yield whole(got)


def _token_counts(block, parts: int):
    """For each token of a block: counts of its bigram, its context and itself, each (kept, deleted)."""
    _, uni, bi, ids, before, h, place, *_ = block
    at = _bounds(_place(h, parts, BITS[BI])[0])
    pairs = [[], []]
    for (k, d), l, r in zip(bi, at[:-1], at[1:], strict=True):
        pairs[0].append(_counts(k, r - l))
        pairs[1].append(_counts(d, r - l))
    pairs = [np.concatenate(x)[place] for x in pairs]
    return pairs, [u[before] for u in uni], [u[ids] for u in uni]


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Contexts of like frequency share mixture weights: 0, 1, 2-3, 4-7, ... times seen."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def _estimates(pair, context, own, n: int, types: int):
    """Maximum-likelihood estimates: bigram, unigram, and 1 over the types and one unknown."""
    return pair / np.maximum(context, 1), own / max(n, 1), 1.0 / (types + 1)


@dataclass(frozen=True)
class Mixture:
    """``weights``: for each bucket those of bigram, unigram and uniform; rows add up to 1."""

    weights: np.ndarray
    tokens: int
    types: int

    def logs(self, pair, context, own) -> np.ndarray:
        f2, f1, f0 = _estimates(pair, context, own, self.tokens, self.types)
        w = self.weights[np.minimum(bucket_of(context), len(self.weights) - 1)]
        return np.log10(w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] * f0)


def _bin(x: np.ndarray) -> np.ndarray:
    """Number of the estimate's bin; -1 for 0."""
    return np.where(x > 0, np.round((np.log2(np.maximum(x, 2.0**_LEAST)) - _LEAST) * _FINE), -1).astype(np.int64)


def _of_bin(b: np.ndarray) -> np.ndarray:
    return np.where(b < 0, 0.0, 2.0 ** (b / _FINE + _LEAST))


def learn_weights(rows: list, types: int, iterations: int = 100, buckets: int = 65) -> np.ndarray:
    """Expectation-maximisation on (bucket, bin of bigram estimate, bin of unigram estimate, tokens)."""
    w = np.tile([0.4, 0.4, 0.2], (buckets, 1))
    w[0] = [0.0, 0.7, 0.3]  # a context never seen says nothing
    if not rows:
        return w
    b, i2, i1, n = np.array(rows, np.int64).T
    f = np.stack([_of_bin(i2), _of_bin(i1), np.full(len(n), 1.0 / (types + 1))], axis=1)
    for _ in range(iterations):
        share = w[b] * f
        share *= (n / share.sum(axis=1))[:, None]
        total = np.stack([np.bincount(b, share[:, k], buckets) for k in range(3)], axis=1)
        # a few tokens' worth of the start keep every weight positive and serve empty buckets
        total += np.where(np.arange(buckets)[:, None] == 0, [0.0, 0.7, 0.3], [0.4, 0.4, 0.2])
        w = total / total.sum(axis=1, keepdims=True)
    return w


def score_documents(documents: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    P(w|v) = a f(w|v) + b f(w) + c / (V + 1): maximum-likelihood estimates from all documents that
    are not ``held_out``, mixed with weights by the bucket of v's frequency. Weights come from
    deleted estimation: one training document in DELETED is left out of the counts, and EM maximises
    its tokens' likelihood under the others' counts.

    Documents are counted in blocks. A block sends its distinct tokens and bigrams, counted, to the
    partition of their hash and gets counts of the whole corpus back: no word, however frequent,
    makes more than one entry a block, no table is broadcast, and memory is bounded by a block and
    by a slice of hashes (their number grows with the corpus; a slice holds a token that is in every block as often as there
    are blocks, 32 bytes each). Messages are a row a block and slice that it touches. Within a slice 48 bits tell tokens
    and 40 bits bigrams apart.

    Null and empty texts have the end token alone. A null doc_id is a training document. Rows with
    one doc_id are scored and counted each. An empty table gives no rows.
    """
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    parts = max(shuffle_partitions(spark), -(-size // COUNT_BYTES))
    split = F.when(held_out, F.lit(TEST)).when(F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(DELETED)) == 0, F.lit(LEFT_OUT)).otherwise(F.lit(KEPT))
    path = shared_path(spark, "grams")
    gram_rows(documents, split, parts).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    schema = ", ".join(x for x in GRAMS.split(", ") if not x.startswith("kind"))
    grams = spark.read.schema(schema + ", kind int").parquet(path)
    totals = cut(count_rows(grams.filter("kind < 2"), parts), "totals")
    remove(spark, f"{path}/kind=1")
    release(spark)
    grams = spark.read.schema(schema + ", kind int").parquet(path)
    asked, docs = grams.filter("kind = 0"), grams.filter("kind = 2")
    seen = totals.filter("block < 0 and kind = 0").agg(
        F.sum("distinct").alias("types"), F.sum("all_kept").alias("kept"), F.sum("all_deleted").alias("deleted")
    ).first()
    types, kept, tokens = seen["types"] or 0, seen["kept"] or 0, (seen["kept"] or 0) + (seen["deleted"] or 0)

    odd = F.col("block") % 2 == 1

    def bins(batches):
        for block in _each_block(batches):
            pair, context, own = _token_counts(block, parts)
            f2, f1, _ = _estimates(pair[0], context[0], own[0], kept, types)
            code = (bucket_of(context[0]) * 1024 + _bin(f2) + 1) * 1024 + _bin(f1) + 1
            code, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    summed = block_rows(docs.filter(odd), asked.filter(odd), totals.filter(odd)).mapInArrow(bins, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    rows = [(r["code"] >> 20, (r["code"] >> 10 & 1023) - 1, (r["code"] & 1023) - 1, r["n"]) for r in summed.collect()]
    model = spark.sparkContext.broadcast(Mixture(learn_weights(sorted(rows), types), tokens, types))  # 65 x 3 numbers
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scores(batches):
        for block in _each_block(batches):
            first, ids, split = block[-3], block[-2], np.array(block[-1])
            pair, context, own = ((x[0] + x[1]) for x in _token_counts(block, parts))
            of = np.repeat(np.arange(len(ids)), np.diff(first))
            base = np.log10((own + 1) / (tokens + types + 1))
            total = lambda x: np.bincount(of, x, len(ids))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(split == TEST), pa.array(np.diff(first).astype(np.int64)),
                    pa.array(total(own > 0).astype(np.int64)), pa.array(np.full(len(ids), tokens, np.int64)), pa.array(total(base)),
                    pa.array(total(model.value.logs(pair, context, own))),
                ],
                names,
            )

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return block_rows(docs, asked, totals).mapInArrow(scores, out)


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return score_documents(docs, held_out)
