"""Language identification with string kernels: blended-spectrum presence, Nyström landmarks, ridge regression."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import blocks, mix, text_bytes

UNKNOWN = "und"


@dataclass(frozen=True)
class Kernel:
    """n-grams of 1 to ``longest`` bytes of lower-cased text, present or not, in ``width`` hashed
    places; ``landmarks`` span the Nyström space, ``ridge`` weighs the penalty. ``sample`` bounds the
    labelled rows that are fitted, shared evenly by the languages; ``languages`` how many, those with most rows, are learned."""

    longest: int = 4
    width: int = 16384
    landmarks: int = 128
    ridge: float = 1e-3
    sample: int = 2048
    languages: int = 256


#: Letters to lower case; other ASCII is one blank; bytes of longer characters stay.
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
_SOME = 64


def presence(texts: pa.Array, k: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """(n x width flags, whether the text has a letter)."""
    raw, at = text_bytes(texts)
    n = len(at) - 1
    flags = np.zeros(n * k.width, bool)
    data = _PLAIN[raw].astype(np.uint64)
    base = np.repeat(np.arange(n, dtype=np.int64) * k.width, np.diff(at))
    code = np.zeros(len(data), np.uint64)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(data))  # bytes from here to the text's end
    for length in range(1, k.longest + 1):
        m = len(data) - length + 1
        if m <= 0:
            break
        code = code[:m] * np.uint64(257) + data[length - 1 :]
        places = (mix(code + np.uint64(length << 48)) & np.uint64(k.width - 1)).astype(np.int64) + base[:m]
        flags[places[left[:m] >= length]] = True
    ascii_letters = np.concatenate([[0], np.cumsum((_PLAIN[raw] >= 97) & (_PLAIN[raw] < 123))])
    letters = ascii_letters[at[1:]] > ascii_letters[at[:-1]]
    for i in np.flatnonzero(~letters & (at[1:] > at[:-1])):
        letters[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return flags.reshape(n, k.width), letters


class Model:
    """One-versus-rest kernel ridge regression in the space that the landmarks span."""

    def __init__(self, flags: np.ndarray, labels: list[str], k: Kernel):
        self.k, self.names = k, sorted(set(labels))
        x = flags.astype(np.float32)
        norm = np.sqrt(np.maximum(x.sum(axis=1), 1))
        x /= norm[:, None]
        by_label = np.argsort(np.array(labels), kind="stable")  # landmarks of all languages, from first to last
        chosen = np.unique(np.linspace(0, len(x) - 1, min(len(x), k.landmarks)).round().astype(np.int64))
        self.marks = np.ascontiguousarray(x[by_label[chosen]].T)
        gram = self.marks.T @ self.marks
        values, vectors = np.linalg.eigh(gram.astype(np.float64))
        good = values > 1e-6 * values[-1]
        whiten = vectors[:, good] / np.sqrt(values[good])
        phi = (x @ self.marks).astype(np.float64) @ whiten
        y = np.where(np.array(labels)[:, None] == np.array(self.names)[None, :], 1.0, -1.0)
        offset = y.mean(axis=0)
        weights = np.linalg.solve(phi.T @ phi + k.ridge * len(x) * np.eye(phi.shape[1]), phi.T @ (y - offset))
        self.out, self.offset = (whiten @ weights).astype(np.float32), offset.astype(np.float32)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        flags, letters = presence(texts, self.k)
        x = flags.astype(np.float32)
        near = (x @ self.marks) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
        margins = near @ self.out + self.offset
        best = margins.argmax(axis=1)
        score = np.clip((margins.max(axis=1).astype(np.float64) + 1) / 2, 0, 1)
        return [self.names[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def learn(labelled: DataFrame, k: Kernel = Kernel()) -> Model | None:
    """Fit on a sample of (doc_id, text, lang): of each language the ``k.sample`` / languages rows that come first by a
    hash of doc_id and text. None without a labelled text.

    The bound is hard: null or repeated doc_ids and equal rows count as rows like others. Languages beyond ``k.languages``
    (those with fewest rows, of equals the later name) are not learned. Texts become flags on the executors, so the driver gets
    ``k.width`` bits a row, however long the texts are. Null texts and labels are left out."""
    rows = labelled.filter("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(k.languages).collect()
    if not counts:
        return None
    each, parts = max(1, k.sample // len(counts)), 1 << 30
    shares = [(r["lang"], int(min(parts, (2 * each + 64) * parts // r["n"] + 1))) for r in counts]
    hashed = rows.withColumn("h", F.xxhash64("doc_id", "text"))

    def run(batches):
        for whole in batches:
            for batch in blocks(whole, "text", 1 << 20):
                flags, letters = presence(batch.column("text"), k)
                packed = [np.packbits(f).tobytes() for f in flags]
                out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(packed, pa.binary())], ["doc_id", "lang", "flags"])
                yield out.filter(pa.array(letters))

    def taken(shares: list[tuple[str, int]]) -> list:
        """Rows of these languages: those with a hash below the share, and of them exactly the first."""
        known = F.broadcast(rows.sparkSession.createDataFrame(shares, "lang string, share long"))  # a row a language
        some = hashed.join(known, "lang").filter(F.pmod("h", F.lit(parts)) < F.col("share")).drop("share")
        first = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(parts)), "h"))
        chosen = some.withColumn("place", first).filter(F.col("place") <= each).drop("place", "h")
        return chosen.mapInArrow(run, "doc_id long, lang string, flags binary").collect()

    got = taken(shares)
    # where few different rows make up a language, chance may leave some out: then all of its rows compete
    found = Counter(r["lang"] for r in got)
    if short := [(r["lang"], parts) for r, (_, share) in zip(counts, shares, strict=True) if share < parts and found[r["lang"]] < min(each, r["n"])]:
        got = [r for r in got if r["lang"] not in dict(short)] + taken(short)
    if not got:
        return None
    got = sorted(got, key=lambda r: (r["lang"], r["doc_id"] or 0, bytes(r["flags"])))
    flags = np.unpackbits(np.frombuffer(b"".join(bytes(r["flags"]) for r in got), np.uint8)).reshape(len(got), k.width)
    return Model(flags, [r["lang"] for r in got], k)


def identify(documents: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score (0 to 1) of each row, from whole texts alone.

    Null and empty texts and texts without a letter are ``und`` with score 0, as is all when there is no model.
    Scored in batches: flags times landmarks, then times weights. Rows are judged alone; an empty
    table gives no rows.
    """
    if model is None:
        return documents.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # landmarks x width numbers
    schema = documents.select(*keep, F.lit("").cast("string").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches):
        for whole in batches:
            for batch in blocks(whole, "text", 1 << 19):
                for i in range(0, batch.num_rows, _SOME):
                    part = batch.slice(i, _SOME)
                    names, score = shared.value.predict(part.column("text"))
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(names, pa.string()), pa.array(score)], schema.names)

    return documents.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op4_language(spark, sf_dir: str) -> DataFrame:
    """The contract's columns: learned where crc32(doc_id) mod 5 is not 0, predicted everywhere."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = learn(docs.filter(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
