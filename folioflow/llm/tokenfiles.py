"""Token ids in sorted-string-table shards: a file format with binary-search lookup, its writer and reader.

A shard file holds documents in ascending key order:

    "FSST" | data block ... | index block | Bloom filter | footer

* data block: entries, then u32 restart offsets and their number. An entry is varint shared,
  varint rest, varint bytes of value, then the key's last ``rest`` bytes, then the value; ``shared`` is how much of
  the key before it repeats, and is 0 at a restart (every 16 entries). A key is a flag byte (0: null doc_id, which
  comes first; 1: any other), the doc_id as 8 bytes (null: 0) and a hash of the text as 8 bytes, both big-endian with
  the sign flipped, so that byte order is numeric order, then a u32 ordinal that tells equal rows apart; so keys are
  unique over all shards. A value is one byte of width (2 or 4), then the ids little-endian.
* index block: for each data block, its last key and u64 offset, u32 length, u32 crc32 of the block.
* Bloom filter: u32 number of hashes, then the bits; it holds the 8 bytes of each doc_id (null: of 0).
* footer: u64 offset and u32 length of index and filter each, u64 entries, u64 ids, u32 crc32 of the
  index and filter, "FSST".
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import blocks
from .common import cut, shared_path, shuffle_partitions, small_batches

MAGIC, RESTART, BLOCK, BLOOM_BITS, BLOOM_HASHES = b"FSST", 16, 64 << 10, 10, 7
_FOOTER = struct.Struct("<QIQIQQI4s")
_INDEX, _KEY = struct.Struct("<QII"), struct.Struct(">BQQI")
#: Bytes of text for which there is a shard file; ids take about half of that.
TEXT_BYTES = 512 << 20
#: Pieces of text that a Python worker remembers during a task, in two generations, and between tasks.
CACHE_PIECES, REST_PIECES = 800_000, 200_000


def key_of(doc_id: int | None, text_hash: int = 0, ordinal: int = 0) -> bytes:
    flip = lambda n: (n + (1 << 63)) & (2**64 - 1)
    return _KEY.pack(doc_id is not None, flip(doc_id or 0), flip(text_hash), ordinal)


def packed(ids: np.ndarray) -> bytes:
    """The value of an entry."""
    wide = ids.size and int(ids.max()) > 0xFFFF
    return (b"\4" + ids.astype("<u4").tobytes()) if wide else (b"\2" + ids.astype("<u2").tobytes())


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _bloom_places(keys: np.ndarray, bits: int) -> np.ndarray:
    """BLOOM_HASHES places for each 8-byte key, by double hashing."""
    x = keys.astype(np.uint64)
    a = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    a ^= a >> np.uint64(29)
    b = (x ^ (x >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53) | np.uint64(1)
    return (a[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(bits)


class Writer:
    """Writes entries, which come in ascending order, to an open binary stream."""

    def __init__(self, out):
        self.out, self.at, self.block, self.restarts, self.n = out, 0, bytearray(), [], 0
        self.first, self.last, self.index, self.ids, self.entries, self.keys = b"", b"", bytearray(), 0, 0, []
        self._put(MAGIC)

    def _put(self, b: bytes) -> None:
        self.out.write(b)
        self.at += len(b)

    def add(self, doc_id: int | None, text_hash: int, ordinal: int, value: bytes) -> None:
        """``value``: :func:`packed` ids."""
        key = key_of(doc_id, text_hash, ordinal)
        if key <= self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += value
        self.last, self.n = key, self.n + 1
        self.entries, self.ids = self.entries + 1, self.ids + (len(value) - 1) // value[0]
        self.first = self.first or key
        self.keys.append(doc_id or 0)
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.n:
            b = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            self.index += self.last + _INDEX.pack(self.at, len(b), zlib.crc32(b))
            self._put(b)
            self.block, self.restarts, self.n = bytearray(), [], 0

    def close(self) -> None:
        self._flush()
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        flags = np.zeros(bits, np.uint8)
        if self.keys:
            flags[_bloom_places(np.array(self.keys, np.int64).view(np.uint64), bits).ravel()] = 1
        bloom = struct.pack("<I", BLOOM_HASHES) + np.packbits(flags).tobytes()
        index, index_at = bytes(self.index), self.at
        self._put(index)
        bloom_at = self.at
        self._put(bloom)
        self._put(_FOOTER.pack(index_at, len(index), bloom_at, len(bloom), self.entries, self.ids, zlib.crc32(index + bloom), MAGIC))


def _entries(block: bytes, at: int = 0, end: int | None = None):
    """(key, ids) of a block's entries, from a restart on."""
    (restarts,) = struct.unpack_from("<I", block, len(block) - 4)
    end = len(block) - 4 - 4 * restarts if end is None else end
    key = b""
    while at < end:
        shared, at = _read_varint(block, at)
        rest, at = _read_varint(block, at)
        size, at = _read_varint(block, at)
        key = key[:shared] + block[at : at + rest]
        at += rest
        width = block[at]
        yield key, np.frombuffer(block, "<u4" if width == 4 else "<u2", (size - 1) // width, at + 1)
        at += size


class Reader:
    """Reads a shard from a seekable binary stream of ``size`` bytes: a scan, or one document."""

    def __init__(self, f, size: int):
        self.f = f
        f.seek(size - _FOOTER.size)
        index_at, index_n, bloom_at, bloom_n, self.entries, self.ids, crc, magic = _FOOTER.unpack(f.read(_FOOTER.size))
        f.seek(index_at)
        rest = f.read(index_n + bloom_n)
        if magic != MAGIC or zlib.crc32(rest) != crc or bloom_at != index_at + index_n:
            raise ValueError("damaged shard")
        self.blocks = []
        for i in range(0, index_n, _KEY.size + _INDEX.size):
            self.blocks.append((rest[i : i + _KEY.size], *_INDEX.unpack_from(rest, i + _KEY.size)))
        self.bits = np.unpackbits(np.frombuffer(rest, np.uint8, offset=index_n + 4))

    def _block(self, i: int) -> bytes:
        _, at, size, crc = self.blocks[i]
        self.f.seek(at)
        b = self.f.read(size)
        if zlib.crc32(b) != crc:
            raise ValueError("damaged block")
        return b

    def scan(self):
        """(doc_id, text_hash, ordinal, ids) in ascending order."""
        for i in range(len(self.blocks)):
            for key, ids in _entries(self._block(i)):
                given, doc_id, text_hash, ordinal = _KEY.unpack(key)
                yield doc_id - (1 << 63) if given else None, text_hash - (1 << 63), ordinal, ids

    def may_hold(self, doc_id: int | None) -> bool:
        return bool(self.bits[_bloom_places(np.array([doc_id or 0], np.int64).view(np.uint64), len(self.bits))].all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of each row with the doc_id: Bloom filter, binary search over blocks, then over restarts."""
        if not self.may_hold(doc_id):
            return []
        key, low, high = key_of(doc_id, -(1 << 63)), 0, len(self.blocks)
        own, out = key[:9], []
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.blocks[mid][0] < key else (low, mid)
        for i in range(low, len(self.blocks)):
            block, a = self._block(i), 0
            if i == low:
                (n,) = struct.unpack_from("<I", block, len(block) - 4)
                restarts = struct.unpack_from(f"<{n}I", block, len(block) - 4 - 4 * n)
                first, last = 0, n
                while last - first > 1:
                    mid = (first + last) // 2
                    first, last = (mid, last) if next(_entries(block, restarts[mid]))[0] <= key else (first, mid)
                a = restarts[first]
            for k, ids in _entries(block, a):
                if k[:9] > own:
                    return out
                if k[:9] == own:
                    out.append(ids)
        return out


#: Characters for which the split pattern below is the tokenizer's own: Latin letters, digits, common
#: marks and line feeds; no apostrophe, which may begin a contraction.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile(f"[{_LATIN}0-9.,;:!?()|#*$%&<>/@_+=~\\-\n ]+")
_SPLIT = re.compile(f" ?[{_LATIN}]+| ?[0-9]+| ?[^\\s{_LATIN}0-9]+|\\s+(?!\\S)|\\s+")


def _byte_letters() -> dict[int, str]:
    """The letters for which a byte-level vocabulary has bytes: printable ones stand for themselves, others are
    numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder(dict):
    """Ids of whole texts as little-endian bytes; as a dict, the ids of a piece after a space.

    Texts that hold an added token, such as an end-of-text mark, go to the library whole, and so do all if the tokenizer
    isn't a plain byte-level one. A byte-level BPE encoding never merges across the place before a run of spaces that ends at a
    non-space: its split pattern starts a piece there, whatever stands further left. So a text is
    cut at those places, each distinct piece is encoded once by the library, and the ids of the
    pieces are joined. Pieces of common characters are split here by the same pattern and go to the
    library's BPE model as they are; all others go through its whole encoder. The store of pieces is bounded:
    when the young half is full it becomes the old half, out of which pieces that are met again return.
    """

    def __init__(self, path: str, most: int = CACHE_PIECES):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.plain = plain and made["model"]["type"] == "BPE" and not made["normalizer"] and not made["truncation"] and not made["padding"]
        added = [re.escape(t["content"]) for t in made["added_tokens"]]
        self.added = re.compile("|".join(added)) if added else None
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, list[int]] = {}
        self.most = most // 2
        self.marks = {m: self.whole(m) for m in ".,"}

    def _part(self, part: str) -> list[int]:
        """Ids of what the split pattern yields."""
        ids = self.parts.get(part)
        if ids is None:
            model, mapped = self.tokenizer.model, part.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in model.tokenize(mapped)]
            if len(self.parts) >= self.most // 4:
                self.parts = {}
            self.parts[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text):
            ids = [i for part in _SPLIT.findall(text) for i in self._part(part)]
            return array("I", ids).tobytes()
        return self.whole(text)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, piece: str) -> bytes | None:
        """Ids of a space and ASCII letters, with a full stop or comma behind them or not: the commonest pieces."""
        end = b""
        if piece[-1:] in (".", ","):
            end, piece = self.marks[piece[-1]], piece[:-1]
        if not (piece.isascii() and piece.isalpha()):
            return None
        return array("I", [t.id for t in self.tokenizer.model.tokenize("\u0120" + piece)]).tobytes() + end

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self._word(piece) or self.ids(" " + piece)
        self[piece] = ids
        return ids

    def rest(self) -> None:
        """Keep little between tasks: workers live on, and other stages need their memory."""
        self.old, self.parts = {}, {}
        if len(self) > REST_PIECES:
            self.clear()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        get, out = self.__getitem__, []
        for text in texts:
            if not text:
                out.append(b"")
            elif not self.plain or (self.added and self.added.search(text)):
                out.append(self.whole(text))
            elif "  " in text:  # runs of spaces: all but the last stand before the piece's own
                out.append(b"".join([self.ids(p) for p in re.findall(" *[^ ]+| +", text)]))
            else:
                head, *rest = text.split(" ")
                if rest and not rest[-1]:  # a space at the end
                    rest[-1:] = []
                    last = self.ids(" ")
                else:
                    last = b""
                out.append((self.ids(head) if head else b"") + b"".join(map(get, rest)) + last)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that all machines share (file, hdfs, s3, gs, ...)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


MANIFEST = "shard int, path string, documents long, ids long, first_key binary, last_key binary"


def _sort_keys(doc_ids: pa.Array, hashes: pa.Array) -> np.ndarray:
    """Flag, doc_id and hash of each row as 17 bytes that sort as keys do."""
    out = np.zeros(len(doc_ids), np.dtype([("given", "u1"), ("doc_id", ">u8"), ("hash", ">u8")]))
    flip = np.uint64(1 << 63)
    out["given"] = doc_ids.is_valid().to_numpy(zero_copy_only=False)
    out["doc_id"] = doc_ids.fill_null(0).to_numpy().view(np.uint64) ^ flip
    out["hash"] = hashes.to_numpy().view(np.uint64) ^ flip
    return out.view("S17")


def key_ranges(rows: DataFrame, n: int) -> np.ndarray:
    """The least sort keys of some ``n`` ranges of (doc_id, h) with about as many rows each; equal keys are in one range. Only
    keys are moved, and a row a range goes to the driver."""
    dealt = rows.select("doc_id", "h").repartitionByRange(n, "doc_id", "h").groupBy(F.spark_partition_id().alias("p"))
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("given"), "doc_id", "h")).alias("k")
    found = [r["k"] for r in dealt.agg(least).collect()]
    keys = _sort_keys(pa.array([k["doc_id"] for k in found], pa.int64()), pa.array([k["h"] for k in found], pa.int64()))
    return np.sort(keys)


def encoded(rows: DataFrame, ranges: np.ndarray, tokenizer: str, end_id: int = 0) -> DataFrame:
    """(doc_id, h, range, value) of ``rows`` (doc_id, h, text): the range of the key, and the ids, packed. Null text: only the end id."""
    shared = rows.sparkSession.sparkContext.broadcast(ranges)  # 17 bytes a shard

    def run(batches):
        ids_of, end = encoder(tokenizer), array("I", [end_id]).tobytes()
        for whole in batches:
            for batch in blocks(whole, "text"):
                ids = [packed(np.frombuffer(x + end, "<u4")) for x in ids_of.encode(batch.column("text").to_pylist())]
                place = np.searchsorted(shared.value, _sort_keys(batch.column("doc_id"), batch.column("h")), "right") - 1
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(place.astype(np.int32)), pa.array(ids, pa.binary())], ["doc_id", "h", "range", "value"])
        ids_of.rest()

    return rows.mapInArrow(run, "doc_id long, h long, range int, value binary")


def write_tables(
    documents: DataFrame, folder: str, tokenizer: str, end_id: int = 0, shards: int | None = None
) -> DataFrame:
    """Encode ``documents`` and write shard files to ``folder``; return the manifest (shard, path,
    documents, ids, first_key, last_key), whose order is the order of ids.

    Texts are encoded where they are read and only their ids move, dealt in ranges of (doc_id, hash of the text), one range a
    shard file, for some TEXT_BYTES of text each. A file gets its name, which no other attempt uses, when it is whole; the manifest
    names the files that count. Rows with one doc_id are stored each, in the order of their text's hash, and equal
    rows are told apart by an ordinal. Null doc_ids come first. No rows: no shard and an empty manifest.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    size = documents.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("b")).first()["b"] or 0
    ranges = key_ranges(rows, shards or max(shuffle_partitions(documents.sparkSession), -(-size // TEXT_BYTES)))
    n = max(1, len(ranges))
    dealt = encoded(rows, ranges, tokenizer, end_id).repartitionById(n, F.col("range")).sortWithinPartitions("doc_id", "h")

    def write(batches):
        fs, base = filesystem(folder)
        part, out, w, last, ordinal = None, None, None, None, 0
        for batch in batches:
            for doc_id, h, value in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "h", "value")], strict=True):
                if w is None:
                    from pyspark import TaskContext

                    fs.create_dir(base, recursive=True)
                    shard, own = TaskContext.get().partitionId(), uuid.uuid4().hex
                    part = f"{base}/_part-{own}"
                    out = fs.open_output_stream(part)
                    w = Writer(out)
                ordinal = ordinal + 1 if (doc_id, h) == last else 0
                last = (doc_id, h)
                w.add(doc_id, h, ordinal, value)
        if w is not None:
            w.close()
            out.close()
            name = f"{base}/shard-{shard:06d}-{own}.sst"
            fs.move(part, name)
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()), "path": [name], "documents": pa.array([w.entries], pa.int64()), "ids": pa.array([w.ids], pa.int64()),
                    "first_key": pa.array([w.first], pa.binary()), "last_key": pa.array([w.last], pa.binary()),
                }
            )

    with small_batches(documents.sparkSession, 8):
        return cut(dealt.select("doc_id", "h", "value").mapInArrow(write, MANIFEST), "manifest")


def lookup(manifest: DataFrame, folder: str, doc_id: int | None) -> list[np.ndarray]:
    """Ids of each row with the doc_id, from the shards whose range of keys holds it."""
    own = bytearray(key_of(doc_id)[:9])
    hit = manifest.filter((F.substring("first_key", 1, 9) <= F.lit(own)) & (F.substring("last_key", 1, 9) >= F.lit(own)))
    fs, out = filesystem(folder)[0], []
    for row in hit.orderBy("shard").select("path").collect():  # one shard, or those that the rows of a repeated doc_id fill
        with fs.open_input_file(row["path"]) as f:
            out += Reader(f, f.size()).get(doc_id)
    return out


def read_tables(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document from the shard files.

    ``start`` counts the ids before a document: running sums over the manifest (a row a shard), then
    within the file."""
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    todo = manifest.select("shard", "path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    todo = todo.repartition(shuffle_partitions(manifest.sparkSession), "shard")
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    )

    def read(batches):
        fs, _ = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                cols, at = ([], [], [], []), row["start"]
                with fs.open_input_file(row["path"]) as f:
                    for doc_id, _, _, ids in Reader(f, f.size()).scan():
                        values = (doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                        for c, v in zip(cols, values, strict=True):
                            c.append(v)
                        at += len(ids)
                        if len(cols[0]) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema.names)
                            cols = ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema.names)

    return todo.mapInArrow(read, schema)


def token_tables(documents: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write ``documents`` to shard files in the shared folder and return what they hold."""
    folder = shared_path(documents.sparkSession, "tokens")
    return read_tables(write_tables(documents, folder, tokenizer, end_id), folder)


def op5_token_tables(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all of ``documents``."""
    import public_tokenizers

    return token_tables(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
