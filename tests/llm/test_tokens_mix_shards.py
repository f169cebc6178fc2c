import io
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.llm import mixing, sharding, tokenfiles
from folioflow.llm.common import shared_path

from . import helpers as H

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def fresh():
    """The tokenizer as the library reads it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


PLAIN = fresh()


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'ab.,1é²ªµ 　—#|<>"), st.characters(codec="utf-8")), max_size=40))
def test_pieces_encode_as_whole_texts(text):
    e = tokenfiles.encoder(PATH)
    assert e.encode([text])[0] == np.array(plain_ids(text), "<u4").tobytes()


def test_special_tokens_encode_as_the_library_does():
    e = tokenfiles.encoder(PATH)
    for text in ("<|endoftext|> hi", "a <|endoftext|>b", "x  <|endoftext|><|endoftext|>", "<|endoftext|", "plain <|endoftext |>", "<|endoftext|>"):
        assert e.encode([text])[0] == np.array(plain_ids(text), "<u4").tobytes(), text


def test_store_of_pieces_stays_bounded():
    e = tokenfiles.Encoder(PATH, most=40)
    texts = [f"alpha{i} beta{i % 3} gamma" for i in range(200)]
    whole = [np.array(plain_ids(t), "<u4").tobytes() for t in texts]
    assert [e.encode([t])[0] for t in texts] == whole
    assert len(e) <= 40 and len(e.old) <= 40


def test_shard_format_round_trip():
    out, rng = io.BytesIO(), np.random.default_rng(1)
    w, want = tokenfiles.Writer(out), {}
    for i in range(-300, 3000, 3):
        for o in range(1 + (i % 7 == 0)):
            ids = rng.integers(0, 70_000 if i % 5 == 0 else 50_000, rng.integers(0, 300)).astype("<u4")
            w.add(i, 5 - i, o, tokenfiles.packed(ids))
            want[i, o] = ids
    w.close()
    r = tokenfiles.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert len(r.blocks) > 3
    scanned = {(i, o): ids for i, h, o, ids in r.scan() if h == 5 - i}
    assert scanned.keys() == want.keys() and all((scanned[k] == want[k]).all() for k in want)
    for i, o in want:
        found = r.get(i)
        assert len(found) == 1 + (i % 7 == 0) and (found[o] == want[i, o]).all()
    assert r.get(1) == [] and r.get(10**9) == [] and r.get(-10**9) == []
    assert sum(r.may_hold(i) for i in range(10_000, 20_000)) < 300
    bad = bytearray(out.getvalue())
    bad[100] ^= 1
    with pytest.raises(ValueError):
        list(tokenfiles.Reader(io.BytesIO(bytes(bad)), len(bad)).scan())
    with pytest.raises(ValueError):
        w2 = tokenfiles.Writer(io.BytesIO())
        w2.add(2, 0, 0, tokenfiles.packed(ids))
        w2.add(1, 0, 0, tokenfiles.packed(ids))


def test_token_tables_equal_plain_encoding(spark):
    rows = [r for r in H.odd_rows() if r[0] is not None]
    got = tokenfiles.token_tables(H.clashing(H.frame(spark, rows)), PATH).collect()
    at, want = 0, []
    for r in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*plain_ids(r[1]), 0], "<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got)) == sorted(want)
    assert tokenfiles.token_tables(H.frame(spark, []), PATH).count() == 0


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    goal, full, left = share * sum(sizes.values()), {}, dict(sizes)
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    while True:
        rest = goal - sum(full.values())
        t = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if t[s] >= cap * sizes[s]]
        if not over:
            return full | t
        for s in over:
            full[s] = cap * sizes.pop(s) if False else cap * sizes[s]
            left.pop(s)
        if not left:
            return full


def test_mix_meets_its_targets(spark):
    rows = H.odd_rows() + [(100 + i, "w " * (1 + i * 7 % 90), "en", f"s{i % 6}" if i % 3 else "s0", 1) for i in range(400)]
    df = H.frame(spark, rows)
    got = mixing.entropy_mix(H.clashing(df)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(H.words(r[1]))
    want = targets(dict(sizes))
    taken = Counter()
    for g in got:
        assert 0 <= g["copies"] <= 2 and g["source_size"] == sizes[g["source"]]
        assert g["target"] == pytest.approx(want[g["source"]], rel=1e-9)
        taken[g["source"]] += g["copies"] * g["size"]
    for s, n in Counter(r[3] for r in rows).items():
        if n > 20:
            assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 45), s
    again = mixing.entropy_mix(df.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixed_documents_and_empty_mix(spark):
    df = H.clashing(H.frame(spark, [r for r in H.odd_rows() if r[0] not in (8,)]))
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    assert all(n <= 2 for k, n in Counter(r["doc_id"] for r in out.collect()).items() if k != 10)
    assert mixing.mix_documents(H.frame(spark, [])).count() == 0
    assert mixing.entropy_mix(H.frame(spark, [(1, None, None, None, None)])).first()["copies"] == 0


def test_shuffle_lays_rows_evenly(spark):
    from pyspark.sql import functions as F

    rows = H.odd_rows() + [(100 + i, f"t{i % 50}", None, None, None) for i in range(333)]
    df = H.clashing(H.frame(spark, rows))
    out = sharding.two_pass_shuffle(df, sharding.size_of(F.col("text")), [F.col("doc_id"), F.xxhash64("text")], 40, 7, 1 << 10)
    assert set(df.columns) <= set(out.columns)
    got = out.collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    place = lambda rows: {(r["shard"], r["slot"]): r["doc_id"] for r in rows}
    again = sharding.two_pass_shuffle(df.repartition(5), sharding.size_of(F.col("text")), [F.col("doc_id"), F.xxhash64("text")], 40, 7, 1 << 10)
    assert place(got) == place(again.collect())
    moved = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"])) if r["doc_id"] is not None]
    assert moved != sorted(moved)


def test_shuffle_deals_many_equal_rows_and_keeps_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EQUAL_ROWS", 50)
    rows = [(None, None, None, None, None)] * 700 + [(i, f"t{i}", None, None, None) for i in range(100)]
    df = H.frame(spark, rows).withColumn("shard", F.lit("own")).withColumn("Slot", F.lit(-1))
    out = sharding.two_pass_shuffle(df, sharding.size_of(F.col("text")), [F.col("doc_id"), F.xxhash64("text")])
    assert out.columns == [*df.columns, "_shard", "_slot"]
    got = out.collect()
    assert Counter((r["doc_id"], r["text"], r["shard"], r["Slot"]) for r in got) == Counter((*r[:2], "own", -1) for r in rows)
    by = Counter(r["_shard"] for r in got)
    assert sorted(by) == list(range(40)) and set(by.values()) == {20}
    assert {(r["_shard"], r["_slot"]) for r in got} == {(s, n) for s in range(40) for n in range(20)}
    # the equal rows don't stand together, as those of one bucket would
    assert all(any(r["doc_id"] is not None for r in got if r["_shard"] in (s, s + 1, s + 2)) for s in range(0, 36, 3))


def test_shards_of_few_rows(spark):
    from pyspark.sql import functions as F

    few = sharding.two_pass_shuffle(H.frame(spark, [(1, "a", None, None, 1), (2, None, None, None, 1)]), F.lit(1), [F.col("doc_id")]).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0)]
    assert sharding.two_pass_shuffle(H.frame(spark, []), F.lit(1), [F.col("doc_id")]).count() == 0


def test_sharding_reads_whole_documents_back_from_shards(spark, tmp_path):
    rows = H.odd_rows() + [(100 + i, f"t{i % 50} " * (1 + i * 37 % 900), None, None, None) for i in range(333)]
    H.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op8_sharding(spark, str(tmp_path)).collect()
    sharding.write_shards(H.frame(spark, rows), f"{tmp_path}/shards")
    files = spark.read.parquet(f"{tmp_path}/shards").collect()
    digest = lambda i, t, shard, slot: (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), shard, slot)
    order = lambda r: r[3:]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got), key=order) == sorted(
        (digest(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in files), key=order
    )
    assert Counter((r["doc_id"], r["text"]) for r in files) == Counter(r[:2] for r in rows)
    assert sorted({r["shard"] for r in got}) == list(range(40))
    H.frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert sharding.op8_sharding(spark, f"{tmp_path}/none").count() == 0


def test_token_tables_keep_null_doc_ids(spark):
    rows = [(None, "a row without id", None, None, 0), (-5, "below nought", None, None, 0), (0, "nought", None, None, 0), (7, None, None, None, 0)]
    got = tokenfiles.token_tables(H.frame(spark, rows), PATH).collect()
    at, want = 0, []
    for doc_id, text, *_ in rows:
        ids = np.array([*plain_ids(text), 0], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    out, ids = io.BytesIO(), np.arange(3, dtype="<u4")
    w = tokenfiles.Writer(out)
    for key in ((None, 0), (None, 1), (-(1 << 63), 0), (0, 0)):
        w.add(key[0], 9, key[1], tokenfiles.packed(ids + len(w.keys)))
    w.close()
    r = tokenfiles.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert [(k[0], k[2]) for k in r.scan()] == [(None, 0), (None, 1), (-(1 << 63), 0), (0, 0)]
    assert (r.get(None)[1] == ids + 1).all() and (r.get(0)[0] == ids + 3).all()


def test_lookup_over_the_manifest(spark):
    rows = H.odd_rows() + [(40, f"many rows of one id {i}", None, None, 1) for i in range(60)] + [(50 + i, f"t {i}", None, None, 1) for i in range(200)] + [(40, "twice", None, None, 1)] * 2
    folder = shared_path(spark, "lookup")
    manifest = tokenfiles.write_tables(H.clashing(H.frame(spark, rows)), folder, PATH, shards=7)
    files = manifest.orderBy("shard").collect()
    assert len(files) > 3 and all(a["last_key"] < b["first_key"] for a, b in zip(files[:-1], files[1:], strict=True))
    for doc_id in (None, 1, 10, 40, 99, 249):
        got = sorted(x.tolist() for x in tokenfiles.lookup(manifest, folder, doc_id))
        assert got == sorted([*plain_ids(r[1]), 0] for r in rows if r[0] == doc_id)
    assert tokenfiles.lookup(manifest, folder, 10**6) == []
