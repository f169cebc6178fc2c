"""Every stage of the pipeline against brute force, with nulls, empty texts, repeated rows and clashing columns."""

import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from folioflow.llm import mixing

from . import helpers as H
from .test_decontaminate_lm_chat import shingles
from .test_groups import brute_groups
from .test_quality_langid import brute
from .test_tokens_mix_shards import plain_ids, targets


def corpus():
    rng, rows = random.Random(21), H.odd_rows()
    word = lambda: f"w{rng.randrange(3000)}"
    items = [" ".join(f"q{k}x{j}" for j in range(12 + k)) for k in range(6)]
    for n in range(60):
        text = [word() for _ in range(rng.randrange(30, 90))]
        if n % 9 == 0:
            text[5:5] = items[n // 9 % 6].split()
        rows.append((100 + n, " ".join(text), "en", f"s{n % 4}" if n % 7 else None, 1))
        if n % 5 == 0:  # a near copy, and an exact one of other case
            copy = list(text)
            copy[rng.randrange(len(copy))] = "changed"
            rows += [(300 + n, " ".join(copy), "en", "s1", 1), (400 + n, " ".join(text).upper(), "en", "s2", 1)]
    rows += [(None, " ".join(word() for _ in range(40)), None, None, None)] * 2 + [(500, "  \n", "en", "s0", 3), (501, None, None, None, None)]
    return rows, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = corpus()
    d = str(tmp_path_factory.mktemp("pipeline"))
    H.clashing(H.frame(spark, rows)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([*enumerate(items), (None, items[0]), (9, None), (10, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_equal_brute_force(spark, folder):
    rows, items = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    assert list(stages) == ["quality", "near_duplicates", "decontaminate", "mix", "tokens"]
    pairs = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())

    good = stages["quality"](spark, docs, folder)
    want = Counter(r[:2] for r in rows if brute(r[1])[-1])
    assert good.columns == columns and pairs(good) == want

    one = stages["near_duplicates"](spark, good, folder)
    groups = brute_groups([(*k, None) for k in want], 5)
    kept = Counter({k: n if k[0] is None else 1 for k, n in want.items() if k[0] is None or groups[k[0]] == k[0]})
    assert one.columns == columns and pairs(one) == kept and len(kept) < len(want)

    clean = stages["decontaminate"](spark, one, folder)
    holds = lambda text: any(100 * len(q & shingles(text)) >= 80 * len(q) for q in map(shingles, items))
    left = Counter({k: n for k, n in kept.items() if not holds(k[1])})
    assert clean.columns == columns and pairs(clean) == left and len(left) < len(kept)

    mixed = stages["mix"](spark, clean, folder)
    assert mixed.columns == columns
    taken = Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect())
    source = {r[:2]: r[3] for r in rows}
    sizes = Counter()
    for k, n in left.items():
        sizes[source[k]] += n * len(H.words(k[1]))
    assert all(n <= 2 * left[k[:2]] for k, n in taken.items())
    for s, goal in targets(dict(sizes)).items():
        got = sum(n * len(H.words(k[1])) for k, n in taken.items() if k[2] == s)
        assert abs(got - goal) <= max(60, *(len(H.words(k[1])) for k in left if source[k] == s)), s

    out = sorted(map(tuple, stages["tokens"](spark, mixed, folder).collect()), key=lambda r: r[1])
    encode = lambda text: b"".join(i.to_bytes(4, "little") for i in [*plain_ids(text), 0])
    want_ids = Counter()
    for (doc_id, text, _), n in taken.items():
        raw = encode(text)
        want_ids[doc_id, len(raw) // 4, zlib.crc32(raw)] += n
    assert Counter((r[0], r[2], r[3]) for r in out) == want_ids
    assert [r[0] is not None for r in out] == sorted(r[0] is not None for r in out) and [r[0] for r in out if r[0] is not None] == sorted(r[0] for r in out if r[0] is not None)
    at = 0
    for r in out:
        assert r[1] == at
        at += r[2]


def test_run_applies_all_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {r["doc_id"] for r in got.collect()} <= {r[0] for r in corpus()[0]}


def test_run_on_empty_tables(spark, tmp_path):
    H.frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_large_sides_of_the_mix_give_the_same(spark, monkeypatch):
    df = H.frame(spark, [(i, "w " * (1 + i * 7 % 50), None, f"s{i % 5}" if i % 11 else None, 1) for i in range(120)])
    few = lambda: (sorted(map(tuple, mixing.source_targets(df.selectExpr("source", "doc_id as size")).collect()), key=repr), Counter(r["doc_id"] for r in mixing.mix_documents(df).collect()))
    small = few()
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    large = few()
    assert large[1] == small[1] and [r[:2] for r in large[0]] == [r[:2] for r in small[0]]
    assert all(a[2] == pytest.approx(b[2]) for a, b in zip(*(x[0] for x in (small, large)), strict=True))


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from folioflow.llm import common

    def session(master, **given):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: given.get(k.replace(".", "_"), d), set=lambda k, v: given.update({k.replace(".", "_"): v})), sparkContext=SimpleNamespace(master=master))

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master))
        assert common.shared_dir(session(master, spark_checkpoint_dir="hdfs:///x")) == "hdfs:///x"
    assert common.shared_dir(session("local[4]")).startswith("file:///")
