import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from folioflow.llm import langid, quality

from . import helpers as H


def brute(text):
    ws = H.words(text)
    lines = [x for x in (text or "").split("\n") if H.words(x)]
    chars = sum(map(len, ws))

    def covered(k):
        grams = [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)]
        n, hit = Counter(grams), set()
        for i, g in enumerate(grams):
            if n[g] > 1:
                hit |= set(range(i, i + k))
        return hit

    rep = len(covered(8))
    failed = len(ws) < 20 or 100 * rep > 30 * len(ws)
    shares = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
    seen, dup = set(), []
    for x in lines:
        dup += [x] * (x in seen)
        seen.add(x)
    kept = not failed and all(sum(len(ws[i]) for i in covered(k)) <= s * chars for k, s in shares.items())
    kept = kept and sum(sum(map(len, H.words(x))) for x in dup) <= 0.30 * chars
    return len(ws), chars, sum(c in "#*$%&|<>" for c in text or ""), len(dup), rep, failed, kept


def test_quality_equals_brute_force(spark):
    rows = H.odd_rows() + [(20 + i, t, "en", "a", 1) for i, t in enumerate([("a b c d e f g h i j " * 3) + " ".join(f"q{j}" for j in range(n)) for n in (0, 40, 90)])]
    got = quality.score(H.frame(spark, rows)).collect()
    want = [(r[0], *brute(r[1])) for r in rows]
    assert sorted(([tuple(g)[:8] for g in got]), key=repr) == sorted(want, key=repr)


def test_quality_keeps_columns_and_empty_tables(spark):
    df = H.clashing(H.frame(spark))
    assert quality.good_documents(df).columns == df.columns
    assert {r["doc_id"] for r in quality.good_documents(df).collect()} >= {5, 6, 10}
    assert quality.score(H.frame(spark, [])).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    en, fr = "the cat and the dog with this thing", "le chat et la chienne avec cette chose"
    rows = [(i, f"{(en if i % 2 else fr)} {i}", "en" if i % 2 else "fr", "s", 1) for i in range(80)]
    return langid.learn(H.frame(spark, rows))


def test_language_of_held_out_texts(spark, model):
    docs = H.frame(spark, [(1, "the dog and this cat", None, None, 0), (2, "la chienne et le chat", None, None, 0), (3, None, "en", None, 0), (4, "123 !?", "en", None, 0), (5, "", None, None, 0), (6, "LE CHAT avec" * 30_000, None, None, 0)])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(H.clashing(docs), model).collect()}
    assert [got[i][0] for i in (1, 2, 6)] == ["en", "fr", "fr"]
    assert all(got[i] == ("und", 0.0) for i in (3, 4, 5))
    assert all(0 <= s <= 1 for _, s in got.values())


def test_language_without_labels(spark):
    docs = H.frame(spark, [(1, "some text", None, None, 0)])
    assert langid.learn(docs) is None
    assert langid.identify(docs, None).first()["lang_pred"] == "und"
    assert langid.identify(H.frame(spark, []), None).count() == 0


def test_language_accuracy_on_the_tables(spark):
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    got = langid.op4_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


def grams(text, longest=4):
    """The text as bytes of lower-case letters and blanks, and all its n-grams."""
    data = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in text.encode())
    return {data[i : i + n] for n in range(1, longest + 1) for i in range(len(data) - n + 1)}


def test_language_model_equals_the_exact_kernel():
    rng = random.Random(3)
    stock = {"aa": "the cat dog with this and that".split(), "bb": "le chat chien avec cette chose et".split(), "cc": "der hund und katze mit diese \u00fcber".split()}
    train = [(" ".join(rng.choices(stock[c], k=12)), c) for c in stock for _ in range(20)]
    test = [" ".join(rng.choices(stock[c], k=9)) for c in stock for _ in range(10)] + ["le hund and chat", "xyz"]
    k = langid.Kernel(width=1 << 18)  # no two n-grams share a place, nearly
    model = langid.Model(langid.presence(pa.array([t for t, _ in train]), k)[0], [c for _, c in train], k)
    kernel = lambda x, y: len(grams(x) & grams(y)) / np.sqrt(len(grams(x)) * len(grams(y)))
    # as many landmarks as rows: ridge regression in their space is kernel ridge regression
    full = np.array([[kernel(x, y) for y, _ in train] for x, _ in train])
    names = sorted(stock)
    y = np.array([[1.0 if c == n else -1.0 for n in names] for _, c in train])
    alpha = np.linalg.solve(full + k.ridge * len(train) * np.eye(len(train)), y - y.mean(axis=0))
    margins = np.array([[kernel(x, t) for t, _ in train] for x in test]) @ alpha + y.mean(axis=0)
    got, score = model.predict(pa.array(test))
    assert got == [names[i] for i in margins.argmax(axis=1)]
    assert np.allclose(score, np.clip((margins.max(axis=1) + 1) / 2, 0, 1), atol=2e-3)


def test_language_sample_is_bounded_and_covers_all_labels(spark, monkeypatch):
    rows = [(None if i % 2 else 7, f"same words {i % 3}" if i % 5 else "one text", f"l{i % 9:02d}", "s", 1) for i in range(4000)]
    seen = []
    init = langid.Model.__init__
    monkeypatch.setattr(langid.Model, "__init__", lambda self, flags, labels, k: seen.append(Counter(labels)) or init(self, flags, labels, k))
    langid.learn(H.frame(spark, rows), langid.Kernel(sample=90))
    langid.learn(H.frame(spark, rows), langid.Kernel(sample=90, languages=3))
    assert len(seen[0]) == 9 and max(seen[0].values()) <= 10 and len(seen[1]) == 3 and sum(seen[1].values()) <= 90
