import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import chat, decontaminate, lm

from . import helpers as H


def shingles(text, n=5):
    w = H.words(H.lowered(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_contaminations_equal_brute_force(spark, monkeypatch):
    items = [(i, " ".join(f"i{i}t{j}" for j in range(6 + 3 * i))) for i in range(12)] + [(50, None), (51, ""), (52, "one"), (53, "a b c"), (None, "no id at all here now")]
    rows = H.odd_rows() + [(60, "A B c", None, None, 1), (61, "before no id at all here now", None, None, 1)]
    for n, (i, t) in enumerate(items[:12]):
        w = t.split()
        rows += [(100 + n, "start " * 400 + t.upper() + " end" * 300, None, None, 1), (200 + n, " ".join(w[: max(5, len(w) * 9 // 10)]), None, None, 1), (300 + n, " ".join(w[: len(w) // 2]) + " gap " + " ".join(w[len(w) // 2 :]), None, None, 1)]
    some = lambda rows: sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0))
    want = some((d[0], i, len(q), len(q & s)) for d in rows for i, t in items for q, s in [(shingles(t), shingles(d[1]))] if d[0] is not None and q and 100 * len(q & s) >= 80 * len(q))
    docs, bench = H.clashing(H.frame(spark, rows)), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminations(docs, bench).filter("doc_id is not null").collect()
    assert want and (61, None, 2, 2) in want and some(map(tuple, got)) == want
    monkeypatch.setattr(decontaminate, "BLOCK_HASHES", 200)  # several blocks of items
    assert some(map(tuple, decontaminate.contaminations(docs, bench).filter("doc_id is not null").collect())) == want
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    hit = {w[0] for w in want}
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(r[0] for r in rows if r[0] not in hit)


def test_contaminations_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminations(H.frame(spark), bench).count() == 0
    assert decontaminate.clean_documents(H.frame(spark), bench).count() == len(H.odd_rows())
    assert decontaminate.contaminations(H.frame(spark, []), spark.createDataFrame([(1, "x")], "item_id long, text string")).count() == 0


def test_containment_search_recalls_edited_items():
    import random

    import pyarrow as pa

    rng = random.Random(6)
    items = [[f"i{k}w{j}" for j in range(rng.randrange(6, 300))] for k in range(60)]
    texts, want = [], set()
    for n in range(600):
        k = rng.randrange(60)
        words = list(items[k])
        for _ in range(rng.randrange(0, 1 + len(words) // 24)):  # an edit costs up to five shingles
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        around = [f"d{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 3000))]
        cut = rng.randrange(len(around) + 1)
        texts.append(" ".join(around[:cut] + words + around[cut:]))
        q, s = shingles(" ".join(items[k])), shingles(texts[-1])
        if 100 * len(q & s) >= 80 * len(q):
            want.add((n, k, len(q & s)))
    sets = [next(iter(decontaminate.shingles(pa.array([" ".join(w)]), 5))) for w in items]
    got = set(decontaminate.Searcher(list(range(60)), sets, 80, 5).find(pa.array(texts)))
    assert len(want) > 400 and got <= want and len(got) >= 0.999 * len(want)


def brute_lm(rows, held):
    docs = [(r, [*H.words(H.lowered(r[1])), None]) for r in rows]
    train = [t for (r, t) in docs if not held(r[0])]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    return {r[0]: (len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for r, t in docs}


def test_lm_counts_and_scores(spark):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    base = ["the cat sat on the mat today", "a dog ran in the park again", "we saw the cat sit on a mat"]
    rows = H.odd_rows() + [(100 + i, base[i % 3], None, None, 1) for i in range(300)]
    flag = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    got = lm.score_documents(H.clashing(H.frame(spark, rows)), flag).collect()
    assert len(got) == len(rows)
    want = brute_lm(rows, held)
    for r in got:
        n, known, total, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, held(r["doc_id"]))
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    new = [r for r in got if r["held_out"] and (r["doc_id"] or 0) >= 100]
    assert new and sum(r["score"] for r in new) > sum(r["base_score"] for r in new) + len(new)
    assert lm.score_documents(H.frame(spark, []), flag).count() == 0


def test_lm_score_equals_brute_force(spark, monkeypatch):
    base = ["the cat sat on the mat today", "a dog ran in the park again", "we saw the cat sit on a mat", "new words here the cat"]
    rows = [(i, " ".join(base[(i + k * k) % 4] for k in range(i % 5)) or None, None, None, 1) for i in range(400)]
    flag = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = H.frame(spark, rows)
    part = {r[0]: "test" if r[1] else "deleted" if r[2] else "kept" for r in docs.select("doc_id", flag, F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(lm.DELETED)) == 0).collect()}
    uni = {s: Counter() for s in ("kept", "deleted", "test")}
    bi = {s: Counter() for s in uni}
    tokens = {r[0]: [*H.words(H.lowered(r[1])), None] for r in rows}
    for i, t in tokens.items():
        uni[part[i]].update(t)
        bi[part[i]].update(zip([None, *t], t, strict=False))
    types = len(uni["kept"] + uni["deleted"])
    n_kept, n = sum(uni["kept"].values()), sum((uni["kept"] + uni["deleted"]).values())
    bins = Counter()
    for i, t in tokens.items():
        for v, w in zip([None, *t], t, strict=False) if part[i] == "deleted" else ():
            c = uni["kept"][v]
            b2, b1 = lm._bin(np.array([bi["kept"][v, w] / max(c, 1), uni["kept"][w] / n_kept]))
            bins[0 if c == 0 else int(math.log2(c)) + 1, int(b2), int(b1)] += 1
    weights = lm.learn_weights(sorted((*k, m) for k, m in bins.items()), types)
    both, pairs = uni["kept"] + uni["deleted"], bi["kept"] + bi["deleted"]

    def want(t):
        total = 0
        for v, w in zip([None, *t], t, strict=False):
            a, b, c = weights[0 if both[v] == 0 else int(math.log2(both[v])) + 1]
            total += math.log10(a * pairs[v, w] / max(both[v], 1) + b * both[w] / n + c / (types + 1))
        return total

    for block, tasks in ((4 << 20, 20_000), (2_000, 3)):  # one block a task, or many, and slices that share a task
        monkeypatch.setattr(lm, "BLOCK_BYTES", block)
        monkeypatch.setattr(lm, "MOST_TASKS", tasks)
        got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, flag).collect()}
        assert len(got) == len(rows)
        for i, t in tokens.items():
            assert got[i] == pytest.approx(want(t), rel=1e-9)


def test_lm_mixture_is_a_distribution():
    w = lm.learn_weights([(3, 400, 300, 50), (3, -1, 200, 20), (0, -1, 300, 5), (0, -1, -1, 5)], 10)
    assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all() and w[0, 0] == 0
    m = lm.Mixture(w, 100, 3)  # counts 50, 30, 20 of three types, after a context seen 4 times
    p = 10 ** m.logs(np.array([3, 1, 0, 0]), np.array([4, 4, 4, 4]), np.array([50, 30, 20, 0]))
    assert p.sum() == pytest.approx(1)


def thread(spark, rows):
    return chat.chat(H.clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))


def test_chat_links_quotes_and_orders_replies(spark):
    rows = [
        (1, 0, "user", "Hello there  friend"), (1, 1, "assistant", "Line one here\nLine two there"), (1, 2, "user", "ok so"), (1, 3, "assistant", "> line ONE here\nreply to one"),
        (1, 4, "user", ">> Line one here\n> reply to one\nnested answer"), (1, 5, "user", "> Hello there friend\nto the first"), (1, 6, "x", "> nobody wrote this\nown words"),
        (2, 0, "user", "> Hello there friend\nother conversation"), (2, 1, "user", None), (2, 1, "user", None), (3, None, "a", "no turn"), (None, 4, None, "no conversation"), (4, 0, "a", ""),
    ]
    got = thread(spark, rows).collect()
    assert len(got) == len(rows)
    one = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["position"])
    assert [r["turn"] for r in one] == [0, 1, 2, 3, 4, 5, 6]
    assert {r["turn"]: r["reply_to"] for r in one} == {0: None, 1: None, 2: None, 3: 1, 4: 3, 5: 0, 6: None}
    assert [r["content"] for r in one][3:6] == ["reply to one", "nested answer", "to the first"]
    assert one[3]["chat"] == "<|assistant|>\nreply to one\n"
    assert all(r["reply_to"] is None for r in got if r["conv_id"] != 1)
    for c in {r["conv_id"] for r in got}:
        own = sorted(r["position"] for r in got if r["conv_id"] == c)
        assert own == list(range(len(own)))


def test_chat_moves_late_replies_to_their_message(spark):
    rows = [(1, 0, "a", "first question here"), (1, 1, "b", "second question here"), (1, 2, "c", "> first question here\nanswer one"), (1, 3, "d", "> second question here\nanswer two"), (1, 4, "e", "> answer one\nthanks")]
    got = sorted(thread(spark, rows).collect(), key=lambda r: r["position"])
    assert [r["turn"] for r in got] == [0, 1, 3, 2, 4]
    assert chat.chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_links_deeper_levels(spark):
    rows = [
        (1, 0, "a", "the very first words"), (1, 1, "b", "> the very first words\nsecond words"), (1, 2, "c", "the very first words"), (1, 3, "d", "something else"),
        (1, 4, "e", ">> the very first words\nonly nested"), (1, 5, "f", ">>> something else\nno such level, so the original"), (1, 6, "g", ">>> the very first words\nonly deep"),
        (1, 7, "h", "> something else\n>> the very first words\n>> the very first words\nlevel 1 goes first"),
        (2, 0, "a", "question"), (2, 1, "b", "> from another thread\nfirst reply"), (2, 2, "c", "> question\nother reply"), (2, 3, "d", ">> from another thread\nits original is not here"), (2, 4, "e", ">> nobody wrote this\nend"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in thread(spark, rows).collect()}
    assert len(got) == len(rows)
    want = {(1, 1): 0, (1, 4): 1, (1, 5): 3, (1, 6): 4, (1, 7): 3, (2, 2): 0, (2, 3): 1}
    assert {k: r["reply_to"] for k, r in got.items() if r["reply_to"] is not None} == want
    assert got[1, 4]["n_linked"] == 4 and got[2, 4]["n_linked"] == 0
    two = sorted((r for k, r in got.items() if k[0] == 2), key=lambda r: r["position"])
    assert [r["turn"] for r in two] == [0, 1, 3, 4, 2]


def brute_chat(rows):
    """(turn: (position, reply_to)) of one conversation without repeated turns, by the rules as they are told."""
    import re

    texts, order = {}, []
    for turn, text in sorted(rows):
        lines = [(m[0].count(">"), x[len(m[0]) :]) for x in (text or "").split("\n") for m in [re.match(r"[ \t]*((?:>[ \t]?)*)", x)]]
        norm = lambda x: " ".join(H.words(H.lowered(x)))
        units, i = set(), 0
        while i < len(lines):
            j = i
            while j < len(lines) and lines[j][0] == lines[i][0]:
                units.add((lines[i][0], norm(lines[j][1])))
                j += 1
            units.add((lines[i][0], norm(" ".join(x for _, x in lines[i:j]))))
            i = j
        texts[turn] = {u for u in units if u[1]}
        order.append(turn)
    reply = {}
    for turn in order:
        votes = {}
        for q, x in texts[turn]:
            if q:
                for level in (q - 1, 0):
                    to = [t for t in order if t < turn and (level, x) in texts[t]]
                    if to:
                        n = len(x.split())
                        v = votes.setdefault(max(to), [0, 0])
                        v[0] += n * (q == 1)
                        v[1] += n
                        break
        reply[turn] = max((v[0], v[1], t) for t, v in votes.items())[2] if votes else None
    follows, children = {}, {t: [] for t in order}
    for before, t in zip(order[:-1], order[1:], strict=True):
        if reply[t] is None or reply[t] == before:
            follows[before] = t
        else:
            children[reply[t]].append(t)
    out = []

    def say(t):
        run = [t]
        while run[-1] in follows:
            run.append(follows[run[-1]])
        out.extend(run)
        for p in reversed(run):
            for c in children[p]:
                say(c)

    say(order[0])
    return {t: (out.index(t), reply[t]) for t in order}


def test_chat_equals_brute_force(spark):
    import random

    rng, rows = random.Random(12), []
    for conv in range(40):
        said = []
        for turn in range(rng.randrange(1, 30)):
            own = f"words {rng.randrange(6)} of turn {turn if rng.random() < 0.7 else 0}"
            lines = []
            if said and rng.random() < 0.7:
                for line in rng.choice(said).split("\n")[: rng.randrange(1, 4)]:
                    lines.append((">" if line.startswith(">") else "> ") + line)
            said.append("\n".join([*lines, own]))
            rows.append((conv, turn, "user", said[-1]))
    deep = [(100, t, "user", f"> answer {t - 2}\nanswer {t}" if t > 1 else f"answer {t}") for t in range(120)]
    got = thread(spark, rows + deep).collect()
    by = {}
    for r in got:
        by.setdefault(r["conv_id"], {})[r["turn"]] = (r["position"], r["reply_to"])
    for conv in {r[0] for r in rows + deep}:
        assert by[conv] == brute_chat([(t, x) for c, t, _, x in rows + deep if c == conv]), conv


def test_conversations_are_assembled_in_parts(spark):
    rows = [(1, 0, "a", "first question here"), (1, 1, "b", "second question here"), (1, 2, "c", "> first question here\nanswer one")]
    got = chat.assembled(thread(spark, rows), 2).orderBy("part").collect()
    assert [(r["part"], r["n_turns"]) for r in got] == [(0, 2), (1, 1)]
    assert got[0]["chat"] + got[1]["chat"] == "<|a|>\nfirst question here\n<|b|>\nsecond question here\n<|c|>\nanswer one\n"
