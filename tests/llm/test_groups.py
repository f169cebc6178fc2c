import random
from itertools import combinations

from folioflow.llm import components, linededup, neardup

from . import helpers as H


def brute_groups(rows, n=2):
    sets = {}
    for doc_id, text, *_ in rows:
        w = H.words(H.lowered(text))
        s = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        sets.setdefault(doc_id, []).append(s)
    comp = {i: i for i in sets}
    for a, b in combinations([i for i in sets if i is not None], 2):
        if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
            low, high = sorted((comp[a], comp[b]))
            comp = {k: low if v == high else v for k, v in comp.items()}
    return comp


def near_rows():
    rng = random.Random(5)
    rows, n = [], 100
    for _ in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(8, 120))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 9))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(4000)}"
            rows.append((n, " ".join(copy), "en", "s", 1))
            n += 1
    return rows


def test_near_groups_equal_brute_force(spark):
    rows = H.odd_rows() + near_rows()
    got = neardup.near_groups(H.clashing(H.frame(spark, rows))).collect()
    assert len(got) == len(rows)
    want = brute_groups(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == set(want.items())


def test_one_of_each_group_stays(spark):
    df = H.clashing(H.frame(spark))
    left = neardup.drop_near(df, neardup.Near(shingle=2))
    assert left.columns == df.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert 5 in ids and not {6, 7, 10} & set(ids) and None in ids and {1, 2, 3} <= set(ids)


def test_near_groups_of_nothing(spark):
    assert neardup.near_groups(H.frame(spark, [])).count() == 0
    assert [r["component_id"] for r in neardup.near_groups(H.frame(spark, [(3, None, None, None, None)])).collect()] == [3]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500), (None, 3), (700, 701), (701, 700)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {700: 700, 701: 700}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    passages = [[f"p{k} " * rng.randrange(3, 9) + str(j) for j in range(6)] for k in range(5)]
    rows = [(r[0], r[1], *r[2:]) for r in H.odd_rows() if r[0] is not None and r[0] != 10]
    for n in range(30):
        text = [f"own {n} {j}" for j in range(4)] + rng.choice(passages) + [""] + rng.choice(passages)[:4] + [f"end {n}"]
        rows.append((50 + n, "\n".join(text), "en", "s", 1))
    df = H.clashing(H.frame(spark, rows))
    texts = {(r[0]): r[1] for r in rows}
    want = every_repeat(rows, 20)
    got = {(r["doc_id"], r["at"]) for r in linededup.repeated_lines(df, 20).collect()}
    assert want and got == want
    out = linededup.dedupe_lines(df, 20)
    assert out.columns == df.columns and out.count() == df.count()
    for r in out.collect():
        t = texts[r["doc_id"]]
        assert r["text"] == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (r["doc_id"], i) not in want))


def test_line_dedup_of_repeated_rows_and_nothing(spark):
    text = "x " * 60
    out = linededup.dedupe_lines(H.frame(spark, [(1, text, None, None, 0), (1, text, None, None, 0), (2, text, None, None, 0), (None, None, None, None, 0)])).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out if r["text"] is not None) == [(1, text), (1, text), (2, "")]
    assert linededup.dedupe_lines(H.frame(spark, [])).count() == 0


def every_repeat(rows, least):
    """Lines of all runs of ``least`` words or more that occur earlier, by trying each pair of places."""
    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None})
    lines = {d: [(i, x.strip(" \t\v\f\r"), len(H.words(x))) for i, x in enumerate(d[1].split("\n")) if H.words(x)] for d in docs}
    places, gone = [(d, i) for d in docs for i in range(len(lines[d]))], set()
    for n, (d, i) in enumerate(places):
        for s, k in places[:n]:
            run = 0
            while i + run < len(lines[d]) and k + run < len(lines[s]) and lines[d][i + run][1] == lines[s][k + run][1]:
                run += 1
            if sum(x[2] for x in lines[d][i : i + run]) >= least:
                gone |= {(d[0], x[0]) for x in lines[d][i : i + run]}
    return gone


def test_line_dedup_considers_every_earlier_source(spark):
    rng, passage = random.Random(9), "l " * 60
    rows = [(1, passage, "en", "s", 1), (2, f"{passage}\ns of ten words\nmore", "en", "s", 1), (3, f"{passage}\ns of ten words\nother", "en", "s", 1)]
    stock = [f"{w} " * n for w, n in zip("abcdefg", (9, 1, 4, 12, 2, 6, 3), strict=True)]
    for n in range(40):
        rows.append((10 + n, "\n".join(rng.choices(stock[:4] if n % 2 else stock, k=rng.randrange(3, 14))), "en", "s", 1))
    got = {(r["doc_id"], r["at"]) for r in linededup.repeated_lines(H.frame(spark, rows), 20).collect()}
    assert (3, 1) in got and got == every_repeat(rows, 20)


def test_line_dedup_is_linear_in_equal_lines(spark):
    import time

    rows = [(1, "\n".join(["five words on a line"] * 20_000), None, None, 0), (2, "own words\n" + "\n".join(["five words on a line"] * 500), None, None, 0)]
    began = time.time()
    got = linededup.repeated_lines(H.frame(spark, rows)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {1: 19_999, 2: 500}
    assert time.time() - began < 60


def around_threshold(n, size=100, seed=3):
    """Copies of one text with so many words replaced that some are just linked with it and some just not; the new
    words come from a small stock, so that copies that aren't linked share some of them."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(size)]
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randrange(1, size // 6)):
            copy[rng.randrange(size)] = f"r{rng.randrange(300)}"
        yield (i, " ".join(copy), "en", "s", 1)


def test_a_group_around_the_threshold_equals_brute_force(spark, monkeypatch):
    rows = list(around_threshold(500))
    want = brute_groups(rows)
    assert 20 < sum(i != c for i, c in want.items()) < 480
    pairs = []
    test = neardup.Links.test
    monkeypatch.setattr(neardup.Links, "test", lambda self, p: pairs.append(p.count()) or test(self, p))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_groups(H.frame(spark, rows)).collect()}
    assert got == want
    assert sum(pairs) < 500 * 40  # of 124,750 pairs
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)  # ids joined by a shuffle
    some = rows[:60]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_groups(H.frame(spark, some)).collect()}
    assert got == brute_groups(some)


def test_families_within_a_group_become_one_component(spark):
    rng, rows = random.Random(4), []
    base = [f"b{i}" for i in range(120)]
    for family in range(3):  # families share most of one text but are not linked with each other
        own = list(base)
        for i in range(family, 120, 9):
            own[i] = f"f{family}x{i}"
        for _ in range(60):
            copy = list(own)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(120)] = f"r{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(copy), "en", "s", 1))
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_groups(H.frame(spark, rows)).collect()}
    assert got == brute_groups(rows) and len(set(got.values())) == 3


def with_one_passage(families, each=4, seed=6):
    """Families of near copies, some just linked and some just not, that have one long passage in common: all collide in
    some table key, and none is near another family."""
    rng, rows = random.Random(seed), []
    passage = [f"p{i}" for i in range(70)]
    for family in range(families):
        own = [f"f{family}x{i}" for i in range(50)]
        for _ in range(each):
            copy, rest = list(own), passage[: rng.randrange(56, 71)]
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(50)] = f"r{rng.randrange(400)}"
            rows.append((len(rows), " ".join(rest + copy), "en", "s", 1))
    rng.shuffle(rows)
    return rows


def test_what_members_far_from_a_hub_lack_of_it_makes_no_rows(spark, monkeypatch):
    rows, made, met = with_one_passage(60), [], []
    postings, pairs = neardup.postings, neardup.Links.test

    def counted(found, how):
        store = spark._jsparkSession.sharedState().statusStore()
        before, out = store.executionsCount(), postings(found, how)
        for i in range(before, store.executionsCount()):
            x = store.executionsList().apply(i)
            values, nodes = store.executionMetrics(x.executionId()), store.planGraph(x.executionId()).allNodes()
            for node in (nodes.apply(k) for k in range(nodes.size())):
                if "Join" in node.name() and "element" in node.desc():
                    found_ids = [m.accumulatorId() for m in (node.metrics().apply(k) for k in range(node.metrics().size())) if m.name() == "number of output rows"]
                    made.extend(int(values.apply(k).replace(",", "")) for k in found_ids if values.contains(k))
        met.append(found.selectExpr("sum(n)").head()[0])
        return out

    monkeypatch.setattr(neardup, "postings", counted)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_groups(H.frame(spark, rows)).collect()}
    want = brute_groups(rows)
    assert got == want and 60 <= len(set(want.values())) < 240
    assert made and sum(made) < 0.3 * sum(met)


def test_planted_pairs_just_above_the_threshold_are_found(spark):
    rng, rows, n = random.Random(8), [], 0
    while n < 400:
        base = [f"p{n}w{i}" for i in range(rng.randrange(60, 200))]
        copy = list(base)
        for _ in range(len(base) // 20):
            copy[rng.randrange(len(base))] = f"n{n}x{rng.randrange(10_000)}"
        a, b = set(zip(base, base[1:], strict=False)), set(zip(copy, copy[1:], strict=False))
        if 0.80 <= len(a & b) / len(a | b) <= 0.85:
            rows += [(n, " ".join(base), "en", "s", 1), (n + 1, " ".join(copy), "en", "s", 1)]
            n += 2
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_groups(H.frame(spark, rows)).collect()}
    assert all(got[i] == got[i + 1] == i for i in range(0, n, 2))


def test_of_equal_rows_one_stays(spark):
    rows = [(1, "one two three four five six", "en", "a", 1)] * 3 + [(1, "other text of the same id but long enough", "en", "a", 1), (2, None, None, None, None), (2, None, None, None, None), (None, "no id", None, None, 1), (None, "no id", None, None, 1)]
    left = neardup.drop_near(H.clashing(H.frame(spark, rows)), neardup.Near(shingle=2)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == sorted([(1, rows[0][1]), (1, rows[3][1]), (2, ""), (2, ""), (0, "no id"), (0, "no id")])
