"""Near-duplicates by MinHash with tensored banding, confirmed on full shingle sets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import Batch, blocks, mix, windows
from .common import cut, drop, fresh, ordered_prefix, small_batches
from .components import components, merged

#: Rows of ids that are sent to all executors at most (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Members whose sets are compared with one copy of their hub's.
HUB_PART = 500
#: Words of 64 bits in the bitmap that stands for a member's differences with its hub.
BITMAP = 8


@dataclass(frozen=True)
class Near:
    """``shingle`` words a shingle; linked where 100 * common >= percent * union.

    Tensored banding: one collection has ``left`` = (hashes a key, keys), another ``right``; a table
    key pairs one of each, so left[1] * right[1] tables of left[0] + right[0] hashes cost only
    left[0] * left[1] + right[0] * right[1] MinHash values. At a similarity of 0.8 a pair is missed
    by all tables with a probability of (1 - .64)**10 + (1 - .512)**14 = 8e-5, at 0.85 below 4e-6.
    """

    shingle: int = 2
    percent: int = 80
    left: tuple[int, int] = (2, 10)
    right: tuple[int, int] = (3, 14)


def shingles(texts: pa.Array, n: int):
    """For each text its sorted distinct shingle hashes; fewer words than ``n``: all of them as one."""
    b = Batch(texts, lower=True)
    words = b.hashes()
    h, at = windows(words, b.first, n)
    bounds = np.searchsorted(at, b.first)
    counts = b.counts()
    for i in range(len(counts)):
        if counts[i] >= n:
            yield np.unique(h[bounds[i] : bounds[i + 1]])
        elif counts[i]:
            one = np.uint64(counts[i])
            for w in words[b.first[i] : b.first[i + 1]]:
                one = mix(np.array([one], np.uint64) + w)[0]
            yield np.array([one], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def set_hashes(u: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    x = mix(u)
    return int(x.sum(dtype=np.uint64).view(np.int64)), int(mix(x ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).view(np.int64))


def sketches(documents: DataFrame, how: Near) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, left, right): set size, set hash in two halves, keys of both collections."""
    rng = np.random.Generator(np.random.PCG64(7))
    hashes = how.left[0] * how.left[1] + how.right[0] * how.right[1]
    a = rng.integers(1, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    c = rng.integers(0, 2**63, hashes, dtype=np.uint64)

    def keys(mins: np.ndarray, size: tuple[int, int], salt: int) -> np.ndarray:
        out = np.arange(salt, salt + size[1], dtype=np.uint64)
        for column in mins.reshape(size[1], size[0]).T:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
        return out.view(np.int64)

    def run(batches):
        for whole in batches:
            for batch in blocks(whole, "text"):
                n, s1, s2, left, right = [], [], [], [], []
                for u in shingles(batch.column("text"), how.shingle):
                    n.append(len(u))
                    for half, value in zip((s1, s2), set_hashes(u), strict=True):
                        half.append(value)
                    if not len(u):
                        left.append([])
                        right.append([])
                        continue
                    mins = np.full(hashes, 2**64 - 1, np.uint64)
                    for i in range(0, len(u), 4096):
                        mins = np.minimum(mins, (u[i : i + 4096, None] * a + c).min(axis=0))
                    cutat = how.left[0] * how.left[1]
                    left.append(keys(mins[:cutat], how.left, 1))
                    right.append(keys(mins[cutat:], how.right, 1000))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(left, longs), pa.array(right, longs)],
                    ["doc_id", "n_shingles", "s1", "s2", "left", "right"],
                )

    schema = "doc_id long, n_shingles long, s1 long, s2 long, left array<long>, right array<long>"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def class_sets(documents: DataFrame, wanted: DataFrame, how: Near, several: bool) -> DataFrame:
    """(rep, set): packed shingle hashes, ascending, of the classes ``wanted`` (rep, first, s1, s2), each from
    one of its documents, ``first``. ``several``: a doc_id may have rows with other texts."""

    def run(batches):
        for whole in batches:
            for batch in blocks(whole, "text"):
                sets = list(shingles(batch.column("text"), how.shingle))
                hashes = np.array([set_hashes(u) for u in sets], np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(hashes[0]), pa.array(hashes[1]), pa.array([u.tobytes() for u in sets], pa.binary())], ["id", "s1", "s2", "set"]
                )

    ids = wanted.select(F.col("first").alias("id")).distinct()
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids, "id", "left_semi")
    with small_batches(documents.sparkSession):
        found = texts.mapInArrow(run, "id long, s1 long, s2 long, set binary")
        if not several:  # a class is named by its first document
            return cut(found.select(F.col("id").alias("rep"), "set"), "packs")
        f, w = found.alias("f"), wanted.alias("w")
        on = (F.col("f.id") == F.col("w.first")) & (F.col("f.s1") == F.col("w.s1")) & (F.col("f.s2") == F.col("w.s2"))
        return cut(f.join(w, on).select("w.rep", "f.set").dropDuplicates(["rep"]), "packs")


def _against_hubs(sets: DataFrame, pairs: DataFrame, run, schema: str, tag: str) -> DataFrame:
    """Rows that ``run`` makes of (hub, member, hub's set, member's set), for ``pairs`` (a, b): member and hub.

    A hub's set moves once for HUB_PART members and leads them, so that no pair carries two sets and no hub, however
    many members it has, is one task's."""

    def each(batches):
        at, v = None, None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("hub", "part", "member", "set")]
            for hub, part, member, packed in zip(*columns, strict=True):
                u = np.frombuffer(packed, np.uint64)
                if member is None:
                    at, v = (hub, part), u
                else:
                    if at != (hub, part):
                        raise ValueError("a hub's set must lead its members")
                    out.append((hub, member, v, u))
            if out:
                yield run(out)

    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HUB_PART).alias("parts"))
    dealt = pairs.join(parts, "b").select(F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), "parts").alias("part"), F.col("a").alias("member"))
    d, s = dealt.alias("d"), sets.alias("s")
    members = d.join(s, F.col("d.member") == F.col("s.rep")).select("d.hub", "d.part", "d.member", "s.set")
    h = dealt.select("hub", "part").distinct().alias("h")
    hubs = h.join(s, F.col("h.hub") == F.col("s.rep")).select("h.hub", "h.part", F.lit(None).cast("long").alias("member"), "s.set")
    beside = members.unionByName(hubs).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("member").asc_nulls_first())
    with small_batches(sets.sparkSession):
        return cut(beside.mapInArrow(each, schema), tag)


def _linked(u: np.ndarray, v: np.ndarray, percent: int) -> tuple[int, bool]:
    common = len(np.intersect1d(u, v, assume_unique=True))
    return common, 100 * common >= percent * (len(u) + len(v) - common)


def confirm(sets: DataFrame, pairs: DataFrame, how: Near) -> DataFrame:
    """(a, b, linked) of each pair of classes, from their whole sets."""

    def run(rows):
        hubs, members, _, _ = zip(*rows, strict=True)
        linked = [_linked(u, v, how.percent)[1] for _, _, v, u in rows]
        return pa.RecordBatch.from_arrays([pa.array(members, pa.int64()), pa.array(hubs, pa.int64()), pa.array(linked)], ["a", "b", "linked"])

    return _against_hubs(sets, pairs, run, "a long, b long, linked boolean", "tested")


def differences(sets: DataFrame, spokes: DataFrame, how: Near) -> DataFrame:
    """For each member and hub: linked, n differences, how many are missing from the member, sizes, a bitmap of
    the differences and their hashes."""
    names = ["hub", "member", "linked", "n", "missing", "size", "hub_size", *(f"b{i}" for i in range(BITMAP)), "elements"]

    def run(rows):
        out = [[] for _ in names]
        for hub, member, v, u in rows:
            extra, missing = np.setdiff1d(u, v, assume_unique=True), np.setdiff1d(v, u, assume_unique=True)
            elements = np.concatenate([mix(extra), mix(missing ^ np.uint64(0x1234567))])
            bits = np.zeros(BITMAP, np.uint64)
            place = elements % np.uint64(64 * BITMAP)
            np.bitwise_or.at(bits, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
            row = (hub, member, _linked(u, v, how.percent)[1], len(elements), len(missing), len(u), len(v), *bits.view(np.int64).tolist(), elements.view(np.int64))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = [pa.bool_() if c == "linked" else pa.list_(pa.int64()) if c == "elements" else pa.int64() for c in names]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    schema = ", ".join(f"{c} {'boolean' if c == 'linked' else 'array<long>' if c == 'elements' else 'long'}" for c in names)
    return _against_hubs(sets, spokes, run, schema, "differences")


#: What is known of a member beside its hub.
_MEMBER = ["member", "component", "linked", "n", "missing", "size", "hub_size", *(f"b{i}" for i in range(BITMAP))]


def _far(x: str, percent: int) -> Column:
    """Shingles outside the hub that a member shares with anything it is linked with: over 0 if it has too few in the hub."""
    return F.ceil(percent * F.col(f"{x}size") / 100) - F.col(f"{x}hub_size") + F.col(f"{x}missing")


def postings(found: DataFrame, how: Near) -> DataFrame:
    """(hub, element, rank, extra_rank, member and what is known of it): the differences by which members of one hub, in
    different components, may meet.

    With A_x = hub less x and E_x = x less hub, two members share |hub| - |A_x| - |A_y| + |A_x & A_y| +
    |E_x & E_y| shingles, so a link needs so many common differences (:func:`_need`). Members that are both linked
    with the hub are in one component; what remains are pairs with an unlinked member. ``rank`` counts a member's differences,
    those first that no member of another component has, then the rarest in the hub's group: the first common difference of a
    pair leaves need - 1 others behind it in both, which bounds its rank in both.

    A member that has little of the hub (:func:`_far`) can't be linked by that alone: it meets others by E only, counted by
    ``extra_rank``, so what it lacks of the hub, as all such members do, makes no rows."""
    p, whole = how.percent, 100 + how.percent
    extras, far = F.col("n") - F.col("missing"), _far("", p)
    met = F.when(far > 0, F.slice("elements", F.lit(1), extras.cast("int"))).otherwise(F.col("elements"))  # extras lead
    e = found.select("hub", *_MEMBER, F.posexplode(met).alias("pos", "element")).withColumn("extra", F.col("pos") < extras).drop("pos")
    often = e.groupBy("hub", "element").agg(F.count(F.lit(1)).alias("often"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    useful = e.join(often.filter("c0 <> c1").drop("c0", "c1"), ["hub", "element"])
    own = Window.partitionBy("hub", "member")
    upto = own.orderBy("often", "element").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.col("n") - F.count(F.lit(1)).over(own) + F.count(F.lit(1)).over(upto)
    is_extra = F.when(F.col("extra"), F.lit(1))
    extra_rank = F.when(F.col("extra"), extras - F.count(is_extra).over(own) + F.count(is_extra).over(upto))
    weight = 100 * F.col("missing") + p * extras
    # with an unlinked partner more than weight / whole are common; the least that an unlinked one may share with any
    near_sent = (far <= 0) & (F.col("rank") <= F.col("n") - F.floor(weight / whole))
    near_asked = (far <= 0) & ~F.col("linked") & (F.col("rank") <= F.col("n") - F.greatest(F.lit(1), F.ceil((weight - (100 - p) * F.col("hub_size")) / whole)) + 1)
    by_extra = F.col("extra") & (F.col("extra_rank") <= extras - F.greatest(F.lit(1), far) + 1)
    rows = useful.select("*", rank.alias("rank"), extra_rank.alias("extra_rank")).drop("often")
    rows = rows.withColumn("sent", near_sent | by_extra).withColumn("asked", near_asked | (by_extra & (far > 0)))
    return cut(rows.filter("sent or asked"), "postings")


def _may_meet(x: str, y: str, percent: int) -> Column:
    """Whether the element at which x and y meet can be the first that they share. Without a far one, x or y is unlinked and all
    differences count; else y is far and extras count, of which they share what their parts of the hub leave open."""
    of = lambda m, c: F.col(f"{m}.{c}")
    far = {m: _far(f"{m}.", percent) > 0 for m in (x, y)}
    least = of(x, "member") < of(y, "member")
    need = _need(x, y, percent)
    near = ~far[x] & ~far[y] & ~of(y, "linked") & (of(x, "linked") | least)
    for m in (x, y):
        near = near & (of(m, "rank") <= of(m, "n") - need + 1)
    extras = need - F.least(of(x, "missing"), of(y, "missing"))
    away = far[y] & (~far[x] | least) & of(x, "extra") & of(y, "extra")
    for m in (x, y):
        away = away & (of(m, "extra_rank") <= of(m, "n") - of(m, "missing") - extras + 1)
    return near | away


def _need(x: str, y: str, percent: int) -> Column:
    """Differences that two members have to share for a link."""
    shared = F.ceil(percent * (F.col(f"{x}.size") + F.col(f"{y}.size")) / (100 + percent))
    return shared - F.col(f"{x}.hub_size") + F.col(f"{x}.missing") + F.col(f"{y}.missing")


def _plausible(x: str, y: str, percent: int) -> Column:
    """Whether two members of one hub can share as many differences as a link needs: each bit in which their
    bitmaps differ is a difference that they don't share."""
    apart = sum((F.bit_count(F.col(f"{x}.b{i}").bitwiseXOR(F.col(f"{y}.b{i}"))) for i in range(BITMAP)), F.lit(0))
    return F.col(f"{x}.n") + F.col(f"{y}.n") - apart >= 2 * _need(x, y, percent)


def _placed(rows: DataFrame, node: str, groups: DataFrame) -> DataFrame:
    """``rows`` with the component of ``node``."""
    r, g = rows.alias("r"), groups.alias("g")
    return r.join(g, F.col(f"r.{node}") == F.col("g.node"), "left").select("r.*", F.coalesce("g.component", f"r.{node}").alias("component"))


def _pairs(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


class Links:
    """What is known of the links between classes: pairs that were tested, and the components so far."""

    def __init__(self, sets: DataFrame, how: Near):
        self.sets, self.how, self.tested, self.groups = sets, how, None, None

    def add(self, tested: DataFrame) -> bool:
        """Take up tested pairs; whether one of them is a link."""
        self.tested = tested if self.tested is None else self.tested.unionByName(tested)
        links = tested.filter("linked").select("a", "b")
        if self.groups is None:
            self.groups = cut(components(links), "groups")
            return True
        if not links.head(1):
            return False
        self.groups = cut(merged(self.groups, links), "groups")
        return True

    def test(self, pairs: DataFrame) -> bool:
        """Test those of ``pairs`` (a, b) that are not tested yet; whether there was a link."""
        if self.tested is not None:
            known = self.tested.select(*_pairs("a", "b"))
            pairs = cut(pairs.select(*_pairs("a", "b")).distinct().join(known, ["a", "b"], "left_anti"), "pairs")
            if not pairs.head(1):
                return False
        return self.add(confirm(self.sets, pairs, self.how))

    def degrees(self) -> DataFrame:
        ends = self.tested.filter("linked").select(F.explode(F.array("a", "b")).alias("node"))
        return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def _open(keys: DataFrame, links: Links) -> DataFrame:
    """(key, rep, component): members of keys that hold several components."""
    placed = _placed(keys.select("key", "rep"), "rep", links.groups)
    mixed = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1")
    return cut(placed.join(mixed.select("key"), "key"), "open")


def _around_hubs(keys: DataFrame, links: Links) -> None:
    """Find every link between members of one key that are still in different components.

    The hub of a component is its most linked node; that of a key is the most linked one of its members' components,
    so that the keys of one group have one hub. All members are compared with it; which others may be linked follows
    from their differences with the hub (:func:`postings`). First, members that have a difference in common meet
    one or two of them, so that a family within the group becomes one component without being compared pair by pair; what
    then is plausible between components is tested pair by pair."""
    how = links.how
    g, e = links.groups.alias("g"), links.degrees().alias("e")
    nodes = g.join(e, F.col("g.node") == F.col("e.node")).select("g.component", "g.node", "e.degree")
    best = nodes.groupBy("component").agg(F.max(F.struct("degree", (-F.col("node")).alias("hub"))).alias("best")).select("component", "best.*")
    k, t = keys.select("key", "rep", "component").alias("k"), best.alias("t")
    ranked = k.join(t, "component", "left").select("k.key", "k.rep", F.coalesce("t.degree", F.lit(0)).alias("degree"), F.coalesce("t.hub", -F.col("k.rep")).alias("hub"))
    hubs = ranked.groupBy("key").agg((-F.max(F.struct("degree", "hub"))["hub"]).alias("hub"))
    spokes = cut(keys.select("key", "rep").join(hubs, "key").select(F.col("rep").alias("a"), F.col("hub").alias("b")).filter("a <> b").distinct(), "spokes")
    found = differences(links.sets, spokes, how)
    links.add(found.select(F.col("member").alias("a"), F.col("hub").alias("b"), "linked"))
    meet = postings(_placed(found, "member", links.groups), how)
    pairs = None
    for i in range(2):
        first = meet.groupBy("hub", "element").agg(F.min(F.struct(F.xxhash64(F.lit(i), "member").alias("h"), F.struct(*_MEMBER).alias("p"))).alias("m"))
        x, y = meet.alias("x"), first.select("hub", "element", "m.p.*").alias("y")
        on = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.element") == F.col("y.element")) & (F.col("x.component") != F.col("y.component"))
        both = x.join(y, on & _plausible("x", "y", how.percent)).select(F.col("x.member").alias("a"), F.col("y.member").alias("b"))
        pairs = both if pairs is None else pairs.unionByName(both)
    now = cut(_placed(meet.drop("component"), "member", links.groups), "postings") if links.test(pairs) else meet
    x, y = now.filter("sent").alias("x"), now.filter("asked").alias("y")
    on = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.element") == F.col("y.element")) & (F.col("x.component") != F.col("y.component"))
    on = on & _may_meet("x", "y", how.percent) & _plausible("x", "y", how.percent)
    links.test(x.join(y, on).select(F.col("x.member").alias("a"), F.col("y.member").alias("b")))
    drop(meet, now, found, spokes)


def near_groups(documents: DataFrame, how: Near = Near()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``documents``.

    1. Documents with equal sets become one class. The sets of classes that share a table key with another are
       written down once, packed; pairs are compared on these.
    2. Such classes are compared with the key's least member, a pair once. A group of a thousand near
       copies so yields some thousand pairs, not their square.
    3. Confirmed links make components. Where one key still holds members of several components, these meet around the
       most linked node of a component (:func:`_around_hubs`). So no link between components that share a key is
       lost, and no group is compared pair by pair.

    Null, empty and blank texts have an empty set and are linked with nothing. Rows with one doc_id
    count as one document. A row without doc_id keeps a null component_id. An empty table gives no rows.
    """
    with small_batches(documents.sparkSession):
        sketch = cut(sketches(documents, how), "sketch")
    several = bool(sketch.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").head(1))
    full = sketch.filter("n_shingles > 0 and doc_id is not null")
    same = ["s1", "s2", "n_shingles"]
    classes = full.groupBy(*same).agg(F.min("doc_id").alias("first"))
    # where a doc_id has several texts, classes are numbered, else named by their first document
    classes = cut(ordered_prefix(classes, [], [F.col(c) for c in same], {}, "rep") if several else classes.withColumn("rep", F.col("first")), "classes")
    sets = cut(full.select("doc_id", *same).join(classes, same).select("doc_id", "rep"), "sets")
    reps = full.join(classes, same).filter("doc_id = first").select("rep", "left", "right")
    if several:
        reps = reps.dropDuplicates(["rep"])
    keyed = (
        reps.select("rep", F.explode("left").alias("l"), "right")
        .select("rep", "l", F.explode("right").alias("r"))
        .select("rep", F.xxhash64("l", "r").alias("key"))
    )
    shared = keyed.groupBy("key").agg(F.min("rep").alias("center"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut(keyed.join(shared, "key"), "members")
    wanted = classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "first", "s1", "s2")
    packs = class_sets(documents, cut(wanted, "wanted"), how, several)
    links = Links(packs, how)
    links.test(members.filter("rep <> center").select(F.col("rep").alias("a"), F.col("center").alias("b")).distinct())
    keys = _open(members.filter("n > 2"), links)
    drop(members)
    if keys.head(1):
        _around_hubs(keys, links)
    drop(packs)
    of_class = _placed(sets, "rep", links.groups).select("doc_id", "component")
    if several:  # a component is named by its least doc_id, and a doc_id joins the components of its texts
        least = of_class.groupBy("component").agg(F.min("doc_id").alias("least"))
        named = cut(of_class.join(least, "component").select("doc_id", "least").distinct(), "named")
        own = components(named.select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
        of_class = _placed(named.select("doc_id").distinct(), "doc_id", own)
    d, c = sketch.select("doc_id", "n_shingles").alias("d"), of_class.alias("c")
    out = d.join(c, F.col("d.doc_id") == F.col("c.doc_id"), "left")
    return out.select("d.doc_id", "d.n_shingles", F.coalesce("c.component", "d.doc_id").alias("component_id"))


def drop_near(documents: DataFrame, how: Near = Near(shingle=5)) -> DataFrame:
    """The rows of ``documents`` that stay when of each group only the least doc_id does, with their columns.

    Rows without doc_id and null, empty or blank texts stay. Of rows that are equal in doc_id and text one stays.
    An empty table gives no rows; columns named like ours don't clash.
    """
    gone = near_groups(documents, how).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    left = documents.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    rows = documents.filter("doc_id is not null and text is not null")
    if not rows.groupBy("doc_id").count().filter("count > 1").head(1):
        return left
    again = fresh(left, "again")[0]
    alone = F.col("doc_id").isNull() | F.col("text").isNull()
    first = F.row_number().over(Window.partitionBy("doc_id", "text", F.when(alone, F.monotonically_increasing_id())).orderBy(F.xxhash64(*[c for c, k in left.dtypes if "map<" not in k])))
    return left.withColumn(again, first).filter(F.col(again) == 1).drop(again)


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all of ``documents``: two-word shingles, similarity 0.8."""
    out = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
