"""Mixing sources to target weights by entropy balancing. DataFrame operations only."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, fresh, n_words, ordered_prefix

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
#: Rows, one a source, that may be ordered by one task.
FEW_SOURCES = 100_000
#: Rows of 16 bytes that may be broadcast.
BROADCAST_ROWS = 1_000_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources ascend by code point, null last, and weigh ``weights`` in turn. They share ``share`` of
    all sizes; a target stops at ``cap`` times its source's size, and what is above is shared again
    by weight until none is above. That fixed point is a water level L with sum(min(cap_s, w_s L))
    = share: sources in order of cap_s / w_s are full as long as that ratio is at most the level
    which the rest would reach. Works on one row a source, after a partial aggregation.
    """
    per = cut(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    capped = _in_order(per, [F.col("source").isNull(), F.col("source")], {}, "_i").select(
        "source", "source_size", weight.alias("_w"), (F.col("source_size") * F.lit(float(cap))).alias("_cap")
    ).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    total = capped.agg((F.sum("source_size") * F.lit(share)).alias("_goal"), F.sum("_w").alias("_all_w"))
    levels = _in_order(
        capped, [F.col("_ratio"), F.col("source").isNull(), F.col("source")], {"_caps": "_cap", "_ws": "_w"}, "_j"
    ).crossJoin(F.broadcast(total))  # one row
    level = (F.col("_goal") - F.col("_caps")) / (F.col("_all_w") - F.col("_ws"))
    levels = levels.withColumn("_level", level).withColumn("_full", F.col("_ratio") <= F.col("_level"))
    # the level of the first source that is not full holds for all that are not
    water = levels.filter(~F.col("_full")).agg(F.min_by("_level", "_j").alias("_water"))
    return levels.crossJoin(F.broadcast(water)).select(
        "source",
        "source_size",
        F.when(F.col("_full"), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * F.col("_water"))).alias("target"),
    )


def _in_order(per: DataFrame, order: list, values: dict[str, str], rank: str) -> DataFrame:
    """:func:`ordered_prefix` over a row a source; few sources are one task's window."""
    if per.count() > FEW_SOURCES:
        return ordered_prefix(per, [], order, values, rank)
    whole = Window.partitionBy(F.lit(0)).orderBy(*order)
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    return per.select(
        "*",
        (F.row_number().over(whole) - 1).cast("long").alias(rank),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(new) for new, c in values.items()],
    )


def tilts(sizes: DataFrame, targets: DataFrame, cap: int = CAP, steps: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """(source, tilt, mean): the dual's solution for each source.

    Rates r minimise sum(r log r - r) subject to sum(size r) = target and r <= cap; so r is
    min(cap, exp(tilt * size / mean)), and the dual in ``tilt`` is convex with one unknown a source,
    its gradient the words taken less the target. Newton steps (on the log odds of the words taken
    against all that the cap allows, which is near linear in the tilt) run for all sources at once;
    a step that leaves the bracket of the root is replaced by its midpoint. Each iteration
    aggregates the (source, size) histogram, which is all that gradient and curvature need.
    """
    spark = sizes.sparkSession
    hist = cut(
        sizes.filter(F.col("size") > 0).groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes"
    )
    means = hist.groupBy("source").agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least")
    )
    top = F.log(F.lit(float(cap)))
    none = F.lit(None).cast("double")
    t, m = targets.alias("t"), means.alias("m")
    state = t.join(m, F.col("t.source").eqNullSafe(F.col("m.source"))).select(
        F.col("t.source").alias("source"),
        F.col("t.target").alias("target"),
        (F.col("t.source_size") * F.lit(float(cap))).alias("most"),
        F.col("m.mean").alias("mean"),
        # from this tilt on every document is at the cap
        (top * F.col("m.mean") / F.col("m.least")).alias("ceiling"),
        F.lit(0.0).alias("tilt"), none.alias("low"), none.alias("high"), F.lit(False).alias("done"),
    )
    state = cut(
        state.withColumn("done", F.col("target") >= F.col("most") * (1 - 1e-12))
        .withColumn("tilt", F.when(F.col("done"), F.col("ceiling")).otherwise(F.col("tilt"))),
        "tilt",
    )
    for _ in range(steps):
        s, h = state.alias("s"), hist.alias("h")
        raw = F.col("s.tilt") * F.col("h.size") / F.col("s.mean")
        rate = F.exp(F.least(raw, top))
        mass = F.col("h.size") * F.col("h.n") * rate
        sums = (
            h.join(s.filter(~F.col("done")), F.col("h.source").eqNullSafe(F.col("s.source")))
            .groupBy(F.col("h.source").alias("source"))
            .agg(
                F.sum(mass).alias("taken"),
                F.sum(F.when(raw < top, mass * F.col("h.size") / F.col("s.mean")).otherwise(0.0)).alias("slope"),
            )
            .alias("g")
        )
        joined = s.join(sums, F.col("s.source").eqNullSafe(F.col("g.source")), "left")
        taken, slope, target, most, tilt = (F.col(c) for c in ("g.taken", "g.slope", "s.target", "s.most", "s.tilt"))
        low = F.when(taken < target, tilt).otherwise(F.col("s.low"))
        high = F.when(taken < target, F.col("s.high")).otherwise(tilt)
        odds = F.log(taken / (most - taken)) - F.log(target / (most - target))
        newton = tilt - odds * taken * (most - taken) / (slope * most)
        inside = newton.isNotNull() & ~F.isnan(newton) & (F.coalesce(newton > low, F.lit(True))) & (
            F.coalesce(newton < high, F.lit(True))
        )
        middle = (
            F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2)
            .when(low.isNotNull(), F.least(F.col("s.ceiling"), F.greatest(low * 2, low + 1)))
            .otherwise(F.least(high * 2, high - 1))
        )
        near = F.abs(taken - target) <= target * tolerance
        done = F.col("s.done") | F.coalesce(near, F.lit(True))
        after = cut(
            joined.select(
                F.col("s.source").alias("source"), "target", "most", "mean", "ceiling",
                F.when(done, tilt).when(inside, newton).otherwise(middle).alias("tilt"),
                F.when(done, F.col("s.low")).otherwise(low).alias("low"),
                F.when(done, F.col("s.high")).otherwise(high).alias("high"),
                done.alias("done"),
            ),
            "tilt",
        )
        drop(state)
        state = after
        if not state.filter(~F.col("done")).head(1):
            break
    else:  # the bracket is halved in each step, so this means that rates can't be told apart any more
        warnings.warn(f"rates of some sources are not within {tolerance} of their targets after {steps} steps", stacklevel=2)
    return state.select("source", "tilt", "mean")


def entropy_mix(
    documents: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, repairs: int = 6
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of ``documents``.

    Rates are rounded along each source's documents in order of size (then doc_id): a document
    gets as many copies as whole numbers lie between the running sums of rates before and after it,
    so at most ``cap``, and errors of neighbours cancel. What still misses the target is repaired
    one document at a time, for all sources at once: the largest that does not overshoot is
    taken once more or once less.

    Null text: size 0, no copies. Null source: a source of its own, after the others. Repeated rows
    and doc_ids are documents of their own. An empty table gives no rows. Extra columns don't matter.
    """
    sized = cut(
        documents.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sized"
    )
    targets = cut(source_targets(sized, weights, share, cap), "targets")
    tilt = tilts(sized, targets, cap)
    d, t, x = sized.alias("d"), targets.alias("t"), tilt.alias("x")
    exponent = F.least(F.col("x.tilt") * F.col("d.size") / F.col("x.mean"), F.log(F.lit(float(cap))))
    rated = (
        d.join(t, F.col("d.source").eqNullSafe(F.col("t.source")))
        .join(x, F.col("d.source").eqNullSafe(F.col("x.source")), "left")
        .select(
            "d.doc_id", "d.source", "d.size", "t.source_size", "t.target",
            # rates in billionths add up the same in any order
            F.when(F.col("d.size") == 0, F.lit(0)).otherwise(F.round(F.coalesce(F.exp(exponent), F.lit(0.0)) * 1e9)).cast("long").alias("rate"),
        )
    )
    run = ordered_prefix(rated, ["source"], [F.col("size").desc(), F.col("doc_id")], {"_before": "rate"}, "_rank")
    whole = lambda c: F.floor((c + F.lit(500_000_000)) / F.lit(1_000_000_000))
    copies = whole(F.col("_before") + F.col("rate")) - whole(F.col("_before"))
    mixed = cut(
        run.select("doc_id", "source", "size", "source_size", "target", "_rank", F.least(copies, F.lit(cap)).cast("long").alias("copies")),
        "mixed",
    )
    moves = None
    for _ in range(repairs):
        gap = mixed if moves is None else _moved(mixed, moves)
        short = gap.groupBy("source").agg(
            (F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("gap")
        )
        g, s = gap.alias("g"), short.alias("s")
        up = F.col("s.gap") > 0
        fits = (F.col("g.size") > 0) & (F.col("g.size") < 2 * F.abs(F.col("s.gap"))) & F.when(
            up, F.col("g.copies") < cap
        ).otherwise(F.col("g.copies") > 0)
        best = (
            g.join(s, F.col("g.source").eqNullSafe(F.col("s.source")))
            .filter(fits)
            .groupBy(F.col("g.source").alias("source"))
            # the nearest to the gap, then the first in the source's order
            .agg(F.min_by(F.struct("g._rank", F.when(up, 1).otherwise(-1).alias("by")), F.struct(F.abs(F.col("g.size") - F.abs(F.col("s.gap"))), F.col("g._rank"))).alias("m"))
            .select("source", "m._rank", "m.by")
        )
        found = cut(best, "moves")
        if not found.head(1):
            break
        moves = found if moves is None else moves.unionByName(found)
    out = mixed if moves is None else _moved(mixed, moves)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies")


def _moved(mixed: DataFrame, moves: DataFrame) -> DataFrame:
    """Copies after the moves: at most ``repairs`` rows a source."""
    net = moves.groupBy("source", "_rank").agg(F.sum("by").alias("by")).alias("v")
    m = mixed.alias("m")
    return m.join(
        net, F.col("m.source").eqNullSafe(F.col("v.source")) & (F.col("m._rank") == F.col("v._rank")), "left"
    ).select("m.doc_id", "m.source", "m.size", "m.source_size", "m.target", "m._rank", (F.col("m.copies") + F.coalesce(F.col("v.by"), F.lit(0))).alias("copies"))


def mix_documents(documents: DataFrame, **how) -> DataFrame:
    """The mixed corpus: rows of ``documents``, each as often as the mix takes it, with their columns.

    Rows are known by doc_id; where doc_ids repeat or are null, rows get numbers of their own.
    The table of copies is broadcast up to BROADCAST_ROWS rows, else joined by a shuffle."""
    row, times, one = fresh(documents, "row_no", "copies", "copy")
    unsure = documents.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if unsure.head(1):
        keyed = cut(documents.withColumn(row, F.monotonically_increasing_id()), "keyed")
        chosen = entropy_mix(keyed.select(F.col(row).alias("doc_id"), "source", "text"), **how)
    else:
        keyed = documents.withColumn(row, F.col("doc_id"))
        chosen = entropy_mix(documents, **how)
    chosen = cut(chosen.filter(F.col("copies") > 0).select(F.col("doc_id").alias(row), F.col("copies").alias(times)), "copies")
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    return (
        keyed.join(chosen, row)
        .withColumn(one, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
        .select(*[F.col(f"`{c}`") for c in documents.columns])
    )


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of :func:`entropy_mix` over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return entropy_mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies"
    )
