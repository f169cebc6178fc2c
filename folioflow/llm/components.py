"""Connected components of an edge table by repeated contraction. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b: long); component: the least node reached.

    Each round points every node at the neighbour (or itself) that comes first by a hash, replaces
    nodes by what they point at, and drops what has become a loop. Random priorities contract
    chains by a factor a round and stars in two or three. Every round is written to the shared
    folder; nothing is gathered. Null ends and loops link nothing; an empty table gives no rows.
    """
    both = edges.filter("a is not null and b is not null and a <> b")
    live = cut(both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    maps: list[DataFrame] = []
    while live.head(1):
        first = live.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("id"))
        points = cut(first.select(F.col("a").alias("from"), F.least(F.col("m"), own)["id"].alias("to")), "points")
        maps.append(points)
        e, p, q = live.alias("e"), points.alias("p"), points.alias("q")
        after = cut(
            e.join(p, F.col("e.a") == F.col("p.from"))
            .join(q, F.col("e.b") == F.col("q.from"))
            .select(F.col("p.to").alias("a"), F.col("q.to").alias("b"))
            .filter("a <> b")
            .distinct(),
            "edges",
        )
        drop(live)
        live = after
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # a node's place is where the rounds' maps lead, one after another
    labels = maps[0].select(F.col("from").alias("node"), F.col("to").alias("at"))
    for points in maps[1:]:
        l, p = labels.alias("l"), points.alias("p")
        labels = l.join(p, F.col("l.at") == F.col("p.from"), "left").select("l.node", F.coalesce("p.to", "l.at").alias("at"))
    labels = cut(labels, "labels")
    drop(*maps)
    least = labels.groupBy("at").agg(F.min("node").alias("component"))
    return labels.join(least, "at").select("node", "component")


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` (node, component) after new ``links`` (a, b) between nodes, which may be new as well.
    Only components that a link joins are contracted."""
    g, h, x = groups.alias("g"), groups.alias("h"), links.alias("x")
    up = (
        x.join(g, F.col("x.a") == F.col("g.node"), "left")
        .join(h, F.col("x.b") == F.col("h.node"), "left")
        .select("x.a", "x.b", F.coalesce("g.component", "x.a").alias("ca"), F.coalesce("h.component", "x.b").alias("cb"))
    )
    up = cut(up, "links")
    joined = cut(components(up.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "joined").alias("j")
    ends = up.select(F.col("a").alias("node"), F.col("ca").alias("component")).unionByName(up.select(F.col("b").alias("node"), F.col("cb").alias("component")))
    every = groups.unionByName(ends).distinct().alias("e")
    return every.join(joined, F.col("e.component") == F.col("j.node"), "left").select("e.node", F.coalesce("j.component", "e.component").alias("component"))
