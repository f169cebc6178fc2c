"""Chat formatting by quotation linking. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, lower_ascii, ordered_prefix

_MARKS = r"^[ \t]*((?:>[ \t]?)*)"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(lower_ascii(text), r"[\x20\x09-\x0D]+", " "))


def _join(lines: str, keep) -> Column:
    return F.array_join(F.transform(F.filter(lines, keep), lambda x: x["s"]), "\n")


def parse(messages: DataFrame) -> DataFrame:
    """Adds ``lines``: array of (q, s), quote level and line without marks, ``body``: the level-0 text,
    and ``passages``: array of (q, s), runs of quoted lines of one level."""
    line = lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), "[^>]", "")).alias("q"),
        F.regexp_replace(x, _MARKS, "").alias("s"),
    )
    return messages.withColumn("lines", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line)).withColumn(
        "body", F.trim(_join("lines", lambda x: x["q"] == 0), F.lit(" \t\r\n"))
    )


def _units(parsed: DataFrame) -> DataFrame:
    """(msg columns, own, h, n): single lines and whole runs of one level as hashes of their normal
    form, own: not quoted, n: words."""
    row = ["conv_id", "turn", "uid"]
    lines = parsed.select(*row, F.posexplode("lines").alias("i", "x")).select(*row, "i", "x.q", "x.s")
    order = Window.partitionBy(*row).orderBy("i")
    runs = (
        lines.withColumn("new", (F.col("q") != F.lag("q", 1, -1).over(order)).cast("int"))
        .withColumn("run", F.sum("new").over(order))
        .groupBy(*row, "q", "run")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), " ").alias("s"))
        .select(*row, "q", "s")
    )
    # normal form: words separated by a blank
    u = lines.select(*row, "q", "s").unionByName(runs).withColumn("s", _normal(F.col("s"))).filter("s <> ''")
    return u.select(*row, "q", F.xxhash64("s", F.length("s")).alias("h"), (F.length(F.regexp_replace("s", "[^ ]", "")) + 1).cast("long").alias("n")).distinct()


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, uid, reply_to, linked): for messages that quote earlier ones of their
    conversation, the turn quoted most.

    Passages (runs of lines of one level, and each line) are hashed in a normal form (A-Z lowered, blanks
    squeezed). One at level q meets the latest earlier message that holds that hash at level q - 1, or,
    where none does, the latest that holds it unquoted. The turn with most words quoted at level 1 is
    replied to, of equals the one with most at deeper levels, then the later one. One window over (conversation, hash,
    level), for hashes that are quoted at all, finds the latest earlier message, so repeated texts don't multiply.
    """
    units = cut(_units(messages), "units")
    quotes = units.filter("q > 0").withColumn("at", F.explode(F.array_distinct(F.array(F.col("q") - 1, F.lit(0)))))
    wanted = quotes.select("conv_id", "h", "at").distinct()
    none = F.lit(None).cast("long")
    own = units.withColumn("at", F.col("q")).join(wanted, ["conv_id", "h", "at"], "left_semi").select("conv_id", "h", "at", "turn", F.col("turn").alias("origin"), none.alias("uid"), F.lit(0).alias("q"), F.lit(0).cast("long").alias("n"))
    asked = quotes.select("conv_id", "h", "at", "turn", none.alias("origin"), "uid", "q", "n")
    earlier = Window.partitionBy("conv_id", "h", "at").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = own.unionByName(asked).withColumn("to", F.max("origin").over(earlier)).filter("uid is not null and to is not null")
    met = found.groupBy("conv_id", "turn", "uid", "h", "q", "n").agg(F.max(F.struct("at", "to"))["to"].alias("to"))
    votes = met.groupBy("conv_id", "turn", "uid", "to").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("q") == 1, F.col("n")).otherwise(0)).alias("n1"))
    best = votes.groupBy("conv_id", "turn", "uid").agg(F.max(F.struct("n1", "n", "to"))["to"].alias("reply_to"), F.sum("n").alias("linked"))
    return best


def chat(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, position, reply_to, n_quoted, n_linked, content, chat) of each message.

    ``reply_to`` is the turn that a message quotes most (:func:`link`), null where it quotes none of its conversation;
    such a message follows the one before it. ``position`` (from 0) is the order of replies: a message, then those that follow
    it, then its other replies by turn, each with its own. ``content`` is the text without quoted lines.
    ``chat`` is the turn ready to be joined in order of position (:func:`assembled`). A quote of a part of a line
    has no hash in common with the line and links nothing.

    The order is computed on runs: messages that follow the one before form a run, and a run that
    answers message p of another comes after all that follows p there. Runs are a tree, and their order is that of
    a walk around it, ranked by pointer doubling (:func:`_walk`): rounds grow with the logarithm of a conversation's runs, and
    rows have a fixed size. Ranks are counted by ranges, so a conversation of any length is no single task's. Texts
    move once, at the end.

    Null texts are empty. Rows without conv_id or turn make no links and come first, in a
    conversation of their own. Equal (conv_id, turn) rows stay rows of their own, ordered by role and text. An empty table
    gives no rows.
    """
    base = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
        F.monotonically_increasing_id().alias("uid"),
    )
    parsed = cut(parse(base), "parsed")
    usable = parsed.filter("conv_id is not null and turn is not null")
    quoting = usable.filter(F.exists("lines", lambda x: x["q"] > 0))
    m = parsed.select("conv_id", "turn", "role", "uid", F.xxhash64("text").alias("th"))
    order = [F.col("turn"), F.col("role"), F.col("th"), F.col("uid")]
    numbered = cut(ordered_prefix(m, ["conv_id"], order, {}, "no").select("conv_id", "turn", "uid", "no"), "numbered")
    if quoting.head(1):
        # only conversations in which something is quoted take part in linking
        links = cut(link(usable.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")), "links")
        places = _places(numbered, links)
    else:
        places = numbered.select("uid", F.col("no").alias("position"), F.lit(None).cast("long").alias("reply_to"), F.lit(0).cast("long").alias("n_linked"))
    n_quoted = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + (x["q"] > 0).cast("long"))
    return parsed.withColumn("n_quoted", n_quoted).join(places, "uid").select(
        "conv_id", "turn", "role", "position", "reply_to", "n_quoted", "n_linked", F.col("body").alias("content"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("body"), F.lit("\n")).alias("chat"),
    )


def _places(numbered: DataFrame, links: DataFrame) -> DataFrame:
    """(uid, position, reply_to, n_linked) of each message."""
    n, k = numbered.alias("n"), links.alias("k")
    joined = n.join(k, F.col("n.uid") == F.col("k.uid"), "left").select("n.*", "k.reply_to", F.coalesce("k.linked", F.lit(0)).cast("long").alias("n_linked"))
    # the first row of the turn that is replied to
    firsts = numbered.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("no").alias("first_no"))
    j, f = joined.alias("j"), firsts.alias("f")
    on = (F.col("j.conv_id") == F.col("f.conv_id")) & (F.col("j.reply_to") == F.col("f.turn"))
    parents = cut(j.join(f, on, "left").select("j.*", F.col("f.first_no").alias("p")), "parents")
    # a run starts at the first message and at each reply to another than the message before
    branch = F.col("p").isNotNull() & (F.col("p") != F.col("no") - 1)
    branching = parents.filter(branch).select("conv_id").distinct()
    inside = parents.join(branching, "conv_id", "left_semi").withColumn("s", ((F.col("no") == 0) | branch).cast("long"))
    straight = parents.join(branching, "conv_id", "left_anti").select("uid", F.col("no").alias("position"), "reply_to", "n_linked")
    if not branching.head(1):
        return straight
    counted = ordered_prefix(inside, ["conv_id"], [F.col("no")], {"prior": "s"}, "_r")
    index = cut(counted.withColumn("i", F.col("prior") + F.col("s")), "index")
    runs = index.groupBy("conv_id", "i").agg(F.min("no").alias("run"), F.count(F.lit(1)).alias("size"), F.min_by("p", "no").alias("p"))
    r, w = runs.alias("r"), index.alias("w")
    up = r.join(w, (F.col("r.conv_id") == F.col("w.conv_id")) & (F.col("r.p") == F.col("w.no")) & (F.col("r.i") > 1), "left")
    tree = cut(up.select("r.conv_id", "r.i", "r.run", "r.size", "r.p", F.col("w.i").alias("up")), "tree")
    before = _walk(tree)
    x, b = index.alias("x"), before.alias("b")
    inner = x.join(b, (F.col("x.conv_id") == F.col("b.conv_id")) & (F.col("x.i") == F.col("b.i")))
    return straight.unionByName(inner.select("x.uid", (F.col("b.before") + F.col("x.no") - F.col("b.run")).alias("position"), "x.reply_to", "x.n_linked"))


def _walk(tree: DataFrame) -> DataFrame:
    """(conv_id, i, run, before): messages that come before each run of ``tree`` (conv_id, i, run, size, p, up) in the walk that
    enters a run, then its children by (-p, run), and leaves it.

    Each run has two stops, 2 i when it is entered, which counts its messages, and 2 i + 1 when it is left. Every stop knows the
    next one; in each round it adds what that one has summed up and takes over its next."""
    children = Window.partitionBy("conv_id", "up").orderBy(F.desc("p"), "run")
    sibling = F.when(F.col("up").isNotNull(), F.lead("i").over(children))
    first = tree.filter("up is not null").groupBy("conv_id", "up").agg(F.min_by("i", F.struct(-F.col("p"), F.col("run"))).alias("child"))
    t, c = tree.withColumn("sibling", sibling).alias("t"), first.alias("c")
    both = t.join(c, (F.col("t.conv_id") == F.col("c.conv_id")) & (F.col("t.i") == F.col("c.up")), "left")
    enter = both.select("t.conv_id", (2 * F.col("t.i")).alias("stop"), F.coalesce(2 * F.col("c.child"), 2 * F.col("t.i") + 1).alias("next"), F.col("t.size").alias("total"))
    leave = both.select("t.conv_id", (2 * F.col("t.i") + 1).alias("stop"), F.coalesce(2 * F.col("t.sibling"), 2 * F.col("t.up") + 1).alias("next"), F.lit(0).cast("long").alias("total"))
    stops = cut(enter.unionByName(leave), "stops")
    while stops.filter("next is not null").head(1):
        a, b = stops.alias("a"), stops.alias("b")
        ahead = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.next") == F.col("b.stop")), "left")
        after = cut(ahead.select("a.conv_id", "a.stop", F.col("b.next").alias("next"), (F.col("a.total") + F.coalesce("b.total", F.lit(0))).alias("total")), "stops")
        drop(stops)
        stops = after
    # a stop's total counts from it to the end; the first run's is the whole conversation
    whole = stops.filter("stop = 2").select("conv_id", F.col("total").alias("whole"))
    at = stops.filter("stop % 2 = 0").join(whole, "conv_id").select("conv_id", (F.col("stop") / 2).cast("long").alias("i"), (F.col("whole") - F.col("total")).alias("before"))
    return at.join(tree.select("conv_id", "i", "run"), ["conv_id", "i"])


def assembled(messages: DataFrame, turns: int = 256) -> DataFrame:
    """(conv_id, part, n_turns, chat): conversations of :func:`chat`'s rows, without quotes and in order of replies, as texts of
    ``turns`` messages each, so that a conversation of any length is no single row."""
    part = F.floor(F.col("position") / turns).alias("part")
    said = F.array_sort(F.collect_list(F.struct("position", "chat")))
    return messages.groupBy("conv_id", part).agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(said, lambda x: x["chat"]), "").alias("chat"))


def op9_chat(spark, sf_dir: str) -> DataFrame:
    """:func:`chat` over all of ``conversations``."""
    return chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
