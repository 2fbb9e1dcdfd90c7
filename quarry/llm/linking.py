"""Links within buckets and connected groups, with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WIDE_BITMAP, cut, free, maybe_in

#: Pivots of a bucket in each round after the first, on average.
PIVOTS = (8, 100)
#: Keys of an id that stand beside each of its rows when all pairs meet.
BESIDE = 16
#: Rows of a bucket up to which all of it meets at its key.
HOT = 512
#: So many edges or fewer are one partition, which no step then deals out; more are dealt like any table.
ONE_PARTITION = 1 << 16


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each node of edges (a, b): the smallest id in its connected group.

    Alternates large-star and small-star steps until nothing changes: a number
    of rounds that grows with the logarithm of the longest path, each moving
    the edges a few times. Loops and repeated edges do no harm; ids aren't null.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now["n"] == 0:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before, old = now, edges
        few = now["n"] <= ONE_PARTITION
        gathered = lambda df: df.coalesce(1) if few else df
        joining = lambda side: side.hint("merge") if few else side  # noqa: E731  # else it goes through the driver as a broadcast
        both = gathered(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.filter("v > u").join(joining(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(joining(least), "u")
        edges = cut(gathered(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))).filter("u > v").distinct())
        free(old)


def between(group: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the groups ``ga`` and ``gb`` of the two; ids that ``group`` lacks are groups of their own."""
    a, b = (group.select(F.col("id").alias(x), F.col("component").alias(f"g{x}")) for x in ("a", "b"))
    return pairs.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("ga", "a").alias("ga"), F.coalesce("gb", "b").alias("gb"))


def merged(group: DataFrame, links: DataFrame) -> DataFrame:
    """``group`` (id, component) after the links (a, b) have joined groups; ids that it lacks are groups of their own."""
    joined = components(between(group, links).select(F.col("ga").alias("a"), F.col("gb").alias("b"))).withColumnsRenamed({"id": "root", "component": "final"})
    every = group.unionByName(joined.select(F.col("root").alias("id"), F.col("root").alias("component")).join(group, "id", "left_anti").select("id", "component"))
    return cut(every.join(joined, F.col("component") == F.col("root"), "left").select("id", F.coalesce("final", "component").alias("component")))


def meetings(rows: DataFrame, near: Callable[[str, str], F.Column], parts: F.Column | None = None, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of ids in different groups that share a bucket of ``rows`` (key, id, component, ...) and pass ``near``.

    A pair that shares several keys is made at the smallest one only, as far as
    the ``BESIDE`` smallest keys of both tell; no pair is lost, a few come again.
    Of two ids that meet, one is never of its bucket's largest group: so a
    bucket's rows meet its few others, not each other.
    ``parts`` is an array for each row, of which rows that are ``near`` have an
    item in common. In buckets of more than ``hot`` rows only rows that share
    one meet; what the other buckets make is at most ``hot`` times their rows.
    """
    groups = rows.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("groups"), F.sum("n").alias("size"))
    main = groups.filter("groups > 1").select("key", F.col("most.component").alias("main"), "size")
    few = rows.groupBy("id").agg(F.expr(f"slice(array_sort(collect_list(key)), 1, {BESIDE})").alias("keys"))
    rows = rows.join(few, "id").join(main, "key")
    once = F.expr("coalesce(key <= array_min(array_intersect(x_keys, y_keys)), true)")

    def met(rows, by):
        x, y = (rows.select(*by, *[F.col(c).alias(f"{p}_{c}") for c in rows.columns if c not in by]) for p in ("x", "y"))
        y = y.filter("y_component != y_main").drop("y_main")
        pairs = x.join(y, by).filter(F.expr("x_component < y_component or x_component = x_main") & near("x", "y") & once)
        return pairs.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))

    if parts is None:
        return met(rows.drop("size"), ["key"])
    divided = rows.filter(F.col("size") > hot).drop("size").withColumn("part", F.explode(parts))
    return met(rows.filter(F.col("size") <= hot).drop("size"), ["key"]).unionByName(met(divided, ["key", "part"]))


def bucket_groups(rows: DataFrame, verify: Callable[[DataFrame], DataFrame], describe: Callable[[DataFrame], DataFrame], near: Callable[[str, str], F.Column], parts: F.Column | None = None) -> DataFrame:
    """(id, component) of the connected groups that links within the buckets (key, id) of ``rows`` make.

    ``describe`` gets the ids (id) that share a bucket and gives columns beside
    them; ``near(x, y)`` is a necessary condition over these under two
    prefixes, cheap and free of false negatives; ``parts``, if there is any, is
    what ``meetings`` divides hot buckets by. ``verify`` keeps those of
    distinct pairs (a, b) that are links. Ids without a link may be missing
    from the result; repeated rows do no harm.

    Not every pair of a bucket is tried. In the first round all ids of a bucket
    meet the smallest one (each the smallest that it may be linked to), in the
    next ones a few ids that a hash picks, and at last all others; only ids
    that still lie in different groups meet. So a bucket of n copies costs n
    pairs, a large group whose members are linked to a tenth of each other is
    one before all its pairs have been tried, and yet no two groups that a link
    of some bucket joins stay apart.

    Pivots are plain aggregates and rows meet them in joins, which a hot
    bucket's rows can be split for.
    """
    empty = rows.sparkSession.createDataFrame([], "a long, b long")
    # Most keys have one row, so the first pass deals out keys alone; of keys with several rows, those of one id go in the second.
    repeated = cut(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    found = cut(maybe_in(rows, repeated, "key", size=WIDE_BITMAP).join(repeated, "key").distinct())
    several = found.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("key")
    shared = cut(found.join(several, "key"))
    free(repeated, found)
    info = describe(shared.select("id").distinct())
    described = [c for c in info.columns if c != "id"]
    side = lambda x: F.struct("id", *described).alias(x)
    spread = lambda x: [F.col(f"{x}.{c}").alias(f"{x}_{c}") for c in described]
    open_ = cut(shared.join(info, "id").withColumn("component", F.col("id")))
    free(shared)
    group, tried, done = cut(empty.select(F.col("a").alias("id"), F.col("b").alias("component"))), empty, []
    grouped = lambda: open_.select("key", "id", *described).join(group, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = lambda rows: rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).filter("low < high").drop("low", "high")

    def meet(marked, pivots):
        """Pairs of ids and the pivots (key, p) of their buckets in other groups that may be links."""
        met = marked.join(pivots, "key").filter("component != p.component").select(side("x"), "p", "size")
        return met.select(F.least("x.id", "p.id").alias("a"), F.greatest("x.id", "p.id").alias("b"), F.col("x.id").alias("who"), "size", *spread("x"), *spread("p")).filter(near("x", "p"))

    def add(pairs):
        """Try pairs and join the groups of those that are links."""
        nonlocal group, tried
        links = cut(verify(pairs))
        tried = tried.unionByName(pairs)
        done.append(pairs)
        if not links.isEmpty():
            old, group = group, merged(group, links)
            free(old)
        free(links)

    def close(most):
        """Leave out buckets that are one group by now, or so small that all their pairs have been tried; the others get their groups and sizes."""
        nonlocal open_
        old, open_ = open_, cut(grouped().join(sizes(grouped()).filter(F.col("size") > most), "key"))
        free(old)

    # The smallest id of each bucket; of what an id may be linked to, one is tried.
    lowest = open_.groupBy("key").agg(F.min(side("p")).alias("p"), F.count("*").alias("size"))
    first = cut(meet(open_, lowest.select("key", F.struct("p.*", F.col("p.id").alias("component")).alias("p"), "size")).groupBy("a", "b", "who").agg(F.min("size").alias("size")))
    add(cut(first.groupBy("who").agg(F.min(F.struct("a", "b")).alias("s")).select("s.a", "s.b").distinct()))
    close(2)
    for turn, most in enumerate(PIVOTS):
        pivots = open_.filter(F.pmod(F.xxhash64(F.lit(turn), "id"), F.col("size")) < most).select("key", F.struct("id", "component", *described).alias("p"))
        add(cut(meet(open_, pivots).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")))
        close(most)
    pairs = meetings(open_.drop("size"), near, parts)
    waiting = between(group, first.filter("size = 2").select("a", "b")).filter("ga != gb").select("a", "b")
    pairs = pairs.unionByName(waiting).distinct()
    pairs = cut(pairs.join(tried, ["a", "b"], "left_anti"))
    free(open_, first, *done)
    if pairs.isEmpty():
        return group
    links, old = cut(verify(pairs)), group
    group = merged(group, links)
    free(links, old, pairs)
    return group
