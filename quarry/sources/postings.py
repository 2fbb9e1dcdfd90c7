"""A stored positional index of one text property.

Three tables in a folder: ``postings`` (slot, term, key, places, length), a row
for each word of a document, in folders by a hash of the word, and one more of
each document in the folder ``DOCUMENTS``; ``terms`` (term, df, ctf, maxtf);
and ``totals``, one row. A query reads the folders of its words only,
collection statistics come from ``terms`` without a look at the texts, and a
word of very many documents is spread over files as the texts are.

A document's words are grouped within its row, and each task writes what it
read: no posting is dealt out, and texts are split once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.bind import once
from quarry.functions.terms import Posted
from quarry.operators import querylang, ranking

SLOTS = 64
LARGEST_SCORE = 65535
#: The slot of the rows that documents have beside those of their words.
DOCUMENTS = -1
#: Bits of a place in an array.
PLACE_BITS = 31


def slot_of(term: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(slots)).cast("int")


def grouped(words: Column, name: Callable[[Column], Column] = F.xxhash64) -> Column:
    """(term, places, length) of each distinct word of an array, with the array's length.

    Places are sorted behind a part of their words' hashes (``name``), which is
    much cheaper than sorting words; a row in which different words have one is
    sorted by the words.
    """
    known = lambda found: F.filter(found, lambda i: i.isNotNull())

    def runs(w: Column, places: Column, starts: Column) -> Column:
        """Of places that are sorted by their words; ``starts`` tells where another word begins."""
        own = lambda a, k: F.slice(places, a + 1, F.coalesce(F.get(starts, k + 1), F.size(w)) - a)
        return F.transform(starts, lambda a, k: F.struct(F.get(w, F.get(places, a)).alias("term"), own(a, k).alias("places"), F.size(w).alias("length")))

    def by_word(w: Column) -> Column:
        starts = lambda s: F.transform(s, lambda x, i: F.when((i == 0) | ~x["t"].eqNullSafe(F.get(s, i - 1)["t"]), i))
        sorted_ = F.sort_array(F.transform(w, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
        return once(sorted_, lambda s: once(F.transform(s, lambda x: x["i"]), lambda places: once(known(starts(s)), lambda found: runs(w, places, found))))

    def by_hash(w: Column) -> Column:
        def start(s: Column, places: Column, x: Column, i: Column) -> Column:
            other = (i == 0) | (F.shiftright(x, PLACE_BITS) != F.shiftright(F.get(s, i - 1), PLACE_BITS))
            return F.when(other, i).when(~F.get(w, F.get(places, i)).eqNullSafe(F.get(w, F.get(places, i - 1))), -1)

        sorted_ = F.sort_array(F.transform(w, lambda t, i: F.shiftleft(name(t), PLACE_BITS).bitwiseOR(i.cast("long"))))
        starts = lambda s, places: known(F.transform(s, lambda x, i: start(s, places, x, i)))
        by_places = lambda s, places: once(starts(s, places), lambda found: F.when(F.array_contains(found, -1), by_word(w)).otherwise(runs(w, places, found)))
        return once(sorted_, lambda s: once(F.transform(s, lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")), lambda places: by_places(s, places)))

    return once(words, by_hash)


def posted(df: DataFrame, key: str, tokens: Column, slots: int = SLOTS) -> DataFrame:
    """(key, term, places, length, slot): a row for each word of a row of ``df``, and one for the row itself."""
    document = lambda w: F.struct(F.lit(None).cast("string").alias("term"), F.lit(None).cast("array<int>").alias("places"), F.size(w).alias("length"))
    each = once(tokens, lambda w: F.concat(F.array(document(w)), grouped(w)))
    # No row is without its document; a plain explode would group the words twice, once to see whether there are any.
    rows = df.select(F.col(key).alias("key"), F.inline_outer(each))
    return rows.withColumn("slot", F.when(F.col("places").isNull(), DOCUMENTS).otherwise(slot_of(F.col("term"), slots)))


def build(df: DataFrame, key: str, tokens: Column, path: str, slots: int = SLOTS) -> PostingsIndex:
    """Write the index of ``tokens`` (an array of words, none for null) of each row; ``key`` is a row's own."""
    rows = posted(df, key, tokens, slots)
    rows.write.partitionBy("slot").parquet(f"{path}/postings")
    spark = df.sparkSession
    stored = spark.read.schema(rows.schema).parquet(f"{path}/postings")
    size = F.size("places")
    stored.filter(F.col("slot") != DOCUMENTS).groupBy("term").agg(F.count("*").alias("df"), F.sum(size).cast("long").alias("ctf"), F.max(size).cast("long").alias("maxtf")).write.parquet(f"{path}/terms")
    stored.filter(F.col("slot") == DOCUMENTS).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total"), F.lit(slots).alias("slots")).write.parquet(f"{path}/totals")
    return PostingsIndex(spark, path)


class PostingsIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._tables = spark, path, {}
        totals = spark.read.parquet(f"{path}/totals").first()
        self.n, self.total, self.slots = totals["n"], totals["total"], totals["slots"]

    def stored(self, name: str) -> DataFrame:
        """A folder of the index; its files are listed once, as the index doesn't change."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.path}/{name}")
        return self._tables[name]

    def table(self, name: str) -> DataFrame:
        """``postings``, ``terms``, or ``documents`` (key, length)."""
        if name == "documents":
            return self.stored("postings").filter(F.col("slot") == DOCUMENTS).select("key", "length")
        return self.stored(name).filter(F.col("slot") != DOCUMENTS) if name == "postings" else self.stored(name)

    def postings(self, words: list[str]) -> DataFrame:
        """Postings of some words; only their folders are read."""
        words = list(dict.fromkeys(words))
        if not words:
            return self.table("postings").filter("false")
        slots = [slot_of(F.lit(w), self.slots) for w in words]  # constants by the time folders are chosen
        return self.table("postings").filter(F.col("slot").isin(*slots) & F.col("term").isin(words))

    def stats(self, words: list[str]) -> ranking.Stats:
        """Collection statistics of a query's words: a row for each reaches the driver."""
        rows = {r["term"]: r for r in self.table("terms").filter(F.col("term").isin(list(words))).collect()}
        pick = lambda c: {w: rows[w][c] if w in rows else 0 for w in words}
        return ranking.Stats(self.n, self.total, pick("df"), pick("ctf"), pick("maxtf"))

    def documents(self, words: list[str], patterns: list[str] = (), every: bool = False) -> tuple[DataFrame, Posted]:
        """Documents with one of the words or patterns (``every``: all there are), and how to read their words."""
        words, patterns = list(dict.fromkeys(words)), list(dict.fromkeys(patterns))
        found = self.postings(words)
        if patterns:
            fits = self.table("terms").select("term", *[F.col("term").rlike(p).alias(f"like{k}") for k, p in enumerate(patterns)])
            some = F.array_contains(F.array(*[f"like{k}" for k in range(len(patterns))]), True)
            found = found.select("key", "length", "term", "places", *[F.lit(False).alias(f"like{k}") for k in range(len(patterns))]).unionByName(self.table("postings").join(fits.filter(some), "term").select("key", "length", "term", "places", *[f"like{k}" for k in range(len(patterns))]))
        wanted = [F.max(F.when(F.col("term") == w, F.col("places"))).alias(f"places{k}") for k, w in enumerate(words)]
        rows = found.groupBy("key").agg(F.max("length").alias("length"), *wanted, *[F.max(f"like{k}").alias(f"like{k}") for k in range(len(patterns))])
        if every:
            rows = self.table("documents").join(rows.drop("length"), "key", "left")
        return rows, Posted(F.col("length"), {w: F.col(f"places{k}") for k, w in enumerate(words)}, {p: F.col(f"like{k}") for k, p in enumerate(patterns)})

    def match(self, node: querylang.Node, strict: bool = False, threshold: float = 0.5, score: str | None = None) -> DataFrame:
        """(key) of documents that match a query tree, and ``score`` by a ranking model if one is named."""
        terms = node.terms()
        stats = self.stats(terms) if score or "wand" in node.kinds() else None
        rows, words = self.documents(node.words(), [querylang.like(p) for p in node.patterns()], not node.anchored())
        bounds = {w: ranking.bm25_bound(stats, w) for w in terms} if stats else None
        hits = rows.filter(querylang.matches(node, words, bounds, threshold, strict))
        return hits.select("key", *([ranking.model(score)(words, terms, stats).alias("score")] if score else []))

    def scored(self, words: list[str]) -> DataFrame:
        """(term, doc, score): postings of some words with occurrences as 16-bit scores."""
        return self.postings(words).select("term", F.col("key").alias("doc"), F.least(F.size("places"), F.lit(LARGEST_SCORE)).cast("long").alias("score"))
