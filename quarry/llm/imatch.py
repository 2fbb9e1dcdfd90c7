"""I-Match fingerprints of documents, with DataFrame operations only.

Terms are words by their 64-bit hashes; document frequencies count every
document. The lexicon is the terms whose inverse document frequency lies in a
band: neither words of nearly every text nor rare ones, such as typos and ids.
As the upper edge is a share of the documents, the lexicon can't have more
terms than ``exp(IDF_HIGH)`` times a document's mean number of terms, whatever
the size of the corpus: so it is one value, a hash table in arrays.

A document's distinct lexicon terms are sorted and hashed as a whole and for
each of several randomised subsets of the lexicon: families of ``SUBSETS``
subsets each, of all of the lexicon or a random quarter, sixteenth, ... of it.
The finer subsets of small families still agree when two long documents share
only part of their terms.

The likeness of two fingerprints is the share of subsets with equal hashes
among those in which either document has a term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import cut, maybe_in, table

SUBSETS = 32
#: Shares of the lexicon in each family are 1, 1/4, 1/16, 1/64.
FAMILIES = 4
#: The band: natural logarithm of documents per document with the term; and the least number of these.
IDF_LOW, IDF_HIGH, LEAST_DF = 1.5, 8.0, 2
#: Buckets of the lexicon's hash table.
BUCKETS = 1 << 16
#: Of the table of ids: ranges with equal numbers of rows, in which parts have so many rows on average.
RANGES, PART_ROWS = 512, 256


def terms_of(text: str) -> str:
    """SQL for the distinct hashes of a text's words: runs of letters, digits and code points over 127, A-Z lower-cased."""
    lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"filter(split({lower}, '[^0-9a-z\\\\x{{80}}-\\\\x{{10FFFF}}]+'), w -> w <> '')"
    return f"array_distinct(transform({words}, w -> xxhash64(w)))"


def lexicon(docs: DataFrame, text_col: str = "text", low: float = IDF_LOW, high: float = IDF_HIGH, least: int = LEAST_DF) -> DataFrame:
    """One row: ``buckets``, BUCKETS arrays with the terms of the band, each in that of its last bits.

    Counts terms over all documents; what is exchanged is a row for each term
    and task. Null and empty texts count as documents without a term; without
    any document all buckets are empty.
    """
    found = docs.select(F.explode(F.expr(terms_of(f"coalesce({text_col}, '')"))).alias("term"))
    total = docs.agg(F.count("*").alias("total")).scalar()
    idf = F.log((total + F.lit(1)) / F.col("df"))
    kept = found.groupBy("term").agg(F.count("*").alias("df")).filter((F.col("df") >= least) & idf.between(low, high))
    slot = F.col("term").bitwiseAND(BUCKETS - 1)
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").alias("slot"), F.array().cast("array<bigint>").alias("terms"))
    full = kept.groupBy(slot.alias("slot")).agg(F.collect_list("term").alias("terms")).unionByName(every).groupBy("slot").agg(F.max_by("terms", F.size("terms")).alias("terms"))
    return cut(full.agg(F.array_sort(F.collect_list(F.struct("slot", "terms"))).alias("b")).select(F.expr("transform(b, x -> x.terms)").alias("buckets")))


def subset_entries() -> str:
    """SQL for the entries of an array ``terms`` of distinct hashes, one for each subset that has a term.

    A subset's entry has its number in the upper and its terms' hash in the
    lower 32 bits. Terms are dealt to subsets by a hash, sorted, and folded.
    """
    spread = "xxhash64(t, 7)"
    of_family = [f"transform(filter(terms, t -> {spread} & {4**k - 1} = 0), t -> shiftleft(cast({k * SUBSETS} + (shiftrightunsigned(xxhash64(t, {11 + k}), 20) & {SUBSETS - 1}) as bigint), 32) | (t & 4294967295L))" for k in range(FAMILIES)]
    keyed = f"array_sort(concat({', '.join(of_family)}))"
    return f"""aggregate({keyed},
        named_struct('at', -1L, 'h', 0L, 'out', cast(array() as array<bigint>)),
        (a, x) -> if(shiftright(x, 32) = a.at,
            named_struct('at', a.at, 'h', xxhash64(a.h, x), 'out', a.out),
            named_struct('at', shiftright(x, 32), 'h', xxhash64(x), 'out', if(a.at < 0, a.out, concat(a.out, array(shiftleft(a.at, 32) | (a.h & 4294967295L)))))),
        a -> if(a.at < 0, a.out, concat(a.out, array(shiftleft(a.at, 32) | (a.h & 4294967295L)))))"""


def fingerprints(texts: DataFrame, buckets: Column, text_col: str, out: str) -> DataFrame:
    """``texts`` with ``out``: array<bigint>, the whole document's hash first, then the subsets' entries.

    A document without a lexicon term is fingerprinted by all its terms. Null
    texts count as empty and have the hash of no terms alone; texts of any
    length are read whole; other columns stay, but one named ``out`` is
    replaced. Equal texts have equal fingerprints.
    """
    kept = f"filter(_all, t -> array_contains(_buckets[cast(t & {BUCKETS - 1} as int)], t))"
    with_terms = texts.withColumn("_all", F.expr(terms_of(f"coalesce({text_col}, '')"))).withColumn("_buckets", buckets).withColumn("_kept", F.expr(kept))
    with_terms = with_terms.withColumn("terms", F.array_sort(F.expr("if(size(_kept) = 0, _all, _kept)")))
    return with_terms.withColumn(out, F.expr(f"concat(array(xxhash64(terms)), {subset_entries()})")).drop("_all", "_buckets", "_kept", "terms")


def text_of(fingerprint: str) -> Column:
    """A fingerprint as hexadecimal text: the whole's hash, then subset:hash."""
    return F.expr(f"concat_ws(' ', transform({fingerprint}, (x, i) -> if(i = 0, lpad(lower(hex(x)), 16, '0'), concat(lower(hex(shiftrightunsigned(x, 32))), ':', lpad(lower(hex(x & 4294967295L)), 8, '0')))))")


def likeness(x: str, y: str) -> Column:
    """0 to 1; 1 for two documents without a term, null if either fingerprint is."""
    rest = lambda c: f"slice({c}, 2, {SUBSETS * FAMILIES})"
    numbers = lambda c: f"transform({rest(c)}, v -> cast(shiftrightunsigned(v, 32) as int))"
    both = f"size(array_union({numbers(x)}, {numbers(y)}))"
    return F.expr(f"if({x} is null or {y} is null, null, if({both} = 0, 1D, size(array_intersect({rest(x)}, {rest(y)})) / cast({both} as double)))")


def place_in(bounds: str, value: str, or_equal: bool, size: int = RANGES) -> str:
    """SQL for the number of ascending ``bounds`` under ``value`` (or equal to it), by binary search; ``size`` is a power of two over theirs."""
    steps = ", ".join(str(size >> k) for k in range(1, size.bit_length()))
    return f"aggregate(array({steps}), 0, (at, s) -> if(get({bounds}, at + s - 1) {'<=' if or_equal else '<'} {value}, at + s, at))"


def parted(rows: DataFrame, key: str, tie: str) -> DataFrame:
    """``rows`` with ``_range`` and ``_part``, whose order is that of (key, tie): a few hundred rows have a part in common.

    Ranges hold about equal numbers of rows, by percentiles of the keys; a key
    with so many rows that it is several percentiles has its rows dealt to as
    many ranges by ``tie``, a hash. In a range keys are dealt evenly.
    """
    value = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 62)))
    shares = ", ".join(f"{k / RANGES}D" for k in range(1, RANGES))
    known = cut(rows.agg(F.percentile_approx(value, F.expr(f"array({shares})"), 10_000).alias("bounds"), F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")))
    with_bounds = rows.withColumn("_key", value).withColumn("_bounds", known.select("bounds").scalar())
    under = F.expr(place_in("_bounds", "_key", False))
    with_place = with_bounds.withColumn("_under", under).withColumn("_upto", F.expr(place_in("_bounds", "_key", True)))
    with_range = with_place.withColumn("_range", F.expr(f"_under + cast(floor((_upto - _under) * (shiftrightunsigned({tie}, 33) / {float(1 << 31)!r}D)) as int)"))
    start = F.coalesce(F.expr("get(_bounds, _range - 1)"), known.select("low").scalar())
    end = F.coalesce(F.expr("get(_bounds, _range)"), known.select("high").scalar())
    parts = F.ceil(known.select("n").scalar() / F.lit(RANGES * PART_ROWS))
    return with_range.withColumn("_part", F.floor((F.col("_key") - start) / (end - start + F.lit(1.0)) * parts)).drop("_key", "_bounds", "_under", "_upto")


def with_next(rows: DataFrame, key: str, values: list[str], derive=lambda dealt: dealt) -> DataFrame:
    """``rows`` with ``next_<value>`` of the row with the next larger key; after the last comes the first.

    Rows are dealt once, by parts of the order of keys (see ``parted``); the
    first row of each part is also dealt to the end of the part before.
    ``derive`` may add columns to the dealt rows, of which ``values`` may name
    some. Rows with equal keys follow each other in the order of a hash of the
    other columns, a null key comes first, and a single row follows itself.
    """
    others = [c for c in rows.columns if c != key]
    placed = parted(rows.withColumn("_tie", F.xxhash64(*others)), key, "_tie")
    order = ["_key", "_tie"]
    known = placed.withColumn("_key", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 62))))
    heads = cut(known.groupBy("_range", "_part").agg(F.min(F.struct(*order)).alias("s")).select("_range", "_part", "s._key", "s._tie"))
    parts = heads.select("_range", "_part", F.lag("_part").over(W.partitionBy("_range").orderBy("_part")).alias("_before"))
    ends = heads.groupBy("_range").agg(F.max("_part").alias("_end"))  # a row for each range, a few hundred
    chain = F.broadcast(ends.select("_range", F.lag("_range").over(W.orderBy("_range")).alias("_r"), F.lag("_end").over(W.orderBy("_range")).alias("_e")))
    last = ends.agg(F.max(F.struct("_range", F.col("_end").alias("_part"))).alias("z")).scalar()
    into = parts.join(chain, "_range").select("_range", "_part", F.when(F.col("_before").isNotNull(), F.struct("_range", F.col("_before").alias("_part"))).otherwise(F.coalesce(F.when(F.col("_r").isNotNull(), F.struct(F.col("_r").alias("_range"), F.col("_e").alias("_part"))), last)).alias("to"))
    wanted = cut(heads.join(into, ["_range", "_part"]).select(*order, F.col("_range").alias("_r"), F.col("_part").alias("_p"), "to"))
    first = maybe_in(known, wanted, *order).join(wanted, order).filter("_range = _r and _part = _p").dropDuplicates(["_range", "_part"])
    first = first.select(*rows.columns, F.col("to._range").alias("_range"), F.col("to._part").alias("_part"), *order, F.lit(True).alias("_copy"))
    dealt = known.select(*rows.columns, "_range", "_part", *order, F.lit(False).alias("_copy")).unionByName(first)
    window = W.partitionBy("_range", "_part").orderBy("_copy", *order)
    made = derive(dealt.repartition("_range", "_part"))
    return made.select("*", *[F.lead(v).over(window).alias(f"next_{v}") for v in values]).filter("not _copy").drop("_range", "_part", *order, "_copy")


def edited_text(text: str, following: str) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of ``following``."""
    return F.expr(f"concat(substr({text}, 1, length({text}) - length({text}) div 2), substr({following}, 1, cast(length({text}) div 2 as int)))")


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    terms = lexicon(docs).scalar()
    pairs = with_next(docs, "doc_id", ["text", "f"], lambda dealt: fingerprints(dealt, terms, "text", "f"))
    both = fingerprints(pairs.withColumn("edited", edited_text("text", "next_text")).drop("next_text"), terms, "edited", "g")
    return both.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), text_of("f").alias("fingerprint"), text_of("g").alias("edited_fingerprint"), likeness("f", "g").alias("near_edited"), likeness("f", "next_f").alias("near_next"))
