"""Removing repeated lines, also fuzzy ones, with DataFrame operations only.

Lines are normalised (lower case, runs of letters and digits) and named by a
hash of their words. Each distinct line gets a SimHash of 8 blocks.
Its features are the line's shingles of two or four words. A feature votes on
all bits of one block, with a weight drawn from its hash so unevenly that the
heaviest feature of a block outvotes the others together: so a block is the
bits of that feature, and an edit changes blocks as a whole or not at all.
Lines join on equal blocks. (With equal weights each word that differs turns
some bits of every block; lines of the similarity differ in 13 of 63 bits, and
no choice of whole blocks that they share is left to join on.)

Pairs are filtered by length and by a parity sketch of their words, then
verified by the edit distance of their words: each word becomes one character,
so that the built-in Levenshtein distance counts words. Of each connected
group of lines the first occurrence, by document and line number, stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import WIDE_BITMAP, cut, free, maybe_in, table
from quarry.llm.linking import bucket_groups

SIMILARITY = 0.8
#: A block is named by the first BLOCK_BITS bits of its features' hashes; there are 8.
BLOCK_BITS = 3
#: Shorter lines have shingles of two words, longer ones of four; those between have both, so that all pairs have a kind in common.
SHORT, LONG = 24, 19
#: Words of the sketch that filters pairs, and characters that words become.
SKETCH, CHARACTERS = 4, 55000
#: Words of the longest lines that are divided by their sketches where very many share a block.
DIVIDED = 32


def words_of(line: str) -> str:
    """SQL for a normalised line: its words, lower-cased runs of letters and digits."""
    return rf"array_remove(split(lower({line}), '[^\\p{{L}}\\p{{N}}]+'), '')"


def raw_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, line, raw) of every line, numbered from 0."""
    return docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("line", "raw"))


def hashed(lines: DataFrame) -> DataFrame:
    """(doc, line, hs, id, n) of every line that isn't blank: hashes of its words, their hash and their number."""
    # A condition over the words would have the text split twice.
    words = lines.filter(r"lower(raw) rlike '[\\p{L}\\p{N}]'").select("doc", "line", F.expr(words_of("raw")).alias("words"))
    return words.select("doc", "line", F.expr("transform(words, w -> xxhash64(w))").alias("hs")).select("doc", "line", "hs", F.xxhash64("hs").alias("id"), F.size("hs").alias("n"))


def features(similarity: float = SIMILARITY) -> str:
    """SQL for the features of a line of ``n`` words with the hashes ``hs``: a block's are in a row when sorted, the heaviest first.

    A line so short that none can differ from it and be similar has none.
    """
    pairs = "slice(zip_with(hs, slice(hs, 2, n), (h, k) -> xxhash64(h, k)), 1, n - 1)"
    fours = "slice(transform(hs, (h, i) -> xxhash64(h, get(hs, i + 1), get(hs, i + 2), get(hs, i + 3))), 1, n - 3)"
    least = next(n for n in range(1, 1 << 20) if int(n / similarity * (1 - similarity + 1e-9)) >= 1) if similarity < 1 else 1 << 30
    return f"if(n < {max(least, 2)}, cast(array() as array<bigint>), if(n < {LONG}, {pairs}, if(n < {SHORT}, concat({pairs}, {fours}), {fours})))"


def parts(similarity: float = SIMILARITY, longest: int = DIVIDED) -> str:
    """SQL for an array for each line of ``n`` words with a sketch: lines that may be similar have an item in common.

    For each length that a similar line can have, the sketch's bits are dealt to
    one part more than the bits that may differ: so one part is equal at least
    (pigeonhole). Longer lines, for which these would be many, have one item.
    """
    most = f"cast(floor({1 - similarity + 1e-9!r}D * {{}}) as int)"
    lengths = f"filter(sequence(1, {longest}), m -> abs(n - m) <= {most.format('greatest(n, m)')})"
    counts = f"transform({lengths}, m -> struct(least(n, m) as lo, greatest(n, m) as hi, 2 * {most.format('greatest(n, m)')} - abs(n - m) + 1 as k))"
    bits = f"filter(sequence(0, {64 * SKETCH - 1}), i -> shiftright(element_at(array({', '.join(f's{k}' for k in range(SKETCH))}), 1 + shiftright(i, 6)), i & 63) & 1L = 1L)"
    each = f"transform(array({bits}), on -> flatten(transform({counts}, c -> transform(sequence(0, c.k - 1), b -> xxhash64(c.lo, c.hi, b, filter(on, i -> i % c.k = b))))))[0]"
    none = "cast(array() as array<bigint>)"
    # What may be similar to a line beyond the longest one meets it here.
    beyond = f"{longest + 1} - n <= {most.format(f'greatest(n, {longest + 1})')}"
    return f"concat(if(n <= {longest}, {each}, {none}), if({beyond} or n > {longest}, array(0L), {none}))"


def similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc, line): every line (from 0) that repeats an earlier line or is connected to one by edit similarities.

    Lines that are equal after normalising are always found; of similar ones
    those that share a block (see the README for the measured recall). Null
    texts have no lines, blank lines none that count; a null id sorts first.
    """
    apart = 1 - similarity + 1e-9
    sorted_ = hashed(raw_lines(docs, id_col, text_col)).select("doc", "line", "id", F.sort_array(F.expr(features(similarity))).alias("fs"))
    heaviest = f"filter(fs, (f, i) -> i = 0 or shiftrightunsigned(f ^ get(fs, i - 1), {64 - BLOCK_BITS}) <> 0)"
    each = cut(sorted_.select("doc", "line", "id", F.expr(heaviest).alias("keys")))
    info = cut(each.groupBy("id").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("copies")))
    rows = each.select(F.explode("keys").alias("key"), "id")
    coded: list[DataFrame] = []

    def describe(ids):
        """Length and sketch of lines that share a block; their words are kept for ``verify``."""
        wanted = cut(info.join(ids, "id").select("id", F.col("first.doc").alias("doc"), F.col("first.line").alias("line")))
        # Any line with the name has the words; the bitmap of places only keeps most others from being read.
        some = hashed(maybe_in(raw_lines(docs, id_col, text_col), wanted, "doc", "line", size=WIDE_BITMAP)).select("id", "n", "hs")
        found = some.join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"])
        bits = lambda k: f"aggregate(hs, 0L, (a, h) -> if(shiftright(h, 6) & {SKETCH - 1} = {k}, a ^ shiftleft(1L, cast(h & 63 as int)), a))"
        coded.append(wanted)
        coded.append(cut(found.select("id", "n", "hs", *[F.expr(bits(k)).alias(f"s{k}") for k in range(SKETCH)])))
        return coded[1].select("id", "n", *[f"s{k}" for k in range(SKETCH)])

    def near(x, y):
        n, m = F.col(f"{x}_n"), F.col(f"{y}_n")
        most = F.floor(F.lit(apart) * F.greatest(n, m))
        differ = sum((F.bit_count(F.col(f"{x}_s{k}").bitwiseXOR(F.col(f"{y}_s{k}"))) for k in range(SKETCH)), F.lit(0))
        # What either line has more than the other, at least (differ + |n - m|) / 2 for one of them, takes as many edits.
        return (F.abs(n - m) <= most) & (differ <= 2 * most - F.abs(n - m))

    def verify(pairs):
        ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        some = cut(maybe_in(coded[1], ids, "id").join(ids, "id").select("id", "hs", F.expr(characters(codes("hs"))).alias("c")))
        coded.extend((ids, some))
        return similar_pairs(pairs, some, similarity)

    group = bucket_groups(rows, verify, describe, near, F.expr(parts(similarity)))
    free(*coded)
    named = info.join(group, "id", "left").filter("copies > 1 or component is not null").withColumn("group", F.coalesce("component", "id"))
    heads = named.groupBy("group").agg(F.min("first").alias("head"), F.sum("copies").alias("all")).filter("all > 1")
    kept = cut(named.join(heads, "group").select("id", "head"))
    gone = cut(maybe_in(each.select("doc", "line", "id"), kept, "id", size=WIDE_BITMAP).join(kept, "id").filter("not (doc <=> head.doc and line = head.line)").select("doc", "line"))
    free(each, info, group, kept)
    return gone


def codes(hs: str) -> str:
    """SQL: a number of one character for each word."""
    return f"transform({hs}, h -> pmod(h, {CHARACTERS}))"


def characters(numbers: str) -> str:
    """SQL: numbers as a string of as many characters."""
    return f"decode(unhex(array_join(transform({numbers}, c -> lpad(hex(1 + c), 4, '0')), '')), 'UTF-16BE')"


def similar_pairs(pairs: DataFrame, words: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of ``pairs`` (a, b) whose lines ``words`` (id, hs, c) have at most ``1 - similarity`` times the longer one's words between them.

    ``c`` has the words as one of ``CHARACTERS`` characters each. Where two
    different words of an accepted pair have become one, the pair is tried
    again with its words numbered: so the answer is exact as long as a pair
    has no more different words than there are characters.
    """
    both = pairs.join(words.select(F.col("id").alias("a"), F.col("hs").alias("hx"), F.col("c").alias("x")), "a").join(words.select(F.col("id").alias("b"), F.col("hs").alias("hy"), F.col("c").alias("y")), "b")
    both = both.withColumn("most", F.expr(f"cast(floor({1 - similarity + 1e-9} * greatest(size(hx), size(hy))) as int)")).filter("levenshtein(x, y, most) >= 0")
    both = both.withColumn("u", F.expr("array_distinct(concat(hx, hy))"))
    numbered = lambda c: characters(f"transform({c}, h -> pmod(array_position(u, h), {CHARACTERS}))")
    return both.filter(F.expr(f"size(u) = size(array_distinct({codes('u')})) or levenshtein({numbered('hx')}, {numbered('hy')}, most) >= 0")).select("a", "b")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and ``n_lines`` and ``n_removed`` beside it.

    Blank lines (nothing but marks and blanks) stay. A null text stays null and
    has no lines; an empty one has one, blank. Rows that share an id count as
    one document: an occurrence kept in one is kept in all. A null id sorts
    first. A document may lose all its lines; it then has an empty text. Lines
    of any length are compared whole; an empty table gives no rows. Columns
    named n_lines or n_removed are replaced, all others are kept.
    """
    gone = similar_lines(docs, id_col, text_col, similarity).groupBy("doc").agg(F.collect_set("line").alias("_gone")).withColumnRenamed("doc", "_doc")
    rest = docs.drop("n_lines", "n_removed")
    both = rest.join(gone, rest[id_col].eqNullSafe(F.col("_doc")), "left").drop("_doc")
    lines = f"split({text_col}, '\\n')"
    both = both.withColumn("n_lines", F.expr(f"coalesce(size({lines}), 0)").cast("long")).withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
    stay = "array_sort(array_except(sequence(0, cast(n_lines - 1 as int)), _gone))"
    left = f"if(_gone is null, {text_col}, array_join(transform(array({lines}), ls -> transform({stay}, i -> get(ls, i)))[0], '\\n'))"
    return both.withColumn(text_col, F.expr(left)).drop("_gone")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
