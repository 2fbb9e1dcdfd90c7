"""Documents whose word shingles have a high Jaccard similarity, joined by parity sketches.

A document's set of shingles is dealt to the blocks of a sketch by hash; each
token toggles one bit of its block. Sets that differ in d tokens differ in at
most d bits, so the Hamming distance of sketches never exceeds the size of the
symmetric difference. Per size band the similarity bounds d, and the sketch has
more blocks than that: some block then has no differing token at all
(pigeonhole), and sets are joined on equal blocks. A block's key also holds the
XOR of its tokens' whole hashes, which is equal too if no token differs.

Blocks without tokens say nothing. Each band's sketch has a few blocks to
spare, so that a set leaves its empty blocks out if it has no more of them than
that; only a set with more also gives those.

Pairs that share a block are filtered by size and by a sketch of fixed width,
then the exact sets are compared. Sets have 64-bit names (a hash of all their
tokens), so equal sets are one set from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import WIDE_BITMAP, chunks, cut, free, in_arrow, maybe_in, spread, table
from quarry.llm.linking import bucket_groups

SIZE, PERCENT = 5, 80
#: Bits of the sketch that filters pairs, in 64-bit words.
WORDS = 8
#: Each size band ends at this many times its start, at least.
BAND = 1.3

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingle_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a row, and how many each has.

    A word's hash is a polynomial in its bytes, taken from running sums over
    the whole batch; a shingle's mixes those of its words in order.
    """
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    data = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    blank = _SPACE[data]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), dtype=np.uint64)])
    back = powers(pow(_BASE, -1, 1 << 64), len(data))
    word = mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    doc = np.searchsorted(np.cumsum(sizes), start, side="right")
    n_words = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    n = np.where(n_words >= size, n_words - size + 1, 0)
    first = np.cumsum(n_words) - n_words
    at = spread(first, n)
    value = np.zeros(len(at), dtype=np.uint64)
    for i in range(size):
        value = mixed(value * np.uint64(3) + word[at + i])
    owner = np.repeat(np.arange(len(texts)), n)
    few = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(few):
        short = np.array([n_words[k] for k in few], dtype=np.uint64)
        for i in range(size - 1):
            has = np.flatnonzero(n_words[few] > i)
            short[has] = mixed(short[has] * np.uint64(5) + word[first[few[has]] + i])
        value, owner = np.concatenate([value, short]), np.concatenate([owner, few])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(texts)).astype(np.int64)


def set_names(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; empty sets get 0."""
    out = np.zeros(len(n), dtype=np.uint64)
    filled = np.flatnonzero(n)
    if len(filled):
        out[filled] = mixed(np.add.reduceat(mixed(tokens + np.uint64(1)), (np.cumsum(n) - n)[filled]) + n[filled].astype(np.uint64))
    return out.astype(np.int64)


def most_apart(size: int, percent: int) -> int:
    """The largest symmetric difference of a set of at most ``size`` tokens and a larger similar one."""
    return (100 - percent) * size // percent


def bands(largest: int, percent: int) -> list[tuple[int, int, int]]:
    """(largest size, blocks, empty blocks to spare) of each band up to ``largest``."""
    out, start, ratio = [], 1, max(BAND, 100 / percent + 0.05)
    while start <= largest:
        end = max(start, int(start * ratio))
        needed = most_apart(end, percent) + 1
        spare = 0
        if needed > 1:
            for _ in range(4):
                m = needed + spare
                empty = m * np.exp(-start / m)
                spare = int(np.ceil(empty + 2.5 * np.sqrt(empty) + 1))
        out.append((end, needed + spare, spare))
        start = end + 1
    return out


def block_keys(tokens: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all blocks that the sets give, and the set of each.

    A set goes to its own size band, and to the band below if a similar set can
    be as small as that.
    """
    plan = bands(int(n.max(initial=1)), percent)
    ends = np.array([b[0] for b in plan], dtype=np.int64)
    own = np.searchsorted(ends, n)
    sets = np.flatnonzero(n)
    lower = sets[(own[sets] > 0) & (n[sets] * percent <= np.concatenate([[0], ends])[own[sets]] * 100)]
    who = np.concatenate([sets, lower])
    band = np.concatenate([own[sets], own[lower] - 1])
    blocks = np.array([b[1] for b in plan], dtype=np.int64)[band]
    spare = np.array([b[2] for b in plan], dtype=np.int64)[band]
    use = np.array([b[1] - b[2] for b in plan], dtype=np.int64)[band] > 1  # else only equal sets are similar
    who, band, blocks, spare = who[use], band[use], blocks[use], spare[use]
    if not len(who):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    base = np.cumsum(blocks) - blocks
    value = tokens[spread((np.cumsum(n) - n)[who], n[who])]
    width = n[who]
    at = (np.repeat(base, width).astype(np.uint64) + (value >> np.uint64(20)) % np.repeat(blocks, width).astype(np.uint64)).astype(np.int64)
    total = int(blocks.sum())
    parity, digest = np.zeros(total, dtype=np.uint64), np.zeros(total, dtype=np.uint64)
    np.bitwise_xor.at(parity, at, np.uint64(1) << (value & np.uint64(63)))
    np.bitwise_xor.at(digest, at, mixed(value))
    full = np.zeros(total, dtype=bool)
    full[at] = True
    owner = np.repeat(np.arange(len(who)), blocks)
    empty = np.bincount(owner[~full], minlength=len(who))
    keep = full | (empty > spare)[owner]
    place = (np.repeat(band, blocks).astype(np.uint64) << np.uint64(40)) + spread(np.zeros(len(who), np.int64), blocks).astype(np.uint64)
    key = mixed(mixed(mixed(parity) ^ digest) + mixed(place))
    return key[keep].astype(np.int64), who[owner[keep]]


def sketches(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros((len(n), WORDS), dtype=np.uint64)
    owner = np.repeat(np.arange(len(n)), n)
    word = ((tokens >> np.uint64(6)) % np.uint64(WORDS)).astype(np.int64)
    np.bitwise_xor.at(out.reshape(-1), owner * WORDS + word, np.uint64(1) << (tokens & np.uint64(63)))
    return out.view(np.int64)


def per_chunk(texts: DataFrame, size: int, schema: str, rows) -> DataFrame:
    """``rows(ids, texts' tokens, sizes)`` for each chunk of (id, text)."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for s in chunks([len(t) for t in texts]):
                yield rows(batch.column(0)[s], *shingle_sets(texts[s], size), seen)

    return in_arrow(texts, run, schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Rows
    link when ``100 * intersection >= percent * union`` of their sets of
    ``size``-word shingles; with fewer words, the whole sequence is one
    shingle. Null or wordless texts have no shingle and link with nothing, a
    null id is never a component's name. Repeated rows and equal texts are in
    one component. An empty table gives no rows; other columns are ignored.
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].cast("string").alias("text"))
    words = [f"s{k}" for k in range(WORDS)]

    def describe(ids, tokens, n, _):
        parts = sketches(tokens, n)
        return pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(set_names(tokens, n)), *(pa.array(parts[:, k]) for k in range(WORDS))], names=["doc", "n", "id", *words])

    def give(_, tokens, n, seen):
        names = set_names(tokens, n)
        fresh = np.zeros(len(n), dtype=bool)
        for k, name in enumerate(names.tolist()):
            if name not in seen:  # one of equal sets in a task gives its blocks
                seen.add(name)
                fresh[k] = True
        keys, who = block_keys(tokens[np.repeat(fresh, n)], np.where(fresh, n, 0), percent)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(names[who])], names=["key", "id"])

    def whole(_, tokens, n, __):
        ends = np.cumsum(n)
        sets = [tokens[a:b].tobytes() for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(set_names(tokens, n)), pa.array(sets, type=pa.binary())], names=["id", "tokens"])

    every = cut(per_chunk(texts, size, f"doc long, n long, id long, {', '.join(w + ' long' for w in words)}", describe))
    info = cut(every.filter("n > 0").groupBy("id").agg(F.min("doc").alias("doc"), *[F.max(c).alias(c) for c in ("n", *words)]))

    def near(x, y):
        n, m = F.col(f"{x}_n"), F.col(f"{y}_n")
        apart = sum((F.bit_count(F.col(f"{x}_{w}").bitwiseXOR(F.col(f"{y}_{w}"))) for w in words), F.lit(0))
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (apart * (100 + percent) <= (100 - percent) * (n + m))

    sets: list[DataFrame] = []

    def describe_shared(ids):
        """Size and sketch of sets that share a block; the sets are kept for ``verify``."""
        wanted = cut(info.join(ids, "id"))
        # One document of each set is read again; a set none of whose documents has an id is known by its name.
        sets.append(wanted)
        some = maybe_in(texts, wanted, "doc", size=WIDE_BITMAP).join(wanted.select(F.col("doc").alias("d")).distinct(), F.expr("doc <=> d"), "left_semi")
        sets.append(cut(per_chunk(some, size, "id long, tokens binary", whole).join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"])))
        return wanted.select("id", "n", *words)

    def verify(pairs):
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
        some = maybe_in(sets[-1], ids, "id")  # a few pairs deal out a few sets
        x, y = (some.select(F.col("id").alias(p), F.col("tokens").alias(q)) for p, q in (("a", "x"), ("b", "y")))
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")

        def compare(batches):
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * same >= percent * (len(x) + len(y) - same))
                kept = batch.filter(pa.array(keep, type=pa.bool_()))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

        return in_arrow(both, compare, "a long, b long")

    rows = per_chunk(texts, size, "key long, id long", give)
    group = bucket_groups(rows, verify, describe_shared, near)
    free(info, *sets)
    placed = every.select("doc", "n", "id").join(group, "id", "left").select("doc", "n", F.when(F.col("n") > 0, F.coalesce("component", "id")).alias("c"))
    smallest = placed.filter("c is not null").groupBy("c").agg(F.min("doc").alias("component_id"))
    return placed.join(smallest, "c", "left").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=85)
