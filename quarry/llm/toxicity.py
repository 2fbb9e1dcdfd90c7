"""Toxicity by the nearest labelled examples.

Terms are words and their first 4 and 5 characters (with a mark in front). A
bounded sample of labelled documents gives the examples. A document is the
TF-IDF vector of its terms, and its neighbours are the examples of largest
cosine. Inverse document frequencies count every document of the table; they
are multiplied by how clearly a term's shares among toxic and other examples
differ, squared: standard errors over ``FULL_Z``, at most 1. (With bare
frequencies the words that all texts of a language share decide who is near,
and every sixth clean document has toxic neighbours; see the README.) A term
that doesn't differ by ``LEAST_Z`` standard errors weighs nothing.

Examples lie in an inverted index cut into blocks of consecutive examples, with
each term's largest weight in each block. A query first bounds every block by
those, takes the most promising blocks whole, and then only blocks whose bound
reaches the k-th best so far, so the k nearest are exact; equal cosines go to
the earlier example. Neighbours vote with their cosines; class weights undo the
balanced sample, and an isotonic fit of left-out votes calibrates the score.
Documents none of whose terms weighs anything get the toxic share of such
examples.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import bounded_sample, chunks, in_arrow, release, remembered, spread, table, training_row

#: Bound of the sample: documents of each class.
PER_CLASS = 3000
#: Standard errors from which a term weighs something, and its full weight.
LEAST_Z, FULL_Z = 3.0, 8.0
NEIGHBOURS, BLOCK = 15, 64
#: Blocks that a query takes before it bounds the rest.
FIRST_BLOCKS = 12
MARK = "^"
WORDS_KEPT = 200_000


def terms_of(word: str) -> tuple[str, ...]:
    return (word, *(MARK + word[:n] for n in (4, 5) if len(word) > n))


def words_of(texts: list[str]):
    """Lower-cased runs of letters and digits of each text, as an Arrow list array; some may be empty."""
    return pc.split_pattern_regex(pc.utf8_lower(pa.array(texts, type=pa.string())), r"[^\p{L}\p{N}]+")


@dataclass
class Index:
    """Examples as unit vectors in blocks; ``start[t, b]`` to ``start[t, b + 1]`` are term t's postings in block b."""

    n: int
    start: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    most: np.ndarray

    @classmethod
    def build(cls, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK) -> Index:
        blocks = max(1, -(-len(vectors) // block))
        term = np.concatenate([v[0] for v in vectors] or [np.zeros(0, np.int64)]).astype(np.int64)
        example = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
        weight = np.concatenate([v[1] for v in vectors] or [np.zeros(0)]).astype(np.float64)
        cell = term * blocks + example // block
        order = np.argsort(cell, kind="stable")
        counts = np.bincount(cell, minlength=n_terms * blocks)
        ends = np.concatenate([[0], np.cumsum(counts)])
        start = np.stack([ends[np.arange(n_terms) * blocks + b] for b in range(blocks + 1)], axis=1)
        most = np.zeros(n_terms * blocks)
        np.maximum.at(most, cell, weight)
        return cls(len(vectors), start, example[order], weight[order], most.reshape(n_terms, blocks))

    def scores(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray, into: np.ndarray) -> None:
        """Add the exact cosines of all examples of ``blocks``."""
        a, b = self.start[terms][:, blocks], self.start[terms][:, blocks + 1]
        lengths = (b - a).reshape(-1)
        at = spread(a.reshape(-1), lengths)
        into += np.bincount(self.example[at], np.repeat(np.repeat(weights, len(blocks)), lengths) * self.weight[at], minlength=self.n)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The exact ``k`` examples of largest positive cosine, best first, and the cosines."""
        bound = weights @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        got = np.zeros(self.n)
        if len(order):
            first = order[:FIRST_BLOCKS]
            self.scores(terms, weights, first, got)
            kth = np.partition(got, -k)[-k] if self.n >= k else 0.0
            reach = int(np.searchsorted(-bound[order], -(kth - 1e-9), side="right"))
            if reach > len(first):
                self.scores(terms, weights, order[len(first) : reach], got)
        value = np.round(got, 12)
        some = np.flatnonzero(value > 0)
        if len(some) > k:
            some = some[value[some] >= np.partition(value[some], -k)[-k]]
        best = some[np.lexsort((some, -value[some]))][:k]
        return best, got[best]


@dataclass
class ToxicityModel:
    terms: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of terms: idf times how clearly they differ
    index: Index | None = None
    names: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    votes: np.ndarray = field(default_factory=lambda: np.zeros(0))  # class weight of each example
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))  # vote and calibrated score
    plain: float = 0.0  # score of documents without a term

    def reader(self) -> TermReader:
        """One for the tasks of a stage in a worker process."""
        return remembered("terms", lambda: TermReader(self.terms))


class TermReader:
    """Counts the terms of a model in texts; remembers each word's."""

    def __init__(self, terms: dict[str, int]):
        self.terms, self.words = terms, {}

    def counts(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each text's terms in ascending order, and how often each occurs."""
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        parts = words_of(texts)
        coded = parts.flatten().dictionary_encode()
        known = []
        for w in coded.dictionary.to_pylist():
            hit = self.words.get(w)
            if hit is None:
                hit = self.words[w] = tuple(self.terms[t] for t in terms_of(w) if t in self.terms)
            known.append(hit)
        many = np.array([len(h) for h in known], dtype=np.int64)
        flat = np.array([t for h in known for t in h], dtype=np.int64)
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy(zero_copy_only=False))
        hits = flat[spread((np.cumsum(many) - many)[at], many[at])] if len(many) else flat
        size = max(len(self.terms), 1)
        cell, n = np.unique(np.repeat(doc, many[at]) * size + hits if len(many) else flat, return_counts=True)
        ends = np.searchsorted(cell // size, np.arange(1, len(texts)))
        return list(zip(np.split(cell % size, ends), np.split(n, ends), strict=True))


def all_counts(reader: TermReader, texts: list[str]):
    """``reader.counts`` of chunks of texts."""
    for s in chunks([len(t) for t in texts]):
        yield from reader.counts(texts[s])


def vector(terms: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and unit TF-IDF weights."""
    w = (1 + np.log(counts)) * weights[terms]
    norm = np.sqrt((w * w).sum())
    return terms, w / norm if norm else w


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising steps that fit (x, y) best by weighted squares: their x and values."""
    xs, inverse = np.unique(x, return_inverse=True)
    total = np.bincount(inverse, w)
    value = np.bincount(inverse, w * y) / total
    groups: list[list[float]] = []
    for a, v, m in zip(xs.tolist(), value.tolist(), total.tolist(), strict=True):
        groups.append([v, m, a, a])
        while len(groups) > 1 and groups[-2][0] >= groups[-1][0]:
            v2, m2, _, hi = groups.pop()
            g = groups[-1]
            g[0], g[1], g[3] = (g[0] * g[1] + v2 * m2) / (g[1] + m2), g[1] + m2, hi
    return np.array([p for g in groups for p in (g[2], g[3])]), np.array([g[0] for g in groups for _ in (0, 1)])


def smoothed_vote(model: ToxicityModel, best: np.ndarray, cosine: np.ndarray) -> float:
    w = cosine * model.votes[best]
    return float((w * model.toxic[best]).sum() / w.sum()) if len(best) and w.sum() > 0 else 0.0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> ToxicityModel:
    """Fit on ``labels`` (id, label 0 or 1) of ``docs``.

    Other labels, and labels of ids that ``docs`` lacks, are left out; of an id
    with several labels the largest counts, of rows that share an id one text.
    Null texts count as empty, long ones are read whole. The sample is the
    ``per_class`` labelled ids of each class with the smallest hash. Without
    labelled examples of both classes every score is the class that there is,
    or 0. Columns beside those named are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and id is not null").groupBy("id").agg(F.max("y").alias("y"))
    known = known.join(texts.select("id"), "id", "left_semi")
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return ToxicityModel(plain=float(next(iter(sizes), 0)))
    chosen = bounded_sample(known, "y", sizes, per_class).select("id", "y")
    sample = texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"])
    share = {y: sizes[y] / min(sizes[y], per_class) for y in sizes}

    def spell(batches):
        for batch in batches:
            found = [sorted({t for w in set(x) if w for t in terms_of(w)}) for x in words_of(batch.column(1).to_pylist()).to_pylist()]
            label = [y for y, f in zip(batch.column(0).to_pylist(), found, strict=True) for _ in f]
            yield pa.RecordBatch.from_arrays([pa.array(label, type=pa.int32()), pa.array([t for f in found for t in f], type=pa.string())], names=["y", "term"])

    n1, n0 = min(sizes[1], per_class), min(sizes[0], per_class)
    both = in_arrow(sample.select("y", "text"), spell, "y int, term string").groupBy("term").agg(F.sum("y").alias("a"), F.sum(F.lit(1) - F.col("y")).alias("b"))
    p = (F.col("a") + F.col("b")) / (n1 + n0)
    z = F.abs(F.col("a") / n1 - F.col("b") / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9)
    clear = {r["term"]: r["z"] for r in both.select("term", z.alias("z")).filter(F.col("z") >= LEAST_Z).collect()}  # bounded by the sample
    number = {t: k for k, t in enumerate(sorted(clear))}
    if not number:
        return ToxicityModel(plain=sizes[1] / (sizes[0] + sizes[1]))

    terms = docs.sparkSession.sparkContext.broadcast(ToxicityModel(number))

    def occur(batches):
        reader, df, n = terms.value.reader(), np.zeros(len(number), dtype=np.int64), 0
        for batch in batches:
            for own, _ in all_counts(reader, batch.column(0).to_pylist()):
                n += 1
                df[own] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(df)), -1], type=pa.int64()), pa.array([*df.tolist(), n], type=pa.int64())], names=["t", "n"])

    counts = {r["t"]: r["n"] for r in in_arrow(texts.select("text"), occur, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    idf = np.log((1 + counts[-1]) / (1 + np.array([counts[t] for t in range(len(number))]))) + 1
    weights = idf * np.minimum(np.array([clear[t] for t in number]) / FULL_Z, 1) ** 2

    def count(batches):
        reader = TermReader(number)
        for batch in batches:
            found = list(all_counts(reader, batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.tolist() for t, _ in found], type=pa.list_(pa.int32())), pa.array([c.tolist() for _, c in found], type=pa.list_(pa.int32()))], names=["id", "y", "t", "c"])

    rows = in_arrow(sample.select("id", "y", "text"), count, "id long, y int, t array<int>, c array<int>").collect()
    # Examples of a class that share their weightiest term stand together, so that few blocks have large bounds.
    data = sorted(((r["y"], np.array(r["t"], dtype=np.int64), np.array(r["c"], dtype=np.int64), r["id"]) for r in rows), key=lambda r: (r[0], int(r[1][np.argmax(weights[r[1]])]) if len(r[1]) else -1, r[3]))
    weight = np.array([share[r[0]] for r in data])
    y = np.array([r[0] for r in data], dtype=np.float64)
    vectors = [vector(r[1], r[2], weights) for r in data]
    filled = np.array([k for k, v in enumerate(vectors) if len(v[0])], dtype=np.int64)
    empty = np.setdiff1d(np.arange(len(data)), filled)
    plain = float((weight[empty] * y[empty]).sum() + 0.5) / float(weight[empty].sum() + 1) if len(empty) else 0.0
    model = ToxicityModel(number, weights, Index.build([vectors[k] for k in filled], len(number)), np.array([data[k][3] for k in filled], dtype=np.int64), y[filled], weight[filled], plain=plain)
    votes = np.zeros(len(filled))
    for k, at in enumerate(filled.tolist()):
        best, cosine = model.index.nearest(*vectors[at], NEIGHBOURS + 1)
        other = best != k
        votes[k] = smoothed_vote(model, best[other][:NEIGHBOURS], cosine[other][:NEIGHBOURS])
    if len(filled):
        model.steps = isotonic(votes, y[filled], weight[filled])
    del rows, data, vectors
    release()
    return model


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``neighbours`` and ``cosines``, which replace columns of such names.

    The evidence is in the last two: ids and cosines of the examples that voted.

    Null texts count as empty; texts none of whose terms weighs anything have no neighbours
    and the score of such examples. Repeated rows get equal scores, all other
    columns stay as they are.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)
    added = ["score", "neighbours", "cosines"]
    kept = docs.drop(*added)
    names = kept.columns
    at = names.index(text_col)

    def run(batches):
        model = handle.value
        reader, known = model.reader(), {}

        def judge(terms, counts):
            if not len(terms) or model.index is None:
                return model.plain, [], []
            key = (terms.tobytes(), counts.tobytes())
            if key not in known:
                if len(known) > 10_000:
                    known.clear()
                best, cosine = model.index.nearest(*vector(terms, counts, model.weights), NEIGHBOURS)
                vote = smoothed_vote(model, best, cosine)
                known[key] = float(np.interp(vote, *model.steps)) if len(best) else model.plain, model.names[best].tolist(), cosine.tolist()
            return known[key]

        for batch in batches:
            out = [judge(*x) for x in all_counts(reader, [t or "" for t in batch.column(at).to_pylist()])]
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cols[0], type=pa.float64()), pa.array(cols[1], type=pa.list_(pa.int64())), pa.array(cols[2], type=pa.list_(pa.float64()))], names=[*names, *added])

    types = [T.DoubleType(), T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())]
    return in_arrow(kept, run, T.StructType([*kept.schema.fields, *map(T.StructField, added, types)]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(training_row()))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (~training_row()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "cosines")
