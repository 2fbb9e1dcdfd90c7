"""Language identification with sparse multinomial logistic regression.

Features are character 1- to 3-grams of lower-cased words padded with a space,
hashed to ``FEATURES`` slots and weighted by relative frequency times inverse
document frequency. Document frequencies count every training document. The
weights are fitted by follow-the-regularised-leader with an elastic-net
penalty on a bounded sample (``per_language`` documents of each language); a
temperature fitted on held-back documents of that sample calibrates the scores.

Scoring reads a text once in chunks; a word's contribution to the logits is
found once per worker, as it is the same wherever the word stands.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import Vocabulary, bounded_sample, chunks, in_arrow, release, segment_sums, spread, table, training_row

FEATURES = 1 << 15
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Relative frequencies are small; FTRL's learning rates suit values of about this much.
SCALE = 50.0


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that nearby values go to distant slots."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def word_features(words: list[str], features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words' n-grams in a row of words, and how many each word has."""
    text = " " + " ".join(words) + " "
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    space = code == 32
    owner = np.cumsum(space) - 1  # of a letter: its word; of a space: the word after it
    slots, owners = [], []
    for n in ORDERS:
        if len(code) < n:
            continue
        size = len(code) - n + 1
        value = np.full(size, n, dtype=np.uint64)
        inner = np.zeros(size, dtype=bool)
        for i in range(n):
            value = value * np.uint64(0x9E3779B97F4A7C15) + code[i : i + size]
            if 0 < i < n - 1 or n == 1:
                inner |= space[i : i + size]
        if n == 2:
            inner = space[:size] & space[1 : 1 + size]
        at = np.flatnonzero(~inner)
        slots.append((mixed(value[at]) % np.uint64(features)).astype(np.int64))
        owners.append(owner[at])
    slots, owners = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return slots[order], np.bincount(owners, minlength=len(words))[: len(words)]


def words_of(text: str) -> list[str]:
    return text.lower().split()


class WordTable:
    """What a function of words gives for each word seen, found once per word."""

    def __init__(self, of_words):
        self.of_words, self.words = of_words, Vocabulary()
        self.rows = None

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.words.known > self.words.kept:
            self.words.clear()
            self.rows = None
        flat, n_words = self.words.number([words_of(t) for t in texts])
        if fresh := self.words.fresh():
            new = self.of_words(fresh)
            self.rows = new if self.rows is None else np.concatenate([self.rows, new])
        return flat, n_words


def document_frequencies(texts: DataFrame, features: int) -> tuple[np.ndarray, int]:
    """In how many of the texts each slot occurs, and the number of texts. One row a slot reaches the driver."""

    def run(batches):
        df, n = np.zeros(features, dtype=np.int64), 0
        for batch in batches:
            every = [t or "" for t in batch.column(0).to_pylist()]
            n += len(every)
            for s in chunks([len(t) for t in every]):
                flat, n_words = (v := Vocabulary()).number([words_of(t) for t in every[s]])
                if not len(flat):
                    continue
                slots, per_word = word_features(v.fresh(), features)
                starts = np.cumsum(per_word) - per_word
                ends = np.cumsum(n_words)
                for a, b in zip((ends - n_words).tolist(), ends.tolist(), strict=True):
                    own = np.unique(flat[a:b])
                    seen = np.zeros(features, dtype=bool)
                    seen[slots[spread(starts[own], per_word[own])]] = True
                    df += seen
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], type=pa.int64()), pa.array([*df[at].tolist(), n], type=pa.int64())], names=["slot", "n"])

    counts = in_arrow(texts, run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(features, dtype=np.int64)
    total = 0
    for r in counts:
        if r["slot"] < 0:
            total = r["n"]
        else:
            df[r["slot"]] = r["n"]
    return df, total


def sample_features(sample: DataFrame, features: int) -> list[tuple[int, str, np.ndarray, np.ndarray]]:
    """(id, language, slots, relative frequencies) of a bounded sample, by id."""

    def run(batches):
        for batch in batches:
            out = []
            for i, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if words := words_of(text or ""):
                    slots, counts = np.unique(word_features(words, features)[0], return_counts=True)
                    out.append((i, lang, slots.astype(np.int32).tobytes(), (counts / counts.sum()).astype(np.float32).tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=["id", "lang", "slots", "share"])

    rows = in_arrow(sample, run, "id long, lang string, slots binary, share binary").collect()
    return sorted((r["id"], r["lang"], np.frombuffer(r["slots"], dtype=np.int32), np.frombuffer(r["share"], dtype=np.float32)) for r in rows) if len({r["id"] for r in rows}) == len(rows) else sorted(((r["id"], r["lang"], np.frombuffer(r["slots"], dtype=np.int32), np.frombuffer(r["share"], dtype=np.float32)) for r in rows), key=lambda x: (x[0], x[1], x[2].tobytes()))


def ftrl(rows: list[tuple], n_classes: int, features: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 4) -> np.ndarray:
    """Weights (features + 1, classes) fitted to (class, slots, values); the last row is the bias, which isn't penalised."""
    z = np.zeros((features + 1, n_classes))
    n = np.zeros_like(z)

    def weights(at):
        zs = z[at]
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(zs) <= l1] = 0.0
        w[-1] = -zs[-1] / ((beta + np.sqrt(n[at[-1]])) / alpha)
        return w

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            label, slots, values = rows[k]
            at, x = np.append(slots, features), np.append(values, 1.0)
            w = weights(at)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1.0
            g = x[:, None] * p[None, :]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    return weights(np.arange(features + 1))


def fitted_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t):
        x = logits / np.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(labels)), labels]))

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass
class LanguageModel:
    """``weights`` has a row for each slot, already times idf; ``bias`` and ``temperature`` apply to a whole text."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 800, features: int = FEATURES) -> LanguageModel:
    """Fit on rows with a text and a language.

    Rows without either are left out; without any row the model knows no
    language and answers ``und``. ``per_language`` bounds the fitted sample:
    the documents of each language with the smallest hash of their id; rows
    that share an id and a language count as one there. Texts are read whole.
    """
    known = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).filter("text is not null and lang is not null and id is not null")
    df, total = document_frequencies(known.select("text"), features)
    ids = known.select("id", "lang").distinct()
    sizes = {r["lang"]: r["count"] for r in ids.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return LanguageModel([], np.zeros((features, 1), np.float32), np.zeros(1), 1.0)
    chosen = bounded_sample(ids, "lang", sizes, per_language).select("id", "lang")
    rows = sample_features(known.join(F.broadcast(chosen), ["id", "lang"], "left_semi").select("id", "lang", "text").dropDuplicates(["id", "lang"]), features)
    languages = sorted({r[1] for r in rows})
    if not languages:  # no sampled text has a word
        return LanguageModel([], np.zeros((features, 1), np.float32), np.zeros(1), 1.0)
    idf = np.log((1 + total) / (1 + df)) + 0.1
    number = {x: i for i, x in enumerate(languages)}
    data = [(number[lang], slots.astype(np.int64), SCALE * share * idf[slots]) for _, lang, slots, share in rows]
    held = [x for i, x in enumerate(data) if i % 5 == 4]
    w = ftrl([x for i, x in enumerate(data) if i % 5 != 4] or data, len(languages), features)
    logits = np.array([x @ w[slots] + w[-1] for _, slots, x in held]).reshape(len(held), len(languages))
    temperature = fitted_temperature(logits, np.array([x[0] for x in held], dtype=np.int64))
    del rows, data, held
    release()
    return LanguageModel(languages, (SCALE * idf[:, None] * w[:-1]).astype(np.float32), w[-1], temperature)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``, which replace columns of such names.

    ``und`` with score 0 if the text is null, has no letter, or the model knows
    no language. Repeated rows get equal answers, all other columns stay as
    they are, ties go to the language that sorts first.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "lang_score")
    fields = kept.columns
    at = fields.index(text_col)

    def run(batches):
        model = handle.value

        def per_word(words):
            slots, per_word = word_features(words)
            return np.column_stack([segment_sums(model.weights[slots], per_word), per_word])

        seen = WordTable(per_word)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            names, scores = [], []
            for s in chunks([len(t) for t in texts]):
                flat, n_words = seen.look_up(texts[s])
                sums = segment_sums(seen.rows[flat], n_words) if len(flat) else np.zeros((len(n_words), model.weights.shape[1] + 1))
                logits = (sums[:, :-1] / np.maximum(sums[:, -1:], 1) + model.bias) / model.temperature
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                for text, k, score in zip(texts[s], best.tolist(), p.max(axis=1).tolist(), strict=True):
                    good = bool(model.languages) and any(map(str.isalpha, text))
                    names.append(model.languages[k] if good else UNKNOWN)
                    scores.append(score if good else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, type=pa.string()), pa.array(scores, type=pa.float64())], names=[*fields, "lang_pred", "lang_score"])

    return in_arrow(kept, run, T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(training_row()))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (~training_row()).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
