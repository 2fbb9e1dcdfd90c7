"""Advertisements: auctions, targeting, click models and recommendation."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CLAUSE = re.compile(r"\s*([\w.]+)\s*(!?)~\s*\{([^}]*)\}\s*")


def auction(ads: DataFrame, top: int, mode: str = "mode", price: str = "price", ctr: str = "ctr", key: str = "ad_id") -> DataFrame:
    """The ``top`` ads by what they earn for a thousand views: their price (mode 0), or rate of clicks times price times 1000."""
    score = F.when(F.col(mode) == 0, F.col(price).cast("double")).otherwise(F.col(ctr) * F.col(price) * 1000)
    return ads.withColumn("ecpm", score).orderBy(F.desc("ecpm"), key).limit(top)


def parse_targeting(rule: str) -> list[dict]:
    """A conjunction ``attr~{v1,v2}^attr!~{v}`` as clauses {"attr", "negated", "values"}."""
    out = []
    for part in rule.split("^"):
        m = _CLAUSE.fullmatch(part)
        if not m:
            raise ValueError(f"can't read {part!r}")
        out.append({"attr": m[1], "negated": bool(m[2]), "values": [v.strip() for v in m[3].split(",") if v.strip()]})
    return out


def parse_disjunction(rule: str) -> list[list[dict]]:
    """Conjunctions parted by ``|``."""
    return [parse_targeting(part) for part in rule.split("|")]


def target(rules: DataFrame, profile: dict[str, list[str]], key: str = "ad_id", rule: str = "rule") -> DataFrame:
    """Ads one of whose rules the profile meets: all clauses of one of its conjunctions, where a missing attribute meets only negated ones.

    ``rule`` holds conjunctions parted by ``|``; clauses are taken apart by
    expressions, so ads of any number are matched in the scan.
    """
    known = F.create_map(*[x for a, v in profile.items() for x in (F.lit(a), F.array(*[F.lit(y) for y in v]).cast("array<string>"))]) if profile else F.create_map().cast("map<string,array<string>>")

    def met(c):
        name = F.trim(F.regexp_extract(c, r"^\s*([\w.]+)\s*!?~", 1))
        values = F.transform(F.split(F.regexp_extract(c, r"\{([^}]*)\}", 1), ","), lambda v: F.trim(v))
        has = F.coalesce(F.arrays_overlap(F.element_at(known, name), values), F.lit(False))
        return F.when(c.contains("!~"), ~has).otherwise(has)

    conjunction = lambda c: F.forall(F.split(c, r"\^"), met)
    return rules.filter(F.exists(F.split(rule, r"\|"), conjunction)).select(key).distinct()


def segment_ctr(log: DataFrame, user: list[str], ad: list[str], clicked: str = "clicked") -> DataFrame:
    """(segments, views, clicks, ctr) for each combination of user and ad segments, and all partial ones."""
    dims = [*user, *ad]
    out = log.cube(*dims).agg(F.count("*").alias("views"), F.sum(F.col(clicked).cast("long")).alias("clicks"))
    return out.withColumn("ctr", F.col("clicks") / F.col("views"))


def history_ctr(table: DataFrame, user_segments: DataFrame, ad_segments: DataFrame, user: str = "user_id", ad: str = "ad_id") -> DataFrame:
    """(user, ad, ctr): the largest rate over the segments of both. ``table`` is (user_segment, ad_segment, ctr).

    Joins segments, not users with ads: each side meets the table on its own segment.
    """
    return user_segments.join(table, "user_segment").join(ad_segments, "ad_segment").groupBy(user, ad).agg(F.max("ctr").alias("ctr"))


def select_ads(candidates: DataFrame, count: int, seed: int, ctr: str = "ctr", key: str = "ad_id") -> DataFrame:
    """A third of ``count`` and one more by rate of clicks, the rest by chance (the same for a seed)."""
    best = count // 3 + 1
    top = candidates.orderBy(F.desc_nulls_last(ctr), key).limit(best)
    rest = candidates.join(top.select(key), key, "left_anti").orderBy(F.xxhash64(F.lit(seed), key), key).limit(max(0, count - best))
    return top.withColumn("explored", F.lit(False)).unionByName(rest.withColumn("explored", F.lit(True)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def recommend(items: DataFrame, factors: list[float], top: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``top`` items by the product of latent factors."""
    return items.select(key, dot(F.col(vector), F.array(*[F.lit(float(x)) for x in factors])).alias("score")).orderBy(F.desc("score"), key).limit(top)


def learn_factors(user: np.ndarray, item: np.ndarray, clicked: bool, rate: float = 0.05, decay: float = 0.01, most: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """One gradient step on both sides' factors; their norms stay at ``most`` or less."""
    error = float(clicked) - 1 / (1 + math.exp(-float(np.clip(user @ item, -30, 30))))
    out = (user + rate * (error * item - decay * user), item + rate * (error * user - decay * item))
    return tuple(v * min(1.0, most / max(np.linalg.norm(v), 1e-12)) for v in out)


#: Mean and deviation of a weight before any view, deviation of a view, and drift; fixed values.
MEAN, DEVIATION, BETA, DRIFT = 0.0, 400.0, 450.0, 0.08


class ClickModel:
    """Bayesian probit regression on sets of features, learnt one view at a time.

    Each feature has a normal weight; a view moves the means of its features by
    how surprising the outcome was and shrinks their variances. Before that a
    weight is drawn back to the prior by ``drift``, so that old views count less.
    """

    def __init__(self, mean: float = MEAN, deviation: float = DEVIATION, beta: float = BETA, drift: float = DRIFT):
        self.prior, self.beta, self.drift, self.weights = (mean, deviation**2), beta, drift, {}

    def _sums(self, features: list[str]) -> tuple[float, float]:
        pairs = [self.weights.get(f, self.prior) for f in features]
        return sum(p[0] for p in pairs), self.beta**2 + sum(p[1] for p in pairs)

    def predict(self, features: list[str]) -> float:
        mean, variance = self._sums(features)
        return 0.5 * (1 + math.erf(mean / math.sqrt(2 * variance)))

    def _drawn_back(self, weight: tuple[float, float]) -> tuple[float, float]:
        (m, s), (pm, ps), e = weight, self.prior, self.drift
        new = 1 / ((1 - e) / s + e / ps)
        return new * ((1 - e) * m / s + e * pm / ps), new

    def update(self, features: list[str], clicked: bool) -> None:
        for f in features:
            if f in self.weights:
                self.weights[f] = self._drawn_back(self.weights[f])
        mean, variance = self._sums(features)
        sign, spread = (1 if clicked else -1), math.sqrt(variance)
        t = sign * mean / spread
        mass = max(0.5 * (1 + math.erf(t / math.sqrt(2))), 1e-12)
        v = math.exp(-t * t / 2) / math.sqrt(2 * math.pi) / mass
        w = v * (v + t)
        for f in features:
            m, s = self.weights.get(f, self.prior)
            self.weights[f] = (m + sign * s / spread * v, max(s * (1 - s / variance * w), 1e-6))


def train_click_models(log: DataFrame, by: str, order: str, features: str = "features", clicked: str = "clicked", models: DataFrame | None = None) -> DataFrame:
    """(by, feature, mean, variance): a model for each value of ``by`` from its views in order, which go on from ``models`` if given."""
    import pandas as pd

    def learn(key, known, group):
        model = ClickModel()
        model.weights = {f: (m, s) for f, m, s in known[["feature", "mean", "variance"]].itertuples(index=False)}
        for f, c in group.sort_values(order)[[features, clicked]].itertuples(index=False):
            model.update(list(f), bool(c))
        return pd.DataFrame([(key[0], f, m, s) for f, (m, s) in sorted(model.weights.items())], columns=[by, "feature", "mean", "variance"])

    kind = dict(log.dtypes)[by]
    schema = f"`{by}` {kind}, feature string, mean double, variance double"
    before = models if models is not None else log.sparkSession.createDataFrame([], schema)
    return before.groupBy(by).cogroup(log.groupBy(by)).applyInPandas(learn, schema)
