"""Approximate nearest neighbours with one hierarchical navigable small world per shard.

Vectors of equal value are indexed once. Shards hold about ``SHARD_ROWS``
vectors of one dimension, dealt by hash. A shard's graph is a few flat integer
arrays: for each level its members and a fixed number of neighbour slots for
each. Vectors are inserted in batches: a batch is searched at once in what is
there already and compared with itself, then linked in with the usual
diversity rule.

A search deals the shards over the cluster and sends every query to each shard
of its dimension (a stated query set against all rows); a task holds one shard
and searches it for a block of queries at a time. Each shard's best are merged;
cosines of the answers are taken in double precision from the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import cut, in_arrow, table

SHARD_ROWS = 16384
QUERY_BLOCK = 128
LINKS = 24
BUILD_WIDTH = 64
SEARCH_WIDTH = 64
#: Shards of a dimension are numbered from so many times it.
DIMENSION = 1_000_000_000


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled first so that neither huge nor tiny values get lost."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    dot, na, nb = (a * b).sum(axis=-1), np.sqrt((a * a).sum(axis=-1)), np.sqrt((b * b).sum(axis=-1))
    with np.errstate(all="ignore"):
        out = dot / (na * nb)
    odd = ~np.isfinite(out) | (na == 0) | (nb == 0)
    if odd.any():
        x, y = a[odd], b[odd]
        x, y = x / np.abs(x).max(axis=-1, keepdims=True), y / np.abs(y).max(axis=-1, keepdims=True)
        out[odd] = (x * y).sum(axis=-1) / (np.sqrt((x * x).sum(axis=-1)) * np.sqrt((y * y).sum(axis=-1)))
    return out


def beam(unit: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``width`` best rows found for each query by best-first search, best first (-1 and -inf: none), and how many rows it was compared with.

    ``graph[i]`` has the neighbours of row i, -1 for none; ``entry`` has the
    starting rows of each query. All queries take a step at a time.
    """
    q, n = len(queries), len(unit)
    every = np.arange(q)
    seen = np.zeros((q, n + 1), dtype=bool)
    seen[:, n] = True  # where -1 points
    seen[every[:, None], entry] = True
    ids = np.full((q, width), -1, dtype=np.int64)
    near = np.full((q, width), -np.inf, dtype=np.float32)
    done = np.ones((q, width), dtype=bool)
    k = entry.shape[1]
    ids[:, :k] = entry
    near[:, :k] = np.where(entry >= 0, np.einsum("qd,qkd->qk", queries, unit[entry]), -np.inf)
    done[:, :k] = entry < 0
    live = every
    while len(live):
        open_ = np.where(done[live], -np.inf, near[live])
        at = open_.argmax(axis=1)
        more = open_[np.arange(len(live)), at] > -np.inf
        live, at = live[more], at[more]
        if not len(live):
            break
        done[live, at] = True
        found = graph[ids[live, at]]
        new = ~seen[live[:, None], found]
        seen[live[:, None], found] = True
        seen[live, n] = True
        value = np.where(new, np.einsum("qd,qkd->qk", queries[live], unit[found]), -np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[live], found], axis=1)
        all_near = np.concatenate([near[live], value], axis=1)
        all_done = np.concatenate([done[live], ~new], axis=1)
        top = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
        row = np.arange(len(live))[:, None]
        ids[live], near[live], done[live] = all_ids[row, top], all_near[row, top], all_done[row, top]
    order = np.argsort(-near, axis=1, kind="stable")
    return np.where(near[every[:, None], order] > -np.inf, ids[every[:, None], order], -1), near[every[:, None], order], seen[:, :n].sum(axis=1)


def diverse(unit: np.ndarray, near: np.ndarray, ids: np.ndarray, links: int) -> np.ndarray:
    """Up to ``links`` of each row's candidates (best first), skipping those nearer to a chosen one, filled up with the skipped."""
    q, k = ids.shape
    among = np.einsum("qad,qbd->qab", unit[ids], unit[ids])
    chosen = np.zeros((q, k), dtype=bool)
    for j in range(k):
        clash = (chosen & (among[:, :, j] > near[:, j : j + 1])).any(axis=1)
        chosen[:, j] = (ids[:, j] >= 0) & (near[:, j] > -np.inf) & ~clash & (chosen.sum(axis=1) < links)
    rank = np.where(chosen, np.arange(k), np.where((ids >= 0) & (near > -np.inf), k + np.arange(k), 3 * k))
    order = np.argsort(rank, axis=1)[:, :links]
    row = np.arange(q)[:, None]
    out = np.where(rank[row, order] < 3 * k, ids[row, order], -1)
    return np.pad(out, ((0, 0), (0, links - out.shape[1])), constant_values=-1)


def build(vectors: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH, batch: int = 128, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the top down, each (members, neighbours): rows of the level below, and a row of slots for each member."""
    unit = unit_rows(vectors)
    n = len(unit)
    height = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(links)).astype(int), 8)
    levels = []
    members = np.arange(n)
    level = 0
    while True:
        slots = links * 2 if level == 0 else links
        u = unit[members]
        graph = np.full((len(members), slots), -1, dtype=np.int32)
        begin = min(len(members), max(batch, slots))
        whole = u[:begin] @ u[:begin].T
        np.fill_diagonal(whole, -np.inf)
        order = np.argsort(-whole, axis=1, kind="stable")[:, : min(width, begin - 1)] if begin > 1 else np.zeros((begin, 0), int)
        if begin > 1:
            graph[:begin] = diverse(u, np.take_along_axis(whole, order, 1), order, slots)
        for a in range(begin, len(members), batch):
            own = np.arange(a, min(a + batch, len(members)))
            entry = np.random.default_rng(a).integers(0, a, size=(len(own), 4))
            entry = np.sort(entry, axis=1)
            entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = -1
            ids, near, _ = beam(u[:a], graph[:a].astype(np.int64), u[own], entry, width)
            inner = u[own] @ u[own].T
            np.fill_diagonal(inner, -np.inf)
            ids = np.concatenate([ids, np.broadcast_to(own, (len(own), len(own)))], axis=1)
            near = np.concatenate([near, inner], axis=1)
            order = np.argsort(-near, axis=1, kind="stable")[:, :width]
            ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
            graph[own] = diverse(u, near, ids, slots)
            to = graph[own].reshape(-1)
            back = np.repeat(own, slots)
            back, to = back[to >= 0], to[to >= 0]
            order = np.argsort(to, kind="stable")
            to, back = to[order], back[order]
            targets, start, count = np.unique(to, return_index=True, return_counts=True)
            most = int(count.max(initial=0))
            extra = np.full((len(targets), most), -1, dtype=np.int64)
            extra[np.repeat(np.arange(len(targets)), count), np.arange(len(to)) - np.repeat(start, count)] = back
            cand = np.concatenate([graph[targets].astype(np.int64), extra], axis=1)
            cand = np.sort(cand, axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            near = np.where(cand >= 0, np.einsum("qd,qkd->qk", u[targets], u[cand]), -np.inf)
            order = np.argsort(-near, axis=1, kind="stable")[:, : slots + 24]
            graph[targets] = diverse(u, np.take_along_axis(near, order, 1), np.take_along_axis(cand, order, 1), slots)
        levels.append((members.astype(np.int32), graph))
        level += 1
        up = np.flatnonzero(height[members] >= 1) if level == 1 else np.flatnonzero(height[members] >= level)
        if len(up) < 2 * links:
            return levels[::-1]
        members = members[up]


def search(vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, width: int = SEARCH_WIDTH, looked: list | None = None) -> np.ndarray:
    """Rows found for each query, best first, -1 for none; ``looked`` gets the share of all rows that each query was compared with."""
    unit, q = unit_rows(vectors), unit_rows(queries)
    top = levels[0][0]
    entry = np.broadcast_to(top[: min(8, len(top))].astype(np.int64), (len(q), min(8, len(top))))
    for k, (members, graph) in enumerate(levels):
        place = np.full(len(unit), -1, dtype=np.int64)
        place[members] = np.arange(len(members))
        start = np.where(entry >= 0, place[entry], -1)
        w = width if k == len(levels) - 1 else 16
        w = max(w, start.shape[1])
        ids, _, seen = beam(unit[members], graph.astype(np.int64), q, start, w)
        found = np.where(ids >= 0, members[ids], -1).astype(np.int64)
        entry = found[:, :8]
    if looked is not None:
        looked += (seen / len(unit)).tolist()
    return found


INDEX = "shard long, dim int, n int, rows binary, vectors binary, levels array<struct<members binary, neighbours binary>>"


def proper(vector: str) -> F.Column:
    """Whether a vector has a direction: not null, all components finite, one of them not 0."""
    return F.expr(f"coalesce({vector} is not null and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({vector}, x -> x <> 0), false)")


def build_index(vectors: DataFrame, key: str = "class", vector: str = "vector", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard; see ``INDEX``. ``vectors`` has distinct keys and proper vectors."""
    sized = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v"), F.size(vector).alias("dim"))
    counts = sized.groupBy("dim").count().collect()  # a row for each dimension
    shards = F.create_map(*[F.lit(x) for r in counts for x in (r["dim"], -(-r["count"] // shard_rows))]) if counts else F.create_map(F.lit(0), F.lit(1))
    dealt = sized.withColumn("shard", F.col("dim").cast("long") * DIMENSION + F.pmod(F.xxhash64("key"), F.element_at(shards, F.col("dim"))))

    def make(group):
        group = group.sort_values("key")
        v = np.stack(group["v"].to_numpy()).astype(np.float64)
        levels = [{"members": m.tobytes(), "neighbours": g.tobytes()} for m, g in build(v)]
        import pandas as pd

        return pd.DataFrame([{"shard": int(group["shard"].iloc[0]), "dim": v.shape[1], "n": len(v), "rows": group["key"].to_numpy(np.int64).tobytes(), "vectors": v.tobytes(), "levels": levels}])

    return dealt.groupBy("shard").applyInPandas(make, INDEX)


def search_index(index: DataFrame, queries: DataFrame, k: int, width: int = SEARCH_WIDTH) -> DataFrame:
    """(query_id, key, score): the best ``k`` keys that each shard finds for each query (query_id, vector).

    ``k`` is raised by ties: all equal to the k-th score stay. Queries of
    another dimension than a shard's don't reach it.
    """
    counts = index.groupBy("dim").agg(F.max("shard").alias("last")).collect()  # a row for each dimension
    last = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["dim"], r["last"])]), F.col("dim")) if counts else F.lit(None).cast("long")
    asked = queries.select("query_id", F.col("vector").alias("v"), F.size("vector").alias("dim")).withColumn("last", last).filter("last is not null")
    asked = asked.select(F.explode(F.sequence(F.col("dim").cast("long") * DIMENSION, "last")).alias("shard"), "query_id", "v")
    parts = [c for c in index.columns if c != "shard"]
    both = index.withColumn("query_id", F.lit(None).cast("long")).withColumn("v", F.lit(None).cast("array<double>")).unionByName(asked, allowMissingColumns=True)
    both = both.select("shard", "query_id", "v", *parts).repartition("shard").sortWithinPartitions("shard", F.col("query_id").asc_nulls_first())

    def run(batches):
        shard, held = None, None
        waiting: list = []

        def answers():
            ids, qv = np.array([i for i, _ in waiting], dtype=np.int64), np.array([v for _, v in waiting], dtype=np.float64)
            waiting.clear()
            vectors, keys, levels = held
            found = search(vectors, levels, qv, width)[:, : max(4 * k, 32)]
            who, at = np.nonzero(found >= 0)
            rows = found[who, at]
            score = exact_cosine(qv[who], vectors[rows])
            order = np.lexsort((keys[rows], -score, who))
            who, rows, score = who[order], rows[order], score[order]
            first = np.searchsorted(who, np.arange(len(found)))
            place = np.arange(len(who)) - first[who]
            kth = score[np.minimum(first + k - 1, np.searchsorted(who, np.arange(len(found)), side="right") - 1)]
            keep = (place < k) | (score == kth[who])
            return pa.RecordBatch.from_arrays([pa.array(ids[who[keep]]), pa.array(keys[rows[keep]]), pa.array(score[keep])], names=["query_id", "key", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["query_id"] is None:  # a shard, before its queries
                    if waiting:
                        yield answers()
                    levels = []
                    for x in r["levels"]:
                        m = np.frombuffer(x["members"], dtype=np.int32)
                        levels.append((m, np.frombuffer(x["neighbours"], dtype=np.int32).reshape(len(m), -1)))
                    shard, held = r["shard"], (np.frombuffer(r["vectors"], dtype=np.float64).reshape(r["n"], r["dim"]), np.frombuffer(r["rows"], dtype=np.int64), levels)
                elif r["shard"] == shard:  # a number without a vector may have no shard
                    waiting.append((r["query_id"], r["v"]))
                    if len(waiting) == QUERY_BLOCK:
                        yield answers()
        if waiting:
            yield answers()

    return in_arrow(both, run, "query_id long, key long, score double")


def nearest(table_: DataFrame, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query row's ``k`` nearest other rows by cosine: (query_id, rank, id, score).

    Ties go to the smaller id; fewer candidates give fewer rows. Rows with a
    null id or without a direction (null, zero, or a component null or not
    finite) take no part; vectors only meet those of their dimension. Repeated
    rows count once, and of rows that share an id each vector counts.
    """
    rows = table_.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asked")).filter(F.col("id").isNotNull() & proper("vector")).distinct()
    # A class is a distinct vector, named by its smallest id; its k + 1 smallest ids suffice for any answer.
    rows = rows.withColumn("hash", F.xxhash64("vector"))
    salted = W.partitionBy("hash", "vector", F.pmod(F.xxhash64("id"), F.lit(16))).orderBy("id")
    few = rows.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k + 1).drop("r")
    members = cut(few.withColumn("r", F.row_number().over(W.partitionBy("hash", "vector").orderBy("id"))).filter(F.col("r") <= k + 1).select("id", "vector", "hash", "r"))
    firsts = members.filter("r = 1").select(F.col("id").alias("class"), "vector", "hash")
    by_class = members.select("id", "vector", "hash").join(firsts, ["hash", "vector"]).select("class", "id")
    # Rows that share an id have classes of their own, so classes are numbered by id and hash.
    names = firsts.withColumn("key", F.xxhash64("class", "hash"))
    queries = rows.filter("asked").select(F.col("id").alias("query_id"), "vector")
    index = cut(build_index(names.select("key", "vector"), "key"))
    found = cut(search_index(index, queries, k + 1))
    ids = members.select("id", "hash", "vector").join(names.select("hash", "vector", "key"), ["hash", "vector"]).select("key", "id")
    hits = found.join(ids, "key").filter("id <> query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
