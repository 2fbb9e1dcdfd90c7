"""Corpus operators against plain code, with odd rows."""

import hashlib
import itertools
import random
import re
import string
import tempfile
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, hnsw, imatch, langid, licenses, line_dedup, linking, packing, pieces, shingle_join, toxicity, url_graph

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string"
rng = random.Random(5)
VOCAB = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def corpus():
    """Texts with near and exact copies, nulls, empties, repeats and a long one."""
    base = [prose(rng.randint(5, 80)) for _ in range(40)]
    rows = list(enumerate(base))
    for t in base[:12]:
        w = t.split()
        for _ in range(3):
            w2 = list(w)
            w2[rng.randrange(len(w2))] = "changed"
            rows.append((len(rows), " ".join(w2)))
    rows += [(len(rows), base[0]), (len(rows) + 1, None), (len(rows) + 2, ""), (len(rows) + 3, " \n\t "), (len(rows) + 4, "one two"), (len(rows) + 5, "One  TWO"), (len(rows) + 6, prose(3000)), (0, base[0])]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).withColumn("key", F.lit(1)).withColumn("id", F.lit("x")).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


# 1 fingerprints


def test_imatch(spark, docs, empty):
    import xxhash

    def spark_hash(*values):
        seed = 42
        for v in values:
            raw = v.encode() if isinstance(v, str) else v.to_bytes(4 if abs(v) < 100 else 8, "little", signed=True)
            seed = xxhash.xxh64_intdigest(raw, seed)
        return seed - (1 << 64) if seed >> 63 else seed

    low, high, least = 0.5, 3.0, 3
    terms = imatch.lexicon(docs, low=low, high=high, least=least).scalar()
    out = {r.doc_id: r for r in imatch.fingerprints(docs, terms, "text", "f").collect()}
    words = {i: set(re.findall("[0-9a-z]+", lower(t))) for i, t in ROWS}
    df = {w: sum(w in set(re.findall("[0-9a-z]+", lower(t))) for _, t in ROWS) for w in set().union(*words.values())}
    known = {w for w, n in df.items() if n >= least and low <= np.log((len(ROWS) + 1) / n) <= high}
    assert 50 < len(known) < len(df)

    def subsets(own):
        """The terms of each subset that has one."""
        found = {}
        for t in sorted(spark_hash(w) for w in (own & known or own)):
            for k in range(imatch.FAMILIES):
                if spark_hash(t, 7) & (4**k - 1) == 0:
                    found.setdefault(k * imatch.SUBSETS + (spark_hash(t, 11 + k) % (1 << 64) >> 20) % imatch.SUBSETS, []).append(t)
        return found

    want = {i: subsets(w) for i, w in words.items()}
    whole = {}
    for i, r in out.items():
        assert [x >> 32 for x in r.f[1:]] == sorted(want[i])
        whole.setdefault(frozenset(words[i] & known or words[i]), set()).add(r.f[0])
    assert all(len(v) == 1 for v in whole.values()) and len({min(v) for v in whole.values()}) == len(whole)
    pairs = imatch.fingerprints(docs, terms, "text", "f").alias("x").crossJoin(imatch.fingerprints(docs, terms, "text", "f").alias("y")).select(F.col("x.doc_id").alias("i"), F.col("y.doc_id").alias("j"), F.col("x.f").alias("f"), F.col("y.f").alias("g"))
    for r in pairs.select("i", "j", imatch.likeness("f", "g").alias("x")).collect():
        a, b = want[r.i], want[r.j]
        assert r.x == pytest.approx(sum(a[k] == b.get(k) for k in a) / len(a.keys() | b.keys()) if a or b else 1.0)
    assert imatch.fingerprints(empty, imatch.lexicon(empty).scalar(), "text", "f").count() == 0


@pytest.mark.parametrize("ids", [[5, -7, 300, 1, 10**12, 257, 255, 256], [1], list(range(0, 9000, 7)), [3, 3, 3, None, None], [7] * 700 + [8] * 20 + [None] * 30])
def test_with_next(spark, ids):
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], DOCS).repartition(3)
    got = {r.text: r.next_text for r in imatch.with_next(df, "doc_id", ["text"]).collect()}
    key = {f"t{k}": -(10**15) if i is None else i for k, i in enumerate(ids)}
    path = ["t0"]
    while got[path[-1]] != "t0":
        path.append(got[path[-1]])
    # one round through all rows, which falls from the largest to the smallest key once
    assert len(got) == len(ids) == len(path) and sum(key[got[t]] < key[t] for t in path) <= 1


def test_next_of_nothing(spark, empty):
    assert imatch.with_next(empty, "doc_id", ["text"]).count() == 0


def test_edited(spark):
    df = spark.createDataFrame([("abcde", "XYZ"), ("é", "b"), ("", "q"), ("abcdef", "1")], "t string, n string")
    assert [r.e for r in df.select(imatch.edited_text("t", "n").alias("e")).collect()] == ["abcXY", "é", "", "abc1"]


# 2 urls


def test_urls(spark):
    link = lambda h: f'<a href="http://{h}/x">'
    rows = [
        (1, "http://a.com/en/1", link("b.org")), (2, "http://b.org/x", link("c.org")), (3, "http://c.org/y", None), (4, "http://good.net/de/1", link("kind.io") + "<a href='//KIND.io/z'>"),
        (5, "http://kind.io/", ""), (6, None, None), (7, "no url", link("a.com")), (8, "HTTP://Sub.Example.COM/en/7?x#y", ""), (9, "http://org/es/1", ""), (10, "http://x.io?://net/de/", ""), (10, "http://x.io?://net/de/", ""), (None, "http://evil.io/", link("a.com")),
    ]
    out = {(r.page_id, r.host): r for r in url_graph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1, "a.com"].rule == "com/en/" and out[1, "a.com"].verdict == "block"
    assert out[8, "sub.example.com"].rule == "example.com/en/7" and out[8, "sub.example.com"].path == "/en/7"
    assert out[9, "org"].rule == "org/es/" and out[10, "x.io"].rule is None and out[10, "x.io"].path == ""
    assert out[6, ""].verdict == out[7, ""].verdict == "allow" and out[7, ""].path == ""
    assert out[None, "evil.io"].verdict == "block" and out[None, "evil.io"].distrust > 0  # it links to a blocked host
    assert out[5, "kind.io"].trust > 0 and out[5, "kind.io"].verdict == "allow"


def test_propagation(spark):
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 1.0)]
    out = {r.host: (r.trust, r.distrust) for r in url_graph.propagate(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([("a", 3, 0), ("c", 0, 2)], "host string, allowed long, blocked long")).collect()}
    names, m = "abc", np.zeros((3, 3))
    for s, t, w in edges:
        m[names.index(s), names.index(t)] = w
    fwd, back = (m / m.sum(1, keepdims=True)).T, m / m.sum(0, keepdims=True)
    t = s1 = 0.15 * np.array([3.0, 0, 0])
    d = s2 = 0.15 * np.array([0, 0, 2.0])
    for _ in range(100):
        t, d = s1 + 0.85 * fwd @ t, s2 + 0.85 * back @ d
    for k, h in enumerate(names):
        assert out[h] == pytest.approx((t[k], d[k]), abs=5 * url_graph.TOLERANCE)


def test_urls_against_plain_code(spark):
    g = random.Random(8)
    hosts = ["a.com", "www.a.com", "b.org", "x.b.org", "deep.x.b.org", "good.net", "c.io", "d.io", "e.io", "shop.e.io", "f.dev", "com", "org"]
    paths = ["/en/1", "/de/2", "/es/3", "/en/7", "", "/?q=/en/"]
    rows = [(k, f"http://{g.choice(hosts)}{g.choice(paths)}", " ".join(f'<a href="https://{g.choice(hosts)}/p">' for _ in range(g.randint(0, 3)))) for k in range(80)]
    own = {k: (u.split("://")[1].split("/")[0], "/" + u.split("://")[1].partition("/")[2].partition("?")[0] if "/" in u.split("://")[1] else "") for k, u, _ in rows}
    weight = {}
    for k, _, html in rows:
        for h in set(re.findall(r"https://([^/]+)/", html)):
            if h != own[k][0]:
                weight[own[k][0], h] = weight.get((own[k][0], h), 0) + 1
    names = {h for h, _ in own.values()} | {b for _, b in weight}
    for h in sorted(names):
        up = h.partition(".")[2]
        if "." in up:
            for e in ((h, up), (up, h)):
                weight[e] = weight.get(e, 0) + 1

    def ruled(h, path):
        fits = [(len(t), t, what) for what, t in url_graph.RULES for name, _, rest in [t.partition("/")] if (h == name or h.endswith("." + name)) and path.startswith("/" + rest)]
        return max(fits)[1:] if fits else (None, None)

    rules = {k: ruled(*v) for k, v in own.items()}
    seeds = {0: {}, 1: {}}
    for k, (_, what) in rules.items():
        if what:
            d = seeds[what == "block"]
            d[own[k][0]] = d.get(own[k][0], 0) + 0.15
    final = {}
    for kind, base in seeds.items():
        total = {}
        for (a, b), w in weight.items():
            total[(a, b)[kind]] = total.get((a, b)[kind], 0) + w
        now = dict(base)
        for _ in range(80):
            new = dict(base)
            for (a, b), w in weight.items():
                x, y = (a, b) if kind == 0 else (b, a)
                new[y] = new.get(y, 0) + 0.85 * now.get(x, 0) * w / total[x]
            now = new
        final[kind] = now
    out = {r.page_id: r for r in url_graph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {what for _, what in rules.values()} == {None, "allow", "block"}
    for k, (h, path) in own.items():
        t, d = final[0].get(h, 0), final[1].get(h, 0)
        assert (out[k].host, out[k].path, out[k].rule) == (h, path, rules[k][0])
        assert (out[k].trust, out[k].distrust) == pytest.approx((t, d), abs=0.01)
        if rules[k][1] or abs(t - d) > 0.02:
            assert out[k].verdict == (rules[k][1] or ("block" if d > t else "allow"))


# 3 neighbours


def test_hnsw_recall():
    x = np.random.default_rng(1).normal(size=(6000, 32))
    looked = []
    found = hnsw.search(x, hnsw.build(x), x[:100], width=32, looked=looked)[:, :6]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = np.argsort(-(u[:100] @ u.T), axis=1)[:, :6]
    recall = np.mean([len(set(a) & set(b)) / 6 for a, b in zip(found.tolist(), truth.tolist())])
    print(f"recall {recall:.3f}, rows looked at {np.mean(looked):.3f}")
    assert recall >= 0.9 and np.mean(looked) < 0.25


def test_nearest(spark):
    g = np.random.default_rng(2)
    rows = [(i, g.normal(size=8).tolist()) for i in range(200)] + [(200 + i, [1.0] * 8) for i in range(30)]
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [1.0, None] * 4), (350, [1.0, 2.0]), (351, [2.0, 1.0]), (None, [1.0] * 8), rows[0], (400, [1e-300] * 8)]
    out = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got[350] == [(351, pytest.approx(0.8))] and 300 not in got
    assert [v for v, _ in got[200]] == [201, 202, 203, 204, 205]
    assert [v for v, _ in got[400]] == [200, 201, 202, 203, 204]
    good = {i: np.array(v, dtype=float) for i, v in rows if i is not None and i < 300}
    for q in (0, 50, 100, 150):
        near = sorted(((-float(good[q] @ v / np.linalg.norm(good[q]) / np.linalg.norm(v)), i) for i, v in good.items() if i != q))[:5]
        assert [i for _, i in near] == [i for i, _ in got[q]]
    assert hnsw.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_nearest_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 100)
    x = np.random.default_rng(5).normal(size=(700, 12)).round(3)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = hnsw.build_index(rows.select(F.col("vec_id").alias("class"), F.col("embedding").alias("vector")), shard_rows=100)
    assert index.count() == 7
    got = hnsw.search_index(index, rows.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 4).collect()
    best = {}
    for r in got:
        best.setdefault(r.query_id, []).append((-r.score, r.key))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = np.argsort(-(u @ u.T), axis=1, kind="stable")[:, :4]
    assert set(best) == set(range(0, 700, 3))
    assert np.mean([len({k for _, k in sorted(v)[:4]} & set(truth[q].tolist())) / 4 for q, v in best.items()]) > 0.97


# 4 toxicity


def test_index_is_exact():
    g = np.random.default_rng(3)
    vectors = []
    for _ in range(400):
        t = np.sort(g.choice(40, size=g.integers(1, 8), replace=False))
        w = g.random(len(t)) + 0.1
        vectors.append((t, w / np.linalg.norm(w)))
    dense = np.zeros((400, 40))
    for k, (t, w) in enumerate(vectors):
        dense[k, t] = w
    index = toxicity.Index.build(vectors, 40, block=16)
    for t, w in vectors[:80]:
        cosine = np.round(dense[:, t] @ w, 12)
        want = [k for k in np.lexsort((np.arange(400), -cosine))[:10] if cosine[k] > 0]
        best, _ = index.nearest(t, w, 10)
        assert best.tolist() == want


def test_toxicity(spark, empty):
    rows = [(i, prose(20) + (" scumbag idiotic " if i % 4 == 0 else "") + prose(20)) for i in range(400)] + [(900, None), (901, ""), (901, "")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(5000, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all((out[i].score >= 0.5) == (i % 4 == 0) for i in range(300, 400))
    assert out[300].neighbours and set(out[300].neighbours) <= set(range(0, 300, 4)) and 0 <= out[901].score < 0.5
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    assert toxicity.fit(docs, labels.filter("toxic = 0")).plain == 0.0


# 5 pieces


def test_pieces(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    signs = "aeiou  \n\tthTHE▁éß中文😀ﬁx12.,aaab"
    rows = ROWS + [(1000 + k, "".join(rng.choice(signs) for _ in range(rng.randint(1, 60)))) for k in range(200)] + [(2000, "  two  blanks "), (2001, "\x00"), (None, "x" * 5000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit(3))
    enc = pieces.encode(df.repartition(2), model)
    for r in pieces.decode(enc, model).join(enc.select("doc_id", "ids", "text"), ["doc_id", "text"]).collect():
        assert r.ids == sp.encode(r.text or "") and r.decoded == (r.text or "").replace("▁", " ")
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<i4").tobytes())
    odd = spark.createDataFrame([(1, None), (2, []), (3, [0, 1, 2]), (4, sp.encode("é")[1:])], "k long, ids array<int>")
    assert [r.decoded for r in pieces.decode(odd, model).orderBy("k").collect()] == [None, "", "", sp.decode(sp.encode("é")[1:])]


# 6 licenses


def licenses_query(spark, rows):
    folder = tempfile.mkdtemp()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    return licenses.op6_licenses(spark, folder).collect()


def test_licenses(spark):
    rows = ROWS + [(700, "The MIT License, the mit-license. APACHE license"), (701, "Under the GNU General Public License"), (702, "general public"), (703, prose(50) + " " + licenses.NOTICES[0][0].replace("without restriction", "with no limits") + " " + prose(50)), (704, "licensed under CC BY-NC 4.0."), (None, "MIT license"), (700, "The MIT License, the mit-license. APACHE license")]
    table, spans = licenses.scan(spark.createDataFrame(rows, DOCS).withColumn("at", F.lit(0)))
    found = spans.collect()
    places = lambda i: sorted((s.start, s.label) for s in found if s.id == i and s.base)
    assert places(700) == [(1, "mit"), (4, "mit"), (6, "apache")] and places(701) == [(3, "gpl")] and places(702) == [] and places(None) == [(0, "mit")]
    assert [(s.label, s.start) for s in found if s.id == 703] == [("mit", 50)] and [s.label for s in found if s.id == 704] == ["cc-by-nc"]
    assert table.count() == len(rows)
    base = {r.doc_id: r for r in [*licenses_query(spark, rows)]}
    for i, t in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
        at = [(k, label) for p, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        if i is not None and i != 0:
            assert (base[i].n_words, base[i].n_base, base[i].first_word, base[i].last_word, base[i].base_labels) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})))
            assert set(filter(None, base[i].base_labels.split(","))) <= set(filter(None, base[i].labels.split(","))) and 0 <= base[i].score <= 1
    n = {r.id: r.n_words for r in table.collect()}
    assert n[700] == 8 and all(n[i] == len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))) for i, t in rows)


# 7 near duplicates


def sets_of(text, size):
    w = re.findall(r"[^\x20\x09-\x0d]+", lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def brute_components(rows, size, percent):
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    s = {i: sets_of(t, size) for i, t in rows}
    for a, b in itertools.combinations(s, 2):
        same = len(s[a] & s[b])
        if same and 100 * same >= percent * (len(s[a]) + len(s[b]) - same):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s[i]), top(i)) for i in s}


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (2, 60)])
def test_near_duplicates(spark, docs, size, percent):
    out = shingle_join.near_duplicates(docs, size=size, percent=percent).collect()
    assert len(out) == len(ROWS)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(ROWS, size, percent)


def test_near_duplicates_by_a_null_id(spark):
    words = prose(100).split()
    changed = lambda k: " ".join(["new"] * k + words[k:])
    # 0 and 18 new words are too far apart, each is near 9 new words; the ids of that text are all null
    rows = [(1, changed(0)), (None, changed(9)), (None, changed(9)), (2, changed(18)), (None, prose(30)), (None, prose(30)), (3, prose(30))]
    out = shingle_join.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in out.collect()) == [("1", "1"), ("2", "1"), ("3", "3"), ("None", "1"), ("None", "1"), ("None", "None"), ("None", "None")]


def test_pipeline_drops_near_copies_only(spark):
    import corpus_pipeline

    texts = [prose(40) for _ in range(9)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2] + " end"), (7, texts[3]), (7, texts[4]), (7, texts[4]), (8, texts[2]), (5, texts[5]), (4, texts[5] + " end"), (None, None), (None, None), (9, ""), (None, texts[6]), (None, texts[6])]
    out = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, DOCS).repartition(3), "")
    want = [(None, texts[0]), (None, texts[1]), (7, texts[3]), (7, texts[4]), (8, texts[2]), (4, texts[5] + " end"), (None, None), (None, None), (9, ""), (None, texts[6])]
    assert out.columns == ["doc_id", "text"] and sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_pipeline_copies_no_texts_to_find_near_copies(spark):
    import corpus_pipeline

    texts = [prose(20000) for _ in range(20)]
    rows = [*enumerate(texts), (20, texts[3] + " end"), (5, texts[5]), (None, texts[7]), (21, None), (21, None)]
    docs = common.cut(spark.createDataFrame(rows, DOCS).repartition(3))
    folder = Path(common.shared_folder(spark).removeprefix("file:"))
    there = set(folder.glob("quarry-*"))
    out = corpus_pipeline.near_copies(spark, docs, "")
    written = sum(f.stat().st_size for d in set(folder.glob("quarry-*")) - there for f in d.glob("*.parquet"))
    held = sum(f.stat().st_size for f in Path(docs._quarry_path.removeprefix("file:")).glob("*.parquet"))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [*enumerate(texts), (21, None), (21, None)]))
    assert written < held / 2  # sets of the few texts that share a block are written, all texts aren't


def test_near_duplicates_of_nothing(spark, empty):
    assert shingle_join.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f g"), (4, "a b c d e f g"), (None, None)], DOCS)
    assert sorted(str(r.component_id) for r in shingle_join.near_duplicates(odd).collect()) == ["4", "4", "None"]


def test_blocks_lose_no_pair():
    g = np.random.default_rng(4)
    for n in (6, 7, 13, 40, 200):
        for _ in range(30):
            a = np.unique(g.integers(0, 1 << 60, size=n, dtype=np.uint64))
            apart = shingle_join.most_apart(len(a), 85)
            drop = int(g.integers(0, apart + 1))
            b = np.unique(np.concatenate([a[drop:], g.integers(0, 1 << 60, size=int(g.integers(0, apart - drop + 1)), dtype=np.uint64)]))
            same = len(np.intersect1d(a, b))
            if 100 * same < 85 * (len(a) + len(b) - same):
                continue
            keys, who = shingle_join.block_keys(np.concatenate([a, b]), np.array([len(a), len(b)]), 85)
            assert len(a) == same == len(b) or set(keys[who == 0]) & set(keys[who == 1])


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (103, 101), (102, 103), (50, 50), (101, 100)]
    got = {r.id: r.component for r in linking.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in (100, 101, 102, 103)}}


def test_few_edges_are_not_dealt_out(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(102, 103), (101, 102), (50, 50)], "a long, b long")
    want = {**{i: 0 for i in range(31)}, **{i: 101 for i in (101, 102, 103)}}
    context, tasks = spark.sparkContext, []
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for most in (linking.ONE_PARTITION, 0):
            monkeypatch.setattr(linking, "ONE_PARTITION", most)
            context.setJobGroup(f"edges {most}", "")
            assert {r.id: r.component for r in linking.components(edges).collect()} == want
            jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup(f"edges {most}")]
            stages = {s for j in jobs for s in j.stageIds}
            tasks.append(sum(i.numCompletedTasks for s in stages if (i := context.statusTracker().getStageInfo(s))))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks[0] < tasks[1] / 3


def test_bucket_groups(spark):
    # numbers link at most 3 apart; buckets of 40, so that no pivot is linked to all; 500 is near 501 and linked to nothing
    numbers = [*range(0, 60), 100, 101, 500, 501]
    rows = spark.createDataFrame([(k, n) for n in numbers for k in {n // 40, (n + 20) // 40 + 1000, 7777}], "key long, id long")
    info = spark.createDataFrame([(n, n) for n in numbers], "id long, at long")
    tries = []

    def verify(pairs):
        tries.extend((r.a, r.b) for r in pairs.collect())
        return pairs.filter("b - a <= 3 and a < 500")

    group = linking.bucket_groups(rows, verify, lambda ids: info.join(ids, "id"), lambda x, y: F.abs(F.col(f"{x}_at") - F.col(f"{y}_at")) <= 5)
    got = {r.id: r.component for r in group.collect()}
    assert {n: got.get(n, n) for n in numbers} == {**{n: 0 for n in range(60)}, 100: 100, 101: 100, 500: 500, 501: 501}
    assert len(tries) == len(set(tries))


def test_a_large_group_is_joined_without_all_pairs(spark):
    # 600 ids of one bucket, a tenth of whose pairs are links
    rows = spark.range(600).select(F.lit(1).cast("long").alias("key"), "id")
    tries = []

    def verify(pairs):
        tries.append(pairs.count())
        return pairs.filter("pmod(xxhash64(a, b), 10) = 0")

    group = linking.bucket_groups(rows, verify, lambda ids: ids.withColumn("at", F.lit(0)), lambda x, y: F.lit(True))
    assert {r.id: r.component for r in group.collect()} == dict.fromkeys(range(600), 0)
    assert sum(tries) < 600 * 599 / 2 / 3


def test_pairs_that_share_several_keys_are_made_once(spark):
    ids = range(50)
    near = lambda x, y: F.abs(F.col(f"{x}_at") - F.col(f"{y}_at")) < 20
    want = [(a, b) for a in ids for b in ids if a < b < a + 20 and a // 2 != b // 2]
    rows = spark.createDataFrame([(k, n, n // 2, n) for n in ids for k in range(-4, 4)], "key long, id long, component long, at long")
    assert sorted(map(tuple, linking.meetings(rows, near).collect())) == want
    # what two ids share lies beyond the keys beside their rows
    own = [(1000 * n + k - 10**6, n, n // 2, n) for n in ids for k in range(linking.BESIDE)]
    more = rows.unionByName(spark.createDataFrame(own, rows.schema))
    assert sorted({tuple(r) for r in linking.meetings(more, near).collect()}) == want


def test_a_large_group_meets_the_others_of_its_buckets_only(spark):
    # group 0 has most rows of each bucket but the last, where it's one of three equal ones; bucket 9 is one group
    rows = [(k, n, 0, n) for k in (1, 2, 3) for n in range(40)] + [(k, n, n // 2, n) for k in (1, 2) for n in range(40, 50)]
    rows += [(4, n, n, n) for n in (1, 60, 61)] + [(9, n, 7, n) for n in (70, 71)]
    rows = [(k, n, 0 if n < 40 else c, at) for k, n, c, at in rows]
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] != b[2] and b[3] - a[3] < 30}
    got = linking.meetings(spark.createDataFrame(rows, "key long, id long, component long, at long"), lambda x, y: F.abs(F.col(f"{x}_at") - F.col(f"{y}_at")) < 30)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_table_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllBlocks().mkString(" ").split() if x.startswith("shuffle_")}
    before = files()
    out = common.cut(spark.range(1000).selectExpr("id % 7 as k", "id").repartition(3).groupBy("k").agg(F.max("id").alias("m")))
    for _ in range(50):  # they go a little later
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and sorted(r.m for r in out.collect()) == list(range(993, 1000))
    assert spark.conf.get(common.CLEAN, "false") == "false"


def test_without(spark):
    rows = spark.range(500).withColumn("t", F.col("id") * 2)
    gone = spark.createDataFrame([(k,) for k in (3, 3, 77, 499, 1000)], "id long")
    want = [(k, 2 * k) for k in range(500) if k not in (3, 77, 499)]
    for size in (64, 1 << 20):  # 64 bits can't tell all rows apart
        assert sorted(map(tuple, common.without(rows, gone, "id", size).collect())) == want
    assert common.without(rows, gone.limit(0), "id").count() == 500


# 8 languages


def test_language(spark, empty):
    words = {"aa": ["bada", "gada", "rado", "mada"], "bb": ["kitu", "lipu", "miku", "situ"]}
    rows = [(i, " ".join(rng.choice(words["aa" if i % 2 else "bb"]) for _ in range(12)), "aa" if i % 2 else "bb") for i in range(200)]
    docs = spark.createDataFrame(rows + [(500, None, "aa"), (501, "", "aa"), (502, "123 ... !", "bb"), (503, "gada", None), (503, "gada", None)], "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(0))
    out = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.identify(docs, langid.fit(docs.filter("doc_id < 150"))).collect()}
    assert all(out[i][0] == ("aa" if i % 2 else "bb") for i in range(150, 200)) and out[503][0] == "aa"
    assert out[500] == out[501] == out[502] == ("und", 0.0)
    none = langid.fit(docs.filter("false"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(empty, none).count() == 0


# 9 packing


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    odd = ROWS + [(3000, "İstanbul <|endoftext|> x.y don't 12 ...\x1c a"), (None, "q")]
    out = packing.pack_documents(spark.createDataFrame(odd, DOCS).dropDuplicates(["doc_id"]), path).collect()
    texts = dict(odd)
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, parts in by_doc.items():
        ids = np.array([*tok.encode(texts[i] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        parts.sort(key=lambda r: r.start)
        assert [r.start for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist() and parts[-1].start + parts[-1].length == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for r in parts)
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        total = sum(r.length for r in parts)
        assert [r.offset for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist() and total <= 2048 and total & (total - 1) == 0
    assert packing.pack_documents(empty, path).count() == 0


def test_step_groups_and_tiers(spark):
    rows = [(k, prose(rng.choice([5, 40, 300, 2500]))) for k in range(220)]
    out = packing.pack_documents(spark.createDataFrame(rows, DOCS).repartition(2), P.path("word_bpe_49k.json"), step_tokens=16 * 2048).collect()
    sizes, groups, tiers = {}, {}, {}
    for r in out:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
        groups[r.sequence_id], tiers[r.sequence_id] = r.step_group, r.tier
    total, mix = {}, {}
    for s, n in sizes.items():
        total[groups[s]] = total.get(groups[s], 0) + n
        mix.setdefault(groups[s], []).append(tiers[s])
        assert n == tiers[s] or n & (n - 1) == 0
    for part in {g >> 40 for g in total}:
        own = [n for g, n in total.items() if g >> 40 == part]
        assert max(own) - min(own) <= 2048 and len(own) == max(1, round(sum(own) / (16 * 2048)))
        counts = [m.count(2048) for g, m in mix.items() if g >> 40 == part]
        assert max(counts) - min(counts) <= 1
    assert 2048 in tiers.values()
    assert {t for t, _ in packing.pack([(200, k, 0) for k in range(50)])[0]} == {256} and {t for t, _ in packing.pack([(n, n, 0) for n in (2000, 40, 800, 200, 100)])[0]} == {2048, 1024}
    assert packing.deal([], 10) == [] and packing.deal([4, 4, 2, 2], 6) == [0, 1, 0, 1]


def test_pack_is_full():
    g = random.Random(1)
    items = [(g.randint(1, 5000), k, 0) for k in range(300)]
    done, left = packing.pack(items)
    assert sum(n for n, _, _ in left) < 2048 and all(sum(p[0] for p in w) == t for t, w in done)
    assert sum(t for t, _ in done) + sum(n for n, _, _ in left) == sum(n for n, _, _ in items)


# 10 lines


def test_line_dedup(spark, empty):
    long = prose(120)
    near = " ".join([*long.split()[:-1], "other"])
    rows = [(1, f"{long}\nunique one here\n\n---"), (2, f"{near}\nunique two there\n\n---"), (3, f"UNIQUE one, here!\n{long}\nrest"), (4, None), (5, ""), (6, "rest"), (6, "rest"), (None, "null id line")]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_lines", F.lit("old")).withColumn("line", F.lit(2))
    out = sorted((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df).collect())
    got = {k: (t, n, m) for k, t, n, m in out}
    assert got["1"] == (rows[0][1], 4, 0) and got["3"] == ("rest", 3, 2) and got["4"] == (None, 0, 0) and got["5"] == ("", 1, 0) and got["6"] == ("", 1, 1) and got["None"] == ("null id line", 1, 0)
    assert got["2"][0] in ("unique two there\n\n---", rows[1][1]) and len(out) == len(rows)
    assert line_dedup.dedup_lines(empty).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_against_edit_similarity_alone(spark):
    draw = random.Random(11)
    words = lambda n: [draw.choice(VOCAB) for _ in range(n)]
    lines = []
    for n in (3, 4, 5, 9, 10, 11, 14, 18, 19, 23, 24, 30, 40, 80):
        for _ in range(8):
            base = words(n)
            lines.append(base)
            for change in range(3):
                w = list(base)
                for _ in range(draw.choice([n // 5, n // 5 + 1])):
                    at = draw.randrange(len(w))
                    w[at : at + (change != 1)] = [] if change == 2 and len(w) > 1 else [draw.choice(VOCAB)]
                lines.append(w)
    lines += [["same"] * n for n in (5, 6, 8, 30, 36, 50)] + [["a", "b"] * 10, ["b", "a"] * 10]
    draw.shuffle(lines)
    rows = [(k, "\n".join(" ".join(w) for w in lines[4 * k : 4 * k + 4])) for k in range(len(lines) // 4)]
    every = [(d, k, t.split()) for d, text in rows for k, t in enumerate(text.split("\n"))]
    parent = list(range(len(every)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(enumerate(every), 2):
        if abs(len(a[2]) - len(b[2])) <= 20 and edits(a[2], b[2]) <= 0.2 * max(len(a[2]), len(b[2])) + 1e-9:
            x, y = top(i), top(j)
            parent[max(x, y)] = min(x, y)
    gone = {(r.doc, r.line) for r in line_dedup.similar_lines(spark.createDataFrame(rows, DOCS)).collect()}
    want = {(d, k) for i, (d, k, _) in enumerate(every) if top(i) != i}
    print(f"recall of fuzzy lines at about the limit of similarity: {len(gone & want) / len(want):.3f}")
    assert gone <= want and len(want) > 100 and len(gone) >= 0.95 * len(want)
    removed = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert sum(removed.values()) == len(gone)


def test_hot_buckets_of_lines_are_divided(spark):
    """No pair that may be similar is lost where lines of a bucket meet by parts of their sketches, and few others meet."""
    rng, rows = random.Random(5), []
    for n in [*range(4, 48)] * 3:
        words = {rng.randrange(256) for _ in range(n)}
        for _ in range(4):
            changed = [rng.randrange(256) if rng.random() < 0.08 else w for w in words] + [rng.randrange(256) for _ in range(rng.randrange(2))]
            odd = {w for w in changed if changed.count(w) % 2}
            sketch = [sum(1 << (w & 63) for w in odd if w >> 6 == k) for k in range(4)]
            rows.append((1, len(rows), len(rows), len(changed), *(s - (1 << 64) if s >> 63 else s for s in sketch)))

    def near(x, y):
        n, m = F.col(f"{x}_n"), F.col(f"{y}_n")
        most = F.floor(F.lit(0.2 + 1e-9) * F.greatest(n, m))
        differ = sum((F.bit_count(F.col(f"{x}_s{k}").bitwiseXOR(F.col(f"{y}_s{k}"))) for k in range(4)), F.lit(0))
        return (F.abs(n - m) <= most) & (differ <= 2 * most - F.abs(n - m))

    df = spark.createDataFrame(rows, "key long, id long, component long, n int, s0 long, s1 long, s2 long, s3 long")
    want = {tuple(r) for r in linking.meetings(df, near).collect()}
    divided = F.expr(line_dedup.parts())
    assert {tuple(r) for r in linking.meetings(df, near, divided, hot=10).collect()} == want and len(want) > 200
    assert {tuple(r) for r in linking.meetings(df, near, divided, hot=1000).collect()} == want
    held = df.filter("n <= 26").select("id", F.explode(divided).alias("part")).distinct()
    met = held.join(held.withColumnRenamed("id", "other"), "part").filter("id < other").select("id", "other").distinct().count()
    few = df.filter("n <= 26").count()
    print(f"pairs that meet: {met} of {few * (few - 1) // 2}")
    assert met < 0.1 * few * (few - 1) / 2


def test_lines_are_split_once(spark):
    lines = line_dedup.raw_lines(spark.createDataFrame([(1, "One, two\n--- \u00b2\n\u24b6 -\nDR\u0130NK"), (2, None)], DOCS), "doc_id", "text")
    out = line_dedup.hashed(lines)
    assert sorted((r.doc, r.line, r.n) for r in out.collect()) == [(1, 0, 2), (1, 1, 1), (1, 3, 2)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(lower(") == 1


def test_pairs_of_lines_are_verified_exactly(spark):
    # words 1 and 1 + CHARACTERS become one character
    c = line_dedup.CHARACTERS
    words = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [1 + c, 2 + c, 3, 4, 5]), (3, [1 + c, 2, 3, 4, 5])], "id long, hs array<long>").withColumn("c", F.expr(line_dedup.characters(line_dedup.codes("hs"))))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    assert sorted((r.a, r.b) for r in line_dedup.similar_pairs(pairs, words).collect()) == [(1, 3), (2, 3)]


def test_digests(spark, tmp_path):
    df = spark.createDataFrame([(3, "abcd"), (9, "wxyz")], DOCS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in imatch.op1_imatch(spark, str(tmp_path)).collect()}
    assert out[3].edited_sha256 == hashlib.sha256(b"abwx").hexdigest() and out[9].edited_sha256 == hashlib.sha256(b"wxab").hexdigest() and out[3].n_chars == 4
