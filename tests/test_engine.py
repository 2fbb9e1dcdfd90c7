"""Operators on small fixtures."""

import json
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import queries
from quarry.functions import geo, paths, text
from quarry.operators import ads, conditions, expression, facets, querylang, ranking, scoring, similar, sorting, suffix, suggest
from quarry.plans import render
from quarry.plans.request import SearchRequest
from quarry.plans.schema import CollectionSchema, Property
from quarry.plans.search import search
from quarry.sources import postings, scd, store
from quarry.sources.collections import Collections, Watched, custom_ranks, merchant_scores
from quarry.streaming import pipelines


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [("   test", "test"), ("(  hello  |   world  )", "(hello|world)"), ("{  test  case } ^ 12(month case)", "({test case}^12&(month&case))"), ("(bracket close)(open space)", "((bracket&close)&(open&space))"), ("a\\&b", "a&b"), ("", "*"), ("!x y", "(!x&y)"), ("a#b", "(a#b)")])
def test_query_language(raw, want):
    assert str(querylang.parse(raw)) == want


@pytest.mark.parametrize("raw", ["(a", "a)", '"', "[]", "|a"])
def test_query_language_errors(raw):
    with pytest.raises(ValueError):
        querylang.parse(raw)


PHRASES = ["1 2 3 4 5 6", "1 2 3 4 5 8 9 10", "5 6 7 8 9 10 11", "9 10 10 10 13 14 15 16 10"]


@pytest.mark.parametrize("raw,want", [('"1 2"', {0, 1}), ('"1 3"', set()), ('"2 1"', set()), ('"1 2 4"', set()), ('"8 9 10"', {1, 2}), ("[1 3 5]", {0, 1}), ("[5 1]", set()), ("{1 4}^3", {0, 1}), ("{1 5}^3", set()), ("1*", {0, 1, 2, 3}), ("1?", {1, 2, 3}), ("1 !8", {0}), ("6|13", {0, 2, 3})])
def test_phrases(spark, raw, want):
    df = spark.createDataFrame(list(enumerate(PHRASES)), "id int, t string").withColumn("w", F.split("t", " "))
    for strict in (False, True):
        got = {r.id for r in df.filter(querylang.matches(querylang.parse(raw), F.col("w"), strict=strict)).collect()}
        assert got == want


def test_postings(spark, tmp_path):
    rows = [*enumerate(PHRASES), (4, None), (5, "1 1 2 8")]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("w", F.when(F.col("t").isNull(), F.array().cast("array<string>")).otherwise(F.split("t", " ")))
    index = postings.build(df, "id", F.col("w"), str(tmp_path / "i"), slots=4)
    for raw in ('"1 2"', '"1 2 4"', "[1 3 5]", "[5 1]", "{1 4}^3", "1*", "1?", "1 !8", "!8", "6|13", "6 | !9", "*", "nothere", "1#8#13"):
        node = querylang.parse(raw)
        stats = ranking.collect_stats(df, F.col("w"), node.terms())
        bounds = {w: ranking.bm25_bound(stats, w) for w in node.terms()}
        assert index.stats(node.terms()) == stats
        for strict in (False, True):
            want = {r.id for r in df.filter(querylang.matches(node, F.col("w"), bounds, strict=strict)).collect()}
            assert {r.key for r in index.match(node, strict).collect()} == want, raw
    for name in ("bm25", "kl", "plm", "none"):
        node = querylang.parse("1 | 2 | 10")
        stats = ranking.collect_stats(df, F.col("w"), node.terms())
        want = {r.id: r.s for r in df.filter(querylang.matches(node, F.col("w"))).select("id", ranking.model(name)(F.col("w"), node.terms(), stats).alias("s")).collect()}
        assert {r.key: r.score for r in index.match(node, score=name).collect()} == pytest.approx(want)
    assert {tuple(r) for r in index.scored(["1", "8"]).collect()} == {("1", 0, 1), ("1", 1, 1), ("8", 1, 1), ("8", 2, 1), ("1", 5, 2), ("8", 5, 1)}


def test_postings_are_grouped_in_their_rows(spark):
    rows = [(0, ["b", "a", "b", None, "c", "a", "b"]), (1, []), (2, ["a"]), (3, [str(k % 7) for k in range(500)])]
    df = spark.createDataFrame(rows, "id int, w array<string>")
    want = {(k, t, tuple(i for i, x in enumerate(w) if x == t), len(w)) for k, w in rows for t in w}
    for name in (F.xxhash64, lambda t: F.lit(7).cast("long"), lambda t: F.when(t == "a", -1).otherwise(5).cast("long")):  # also where words share a hash
        got = [(r.id, r.term, tuple(r.places), r.length) for r in df.select("id", F.inline(postings.grouped(F.col("w"), name))).collect()]
        assert len(got) == len(want) and set(got) == want
    each = postings.posted(df, "id", F.col("w"))
    assert {(r.key, r.length) for r in each.filter(F.col("slot") == postings.DOCUMENTS).collect()} == {(k, len(w)) for k, w in rows}
    assert "Exchange" not in each._jdf.queryExecution().executedPlan().toString()


def test_group_paths(spark):
    f = paths.group_paths(F.col("t"))
    assert one(spark, f, t="") == []
    assert one(spark, f, t=",,,;,;;,") == []
    assert one(spark, f, t="a,b;c") == [["a"], ["b"], ["c"]]
    assert one(spark, f, t="A>B>C, D >E>F") == [["A", "B", "C"], ["D", "E", "F"]]
    assert one(spark, f, t='"x,y">z') == [["x,y", "z"]]


def test_attributes(spark):
    got = one(spark, paths.attributes(F.col("t")), t="品牌:阿依莲,季节:春季|夏季|秋季,价格:2011,bad,:x")
    assert [(a["name"], a["values"]) for a in got] == [("品牌", ["阿依莲"]), ("季节", ["春季", "夏季", "秋季"]), ("价格", ["2011"])]


def test_dates_and_numbers(spark):
    f = F.date_format(paths.timestamp(F.col("t")), "yyyy-MM-dd HH:mm:ss")
    assert one(spark, f, t="20120704143015") == "2012-07-04 14:30:15"
    assert one(spark, f, t="2012-07-04") == "2012-07-04 00:00:00"
    assert one(spark, f, t="2012/07/04 01:02:03") == "2012-07-04 01:02:03"
    assert one(spark, f, t="no date") is None
    assert tuple(one(spark, paths.number_range(F.col("t")), t="9~-2.5")) == (-2.5, 9.0)
    assert tuple(one(spark, paths.number_range(F.col("t")), t="7")) == (7.0, 7.0)
    assert [paths.byte_size(x) for x in ("10", "1k", "1.5MB", "2g")] == [10, 1024, 1572864, 2 << 30]


def test_geo(spark):
    assert one(spark, geo.geohash(F.col("x0"), F.col("y0"), 6), x0=-5.6, y0=42.6) == "ezs42e"
    assert one(spark, geo.distance(F.col("x0"), F.col("y0"), 0.0, 0.0), x0=0.0, y0=90.0) == pytest.approx(np.pi * 6378137 / 2)
    assert one(spark, geo.distance(F.col("x0"), F.col("y0"), 0.0, 0.0), x0=999.0, y0=90.0) == pytest.approx(np.pi * 6378137)


def test_expression(spark):
    df = spark.createDataFrame([(2.0, 0.0)], ["price", "zero"])
    value = lambda t, **p: df.select(expression.expression(t, df.columns, p).alias("x")).first().x
    assert value("1 + p * price - -3 / (2 + 4)", p=2) == pytest.approx(5.5)
    assert value("POW(price, 3) + sqrt(q)", q="price") == pytest.approx(8 + 2**0.5)
    assert value("price / zero") is None
    assert value("log(zero)") is None
    for bad in ("1 +", "foo", "pow(1)", "1 2", "price; drop"):
        with pytest.raises(ValueError):
            value(bad)


def test_conditions(spark):
    df = spark.createDataFrame([(1, ["a", "b"], (1.0, 3.0)), (2, [], (5.0, 9.0)), (3, None, None)], "id int, tags array<string>, span struct<lo:double,hi:double>")
    ids = lambda t: [r.id for r in df.filter(conditions.condition(t, df.schema)).orderBy("id").collect()]
    assert ids([{"property": "tags", "operator": "=", "value": ["b"]}]) == [1]
    assert ids([{"property": "tags", "operator": "not_in", "value": ["b"]}]) == [2]
    assert ids([{"property": "span", "operator": "between", "value": [3, 5]}]) == [1, 2]
    assert ids([{"property": "span", "operator": ">", "value": [3]}]) == [2]
    assert ids([]) == [1, 2, 3]
    for bad in ({"property": "id", "operator": "~", "value": [1]}, {"property": "id", "operator": "between", "value": [1]}, {"property": "no", "operator": "=", "value": [1]}, {"relation": "xor", "condition_array": []}):
        with pytest.raises(ValueError):
            conditions.condition(bad, df.schema)


def test_drill_sideways(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "b", "y"), (5, None, "x")], "id int, g string, h string")
    hits, side = facets.drill_sideways(df, {"g": F.col("g") == "a", "h": F.col("h") == "x"})
    assert [r.id for r in hits.collect()] == [1]
    assert {r.id for r in side["g"].collect()} == {1, 3, 5}
    assert {r.id for r in side["h"].collect()} == {1, 2}


def test_hierarchy(spark):
    df = spark.createDataFrame([(1, [["A", "B"], ["A", "C"]]), (2, [["A", "B"]]), (3, [])], "id int, p array<array<string>>")
    got = {r.path: r["count"] for r in facets.hierarchy(df, "p").collect()}
    assert got == {"": 2, "A": 3, "A>B": 2, "A>C": 1}


def test_number_ranges():
    cells = [(0, c, n) for c, n in ((1, 5), (2, 9), (50, 4), (51, 4))] + [(1, 40, 7), (2, 11, 2), (3, 90, 1), (6, 99, 3)]
    got = facets.number_ranges(cells)
    assert len(got) <= 7 and sum(g[2] for g in got) == sum(c[2] for c in cells)
    assert all(a[1] < b[0] for a, b in zip(got, got[1:]))
    assert facets.number_ranges([]) == []
    # one range a segment, three more for the fullest; the last takes what is left
    assert facets.number_ranges([(0, 1, 4), (0, 5, 4), (0, 6, 4), (2, 10, 2)], 4) == [(10, 19, 4), (50, 59, 4), (60, 69, 4), (10000, 10999, 2)]
    assert facets.number_ranges([(0, 3, 100)], 7) == [(30, 39, 100)]


def test_rerank(spark):
    df = spark.createDataFrame([(i, i / 10, 1, [m]) for i, m in zip(range(1, 10), [1, 1, 1, 2, 2, 2, 3, 3, 3])], "doc_id int, rank_ double, offers int, m array<int>")
    out = scoring.product_rerank(df.withColumn("s", 1 - F.col("rank_") / 100), "s", 10.0, "offers", "m")
    assert [r.doc_id for r in out.orderBy("place").collect()] == [1, 4, 7, 2, 5, 8, 3, 6, 9]


def test_sorting(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 5), (4, 1)], "id int, v int")
    ids = lambda keys: [r.id for r in sorting.page(df, sorting.sort_columns(keys, ["v"], "id"), 0, 9).collect()]
    assert ids(["v"]) == [1, 4, 3, 2]
    assert ids([{"property": "v", "order": "DESC"}]) == [3, 2, 4, 1]
    assert ids(["unknown"]) == [4, 3, 2, 1]


def test_text(spark):
    assert one(spark, text.highlight(F.col("t"), ["cat"]), t="A Cat, concat") == "A <b>Cat</b>, concat"
    assert one(spark, text.snippet(F.col("t"), ["cat"]), t="One 10. A cat sat. Two. The cat ate.") == "A cat sat. ... The cat ate."
    assert one(spark, text.snippet(F.col("t"), ["dog"]), t="One 10. Two.") == "One 10."
    assert one(spark, text.summary(F.col("t"), 1), t="a b. a b c c. d.") == "a b c c."
    assert one(spark, text.bigrams(F.col("t")), t="中国人 abc 上") == ["中国", "国人", "abc", "上"]
    assert text.normalized_query("HTC one M7") == "htc m7 one"


def test_suffix(spark):
    df = spark.createDataFrame([("red shoe",), ("blue shoe",), ("hat",)], "t string")
    assert {r.t for r in suffix.fuzzy_search(df, "t", {"red": 1.0, "shoe": 1.0}).collect()} == {"red shoe"}
    assert {r.t for r in suffix.fuzzy_search(df, "t", {"green": 1.0, "shoe": 1.0}, 0.4).collect()} == {"red shoe", "blue shoe"}
    assert one(spark, suffix.longest_suffix(F.col("t"), "old hat"), t="a hat") == 4
    assert suffix.relaxations([("a", 1.0), ("b", 3.0), ("c", 2.0)]) == [["a", "b", "c"], ["b", "c"], ["b"]]
    terms, _ = suffix.search_relaxed(lambda ts: df.filter(F.lit(True) if ts == ["shoe"] else F.lit(False)), [("shoe", 2.0), ("zzz", 1.0)])
    assert terms == ["shoe"]


def test_suggest(spark):
    q = spark.createDataFrame([("red shoe", 5), ("shoe red", 9), ("blue shoe", 7), ("red hat", 1)], "query string, freq long")
    assert [r.query for r in suggest.suggest(suggest.index_queries(q), ["red", "shoe"], 3).collect()] == ["shoe red", "blue shoe", "red hat"]
    assert suggest.correct(q, "red hst").first().correction == "red hat"
    assert suggest.correct(q, "shoe red").first() is None
    assert suggest.correct(q, "x", {"x": "y"}).first().correction == "y"


def test_ads(spark):
    assert ads.parse_targeting("a~{x, y}^b!~{z}") == [{"attr": "a", "negated": False, "values": ["x", "y"]}, {"attr": "b", "negated": True, "values": ["z"]}]
    rules = spark.createDataFrame([(1, "a~{10}"), (2, "a~{x}^b!~{y}"), (3, "c!~{q}"), (4, "c~{q}")], "ad_id int, rule string")
    assert {r.ad_id for r in ads.target(rules, {"a": ["10", "x"], "b": ["n"]}).collect()} == {1, 2, 3}
    m = ads.ClickModel()
    for _ in range(30):
        m.update(["good"], True)
        m.update(["bad"], False)
    assert m.predict(["good"]) > 0.8 > 0.2 > m.predict(["bad"])
    u, i = ads.learn_factors(np.ones(4), np.ones(4) * 0.1, True)
    assert u @ i > 0.4
    c = spark.createDataFrame([(i, i / 10) for i in range(10)], "ad_id int, ctr double")
    got = ads.select_ads(c, 6, 1)
    assert got.count() == 6 and got.filter("not explored").count() == 3


def test_scd(spark, tmp_path):
    assert scd.parse_name("B-00-200912311000-11111-I-C.SCD")["kind"] == "insert"
    assert scd.parse_name("x/b-01-200912311000-11111-d-c.scd")["kind"] == "delete"
    with pytest.raises(ValueError):
        scd.parse_name("B-00-200912311000-11111-X-C.SCD")
    (tmp_path / "B-00-200912311000-11111-I-C.SCD").write_text("<DOCID>1\n<Title>one\nmore\n<Content>c1\n<DOCID>2\n<Title>two\n<Content>\n")
    (tmp_path / "B-00-200912311001-11111-U-C.SCD").write_text("<DOCID>1\n<Title>new\n<DOCID>3\n<Title>three\n")
    (tmp_path / "B-00-200912311002-11111-D-C.SCD").write_text("<DOCID>2\n")
    (tmp_path / "notes.txt").write_text("<DOCID>9\n")
    got = {r.DOCID: (r.fields, r.kind) for r in scd.merge(scd.read(spark, str(tmp_path))).collect()}
    assert got["1"] == ({"Title": "new", "Content": "c1"}, "insert")
    assert got["2"][1] == "delete" and got["3"] == ({"Title": "three"}, "update") and "9" not in got


def test_store(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "k int, t string, n int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", None)], "k int, t string, n int")
    assert {tuple(r) for r in store.upsert(old, new, "k").collect()} == {(1, "a", 1), (2, "b", 5), (3, "c", None)}
    assert {tuple(r) for r in store.update_kinds(old, new, "k", ["n"]).collect()} == {(2, "RTYPE"), (3, "INSERT")}
    c = Collections(spark, str(tmp_path / "c"))
    assert c.names() == [] and c.write("x", old) == 1 and c.write("x", new) == 2
    assert c.read("x").count() == 2 and c.versions("x") == [1, 2]
    c.drop("x")
    assert c.versions("x") == []


def test_streaming(spark, tmp_path):
    events = spark.createDataFrame([(1, "u", True, 1), (2, "v", False, 1), (1, "w", True, 2)], "k int, t string, clicked boolean, s int")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    c = Collections(spark, str(tmp_path / "c"))
    stream = pipelines.file_stream(spark, str(tmp_path / "in"), events.schema)
    q = pipelines.start_upserts(stream, c, "x", "k", ["s"], str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert {(r.k, r.t) for r in c.read("x").collect()} == {(1, "w"), (2, "v")}
    r = pipelines.click_rates(pipelines.file_stream(spark, str(tmp_path / "in"), events.schema), "k", "clicked")
    q = r.writeStream.outputMode("update").format("memory").queryName("rates").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.awaitTermination(60)
    assert {(r.k, r.views, r.clicks) for r in spark.table("rates").collect()} == {(1, 2, 2), (2, 1, 0)}


def test_search(spark):
    df = spark.createDataFrame([(1, "red shoe", "A>B", 5.0), (2, "blue shoe", "A>C", 7.0), (3, "red hat", "D", 9.0)], "id int, title string, cat string, price double")
    schema = CollectionSchema.of("c", "id", df)
    r = search(df, schema, {"search": {"keywords": "red | shoe", "in": ["title"]}, "group": [{"property": "price"}], "range": {"property": "price"}, "sort": [{"property": "price", "order": "DESC"}], "select": [{"property": "title", "highlight": True}], "limit": 2})
    assert [(x.id, x.title) for x in r.page.collect()] == [(3, "<b>red</b> hat"), (2, "blue <b>shoe</b>")]
    assert tuple(r.totals.first()) == (3, 5.0, 9.0)
    r = search(df, schema, {"search": {"keywords": "*", "group_label": [{"property": "cat", "value": ["A"]}]}, "group": [{"property": "cat"}]})
    assert r.hits.count() == 2 and {(x.value, x.level, x["count"]) for x in r.facets["cat"].collect()} == {("A", 1, 2), ("A>B", 2, 1), ("A>C", 2, 1), ("D", 1, 1)}
    r = search(df, schema, {"search": {"group_label": [{"property": "cat", "value": ["A", "B"]}, {"property": "cat", "value": ["D"]}, {"property": "price", "value": [5, 9]}]}, "group": [{"property": "price", "range": True}, {"property": "price"}], "pinned": [2]})
    assert {x.id for x in r.hits.collect()} == {1, 3} and {"low", "high"} <= set(r.facets["price"].columns)
    r = search(df, schema, {"search": {"keywords": "hat", "in": ["title"]}, "pinned": [2], "select": ["title"]})
    assert {(x._id, x.title) for x in r.page.collect()} == {(2, "blue shoe"), (3, "red hat")}
    assert {x.id for x in search(df, schema, {"search": {"keywords": "red shoe", "mode": "zambezi", "in": ["title"]}}).hits.collect()} == {1}
    assert {(x.id, x._rank) for x in search(df, schema, {"search": {"keywords": "red shoe", "mode": "zambezi", "algorithm": "mbwand", "in": ["title"]}}).hits.collect()} == {(1, 2.0), (2, 1.0), (3, 1.0)}
    assert [x.cat for x in search(df, schema, {"select": [{"property": "cat", "split_property_value": True}], "limit": 1}).page.collect()] == [[["D"]]]
    for bad in ({"mode": "ad_index"}, {"mode": "zambezi", "algorithm": "none"}):
        with pytest.raises(ValueError):
            search(df, schema, {"search": bad})
    for mode in ("or", "wand", "suffix", "verbose"):
        assert search(df, schema, {"search": {"keywords": "red shoe", "mode": mode, "in": ["title"]}}).hits.count() >= 1
    with pytest.raises(ValueError, match="nope"):
        search(df, schema, {"search": {"keywords": "("}, "select": ["nope"]})
    with pytest.raises(ValueError):
        SearchRequest.from_json({"serch": {}})
    with pytest.raises(ValueError):
        CollectionSchema("x", "id", (Property("id"), Property("id")))


def test_dictionaries(spark):
    assert one(spark, text.segment(F.col("t"), ["中国", "中国人", "人民"]), t="中国人民 ABC1好") == ["中国人", "民", "abc1", "好"]
    df = spark.createDataFrame([(1, [("c", ["red", "red"])]), (2, [("c", ["blue"])])], "id int, a array<struct<name:string,values:array<string>>>")
    w = spark.createDataFrame([("c", "red", 2.0)], "name string, value string, weight double")
    assert [tuple(r) for r in facets.attribute_scores(df, "a", w).collect()] == [("c", "red", 4.0)]
    hits = spark.createDataFrame([(1, "m", ["A", "B"]), (2, "m", ["C"]), (3, "n", ["A"])], "id int, m string, p array<string>")
    scores = spark.createDataFrame([("m", None, 1.0), ("m", "A", 5.0)], "merchant string, category string, score double")
    assert {r.id: r.merchant_score for r in scoring.merchant_score(hits, "p", "m", scores).collect()} == {1: 5.0, 2: 1.0, 3: 0.0}
    assert scoring.boost_labels([["a"]], [["a"], ["b"]], [["c"]], 2) == [["a"], ["b"]]


def test_whole_table_queries_against_plain_code(spark, tmp_path):
    texts = ["The end of it", "thé the_of OF, of", "éthe theé ofß of9 the", "the the\nof\tthe", "of. The-of", "", None, "在the中 the。of", "HTC one\nM7", "b  a\u00a0c\u3000Äa a"]
    spark.createDataFrame([(k, t, [None, "en", "de"][k % 3]) for k, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def tagged(t):
        if t is None:
            return None
        out, i = "", 0
        while i < len(t):
            inside = i > 0 and unicodedata.category(t[i - 1])[0] in "LN"
            for w in ("the", "of"):
                end = i + len(w)
                if not inside and t[i:end].lower() == w and not (end < len(t) and unicodedata.category(t[end])[0] in "LN"):
                    out, i = f"{out}<b>{t[i:end]}</b>", end
                    break
            else:
                out, i = out + t[i], i + 1
        return out

    def bag(t):
        if t is None:
            return None
        words, word = [], ""
        for c in t.lower() + " ":
            if not c.isspace():
                word += c
            elif word:
                words.append(word)
                word = ""
        return " ".join(sorted(words))

    assert {r.doc_id: r.text for r in queries.QUERIES["highlighted"](spark, str(tmp_path)).collect()} == {k: tagged(t) for k, t in enumerate(texts)}
    assert {r.item_id: r.norm for r in queries.QUERIES["normalized"](spark, str(tmp_path)).collect()} == {k: bag(t) for k, t in enumerate(texts)}


def test_search_options(spark):
    df = spark.createDataFrame([(1, "red shoe", "leather", 5), (2, "blue shoe", "red cloth", 7), (3, "green hat", "wool", 9), (4, "green hat", "straw", 5)], "id int, title string, body string, size int")
    base = CollectionSchema.of("c", "id", df)
    schema = CollectionSchema("c", "id", (*base.properties, Property("all", parts=("title", "body"))))
    ids = lambda request, **more: {r.id for r in search(df, schema, request, **more).hits.collect()}
    assert ids({"search": {"keywords": "red cloth", "in": ["all"]}}) == {2}
    assert ids({"search": {"keywords": "9", "in": ["title", "size"]}}) == {3}
    assert ids({"search": {"keywords": "red hat", "in": ["title"], "query_prune": True}}) == {1} and ids({"search": {"keywords": "red hat", "in": ["title"]}}) == set()
    assert ids({"search": {"keywords": "nothing here", "in": ["title"], "query_prune": True}}) == set()
    assert ids({"search": {"keywords": "shoe | hat", "in": ["title"]}, "remove_duplicated_result": ["title"]}) == {1, 2, 3}
    ranks = lambda **s: {r.id: r._rank for r in search(df, schema, {"search": {"keywords": "shoe", "in": ["title"], **s}}).hits.collect()}
    assert ranks(rank_keywords=["blue"])[2] > ranks()[2] and ranks(rank_keywords=["blue"])[1] == pytest.approx(ranks()[1])
    assert set(ranks(search_only=["shoe"]).values()) == {0.0}
    assert ranks(personal={"red": 2.0})[1] == pytest.approx(ranks()[1] + 0.2)
    clicks = spark.createDataFrame([("*", "5"), ("*", "5"), ("*", "9")], "query string, label string")
    assert ids({"search": {"keywords": "*", "group_label": [{"property": "size", "auto_select": 1}]}}, clicks=clicks) == {1, 4}
    order = [r.id for r in search(df, schema, {"search": {"random_seed": 3}}).page.collect()]
    assert sorted(order) == [1, 2, 3, 4] and order == [r.id for r in search(df, schema, {"search": {"random_seed": 3}}).page.collect()]
    with pytest.raises(ValueError):
        search(df, schema, {"search": {"group_label": [{"property": "size"}]}})


def test_scores(spark):
    assert one(spark, scoring.exponent(F.col("v"), 0, 10, 2.0), v=50.0) == pytest.approx((np.exp(5) - 1) / (np.exp(5) + 1))
    assert one(spark, scoring.exponent(F.col("v"), 0, 10, 2.0), v=0.0) == 0
    df = spark.createDataFrame([(1, 2.0), (2, 4.0)], "id int, v double")
    table = scoring.popularity_table(df, "id", [(F.col("v"), 0.5), (scoring.min_max(F.col("v"), 2, 4), 1.0)])
    assert {r.id: r.popularity for r in scoring.with_popularity(spark.createDataFrame([(1,), (2,), (3,)], "id int"), table, "id").collect()} == {1: 1.0, 2: 3.0, 3: 0.0}
    assert 0 <= one(spark, scoring.random_score(F.col("k"), 1), k=7) < 1
    assert one(spark, scoring.average([F.col("a"), F.col("b")]), a=1.0, b=3.0) == 2.0
    assert (one(spark, paths.round_down(F.col("v"), 10), v=19), one(spark, paths.round_up(F.col("v"), 10), v=11)) == (10, 20)


def test_tokenizers(spark):
    assert one(spark, text.ngrams(F.col("t")), t="abcd x") == ["ab", "bc", "cd", "abc", "bcd", "x"]
    assert one(spark, text.matrix(F.col("t"), 2), t="abc") == ["a", "b", "c", "ab", "bc"]
    assert one(spark, text.without(text.words(F.col("t")), ["The"]), t="The cat the hat") == ["cat", "hat"]
    assert one(spark, text.md5_id(F.col("t")), t="a") == "0cc175b9c0f1b6a831c399e269772661"
    assert [tuple(x) for x in one(spark, text.attribute_tokens(F.col("t"), {"red shoe": 5, "red": 2}), t="Red shoe, red hat")] == [("red shoe", 5), ("red", 2)]


def test_documents_by_key(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "a", 2)], "id int, t string, n int")
    assert {r.id for r in store.get(df, {"property": "t", "value": ["a"]}).collect()} == {1, 3}
    assert {r.id for r in store.get(df, {"property": "id", "operator": "in", "value": [2, 3, 9]}).collect()} == {2, 3}
    with pytest.raises(ValueError):
        store.get(df, {"property": "id", "operator": ">", "value": [1]})
    assert {r.id for r in store.get_by_ids(df, "id", spark.createDataFrame([(3,), (3,)], "id int")).collect()} == {3}
    assert {tuple(r) for r in store.without_duplicates(df, ["t"], "id").collect()} == {(1, "a", 1), (2, "b", 1)}
    names = scd.write_kind(df.select(F.col("id").alias("DOCID"), F.col("t").alias("Title")).coalesce(1), str(tmp_path / "in"), "update")
    assert [scd.parse_name(n)["kind"] for n in names] == ["update"]
    records = scd.read(spark, str(tmp_path / "in"))
    scd.write_index(records, str(tmp_path / "index"), slots=4)
    assert {(r.DOCID, r.kind, r.fields["Title"]) for r in scd.look_up(spark, str(tmp_path / "index"), ["1", "3", "7"], slots=4).collect()} == {("1", "update", "a"), ("3", "update", "a")}


def test_settings(spark, tmp_path):
    c = Collections(spark, str(tmp_path / "c"))
    scores = merchant_scores(c)
    schema = "merchant string, category string, score double"
    scores.set(spark.createDataFrame([("m", None, 1.0), ("m", "A", 2.0)], schema))
    scores.set(spark.createDataFrame([("m", None, 5.0)], schema))
    assert {tuple(r) for r in scores.get(merchant="m").collect()} == {("m", None, 5.0), ("m", "A", 2.0)}
    ranks = custom_ranks(c)
    ranks.set(spark.createDataFrame([("q", [1, 2], [3])], "query string, pinned array<int>, excluded array<int>"))
    assert ranks.get(query="q").first().pinned == [1, 2] and ranks.get(query="x").count() == 0
    path = tmp_path / "words.txt"
    path.write_text("a")
    watched = Watched(spark, str(path), lambda s, p: [r.value for r in s.read.text(p).collect()])
    assert watched.get() == ["a"]
    path.write_text("b\nc")
    assert watched.get() == ["b", "c"]


def test_correction_ladder(spark):
    q = spark.createDataFrame([("shoes red", 5), ("shoe rack", 8), ("nite", 4), ("night", 3), ("shoes", 1)], "query string, freq long")
    assert suggest.correct(q, "shoes ").first().correction == "shoes red"
    sounds = spark.createDataFrame([("nite", "nait"), ("night", "nait"), ("shoes", "shuz")], "query string, sound string")
    assert suggest.correct(q, "nite", sounds=sounds).first().correction == "night"
    assert {r.query for r in suggest.allowed(q, q.filter("freq < 4")).collect()} == {"shoes red", "shoe rack", "nite"}


def test_click_models_go_on(spark, tmp_path):
    assert ads.parse_disjunction("a~{x}|b!~{y}^c~{z}") == [[{"attr": "a", "negated": False, "values": ["x"]}], [{"attr": "b", "negated": True, "values": ["y"]}, {"attr": "c", "negated": False, "values": ["z"]}]]
    rules = spark.createDataFrame([(1, "a~{q}|b~{n}"), (2, "a~{q}|c~{z}")], "ad_id int, rule string")
    assert {r.ad_id for r in ads.target(rules, {"a": ["x"], "b": ["n"]}).collect()} == {1}
    log = spark.createDataFrame([("k", k, ["f", "g"] if k % 2 else ["f"], k % 2 == 1) for k in range(12)], "by string, at int, features array<string>, clicked boolean")
    values = lambda t: {(r.feature, k): r[k] for r in t.collect() for k in ("mean", "variance")}
    whole = values(ads.train_click_models(log, "by", "at"))
    first = ads.train_click_models(log.filter("at < 5"), "by", "at")
    assert values(ads.train_click_models(log.filter("at >= 5"), "by", "at", models=first)) == pytest.approx(whole)
    c = Collections(spark, str(tmp_path / "c"))
    log.filter("at < 5").coalesce(1).write.parquet(str(tmp_path / "in"))
    for part in ("at < 5", "at >= 5"):
        if part == "at >= 5":
            log.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        pipelines.start_click_models(pipelines.file_stream(spark, str(tmp_path / "in"), log.schema), c, "models", "by", "at", str(tmp_path / "ck")).awaitTermination(60)
    assert values(c.read("models")) == pytest.approx(whole)


def test_similar(spark):
    rows = [(k, t.split()) for k, t in enumerate(["a b c d e f g h", "a b c d e f g x", "q w e r t y u i", ""])]
    df = spark.createDataFrame(rows, "id int, w array<string>").withColumn("s", similar.simhash(F.col("w")))
    marks = {r.id: r.s for r in df.collect()}
    votes = {k: [xxhash64_bits(spark, w) for w in ws] for k, ws in rows}
    for k, hashes in votes.items():
        assert marks[k] == sum(1 << b for b in range(similar.BITS) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert [r.id for r in similar.nearest(df, "s", marks[0], 2, "id").collect()] == [0, 1]
    assert [r.id for r in similar.nearest(df, "s", marks[0], 9, "id", most=0).collect()] == [0]


def xxhash64_bits(spark, word):
    return spark.range(1).select(F.xxhash64(F.lit(word)).alias("x")).first().x % (1 << 64)


def test_render(spark):
    df = spark.createDataFrame([(1, "A>B", None), (2, "A", 2.0)], "id int, cat string, price double")
    out = json.loads(render.response(search(df, CollectionSchema.of("c", "id", df), {"group": [{"property": "cat"}, {"property": "price"}], "sort": ["id"], "select": ["cat", "price"]})))
    assert out["total_count"] == 2 and [(r["_id"], r.get("price")) for r in out["resources"]] == [(1, None), (2, 2.0)]
    assert out["group"] == {"cat": [{"label": "A", "count": 2, "sub_labels": [{"label": "B", "count": 1, "sub_labels": []}]}], "price": [{"value": "2.0", "count": 1}]}


def test_small_parsers(spark):
    assert one(spark, paths.merchant_names(F.col("t")), t=" a, b;a ,;c d") == ["a", "b", "c d"]
    assert one(spark, querylang.signs_like(F.col("t"), "b?d*g"), t="A BC d ef G") is True and one(spark, querylang.signs_like(F.col("t"), "b?g"), t="abcd g") is False
    df = spark.createDataFrame([(i, float(i), 1, [1]) for i in range(30)], "doc_id int, s double, offers int, m array<int>")
    places = lambda seed: [r.doc_id for r in scoring.product_rerank(df, "s", 100.0, "offers", "m", random_seed=seed).orderBy("place").collect()]
    assert places(1) == places(1) != places(2) and sorted(places(1)) == list(range(30))
