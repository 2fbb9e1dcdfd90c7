"""Queries over the driver's tables, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import geo, paths, text
from quarry.operators import ads, conditions, expression, facets, logs, querylang, ranking, scoring, similar, sorting, suffix, suggest
from quarry.plans.schema import CollectionSchema
from quarry.plans.search import search
from quarry.sources import postings, scd, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with SQL where SQL can say it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Requests


def _lineitem_request(spark: SparkSession, d: str):
    df = read(spark, d, "lineitem").withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return search(df, CollectionSchema.of("lineitem", "key", df), {
        "search": {"keywords": "*"}, "conditions": [{"property": "l_quantity", "operator": "between", "value": [10, 20]}],
        "group": [{"property": "l_returnflag", "sub_property": "l_linestatus"}], "range": {"property": "l_extendedprice"}, "count": [{"property": "l_linenumber"}],
        "sort": [{"property": "l_extendedprice", "order": "DESC"}], "limit": 20,
    })


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber DESC LIMIT 20")
def search_page(spark, d):
    return _lineitem_request(spark, d).page.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT count(*) AS total_count, min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice, CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def search_totals(spark, d):
    return _lineitem_request(spark, d).totals


@query("SELECT l_returnflag AS value, l_linestatus AS sub_value, count(*) AS count FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus))")
def search_sub_facet(spark, d):
    return _lineitem_request(spark, d).facets["l_returnflag"]


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') AND (p_size BETWEEN 1 AND 10 OR p_size = 40)")
def search_labels(spark, d):
    df = read(spark, d, "part")
    labels = [{"property": "p_brand", "value": ["Brand#11"]}, {"property": "p_brand", "value": ["Brand#12"]}, {"property": "p_size", "value": ["-10"]}, {"property": "p_size", "value": [40]}]
    return search(df, CollectionSchema.of("part", "p_partkey", df), {"search": {"group_label": labels}}).hits.select("p_partkey")


@query("WITH c AS (SELECT [r_name, n_name, c_mktsegment] AS p FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), n AS (SELECT unnest([1, 2, 3]) AS k) SELECT array_to_string(p[1:k], '>') AS value, CAST(k AS INTEGER) AS level, count(*) AS count FROM c, n GROUP BY 1, 2")
def search_tree(spark, d):
    joined = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    df = joined.select("c_custkey", F.concat_ws(">", "r_name", "n_name", "c_mktsegment").alias("place"))
    return search(df, CollectionSchema.of("customer", "c_custkey", df), {"group": [{"property": "place"}, {"property": "place", "unit": "ignored"}]}).facets["place"]


@query("SELECT low || '-' || (low + 9) AS value, CAST(low AS BIGINT) AS low, CAST(low + 9 AS BIGINT) AS high, count(*) AS count FROM (SELECT n_nationkey % 7 * 10 AS low FROM nation) GROUP BY low")
def search_ranges(spark, d):
    df = read(spark, d, "nation").withColumn("n", F.col("n_nationkey") % 7 * 10 + 5)
    return search(df, CollectionSchema.of("nation", "n_nationkey", df), {"group": [{"property": "n", "range": True}]}).facets["n"]


@query("SELECT doc_id, CAST(f0 + f1 AS DOUBLE) AS score FROM (SELECT doc_id, len(list_filter(w, lambda x: x = 'the')) AS f0, len(list_filter(w, lambda x: x = 'hain')) AS f1 FROM (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents)) WHERE f0 > 0 AND f1 > 0")
def search_retrieved(spark, d):
    df = read(spark, d, "documents")
    hits = search(df, CollectionSchema.of("documents", "doc_id", df), {"search": {"keywords": "the hain", "mode": "zambezi", "in": ["text"]}}).hits
    return hits.select("doc_id", F.col("_rank").alias("score"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (1, 2, 3, 7, 32)")
def documents_got(spark, d):
    return store.get(read(spark, d, "orders"), {"property": "o_orderkey", "operator": "in", "value": [1, 2, 3, 7, 32]}).select("o_orderkey")


@query("SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand")
def unique_by_brand(spark, d):
    return store.without_duplicates(read(spark, d, "part").select("p_brand", "p_partkey"), ["p_brand"], "p_partkey")


# Conditions, one query for each operator

_CONDITIONS = {
    "eq": ("part", "p_partkey", "p_size", "=", [15], "p_size = 15"),
    "ne": ("part", "p_partkey", "p_size", "<>", [15], "p_size <> 15"),
    "lt": ("part", "p_partkey", "p_retailprice", "<", [1000.0], "p_retailprice < 1000.0"),
    "le": ("part", "p_partkey", "p_size", "less_than_or_equal", [10], "p_size <= 10"),
    "gt": ("customer", "c_custkey", "c_acctbal", ">", [5000.0], "c_acctbal > 5000.0"),
    "ge": ("customer", "c_custkey", "c_acctbal", ">=", [0.0], "c_acctbal >= 0.0"),
    "between": ("orders", "o_orderkey", "o_totalprice", "range", [1000.0, 50000.0], "o_totalprice BETWEEN 1000.0 AND 50000.0"),
    "in": ("orders", "o_orderkey", "o_orderpriority", "in", ["1-URGENT", "2-HIGH"], "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "not_in": ("orders", "o_orderkey", "o_orderstatus", "not_in", ["F", "O"], "o_orderstatus NOT IN ('F', 'O')"),
    "starts_with": ("part", "p_partkey", "p_brand", "starts_with", ["Brand#1"], "starts_with(p_brand, 'Brand#1')"),
    "ends_with": ("part", "p_partkey", "p_name", "ends_with", ["1"], "ends_with(p_name, '1')"),
    "contains": ("part", "p_partkey", "p_type", "contains", ["E"], "contains(p_type, 'E')"),
}


def _condition(name, table, key, prop, op, values, where):
    def run(spark, d):
        df = read(spark, d, table)
        return df.filter(conditions.condition([{"property": prop, "operator": op, "value": values}], df.schema)).select(key, prop)

    run.__name__ = f"filter_{name}"
    query(f"SELECT {key}, {prop} FROM {table} WHERE {where}")(run)


for _name, _args in _CONDITIONS.items():
    _condition(_name, *_args)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND (l_returnflag = 'R' OR (l_discount < 0.05 AND l_linestatus IN ('O')))")
def filter_tree(spark, d):
    df = read(spark, d, "lineitem")
    tree = [{"property": "l_quantity", "operator": ">=", "value": [10]}, {"relation": "or", "condition_array": [{"property": "l_returnflag", "operator": "=", "value": ["R"]}, {"relation": "and", "condition_array": [{"property": "l_discount", "operator": "<", "value": [0.05]}, {"property": "l_linestatus", "operator": "in", "value": ["O"]}]}]}]
    return df.filter(conditions.condition(tree, df.schema)).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE list_has_any([p_brand, CASE WHEN p_size > 40 THEN '@@ALL@@' ELSE 'none' END], ['Brand#11', '@@ALL@@']) AND NOT list_has_any([p_type], ['ECONOMY'])")
def filter_acl(spark, d):
    df = read(spark, d, "part").withColumn("ACL_ALLOW", F.array("p_brand", F.when(F.col("p_size") > 40, "@@ALL@@").otherwise("none"))).withColumn("ACL_DENY", F.array("p_type"))
    return df.filter(conditions.access(["Brand#11"]) & ~F.arrays_overlap("ACL_DENY", F.array(F.lit("ECONOMY")))).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1996 OR strftime(o_orderdate, '%Y-%m') = '1995-03'")
def label_date(spark, d):
    return read(spark, d, "orders").filter(conditions.date_labels(F.col("o_orderdate"), ["1996", "1995-03"])).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size = 3 OR p_size BETWEEN 10 AND 12 OR p_size >= 48 OR (p_size > 0 AND p_size <= 2)")
def label_number(spark, d):
    return read(spark, d, "part").filter(conditions.number_label(F.col("p_size"), ["3", "10-12", "48-", "-2"])).select("p_partkey")


_PLACES = "SELECT c_custkey, [r_name, n_name, c_mktsegment] AS p FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _customer_paths(spark, d):
    joined = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("c_custkey", paths.group_paths(F.concat_ws(">", "r_name", "n_name", "c_mktsegment")).alias("paths"))


@query(f"SELECT c_custkey FROM ({_PLACES}) WHERE p[1] = 'ASIA'")
def label_path(spark, d):
    return _customer_paths(spark, d).filter(conditions.path_label(F.col("paths"), ["ASIA"])).select("c_custkey")


# Facets


@query(f"WITH c AS ({_PLACES}), n AS (SELECT unnest([1, 2, 3]) AS k) SELECT array_to_string(p[1:k], '>') AS path, CAST(k AS INTEGER) AS level, count(*) AS count FROM c, n GROUP BY 1, 2 UNION ALL SELECT '' AS path, 0 AS level, count(*) AS count FROM c")
def facet_hierarchy(spark, d):
    return facets.hierarchy(_customer_paths(spark, d), "paths")


@query("SELECT p_brand AS value, count(*) AS count FROM part GROUP BY p_brand")
def facet_string(spark, d):
    return facets.values(read(spark, d, "part"), "p_brand")


@query("SELECT p_size AS value, count(*) AS count FROM part GROUP BY p_size")
def facet_number(spark, d):
    return facets.values(read(spark, d, "part"), "p_size")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS value, count(*) AS count FROM orders GROUP BY 1")
def facet_month(spark, d):
    return facets.dates(read(spark, d, "orders"), "o_orderdate", "M")


@query("SELECT strftime(ts, '%Y-%m-%d') AS value, count(*) AS count FROM events GROUP BY 1")
def facet_day(spark, d):
    return facets.dates(read(spark, d, "events"), "ts", "D")


@query("SELECT strftime(l_shipdate, '%Y') AS value, count(*) AS count FROM lineitem GROUP BY 1")
def facet_year(spark, d):
    return facets.dates(read(spark, d, "lineitem"), "l_shipdate", "Y")


@query("SELECT value, count FROM (SELECT p_size AS value, count(*) AS count, rank() OVER (ORDER BY count(*) DESC) AS r FROM part GROUP BY p_size) WHERE r <= 5")
def facet_top(spark, d):
    return facets.group_top(facets.values(read(spark, d, "part"), "p_size"), 5)


_CELLS = "SELECT CASE WHEN v < 1000 THEN 0 WHEN v < 10000 THEN 1 WHEN v < 100000 THEN 2 WHEN v < 1000000 THEN 3 WHEN v < 10000000 THEN 4 WHEN v < 100000000 THEN 5 ELSE 6 END AS segment, least(v, 999999999) AS v FROM (SELECT CAST(trunc(o_totalprice) AS BIGINT) AS v FROM orders WHERE o_totalprice > 0)"


@query(f"SELECT CAST(segment AS INTEGER) AS segment, CAST(v // CAST(pow(10, segment + 1) AS BIGINT) AS INTEGER) AS cell, count(*) AS count FROM ({_CELLS}) GROUP BY 1, 2")
def facet_number_cells(spark, d):
    return facets.number_cells(read(spark, d, "orders"), "o_totalprice")


@query("WITH a AS (SELECT event_id, event_type, user_id % 5 AS u FROM events), n AS (SELECT event_id, 'type' AS name, event_type AS value FROM a UNION ALL SELECT event_id, 'user', CAST(u AS VARCHAR) FROM a UNION ALL SELECT event_id, 'user', 'any' FROM a) SELECT name, value, count(*) AS count FROM n GROUP BY 1, 2")
def facet_attributes(spark, d):
    df = read(spark, d, "events").select(paths.attributes(F.concat(F.lit("type:"), "event_type", F.lit(",user:"), (F.col("user_id") % 5).cast("string"), F.lit("|any"))).alias("attrs"))
    return facets.attributes(df, "attrs")[1]


@query("SELECT 'type' AS name, count(*) AS count FROM events UNION ALL SELECT 'user', count(*) FROM events")
def facet_attribute_names(spark, d):
    df = read(spark, d, "events").select(paths.attributes(F.concat(F.lit("type:"), "event_type", F.lit(",user:"), (F.col("user_id") % 5).cast("string"), F.lit("|any"))).alias("attrs"))
    return facets.attributes(df, "attrs")[0]


@query("SELECT 'status' AS facet, o_orderstatus AS value, count(*) AS count FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY 2")
def facet_drill_sideways(spark, d):
    labels = {"status": F.col("o_orderstatus") == "F", "priority": F.col("o_orderpriority") == "1-URGENT"}
    _, side = facets.drill_sideways(read(spark, d, "orders"), labels)
    status = facets.values(side["status"], "o_orderstatus").select(F.lit("status").alias("facet"), "value", "count")
    return status.unionByName(facets.values(side["priority"], "o_orderpriority").select(F.lit("priority").alias("facet"), "value", "count"))


@query("SELECT count(DISTINCT o_custkey) AS key_count FROM orders")
def key_count(spark, d):
    return facets.key_count(read(spark, d, "orders"), "o_custkey")


# Sorting and expressions


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size ASC, p_partkey DESC LIMIT 30 OFFSET 10")
def sort_page(spark, d):
    order = sorting.sort_columns([{"property": "p_size"}], ["p_size"], "p_partkey")
    return sorting.page(read(spark, d, "part"), order, 10, 30).select("p_partkey", "p_size")


@query("SELECT p_partkey, round(0.5 + 2 * p_retailprice / p_size + ln(p_size) - pow(p_size, 0.5), 6) AS custom_rank FROM part")
def custom_rank(spark, d):
    e = expression.expression("a + 2 * price / p_size + LOG(p_size) - pow(p_size, 0.5)", ["p_size", "p_retailprice"], {"a": 0.5, "price": "p_retailprice"})
    return read(spark, d, "part").select("p_partkey", F.round(e, 6).alias("custom_rank"))


@query("SELECT c_custkey, round(2 * 6378137.0 * asin(least(1.0, sqrt(pow(sin((radians(lat) - radians(40.0)) / 2), 2) + cos(radians(lat)) * cos(radians(40.0)) * pow(sin((radians(lon) - radians(-74.0)) / 2), 2)))), 3) AS metres FROM (SELECT c_custkey, CAST(c_custkey * 37 % 360 - 180 AS DOUBLE) AS lon, CAST(c_custkey * 17 % 180 - 90 AS DOUBLE) AS lat FROM customer)")
def geo_distance(spark, d):
    df = read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 37 % 360 - 180).cast("double").alias("lon"), (F.col("c_custkey") * 17 % 180 - 90).cast("double").alias("lat"))
    return df.select("c_custkey", F.round(geo.distance(F.col("lon"), F.col("lat"), -74.0, 40.0), 3).alias("metres"))


# Text: matching

_TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


_INDEXES: dict[str, postings.PostingsIndex] = {}


def _index(spark, d) -> postings.PostingsIndex:
    """The stored index of the documents' texts, built when a program first asks for it."""
    if d not in _INDEXES or _INDEXES[d].spark is not spark:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quarry-")
        _INDEXES[d] = postings.build(read(spark, d, "documents"), "doc_id", text.words(F.col("text")), f"{folder}/postings-{uuid.uuid4().hex}")
    return _INDEXES[d]


def _match(name, keywords, where, strict=False):
    def run(spark, d):
        return _index(spark, d).match(querylang.parse(keywords), strict).select(F.col("key").alias("doc_id"))

    run.__name__ = f"match_{name}"
    query(f"SELECT doc_id FROM (SELECT doc_id, {_TOKENS} AS w FROM documents) WHERE {where}")(run)


_match("term", "hain", "list_contains(w, 'hain')")
_match("and", "the of", "list_contains(w, 'the') AND list_contains(w, 'of')")
_match("or", "hain | thion", "list_contains(w, 'hain') OR list_contains(w, 'thion')")
_match("not", "the !is", "list_contains(w, 'the') AND NOT list_contains(w, 'is')")
_match("wildcard", "th?n", "len(list_filter(w, lambda x: regexp_full_match(x, 'th.n'))) > 0")
_match("exact", '"of the"', "contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')", strict=True)
_match("ordered", "[the to is]", "list_position(w, 'the') > 0 AND len(list_filter(w, lambda x, i: x = 'to' AND i > list_position(w, 'the'))) > 0 AND len(list_filter(w, lambda x, i: x = 'is' AND i > list_min(list_filter(range(1, len(w) + 1), lambda j: w[j] = 'to' AND j > list_position(w, 'the'))))) > 0", strict=True)
_match("nearby", "{the of}^3", "len(list_filter(w, lambda x, i: x = 'the' AND list_contains(w[i + 1 : i + 3], 'of'))) > 0", strict=True)

_match("exact_default", '"the the of"', "len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'the' AND (w[i + 1] = 'of' OR (w[i + 1] = 'the' AND w[i + 2] = 'of')))) > 0")
_match("ordered_default", "[the the of]", "list_position(w, 'the') > 0 AND len(list_filter(w, lambda x, i: x = 'of' AND i > list_position(w, 'the'))) > 0")
_match("nearby_default", "{of of the}^2", "len(list_filter(w, lambda x, i: x = 'of' AND (list_contains(w[i + 1 : i + 2], 'the') OR (list_contains(w[i + 1 : i + 2], 'of') AND list_contains(w[i + 1 : i + 4], 'the') AND len(list_filter(range(i + 1, i + 3), lambda j: w[j] = 'of' AND list_contains(w[j + 1 : j + 2], 'the'))) > 0)))) > 0")

_STATS = "t AS (SELECT doc_id, {tokens} AS w FROM documents), s AS (SELECT count(*) AS n, sum(len(w)) AS total, sum(len(w)) / count(*) AS avg FROM t), tf AS (SELECT doc_id, len(w) AS len, {tfs} FROM t)".replace("{tokens}", _TOKENS)
_TERMS = ["hain", "the", "thion"]
_TFS = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS f{k}" for k, t in enumerate(_TERMS))
_DF = ", ".join(f"count(*) FILTER (f{k} > 0) AS d{k}, sum(f{k}) AS c{k}, max(f{k}) AS m{k}" for k in range(3))
_WITH = f"WITH {_STATS.replace('{tfs}', _TFS)}, df AS (SELECT {_DF} FROM tf)"


def _scored(spark, d, name):
    hits = _index(spark, d).match(querylang.disjunction(_TERMS), score=name)
    return hits.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


_IDF = [f"greatest(ln((n - d{k} + 0.5) / (d{k} + 0.5)), 0.1)" for k in range(3)]


@query(f"{_WITH} SELECT doc_id, round({' + '.join(f'{_IDF[k]} * (1001.0 / 1001.0) * 2.2 * f{k} / (1.2 * (0.75 * len / avg + 0.25) + f{k})' for k in range(3))}, 6) AS score FROM tf, s, df WHERE f0 + f1 + f2 > 0")
def rank_bm25(spark, d):
    return _scored(spark, d, "bm25")


_KL = " + ".join(f"CASE WHEN f{k} > 0 THEN (1.0 / 3) * ln((f{k} + 2000.0 * c{k} / total) / (2000.0 * c{k} / total)) ELSE 0 END" for k in range(3))


@query(f"{_WITH}, r AS (SELECT doc_id, len, {_KL} AS v FROM tf, s, df WHERE f0 + f1 + f2 > 0) SELECT doc_id, round(CASE WHEN v > 0 THEN v + ln(2000.0 / (2000.0 + len)) ELSE v END, 6) AS score FROM r")
def rank_kl(spark, d):
    return _scored(spark, d, "kl")


_FAR = "list_min(flatten(list_transform({0}, lambda x: list_transform({1}, lambda y: abs(x - y)))))"
_CLOSE = "CASE WHEN {0} IS NULL THEN 0 WHEN {0} = 1 THEN 2.0 / 3 ELSE pow(3.0, -{0}) END"
_PLM_PLACES = ", ".join(f"list_filter(range(1, len(w) + 1), lambda i: w[i] = '{t}') AS p{k}" for k, t in enumerate(_TERMS))
_PLM = " + ".join(f"CASE WHEN len(p{k}) > 0 THEN (1.0 / 3) * ln((len(p{k}) + 1000.0 * near{k} + 2000.0 * c{k} / total) / (2000.0 * c{k} / total)) ELSE 0 END" for k in range(3))


@query(f"""
WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), p AS (SELECT doc_id, len(w) AS len, {_PLM_PLACES} FROM t),
s AS (SELECT sum(len) AS total, sum(len(p0)) AS c0, sum(len(p1)) AS c1, sum(len(p2)) AS c2 FROM p),
d AS (SELECT *, {_FAR.format('p0', 'p1')} AS d01, {_FAR.format('p0', 'p2')} AS d02, {_FAR.format('p1', 'p2')} AS d12 FROM p WHERE len(p0) + len(p1) + len(p2) > 0),
m AS (SELECT *, {_CLOSE.format('d01')} AS s01, {_CLOSE.format('d02')} AS s02, {_CLOSE.format('d12')} AS s12 FROM d),
n AS (SELECT *, (s01 + s02) / 2 AS near0, (s01 + s12) / 2 AS near1, (s02 + s12) / 2 AS near2 FROM m),
r AS (SELECT doc_id, len, near0 + near1 + near2 AS close, {_PLM} AS v FROM n, s)
SELECT doc_id, round(CASE WHEN v > 0 THEN v + ln(2000.0 / (2000.0 + len + 1000.0 * close)) ELSE v END, 6) AS score FROM r""")
def rank_plm(spark, d):
    return _scored(spark, d, "plm")


_UB = [f"(CASE WHEN m{k} > 0 THEN {_IDF[k]} * 2.2 * m{k} / (1.2 * (0.75 * m{k} / avg + 0.25) + m{k}) ELSE 0 END)" for k in range(3)]


@query(f"{_WITH} SELECT doc_id FROM tf, s, df WHERE {' + '.join(f'(CASE WHEN f{k} > 0 THEN {_UB[k]} ELSE 0 END)' for k in range(3))} > 0.5 * ({' + '.join(_UB)})")
def match_wand(spark, d):
    return _index(spark, d).match(querylang.parse("#".join(_TERMS))).select(F.col("key").alias("doc_id"))


@query("SELECT term, doc, least(count(*), 65535) AS score FROM (SELECT doc_id AS doc, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS term FROM documents) WHERE term IN ('the', 'hain') GROUP BY 1, 2")
def postings_scored(spark, d):
    return _index(spark, d).scored(["the", "hain"])


@query(f"SELECT doc, CAST(f0 + f1 AS DOUBLE) AS score FROM (SELECT doc_id AS doc, len(list_filter(w, lambda x: x = 'the')) AS f0, len(list_filter(w, lambda x: x = 'hain')) AS f1 FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)) WHERE f0 > 0 AND f1 > 0")
def retrieve_svs(spark, d):
    return suffix.retrieve(_index(spark, d).scored(["the", "hain"]), ["the", "hain"])


@query(f"SELECT doc, CAST(f0 + f1 AS DOUBLE) AS score FROM (SELECT doc_id AS doc, len(list_filter(w, lambda x: x = 'thion')) AS f0, len(list_filter(w, lambda x: x = 'hain')) AS f1 FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)) WHERE f0 > 0 OR f1 > 0")
def retrieve_or(spark, d):
    return suffix.retrieve(_index(spark, d).scored(["thion", "hain"]), ["thion", "hain"], "bwand_or")


@query("SELECT p_partkey, round(CASE WHEN contains(lower(p_name), 'part 12') THEN 7 WHEN contains(lower(p_name), 'art 12') THEN 6 WHEN contains(lower(p_name), 'rt 12') THEN 5 WHEN contains(lower(p_name), 't 12') THEN 4 WHEN contains(lower(p_name), ' 12') THEN 3 WHEN contains(lower(p_name), '12') THEN 2 WHEN contains(lower(p_name), '2') THEN 1 ELSE 0 END / length(p_name), 6) AS score FROM part")
def suffix_longest(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(suffix.suffix_score([F.col("p_name")], "Part 12"), 6).alias("score"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), '1') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(lower(p_name), '7') THEN 2.0 WHEN contains(lower(p_name), '8') THEN 1.9 ELSE 0.0 END AS score FROM part")
def suffix_fuzzy(spark, d):
    s, _ = suffix.fuzzy_score(F.col("p_name"), {"1": 1.0, "7": 2.0}, {"7": ["8"]})
    return read(spark, d, "part").select("p_partkey", s.alias("score"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+'), lambda x: CASE WHEN lower(x) IN ('the', 'of') THEN '<b>' || x || '</b>' ELSE x END), '') END AS text FROM documents")
def highlighted(spark, d):
    return read(spark, d, "documents").select("doc_id", text.highlight(F.col("text"), ["the", "of"]).alias("text"))


@query(r"SELECT item_id, list_filter(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''), lambda w: w NOT IN ('the', 'of')) AS words, md5(text) AS name FROM benchmark")
def analyzed(spark, d):
    t = F.col("text")
    return read(spark, d, "benchmark").select("item_id", text.without(text.words(t), ["the", "Of"]).alias("words"), text.md5_id(t).alias("name"))


@query()
def snippets(spark, d):
    return read(spark, d, "documents").select("doc_id", text.snippet(F.col("text"), ["hain", "thion"]).alias("snippet"))


@query(r"SELECT item_id, array_to_string(list_sort(list_filter(string_split_regex(lower(text), '[\p{Z}\x09-\x0D\x1C-\x1F\x{85}]+'), lambda w: w <> '')), ' ') AS norm FROM benchmark")
def normalized(spark, d):
    return read(spark, d, "benchmark").select("item_id", text.normalized(F.col("text")).alias("norm"))


# Scores and reranking


@query("SELECT p_partkey, round(0.7 * greatest(0, least(1, (p_retailprice - 900) / 1100.0)) + 0.3 * CASE p_partkey WHEN 5 THEN 2 WHEN 9 THEN 1 ELSE 0 END, 6) AS score FROM part")
def product_score(spark, d):
    s = scoring.weighted_sum([(scoring.min_max(F.col("p_retailprice"), 900, 2000), 0.7), (scoring.pinned(F.col("p_partkey"), [5, 9]), 0.3)])
    return read(spark, d, "part").select("p_partkey", F.round(s, 6).alias("score"))


@query("SELECT c_custkey, CASE WHEN p[1] = 'ASIA' AND p[2] = 'CHINA' THEN 1 WHEN p[1] = 'ASIA' THEN 3 WHEN p[1] = 'EUROPE' THEN 2 ELSE 0 END AS score FROM (" + _PLACES + ")")
def category_score(spark, d):
    return _customer_paths(spark, d).select("c_custkey", scoring.category(F.element_at("paths", 1), [["ASIA"], ["EUROPE"], ["ASIA", "CHINA"]]).alias("score"))


@query("WITH h AS (SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) - 1 AS rank FROM lineitem ORDER BY rank LIMIT 500) SELECT l_orderkey, l_linenumber, CAST(1 - row_number() OVER (PARTITION BY l_suppkey ORDER BY rank) AS INTEGER) AS turn FROM h")
def rerank_diversity(spark, d):
    df = read(spark, d, "lineitem").withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumn("one", F.lit(1))
    best = scoring.best_hits(df, "l_extendedprice", "key", 500)
    return best.select("l_orderkey", "l_linenumber", scoring.diversity_round(["one"], "l_suppkey").alias("turn"))


@query("WITH h AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS rank, floor(p_retailprice / 100) AS cat, least(p_size, 2) AS offer, p_partkey % 7 AS m FROM part ORDER BY rank LIMIT 4000), t AS (SELECT *, 1 - row_number() OVER (PARTITION BY cat, m ORDER BY rank) AS turn FROM h) SELECT p_partkey, CAST(row_number() OVER (ORDER BY cat DESC, offer DESC, turn DESC, m * 10 DESC, rank) AS INTEGER) AS place FROM t")
def rerank_products(spark, d):
    df = read(spark, d, "part").withColumn("merchants", F.array(F.col("p_partkey") % 7))
    merchants = spark.range(7).select(F.col("id").alias("merchant"), (F.col("id") * 10).alias("score"))
    return scoring.product_rerank(df, "p_retailprice", 100.0, "p_size", "merchants", merchants, key="p_partkey").select("p_partkey", "place")


@query("SELECT p_partkey, CAST(bit_count(xor(p_partkey, 341)) AS INTEGER) AS apart FROM part ORDER BY 2, 1 LIMIT 15")
def nearest_signatures(spark, d):
    return similar.nearest(read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("p_partkey")), "p_partkey", 341, 15, "p_partkey")


@query("SELECT p_partkey, round((exp(least(50, greatest(1, p_size)) / 20.0) - 1) / (exp(least(50, greatest(1, p_size)) / 20.0) + 1), 6) AS score FROM part")
def exponent_score(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(scoring.exponent(F.col("p_size"), 1, 50, 20.0), 6).alias("score"))


@query("SELECT p_partkey, round(0.5 * p_size + (p_retailprice - 900) / 1100.0, 6) AS popularity FROM part WHERE p_retailprice BETWEEN 900 AND 2000")
def popularity(spark, d):
    p = read(spark, d, "part")
    table = scoring.popularity_table(p, "p_partkey", [(F.col("p_size"), 0.5), (scoring.min_max(F.col("p_retailprice"), 900, 2000), 1.0)])
    return scoring.with_popularity(p.filter("p_retailprice between 900 and 2000").select("p_partkey"), table, "p_partkey").select("p_partkey", F.round("popularity", 6).alias("popularity"))


# Ingest


@query("SELECT doc_id, max(turn) AS turn FROM (SELECT conv_id AS doc_id, turn FROM conversations) GROUP BY doc_id")
def latest_rows(spark, d):
    return store.latest(read(spark, d, "conversations"), "conv_id", ["turn", "text"]).select(F.col("conv_id").alias("doc_id"), "turn")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer UNION ALL SELECT c_custkey + 10000000, 'NEW', NULL FROM customer WHERE c_custkey % 50 = 0")
def upserted(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment")).unionByName(c.filter("c_custkey % 50 = 0").select((F.col("c_custkey") + 10000000).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment")))
    return store.upsert(c, new, "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'NOCHANGE' WHEN c_custkey % 4 = 1 THEN 'RTYPE' WHEN c_custkey % 4 = 2 THEN 'GENERAL' ELSE 'INSERT' END AS kind FROM (SELECT CASE WHEN c_custkey % 4 = 3 THEN c_custkey + 40000000 ELSE c_custkey END AS c_custkey FROM customer)")
def upsert_kinds(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    m = F.col("c_custkey") % 4
    new = c.select(F.when(m == 3, F.col("c_custkey") + 40000000).otherwise(F.col("c_custkey")).alias("c_custkey"), F.when(m == 2, "x").otherwise(F.col("c_name")).alias("c_name"), F.when(m == 1, -1e9).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    return store.update_kinds(c, new, "c_custkey", ["c_acctbal"])


@query("SELECT p_partkey, CAST(p_size + CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 0 END AS INTEGER) AS p_size FROM part")
def added_in_place(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_size")
    return store.add_in_place(p, p.filter("p_partkey % 2 = 0").select("p_partkey", F.lit(5).alias("delta")), "p_partkey", "p_size")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def deleted(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return store.delete(o, o.filter("o_orderstatus = 'F'"), "o_orderkey").select("o_orderkey")


@query("SELECT CAST(c_custkey AS VARCHAR) AS \"DOCID\", CASE WHEN c_custkey % 2 = 0 THEN 'second' ELSE c_name END AS \"Title\", c_mktsegment AS \"Content\" FROM customer WHERE c_custkey % 5 <> 0")
def scd_merged(spark, d):
    c = read(spark, d, "customer")
    record = lambda rows, stamp, kind, **f: rows.select(F.col("c_custkey").cast("string").alias("DOCID"), F.create_map(*[x for k, v in f.items() for x in (F.lit(k), v)]).cast("map<string,string>").alias("fields"), F.lit(kind).alias("kind"), F.lit(stamp).alias("stamp"), F.col("c_custkey").alias("position"))
    every = record(c, "1", "insert", Title=F.col("c_name"), Content=F.col("c_mktsegment")).unionByName(record(c.filter("c_custkey % 2 = 0"), "2", "update", Title=F.lit("second"))).unionByName(record(c.filter("c_custkey % 5 = 0"), "3", "delete", Title=F.lit("")))
    merged = scd.merge(every).filter("kind <> 'delete'")
    return scd.typed(merged, {"Title": "string", "Content": "string"}).select("DOCID", "Title", "Content")


# Logs, clicks, suggestions, advertisements


@query("SELECT event_type AS query, max(ts) AS latest FROM events WHERE value > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def log_recent(spark, d):
    return logs.recent_keywords(read(spark, d, "events").withColumnRenamed("event_type", "query"), 10, hits="value")


@query("SELECT event_type AS query, max(value) AS max_hits, count(*) AS count FROM events WHERE ts >= TIMESTAMP '2000-01-01' GROUP BY 1")
def log_frequency(spark, d):
    return logs.keyword_frequency(read(spark, d, "events").withColumnRenamed("event_type", "query"), "2000-01-01 00:00:00", hits="value")


@query("SELECT user_id, event_id, event_type, count FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS count, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def log_latest(spark, d):
    return logs.latest_per_key(read(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "count")


@query("SELECT l_returnflag AS label_name, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def log_label_totals(spark, d):
    return logs.label_totals(read(spark, d, "lineitem").select(F.col("l_returnflag").alias("label_name"), F.col("l_linenumber").alias("hit_docs_num")))


@query("SELECT user_id, event_type, count FROM (SELECT user_id, event_type, count(*) AS count, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r <= 2")
def click_top(spark, d):
    return logs.top_values(read(spark, d, "events"), ["user_id"], "event_type", 2)


@query("SELECT count(DISTINCT user_id) AS distinct_count FROM events")
def log_distinct(spark, d):
    return logs.distinct_count(read(spark, d, "events"), "user_id")


@query("SELECT p_brand AS query, p_type AS label, count FROM (SELECT p_brand, p_type, count(*) AS count, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1, 2) WHERE r <= 3")
def click_label_top(spark, d):
    return logs.click_labels(read(spark, d, "part").select(F.col("p_brand").alias("query"), F.col("p_type").alias("label")), 3)


@query("SELECT name AS query, freq FROM (SELECT p_name AS name, sum(p_size) AS freq FROM part GROUP BY 1) WHERE starts_with(name, 'Part') ORDER BY freq DESC, name LIMIT 10")
def suggest_prefix(spark, d):
    q = read(spark, d, "part").groupBy(F.col("p_name").alias("query")).agg(F.sum("p_size").alias("freq"))
    return suggest.complete(q, "Part", 10)


@query("SELECT p_partkey AS ad_id, round(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE p_size / 100.0 * p_retailprice * 1000 END, 4) AS ecpm FROM part ORDER BY CASE WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE p_size / 100.0 * p_retailprice * 1000 END DESC, p_partkey LIMIT 25")
def ad_auction(spark, d):
    a = read(spark, d, "part").select(F.col("p_partkey").alias("ad_id"), (F.col("p_partkey") % 2).alias("mode"), F.col("p_retailprice").alias("price"), (F.col("p_size") / 100.0).alias("ctr"))
    return ads.auction(a, 25).select("ad_id", F.round("ecpm", 4).alias("ecpm"))


@query("SELECT p_partkey AS ad_id FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') AND p_size NOT IN (1, 2, 3)")
def ad_targeting(spark, d):
    rules = read(spark, d, "part").select(F.col("p_partkey").alias("ad_id"), F.concat(F.lit("brand~{"), "p_brand", F.lit("}^size!~{"), F.col("p_size").cast("string"), F.lit("}")).alias("rule"))
    return ads.target(rules, {"brand": ["Brand#11", "Brand#12"], "size": ["1", "2", "3"]})


@query("SELECT p_partkey AS ad_id FROM part WHERE p_brand = 'Brand#11' OR p_size NOT IN (1, 2, 3)")
def ad_disjunction(spark, d):
    rules = read(spark, d, "part").select(F.col("p_partkey").alias("ad_id"), F.concat(F.lit("brand~{"), "p_brand", F.lit("}|size!~{"), F.col("p_size").cast("string"), F.lit("}")).alias("rule"))
    return ads.target(rules, {"brand": ["Brand#11"], "size": ["1", "2", "3"]})


@query("SELECT name AS correction, freq * 1.0 AS score FROM (SELECT p_type AS name, count(*) AS freq FROM part GROUP BY 1) WHERE starts_with(name, 'S') AND name <> 'S'")
def suggest_candidates(spark, d):
    q = read(spark, d, "part").groupBy(F.col("p_type").alias("query")).agg(F.count("*").alias("freq"))
    return suggest.candidates(q, "S")


@query("SELECT o_orderpriority AS u, o_orderstatus AS a, count(*) AS views, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS clicks FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def ad_segments(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("u"), F.col("o_orderstatus").alias("a"), (F.col("o_totalprice") > 100000).alias("clicked"))
    return ads.segment_ctr(o, ["u"], ["a"]).select("u", "a", "views", "clicks")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 0.5)), 6) AS score FROM embeddings ORDER BY list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 0.5)) DESC, vec_id LIMIT 20")
def ad_recommend(spark, d):
    n = 64
    return ads.recommend(read(spark, d, "embeddings"), [0.5] * n, 20).select("vec_id", F.round("score", 6).alias("score"))
