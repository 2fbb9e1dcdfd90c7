"""URL filters: rules first, then trust and distrust propagated over host edges.

Hosts link to the hosts that their pages name in ``href`` attributes, and to
and from the domain one label up (``blog.site.org`` and ``site.org``). Trust
starts at hosts with pages that a rule allows and follows the edges;
distrust starts at hosts with blocked pages and follows them backwards. Both
are personalised PageRank, in units of pages, propagated until less than
``TOLERANCE`` of the seeds' weight is still on its way; a host is blocked whose
distrust is more than ``THRESHOLD`` of the sum. A host that neither reaches is
allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, table

#: (verdict, host and path); fixed values.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-3, 0.5
#: Rounds whose plan runs as one job.
AT_ONCE = 5
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), *LOWER)


def path_of(url: Column) -> Column:
    """What stands between the host and ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. ``rules`` is a short list; it becomes one expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, weight): links between different hosts, counted; and links with the domain one label up."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    links = pages.select(F.col(host).alias("src"), F.explode(F.array_distinct(found)).alias("link"))
    links = links.select("src", host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))).alias("dst"))
    links = links.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    names = pages.select(F.col(host).alias("h")).union(links.select("dst")).distinct()
    upper = F.regexp_extract("h", r"\A[^.]+\.([^.]+\..*)\z", 1)
    up = names.select(F.col("h").alias("src"), upper.alias("dst"), F.lit(1.0).alias("weight")).filter("dst <> ''")
    return links.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) of every host that either reaches.

    ``seeds`` is (host, allowed, blocked). Flows are kept apart by ``kind``: 0
    is trust along edges, shared out by weight among a host's targets; 1 is
    distrust against them, shared out among those that link to a host. What
    each round moves on is added up; it shrinks by ``damping`` at least.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("total"))
    flow = cut(
        edges.join(out, "src").select(F.col("src").alias("host"), F.lit(0).alias("kind"), F.col("dst").alias("to"), (F.lit(damping) * F.col("weight") / F.col("total")).alias("share"))
        .unionByName(edges.join(into, "dst").select(F.col("dst").alias("host"), F.lit(1).alias("kind"), F.col("src").alias("to"), (F.lit(damping) * F.col("weight") / F.col("total")).alias("share")))
    )
    start = seeds.select("host", F.explode(F.expr("array(struct(0 as kind, allowed * 1D as n), struct(1 as kind, blocked * 1D as n))")).alias("s")).select("host", "s.kind", "s.n").filter("n > 0")
    moving = cut(start.select("host", "kind", (F.lit(1 - damping) * F.col("n")).alias("score")))
    weight = lambda t: t.agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
    scores, least = moving, tolerance * weight(moving)
    while True:
        parts = [scores]
        for _ in range(AT_ONCE):
            moving = flow.join(moving, ["host", "kind"]).groupBy("to", "kind").agg(F.sum(F.col("share") * F.col("score")).alias("score")).withColumnRenamed("to", "host")
            parts.append(moving)
        moving = cut(moving)
        scores = cut(reduce(DataFrame.unionByName, [*parts[:-1], moving]).groupBy("host", "kind").agg(F.sum("score").alias("score")))
        if weight(moving) <= least:
            break
    part = lambda k: F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0))
    return scores.groupBy("host").agg(part(0).alias("trust"), part(1).alias("distrust"))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) for every row.

    A null url, or one without ``://``, has an empty host and path; no rule
    without a host fits it and it is allowed. Null html has no links. Repeated
    rows each count as a page; a null id stays null; pages of any length are
    read whole; other columns are ignored; an empty table gives no rows. Equal
    trust and distrust allow.
    """
    own = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = own.withColumn("rule", rule).withColumn("ruled", verdict)
    count = lambda what: F.count(F.when(F.col("ruled") == what, 1))
    seeds = ruled.filter("host <> '' and ruled is not null").groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("blocked"))
    scores = propagate(host_edges(own, "host", "html"), seeds)
    joined = ruled.drop("html").join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
    by_host = F.when(F.col("distrust") > F.lit(threshold) * (F.col("trust") + F.col("distrust")), "block").otherwise("allow")
    return joined.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), "trust", "distrust")


def op2_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
