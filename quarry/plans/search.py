"""Running a request: one stream of hits, and a page and facets derived from it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import geo, paths, text
from quarry.functions.terms import as_words
from quarry.operators import conditions, expression, facets, logs, querylang, ranking, sorting, suffix
from quarry.plans.request import SearchRequest
from quarry.plans.schema import NUMERIC, CollectionSchema
from quarry.sources import store


@dataclass
class SearchResult:
    """DataFrames that run when read. ``hits`` are all that match; facets go by property."""

    hits: DataFrame
    page: DataFrame
    totals: DataFrame
    facets: dict[str, DataFrame] = field(default_factory=dict)
    attributes: tuple[DataFrame, DataFrame] | None = None


def _match(df: DataFrame, schema: CollectionSchema, r: SearchRequest, analyzer) -> tuple[Column, Column]:
    """Whether a row matches the keywords, and its score."""
    props = r.search_in or schema.searchable()
    node = querylang.parse(r.keywords)
    if node.kind == "all":
        return F.lit(True), F.lit(1.0)
    if r.mode == "suffix":
        tokens = {t: 1.0 for t in text.query_words(r.keywords)}
        scores = [suffix.fuzzy_score(F.col(p), tokens) for p in props]
        every = scores[0][1]
        for _, e in scores[1:]:
            every = every | e
        return every, sum((s for s, _ in scores[1:]), scores[0][0])
    if r.mode == "zambezi":
        words = node.words()
        retrieved = {p: _retrieved(analyzer(F.col(p)), words, r.algorithm) for p in props}
        keep = reduce(lambda a, b: a | b, [hit for hit, _ in retrieved.values()])
        return keep, ranking.multi_property({p: F.when(hit, s).otherwise(0.0) for p, (hit, s) in retrieved.items()}, {p: schema.get(p).rank_weight for p in props})
    if r.mode == "or" and node.kind in ("and", "term"):
        node = querylang.disjunction(node.terms())
    typed = [p for p in props if schema.get(p).type in NUMERIC and not schema.get(p).parts]
    tokens = {p: analyzer(text.virtual(list(schema.get(p).parts)) if schema.get(p).parts else F.col(p)) for p in props if p not in typed}
    words = [w for w in node.terms() if w not in r.search_only] + [w.lower() for w in r.rank_keywords]
    stats = {p: ranking.collect_stats(df, c, words) for p, c in tokens.items()}
    if r.mode == "wand":
        node = querylang.Node("wand", parts=tuple(querylang.Node("term", w) for w in dict.fromkeys(node.terms())))
    keep = reduce(lambda a, b: a | b, [_number(F.col(p), node.terms()) for p in typed]) if typed else None
    for p, c in tokens.items():
        bounds = {w: ranking.bm25_bound(stats[p], w) for w in dict.fromkeys(words)}
        m = querylang.matches(node, c, bounds, r.threshold)
        keep = m if keep is None else keep | m
    score = ranking.model(r.model)
    weights = {p: schema.get(p).rank_weight for p in props}
    scores = {p: score(c, words, stats[p]) + ranking.personal_boost(c, r.personal) for p, c in tokens.items()}
    return keep, ranking.multi_property(scores, weights) if scores else F.lit(0.0)


def _number(c: Column, words: list[str]) -> Column:
    """Whether a number is what one of the words says."""
    return F.coalesce(reduce(lambda a, b: a | b, [c.cast("double") == F.lit(w).try_cast("double") for w in words], F.lit(False)), F.lit(False))


def _retrieved(tokens: Column, words: list[str], algorithm: str) -> tuple[Column, Column]:
    """Whether one property has all words (or any, by the algorithm), and its occurrences of them as 16-bit scores."""
    counts = [as_words(tokens).count(w) for w in dict.fromkeys(words)]
    join = (lambda a, b: a & b) if algorithm in suffix.CONJUNCTIVE else (lambda a, b: a | b)
    return reduce(join, [c > 0 for c in counts]), reduce(lambda a, b: a + b, [F.least(c, F.lit(65535)) for c in counts]).cast("double")


def _labels(schema: CollectionSchema, labels: list[dict]) -> dict[str, Column]:
    """One condition for each property (for attributes, each name): any of its labels."""
    out: dict[str, Column] = {}
    for x in labels:
        name = f"attr {x['property']}" if x.get("attr") else x["property"]
        c = F.coalesce(_label(schema, x), F.lit(False))
        out[name] = out[name] | c if name in out else c
    return out


def _pruned(df: DataFrame, schema: CollectionSchema, r: SearchRequest, analyzer, clicks) -> SearchRequest:
    """The request with the most of its words that have a hit; unchanged if none has or it isn't plain words."""
    words = querylang.parse(r.keywords).terms()
    if len(words) < 2 or str(querylang.parse(r.keywords)) != str(querylang.conjunction(words)):
        return r
    counts = ranking.collect_stats(df, analyzer(F.concat_ws(" ", *(r.search_in or schema.searchable()))), words)
    kept, found = suffix.search_relaxed(lambda ts: search(df, schema, replace(r, keywords=" ".join(ts), prune=False), analyzer, clicks).hits, [(w, ranking.idf(counts, w) if counts.df[w] else 0.0) for w in words])
    return r if found.isEmpty() else replace(r, keywords=" ".join(kept), prune=False)


def _label(schema: CollectionSchema, label: dict) -> Column:
    name, values = label["property"], label["value"] if isinstance(label["value"], list) else [label["value"]]
    if label.get("attr"):
        return conditions.attr_label(paths.attributes(F.col(label.get("column", "Attribute"))), name, values)
    kind = schema.get(name).type
    if kind == "datetime":
        return conditions.date_labels(F.col(name), values)
    if kind == "string":
        return conditions.path_label(paths.group_paths(F.col(name)), values)
    return conditions.number_label(F.col(name), [str(v) for v in values])


def search(df: DataFrame, schema: CollectionSchema, request: SearchRequest | dict | str, analyzer=text.words, clicks: DataFrame | None = None) -> SearchResult:
    """Raises ValueError with all that is wrong with the request.

    ``clicks`` (query, label) fills labels that ask for the query's most
    clicked ones (``auto_select``: how many). With ``query_prune`` a query of
    several words without a hit is asked again without its commonest word, and
    so on: that runs a small job for each try.

    Labels of one property are alternatives, those of several properties all
    hold. Facets of strings are trees of their category paths, those with
    ``range`` a few ranges of about equal counts; of several facets of one
    property the first counts. Mode ``verbose`` is ``and`` by another name.
    """
    r = request if isinstance(request, SearchRequest) else SearchRequest.from_json(request)
    if wrong := r.problems(schema):
        raise ValueError("; ".join(wrong))
    if r.prune:
        r = _pruned(df, schema, r, analyzer, clicks)
    labels = [x if x.get("value") else {**x, "value": logs.auto_labels(clicks, r.keywords, int(x["auto_select"])) if clicks is not None else []} for x in r.labels]
    labels = [x for x in labels if x["value"]]
    rows = df.filter(conditions.condition(r.conditions, df.schema))
    if r.acl is not None:
        rows = rows.filter(conditions.access(r.acl, "ACL_ALLOW" if schema.has("ACL_ALLOW") else None, "ACL_DENY" if schema.has("ACL_DENY") else None))
    if r.excluded:
        rows = rows.filter(~F.col(schema.key).isin(r.excluded))
    hit, score = _match(rows, schema, r, analyzer)
    hits = rows.filter(hit | F.col(schema.key).isin(r.pinned) if r.pinned else hit).withColumn("_rank", score)
    if r.custom_rank:
        hits = hits.withColumn("custom_rank", expression.expression(r.custom_rank["expression"], df.columns, r.custom_rank.get("params")))
    if r.geo:
        lon, lat = F.col(r.geo["lon"]), F.col(r.geo["lat"])
        hits = hits.withColumn("geo_rank", geo.distance(lon, lat, *r.geo["point"]))
        if "scope" in r.geo:
            hits = hits.filter(geo.within(lon, lat, *r.geo["point"], r.geo["scope"]))
    sideways: dict[str, DataFrame] = {}
    everything = hits
    if labels:
        everything, sideways = facets.drill_sideways(hits, _labels(schema, labels))
    if r.unique_by:
        everything = store.without_duplicates(everything, r.unique_by, schema.key)
    known = [*df.columns, "_rank", *(["custom_rank"] if r.custom_rank else []), *(["geo_rank"] if r.geo else [])]
    order = sorting.sort_columns([k for k in r.sort if (k if isinstance(k, str) else k["property"]) in known], known, schema.key, "custom_rank" if r.custom_rank else "_rank")
    if r.random_seed is not None:
        order = sorting.random_order(everything, schema.key, r.random_seed)
    page = sorting.page(everything, order, r.offset, r.limit)
    terms = querylang.parse(r.keywords).terms()
    for p in r.summary:
        page = page.withColumn(f"{p}_summary", text.summary(F.col(p)))
    for p in r.snippet:
        page = page.withColumn(f"{p}_snippet", text.snippet(F.col(p), terms))
    for p in r.highlight:
        page = page.withColumn(p, text.highlight(F.col(p), terms))
    page = page.withColumn("_id", F.col(schema.key))
    for p in r.split:
        page = page.withColumn(p, paths.attributes(F.col(p)) if schema.get(p).attr else paths.group_paths(F.col(p)))
    if r.select is not None:
        page = page.select("_id", schema.key, "_rank", *[c for c in known if c in ("custom_rank", "geo_rank")], *[p for p in r.select if p != schema.key], *[p for p in ("ACL_ALLOW", "ACL_DENY") if r.acl is not None and schema.has(p) and p not in r.select], *[f"{p}_{k}" for k in ("summary", "snippet") for p in getattr(r, k)])
    out = SearchResult(everything, page, facets.totals(everything, r.range, r.sums))
    for f in r.facets:
        if f.property in out.facets:  # the first one counts
            continue
        stream, kind = sideways.get(f.property, everything), schema.get(f.property).type
        if f.range:
            table = facets.ranges(stream, f.property)
        elif f.sub_property:
            table = facets.sub_facet(stream, f.property, f.sub_property)
        elif kind == "datetime":
            table = facets.dates(stream, f.property, f.unit or "M")
        elif kind == "string":
            table = facets.tree(stream, f.property)
        else:
            table = facets.values(stream, f.property)
        out.facets[f.property] = facets.group_top(table, f.top) if f.top and not f.range else table
    if r.attributes:
        out.attributes = facets.attributes(everything.withColumn("_attrs", paths.attributes(F.col(r.attributes))), "_attrs", top_names=r.attr_top)
    return out
