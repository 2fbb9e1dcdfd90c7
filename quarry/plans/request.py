"""One search request as JSON: what it may hold, and what is wrong with it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from quarry.operators import conditions, querylang, suffix
from quarry.plans.schema import NUMERIC, CollectionSchema

MODES = ("and", "or", "wand", "verbose", "suffix", "zambezi", "ad_index")


@dataclass
class Facet:
    property: str
    sub_property: str | None = None
    range: bool = False
    unit: str | None = None
    top: int | None = None


@dataclass
class SearchRequest:
    keywords: str = "*"
    mode: str = "and"
    algorithm: str = "svs"
    model: str | None = None
    threshold: float = 0.5
    search_in: list[str] = field(default_factory=list)
    conditions: list | dict = field(default_factory=list)
    acl: list[str] | None = None
    labels: list[dict] = field(default_factory=list)
    facets: list[Facet] = field(default_factory=list)
    attributes: str | None = None
    attr_top: int | None = None
    range: list[str] = field(default_factory=list)
    sums: list[str] = field(default_factory=list)
    custom_rank: dict | None = None
    geo: dict | None = None
    sort: list = field(default_factory=list)
    select: list | None = None
    highlight: list[str] = field(default_factory=list)
    snippet: list[str] = field(default_factory=list)
    summary: list[str] = field(default_factory=list)
    split: list[str] = field(default_factory=list)
    rank_keywords: list[str] = field(default_factory=list)
    search_only: list[str] = field(default_factory=list)
    personal: dict[str, float] = field(default_factory=dict)
    prune: bool = False
    random_seed: int | None = None
    unique_by: list[str] = field(default_factory=list)
    pinned: list = field(default_factory=list)
    excluded: list = field(default_factory=list)
    offset: int = 0
    limit: int = 20

    @classmethod
    def from_json(cls, text: str | dict) -> SearchRequest:
        """Raises ValueError for what can't be read; unknown keys are named."""
        d = json.loads(text) if isinstance(text, str) else text
        search = d.get("search", {})
        known = {"search", "conditions", "group", "attr", "range", "count", "custom_rank", "geo", "sort", "select", "offset", "limit", "acl_tokens", "pinned", "excluded", "remove_duplicated_result", "collection"}
        if odd := set(d) - known:
            raise ValueError(f"unknown keys {sorted(odd)}")
        as_list = lambda x: x if isinstance(x, list) else [x] if x else []
        select = d.get("select")
        names = None if select is None else [s if isinstance(s, str) else s["property"] for s in select]
        marked = lambda k: [s["property"] for s in select or [] if isinstance(s, dict) and s.get(k)]
        return cls(
            keywords=search.get("keywords", "*"), mode=str(search.get("mode", "and")).lower(), algorithm=str(search.get("algorithm", "svs")).lower(), model=search.get("ranking_model"), threshold=search.get("threshold", 0.5), search_in=list(search.get("in", [])),
            conditions=d.get("conditions", []), acl=d.get("acl_tokens"), labels=search.get("group_label", []) + [x | {"attr": True} for x in search.get("attr_label", [])],
            facets=[Facet(g["property"], g.get("sub_property"), bool(g.get("range")), g.get("unit"), g.get("grouptop")) for g in d.get("group", [])],
            attributes=d.get("attr", {}).get("property"), attr_top=d.get("attr", {}).get("attr_top"), range=[r["property"] for r in as_list(d.get("range"))], sums=[c["property"] for c in as_list(d.get("count"))],
            custom_rank=d.get("custom_rank"), geo=d.get("geo"), sort=d.get("sort", []), select=names, highlight=marked("highlight"), snippet=marked("snippet"), summary=marked("summary"), split=marked("split_property_value"),
            rank_keywords=list(search.get("rank_keywords", [])), search_only=list(search.get("search_only", [])), personal=dict(search.get("personal", {})), prune=bool(search.get("query_prune")), random_seed=search.get("random_seed"), unique_by=list(d.get("remove_duplicated_result", [])),
            pinned=list(d.get("pinned", [])), excluded=list(d.get("excluded", [])), offset=int(d.get("offset", 0)), limit=int(d.get("limit", 20)),
        )

    def problems(self, schema: CollectionSchema) -> list[str]:
        """What the collection can't do of this."""
        out = []
        if self.mode not in MODES:
            out.append(f"unknown mode {self.mode}")
        if self.mode == "ad_index":
            out.append("ad_index searches advertisements: use operators.ads")
        if self.algorithm not in suffix.CONJUNCTIVE + suffix.DISJUNCTIVE:
            out.append(f"unknown algorithm {self.algorithm}")
        try:
            querylang.parse(self.keywords)
        except ValueError as e:
            out.append(str(e))

        def walk(t):
            if isinstance(t, list):
                return [p for x in t for p in walk(x)]
            if "condition_array" in t:
                return walk(t["condition_array"])
            if not schema.filterable(t.get("property", "")):
                return [f"{t.get('property')} can't be filtered"]
            return [] if str(t.get("operator", "")).lower() in conditions.ALIASES else [f"unknown operator {t.get('operator')}"]

        out += walk(self.conditions or [])
        for p in [*self.range, *self.sums]:
            if not schema.has(p) or schema.get(p).type not in NUMERIC:
                out.append(f"{p} isn't a number")
        out += [f"{f.property} isn't known" for f in self.facets if not schema.has(f.property)]
        out += [f"{f.property}: range and sub_property don't go together" for f in self.facets if f.range and f.sub_property]
        out += [f"{p} isn't known" for p in [*(self.select or []), *self.search_in, *self.unique_by] if not schema.has(p)]
        out += [f"{x['property']}: a label needs a value" for x in self.labels if not x.get("value") and not x.get("auto_select")]
        if self.limit < 0 or self.offset < 0:
            out.append("offset and limit can't be negative")
        return out
