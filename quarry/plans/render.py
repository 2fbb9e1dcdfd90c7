"""Results as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def documents(page: DataFrame) -> DataFrame:
    """(json): each row of a page as one object; nulls are left out."""
    return page.select(F.to_json(F.struct(*page.columns)).alias("json"))


def nested(rows: list[tuple[str, int]], separator: str = ">") -> list[dict]:
    """The nodes (path, count) of a facet as a tree: ``[{"label", "count", "sub_labels"}]``, in order of their names."""
    top: dict = {}
    for path, count in sorted(rows):
        at = top
        for part in path.split(separator):
            node = at.setdefault(part, {"count": 0, "sub": {}})
            last, at = node, node["sub"]
        last["count"] = count
    build = lambda level: [{"label": k, "count": v["count"], "sub_labels": build(v["sub"])} for k, v in sorted(level.items())]
    return build(top)


def response(result) -> str:
    """One page with its totals and facets as JSON text. What it holds is bounded by the page and by the facets' labels, as a caller asks for them."""
    found = {}
    for name, table in result.facets.items():
        if "level" in table.columns:
            found[name] = nested([(r["value"], r["count"]) for r in table.collect()])
        else:
            found[name] = [{k: str(v) if k == "value" else v for k, v in r.asDict().items() if v is not None} for r in table.collect()]
    body = {"total_count": result.totals.first()["total_count"], "resources": [json.loads(r["json"]) for r in documents(result.page).collect()], "group": found}
    return json.dumps(body, ensure_ascii=False)
