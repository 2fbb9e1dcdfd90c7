"""Queries of this folder and their SQL."""

from quarry.llm import hnsw, imatch, langid, licenses, line_dedup, packing, pieces, shingle_join, toxicity, url_graph

QUERIES = {
    "op1_imatch": imatch.op1_imatch,
    "op2_url_graph": url_graph.op2_url_graph,
    "op3_nearest": hnsw.op3_nearest,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_pieces": pieces.op5_pieces,
    "op6_licenses": licenses.op6_licenses,
    "op7_shingle_join": shingle_join.op7_shingle_join,
    "op8_language": langid.op8_language,
    "op9_packing": packing.op9_packing,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

#: Sets of shingles are compared once for all documents that share one; groups are what a closure of the links reaches.
SHINGLE_JOIN = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
    SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END) AS s FROM w),
c AS (SELECT s, row_number() OVER (ORDER BY min(doc_id)) AS k, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
x AS (SELECT k, n, unnest(s) AS g FROM c),
l AS (SELECT a.k AS a, b.k AS b FROM x a JOIN x b ON a.g = b.g AND a.k < b.k GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT k AS a, k AS b FROM c UNION SELECT r.a, e.b FROM r JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) e ON r.b = e.a),
g AS (SELECT a AS k, min(b) AS root FROM r GROUP BY a),
d AS (SELECT s.doc_id, len(s.s) AS n, g.root FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN g ON c.k = g.k)
SELECT doc_id, n AS n_shingles, CASE WHEN root IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY root) END AS component_id FROM d
"""

ORACLES: dict[str, str] = {"op7_shingle_join": SHINGLE_JOIN}
