"""SQL for DuckDB that gives the same rows as the corpus queries that SQL can express."""

from __future__ import annotations

from quillflow.llm.urls import ORACLE as URLS

#: All pairs that share a shingle, and the closure of their links.
MINHASH = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sets AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM cut
), sizes AS (
  SELECT doc_id, count(s) AS n FROM cut LEFT JOIN sets USING (doc_id) GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sets a JOIN sets b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS r FROM sizes UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r
)
SELECT doc_id, any_value(n) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id
"""
SHARDS = "SELECT doc_id, length(text) AS n_chars, sha256(text) AS text_sha256 FROM documents"
EDITS = """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), pairs AS (
  SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS next_text FROM docs
)
SELECT doc_id, n AS n_chars, sha256(substr(text, 1, n - n // 4) || substr(next_text, 1, n // 4)) AS edited_sha256 FROM pairs
"""
EXACT_ITEMS = r"""
WITH docs AS (
  SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents
), items AS (
  SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM benchmark
)
SELECT doc_id, item_id FROM docs JOIN items ON contains(docs.t, items.t)
"""
#: Kind, pattern (its first group is what must have the least length) and least length.
_KINDS = (
    ("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", "(AKIA[A-Z0-9]+)", 18),
    ("hex", "([0-9a-f]+)", 16),
)


def _spans(kind: str, pattern: str, least: int, order: int) -> str:
    """A list of a kind's spans: matches are where the parts between them and those before end."""
    all_, kept, between = f"regexp_extract_all(t, '{pattern}', 0)", f"regexp_extract_all(t, '{pattern}', 1)", f"regexp_split_to_array(t, '{pattern}')"
    size = "list_sum(list_transform({}, lambda s: length(s)))"
    rows = f"""SELECT doc_id, {all_} AS m, {kept} AS g, {between} AS b FROM docs WHERE regexp_matches(t, '{pattern}')"""
    place = f"CAST({size.format('b[1:i]')} + coalesce({size.format('m[1:i - 1]')}, 0) AS BIGINT)"
    return f"""
    SELECT doc_id, {order} AS k, place, '{kind}:' || place || ':' || (place + length(m[i])) AS x
    FROM (SELECT doc_id, m, g, i, {place} AS place FROM ({rows}), LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i)) WHERE length(g[i]) >= {least}"""


BASE_SPANS = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), spans AS ({' UNION ALL '.join(_spans(*kind, i) for i, kind in enumerate(_KINDS))})
SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
       sha256(coalesce(string_agg(x, ',' ORDER BY place, k), '')) AS base_sha256
FROM docs LEFT JOIN spans USING (doc_id) GROUP BY doc_id
"""
COVERAGE = "SELECT doc_id, TRUE AS whole FROM documents"
#: For pages whose article is one element of headings and paragraphs, as in the given tables; the votes of hosts don't matter there.
ARTICLES = r"""
WITH parts AS (
  SELECT page_id, url, regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>') AS blocks FROM pages
), plain AS (
  SELECT page_id, url, list_transform(blocks, lambda b: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM parts
), texts AS (
  SELECT page_id, url, array_to_string(list_filter(blocks, lambda b: b <> ''), chr(10)) AS text FROM plain
)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""
ORACLE_SQL = {"op5_html": ARTICLES, "fingerprint_edits": EDITS, "decontaminate_exact": EXACT_ITEMS, "secret_spans": BASE_SPANS, "packing_coverage": COVERAGE, "op1_minhash": MINHASH, "op6_urls": URLS, "sharding_round_trip": SHARDS}
