"""SQL for DuckDB that gives the same rows as the queries of the same name."""

from __future__ import annotations

from quillflow.catalog.queries import EVENT_STATES, LONG_CHARS
from quillflow.model import MOVES

_LINES = "SELECT doc_id, i - 1 AS line_index, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)"
_KEYED = "SELECT doc_id, source, sha256(CAST(to_json({'tool': 'normalize', 'version': '1.0.0', 'text': text, 'lang': lang}) AS VARCHAR)) AS key FROM documents"
_TREE = """
  SELECT 'run' AS run_id, 'root' AS node_id, CAST(NULL AS VARCHAR) AS parent_id, CAST(0 AS BIGINT) AS ord, 'in-progress' AS state
  UNION ALL SELECT 'run', 'c' || conv_id, 'root', conv_id, CASE WHEN count(*) > 4 THEN 'done' ELSE 'pending' END FROM conversations GROUP BY conv_id
  UNION ALL SELECT 'run', 'c' || conv_id || '-t' || turn, 'c' || conv_id, turn, CASE WHEN role = 'user' THEN 'done' ELSE 'pending' END FROM conversations
"""
_ORDERED = f"""
WITH RECURSIVE nodes AS ({_TREE}), tree AS (
  SELECT *, CAST(0 AS BIGINT) AS depth, lpad(CAST(ord AS VARCHAR), 10, '0') AS path FROM nodes WHERE parent_id IS NULL
  UNION ALL
  SELECT n.*, t.depth + 1, t.path || '/' || lpad(CAST(n.ord AS VARCHAR), 10, '0') FROM nodes n JOIN tree t ON n.parent_id = t.node_id
)
"""
_STATE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_STATES.items()) + " END"
_LEGAL = ", ".join(f"('{a}', '{b}')" for a, many in MOVES.items() for b in many)
_URI = "'^([^:]+)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?'"


def _batched(rows: str, n: int) -> str:
    return f"SELECT (rn - 1) // {n} AS batch, count(*) AS n_items, string_agg(line, chr(10) ORDER BY rn) AS lines FROM ({rows}) GROUP BY 1"


ORACLE_SQL = {
    "flagship": _batched(f"SELECT line, row_number() OVER (ORDER BY doc_id, line_index) AS rn FROM ({_LINES})", 5),
    "flatmap_lines": _LINES,
    "domain_hierarchy": f"SELECT 'd' || doc_id || '-l' || line_index AS id, 'd' || doc_id AS paragraphId, line AS text, CAST(line_index AS INTEGER) AS index FROM ({_LINES})",
    "batch_items": "SELECT (rn - 1) // 5 AS batch, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rn) AS items FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) GROUP BY 1",
    "batch_within": "SELECT conv_id, (rn - 1) // 3 AS batch, string_agg(role, ',' ORDER BY rn) AS items FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY 1, 2",
    "jsonl_batch_size": """
        SELECT CASE WHEN rn <= tot - tot % 7 THEN (rn - 1) // 7 ELSE tot // 7 + (rn - (tot - tot % 7)) - 1 END AS batch,
               count(*) AS n_items, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rn) AS items
        FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS tot FROM documents) GROUP BY 1""",
    "window_items": """
        SELECT event_id, array_to_string(items, ',') AS items FROM (
          SELECT event_id, list(event_id) OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS items FROM events) WHERE len(items) = 3""",
    "window_within": """
        SELECT user_id, event_id, array_to_string(items, ',') AS items FROM (
          SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
                 list(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS items FROM events)
        WHERE (rn - 1) % 2 = 0""",
    "global_numbering": "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS number, l_orderkey, l_linenumber, l_partkey FROM lineitem",
    "resume_cursor": "SELECT number, doc_id, lang, source FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS number FROM documents) WHERE number > 100",
    "uri_parse": f"SELECT page_id, regexp_extract(url, {_URI}, 1) AS scheme, regexp_extract(url, {_URI}, 2) AS host, regexp_extract(url, {_URI}, 3) AS path, regexp_extract(url, {_URI}, 4) AS query FROM pages",
    "uri_fragment_": "SELECT page_id, regexp_extract(url, '^[^#]*(?:#(.*))?$', 1) AS fragment FROM pages",
    "uri_query_params": f"""
        SELECT page_id, split_part(p, '=', 1) AS param, CASE WHEN strpos(p, '=') > 0 THEN substr(p, strpos(p, '=') + 1) ELSE '' END AS value
        FROM (SELECT page_id, unnest(string_split(regexp_extract(url, {_URI}, 4), '&')) AS p FROM pages) WHERE split_part(p, '=', 1) <> ''""",
    "cache_key": "SELECT conv_id, turn, sha256(CAST(to_json({'tool': 'normalize', 'version': '1.0.0', 'conv_id': conv_id, 'turn': turn, 'role': role, 'text': text}) AS VARCHAR)) AS key FROM conversations",
    "cache_hit_join": f"WITH k AS ({_KEYED}) SELECT doc_id, key IN (SELECT key FROM k WHERE source = 'src0') AS hit FROM k",
    "cache_miss_anti": f"WITH k AS ({_KEYED}) SELECT key, min(doc_id) AS doc_id FROM k WHERE key NOT IN (SELECT key FROM k WHERE source = 'src0') GROUP BY key",
    "cache_second_run": "SELECT conv_id, turn, lower(trim(text)) AS item FROM conversations",
    "tool_normalize": "SELECT doc_id, lower(trim(text)) AS item FROM documents",
    "tool_pandas": "SELECT doc_id, length(text) AS item FROM documents",
    "tool_retry": "SELECT conv_id, turn, length(text) AS item FROM conversations",
    "tool_pipe": "SELECT conv_id, turn, length(text) AS item FROM conversations",
    "dead_letter_split": f"SELECT CASE WHEN length(text) > {LONG_CHARS} THEN 'dead:ValueError' ELSE 'ok' END AS outcome, count(*) AS n FROM documents GROUP BY 1",
    "retry_schedule": "SELECT strategy, attempt, CAST(CASE strategy WHEN 'linear' THEN 1000 * (attempt + 1) WHEN 'exp' THEN 1000 * power(2, attempt) ELSE 1000 END AS BIGINT) AS wait_ms FROM (VALUES ('fixed'), ('linear'), ('exp')) s(strategy), range(4) r(attempt)",
    "fork_inline": "SELECT conv_id, turn, length(lower(trim(text))) AS item FROM conversations",
    "tap_passthrough": "SELECT doc_id, n_chars FROM documents",
    "json_item_field": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "checkpoint_counts": f"SELECT run_id, state, count(*) AS n FROM ({_TREE}) GROUP BY 1, 2",
    "checkpoint_depth": f"{_ORDERED} SELECT depth, state, count(*) AS n FROM tree GROUP BY 1, 2",
    "checkpoint_first_open": f"{_ORDERED} SELECT run_id, node_id, state FROM tree WHERE depth > 0 AND state <> 'done' ORDER BY path LIMIT 1",
    "state_transitions": f"""
        SELECT user_id, event_id, prev_state, state, (prev_state, state) IN (VALUES {_LEGAL}) AS legal FROM (
          SELECT user_id, event_id, {_STATE} AS state, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_state FROM events) WHERE prev_state IS NOT NULL""",
    "runs_list": f"SELECT user_id AS run_id, min(ts) AS started_at, max(ts) AS updated_at, arg_max({_STATE}, (ts, event_id)) AS state FROM events GROUP BY 1 ORDER BY started_at DESC, run_id",
    "jsonl_round_trip": "SELECT doc_id, text, lang FROM documents",
    "pipeline_run": _batched(f"SELECT lower(trim(line)) AS line, row_number() OVER (ORDER BY doc_id, line_index) AS rn FROM ({_LINES})", 10),
    "streaming_replay": "SELECT event_id, event_type FROM events",
}

_SHORT = f"CASE WHEN length(text) > {LONG_CHARS} THEN -1 ELSE length(text) END"


def _values(columns: str, *rows: tuple) -> str:
    """A table of the given rows."""
    text = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({columns})"


#: Of the runs that the shipped code makes.
ORACLE_SQL |= {
    "jsonl_source_batches": """
        SELECT min(rn) - 1 AS seq, count(*) AS n_items, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rn) AS items
        FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS tot FROM documents)
        GROUP BY CASE WHEN rn <= tot - tot % 7 THEN (rn - 1) // 7 ELSE tot + rn END""",
    "jsonl_source_resumed": "SELECT rn - 1 AS seq, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) WHERE rn > 100",
    "jsonl_dead_letters": "SELECT CASE WHEN doc_id % 10 = 0 THEN 'MalformedLine' ELSE 'ok' END AS outcome, doc_id FROM documents",
    "column_dead_letters": f"SELECT doc_id, {_SHORT} AS item FROM documents",
    "pandas_dead_letters": f"SELECT doc_id, {_SHORT} AS item FROM documents",
    "skip_item_run": f"SELECT doc_id, length(text) AS item FROM documents WHERE length(text) <= {LONG_CHARS}",
    "result_shape_checked": "SELECT CAST(n_nationkey AS BIGINT) AS seq, CASE WHEN length(n_name) % 2 = 1 THEN length(n_name) END AS item, length(n_name) % 2 = 0 AS failed FROM nation",
    "child_for_each_item": "SELECT CAST(n_nationkey AS BIGINT) AS seq, lower(n_name) AS item FROM nation",
    "memo_lookups": """
        WITH kept AS (SELECT DISTINCT text FROM documents WHERE source = 'src0' AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0))
        SELECT doc_id, kept.text IS NOT NULL AS hit, length(trim(kept.text)) AS n_chars FROM documents LEFT JOIN kept USING (text)""",
    "memo_cleared": "SELECT count(*) AS known, CAST(0 AS BIGINT) AS hits, count(*) AS n FROM nation",
    "runs_listed": _values("pipeline_id, state", ("done", "done"), ("paused", "paused"), ("failed", "failed")),
    "run_paused_and_resumed": "SELECT CAST(n_nationkey AS BIGINT) AS seq, lower(n_name) AS item FROM nation",
    "run_of_stored_steps": "SELECT s AS step, 'done' AS state, CASE WHEN s = 'batch' THEN (n + 3) // 4 ELSE n END AS n FROM (SELECT count(*) AS n FROM nation), (VALUES ('source'), ('tool'), ('batch')) t(s)",
    "drained_run": "SELECT count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents",
    "no_source_run": _values("rows, item", (1, "made")),
    "forks_in_turn": """
        SELECT seq, CAST(total AS BIGINT) AS total FROM (
          SELECT seq, sum(n) OVER w AS total, count(*) OVER w AS rows FROM (SELECT conv_id * 1000 + turn AS seq, length(lower(trim(text))) AS n FROM conversations)
          WINDOW w AS (ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE rows = 3""",
    "own_source_and_target": "SELECT r_regionkey AS seq, upper(r_name) AS name, TRUE AS known FROM region",
    "uri_on_both_sides": _values(
        "i, raw, scheme, host, path, same",
        (0, "jsonl://./file.jsonl?batchSize=5#part", "jsonl", "", "./file.jsonl", True),
        (1, "http://localhost:7000/in?path=/chapter", "http", "localhost:7000", "/in", True),
        (2, "parquet:/a/b", "parquet", "", "/a/b", True),
        (3, "jsonl:///a/b", "jsonl", "", "/a/b", True),
        (4, "x://h?q", "x", "h", "", True),
        (5, "s3a://h/p:q/r#f?g", "s3a", "h", "/p:q/r", True),
        (6, "not-a-uri", "", "", "", True),
        (7, "1x://h", "", "", "", True),
        (8, "x+y-1.z://../up", "x+y-1.z", "", "../up", True),
        (9, "a b://c", "", "", "", True),
        (10, "x://host", "x", "host", "", True),
        (11, "mailto:me", "mailto", "", "me", True),
        (12, "", "", "", "", True),
    ),
    "folder_round_trip": "SELECT n_regionkey, n_name FROM nation",
    "formats_round_trip": "SELECT n_nationkey, n_name FROM nation",
    "standard_streams": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS seq, n_name AS name FROM nation",
    "posted_and_landed": "SELECT CAST(n_nationkey AS BIGINT) AS seq, n_name AS item FROM nation",
    "retries_and_waits": """
        SELECT strategy, f AS failures, CASE WHEN f <= 3 THEN 'ok' ELSE 'failed' END AS outcome, least(f, 3) + 1 AS attempts,
               CAST(CASE strategy WHEN 'fixed' THEN 1000 * least(f, 3) WHEN 'linear' THEN 500 * least(f, 3) * (least(f, 3) + 1) ELSE 1000 * (power(2, least(f, 3)) - 1) END AS BIGINT) AS waited_ms
        FROM (VALUES ('fixed'), ('linear'), ('exp')) s(strategy), range(5) r(f)""",
    "policy_fields": _values("i, most, backoff_ms, strategy, on_error", (0, 3, 50, "exp", "dead-letter"), (1, 5, 50, "exp", "dead-letter"), (2, 3, 50, "linear", "skip-item")),
    "checkpoint_marks": _values(
        "step, depth, state, error, found, done_before, done_after",
        ("root", 0, "pending", None, True, False, True),
        ("source-1", 1, "done", None, True, False, True),
        ("tool-1", 1, "pending", None, True, False, True),
        ("fork-1", 2, "failed", "no", True, False, True),
        ("fork-2", 2, "pending", None, True, False, True),
    ),
    "store_files": _values("name, there, text, after", ("a", True, "two\nthree\n", False), ("b", True, "four\n", True), ("c", False, None, False)),
    "command_line": "SELECT line, count(*) AS n, TRUE AS told FROM (SELECT lower(n_name) AS line FROM nation UNION ALL SELECT 'x' FROM nation) GROUP BY 1",
}
