"""One query for each operator, through the library's own functions, over whole tables."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow import fs
from quillflow.functions import backoff_column, content_key, query_params, uri_fragment, uri_struct
from quillflow.model import Policy, Retry
from quillflow.operators import ColumnTool, Memo, PandasTool, ProcessTool, RowTool, apply_tool, batch, domain_lines, flat_map, fork, numbered, sliding, split_errors, tap
from quillflow.plans import Runner, count_by_state, first_open, illegal_moves, pipeline, tree_order
from quillflow.sources import JsonlSource, JsonlTarget
from quillflow.streaming import landed_stream, run_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LONG_CHARS = 5000
#: Stand-ins for run states in ``events``.
EVENT_STATES = {"click": "running", "error": "failed", "purchase": "done", "signup": "pending", "view": "paused"}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(items: str, sep: str = ",") -> F.Column:
    return F.array_join(F.transform(items, lambda x: x.cast("string")), sep)


NORMALIZE = ColumnTool("normalize", "1.0.0", lambda c: F.lower(F.trim(c)))


@query
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source -> flat_map(lines) -> batch(5)."""
    lines = flat_map(table(spark, sf_dir, "documents").select("doc_id", "text"), F.split("text", "\n", -1), position="line_index")
    groups = batch(lines, 5, "doc_id", "line_index")
    return groups.select("batch", F.size("items").cast("bigint").alias("n_items"), F.array_join("items", "\n").alias("lines"))


@query
def flatmap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = flat_map(table(spark, sf_dir, "documents").select("doc_id", "text"), F.split("text", "\n", -1), item="line", position="line_index")
    return lines.select("doc_id", F.col("line_index").cast("bigint").alias("line_index"), "line")


@query
def domain_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain_lines(table(spark, sf_dir, "documents"))


@query
def batch_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch(table(spark, sf_dir, "documents").select("doc_id"), 5, "doc_id", item="doc_id").select("batch", joined("items").alias("items"))


@query
def batch_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of three turns that start anew with each conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return batch(turns, 3, "turn", item="role", within=["conv_id"]).select("conv_id", "batch", joined("items").alias("items"))


@query
def jsonl_batch_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = batch(table(spark, sf_dir, "documents").select("doc_id"), 7, "doc_id", item="doc_id", tail="single")
    return groups.select("batch", F.size("items").cast("bigint").alias("n_items"), joined("items").alias("items"))


@query
def window_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = sliding(table(spark, sf_dir, "events").select("event_id"), 3, "event_id", item="event_id")
    return frames.select("event_id", joined("items").alias("items"))


@query
def window_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial windows of four with a step of two, for each user."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    return sliding(events, 4, "event_id", item="event_id", step=2, partial=True, within=["user_id"]).select("user_id", "event_id", joined("items").alias("items"))


@query
def global_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice").select("number", "l_orderkey", "l_linenumber", "l_partkey")


@query
def resume_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a source gives from cursor 100 on."""
    return numbered(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id").where("number > 100").select("number", "doc_id", "lang", "source")


@query
def uri_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", uri_struct(F.col("url")).alias("u")).select("page_id", "u.*")


@query
def uri_fragment_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", uri_fragment(F.col("url")).alias("fragment"))


@query
def uri_query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", uri_struct(F.col("url"))["query"].alias("q"))
    return flat_map(pages, query_params(F.col("q")), item="p").select("page_id", F.col("p.key").alias("param"), F.col("p.value").alias("value"))


@query
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", content_key("normalize", "1.0.0", *(F.col(c) for c in ("conv_id", "turn", "role", "text"))).alias("key"))


def _known(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents with keys, and the keys that a run over one source has left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", content_key("normalize", "1.0.0", F.col("text"), F.col("lang")).alias("key"))
    return docs, docs.where("source = 'src0'").select("key").distinct()


@query
def cache_hit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, known = _known(spark, sf_dir)
    return docs.join(known.withColumn("hit", F.lit(True)), "key", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("hit"))


@query
def cache_miss_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, known = _known(spark, sf_dir)
    return docs.join(known, "key", "left_anti").groupBy("key").agg(F.min("doc_id").alias("doc_id"))


@query
def cache_second_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A remembered tool over two runs: the second gets its results from the memo table alone."""
    memo = Memo(spark, fs.scratch(spark, "memo"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("item"))
    memo.apply(turns, "normalize", "1.0.0", lambda todo: apply_tool(todo, NORMALIZE))

    def never(todo: DataFrame) -> DataFrame:
        if not todo.isEmpty():
            raise RuntimeError("a known item came back")
        return todo

    return memo.apply(turns, "normalize", "1.0.0", never).select("conv_id", "turn", "item")


@query
def tool_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_tool(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("item")), NORMALIZE)


@query
def tool_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = PandasTool("length", "1.0.0", lambda s: s.str.len(), "bigint")
    return apply_tool(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("item")), tool)


@query
def tool_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool that fails at its first attempt with each item, and then succeeds."""
    seen: set = set()

    def flaky(x: str) -> int:
        if x not in seen:
            seen.add(x)
            raise RuntimeError("not yet")
        seen.discard(x)
        return len(x)

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("item"))
    return apply_tool(rows, RowTool("flaky", "1.0.0", flaky, "bigint"), Policy(Retry(2, 0, "fixed")))


@query
def tool_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program that answers JSON lines, one process for each Arrow batch."""
    program = "import sys,json\nfor l in sys.stdin:\n x=json.loads(l); print(json.dumps({'seq':x['seq'],'item':len(x['item'])}))"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("item"))
    return apply_tool(rows, ProcessTool("length", "1.0.0", [sys.executable, "-c", program], "bigint"))


@query
def dead_letter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a tool refuses go to the dead letters, the others on; the tool's result is written once."""

    def short(x: str) -> int:
        if len(x) > LONG_CHARS:
            raise ValueError("too long")
        return len(x)

    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("item"))
    staged = apply_tool(rows, RowTool("short", "1.0.0", short, "bigint"), Policy(Retry(0), "dead-letter"))
    path = fs.scratch(spark, "staged")
    staged.write.parquet(path)
    good, dead = split_errors(spark.read.parquet(path), "1-tool-short")
    both = good.select(F.lit("ok").alias("outcome")).unionByName(dead.select(F.concat(F.lit("dead:"), F.col("error.name")).alias("outcome")))
    return both.groupBy("outcome").agg(F.count("*").alias("n"))


@query
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.explode(F.array(*(F.lit(x) for x in ("fixed", "linear", "exp")))).alias("strategy")
    return spark.range(4).select(names, F.col("id").alias("attempt")).select("strategy", "attempt", backoff_column(F.col("strategy"), F.lit(1000), F.col("attempt")).alias("wait_ms"))


@query
def fork_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("item"))
    return fork(rows, lambda df: apply_tool(apply_tool(df, NORMALIZE), ColumnTool("length", "1.0.0", lambda c: F.length(c).cast("bigint"))))


@query
def tap_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tap(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "seen", F.count("*").alias("rows"))[0]


@query
def json_item_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint tree: a root, a node for each conversation, and one for each turn."""
    turns = table(spark, sf_dir, "conversations")
    conv = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    root = spark.range(1).select(F.lit("run").alias("run_id"), F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("bigint").alias("ord"), F.lit("in-progress").alias("state"))
    middle = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select(F.lit("run").alias("run_id"), conv.alias("node_id"), F.lit("root").alias("parent_id"), F.col("conv_id").alias("ord"), F.when(F.col("n") > 4, "done").otherwise("pending").alias("state"))
    leaf = turns.select(F.lit("run").alias("run_id"), F.concat(conv, F.lit("-t"), F.col("turn").cast("string")).alias("node_id"), conv.alias("parent_id"), F.col("turn").alias("ord"), F.when(F.col("role") == "user", "done").otherwise("pending").alias("state"))
    return root.unionByName(middle).unionByName(leaf)


@query
def checkpoint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by_state(_tree(spark, sf_dir))


@query
def checkpoint_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_order(_tree(spark, sf_dir)).groupBy(F.col("depth").cast("bigint").alias("depth"), "state").agg(F.count("*").alias("n"))


@query
def checkpoint_first_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_open(tree_order(_tree(spark, sf_dir)).where("depth > 0")).select("run_id", "node_id", "state")


def _states() -> F.Column:
    return F.create_map(*(F.lit(x) for kv in EVENT_STATES.items() for x in kv))[F.col("event_type")]


@query
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", _states().alias("state"))
    return illegal_moves(events, "user_id", "state", "event_id")


@query
def runs_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run for each user: begin, last change, latest state; the latest begun first."""
    events = table(spark, sf_dir, "events")
    runs = events.groupBy(F.col("user_id").alias("run_id")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"), F.max_by(_states(), F.struct("ts", "event_id")).alias("state"))
    return runs.orderBy(F.desc("started_at"), "run_id")


@query
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines and read back."""
    path = fs.scratch(spark, "jsonl")
    docs = table(spark, sf_dir, "documents")
    JsonlTarget(path).write(docs.select(F.struct("doc_id", "text", "lang").alias("item")))
    return JsonlSource(path, item_schema="doc_id bigint, text string, lang string").read(spark).df.select("item.*")


@query
def pipeline_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The builder and runner from end to end: lines of documents, normalised, in batches of ten, written as Parquet."""
    out = fs.scratch(spark, "out")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    p = pipeline("lines").from_(docs, "doc_id").flat_map(lambda c: F.split(c["text"], "\n", -1)).use(NORMALIZE).batch(10).to(f"parquet:{out}")
    Runner(spark, fs.scratch(spark, "runs")).start(p)
    return spark.read.parquet(out).select(F.col("seq").alias("batch"), F.size("items").cast("bigint").alias("n_items"), F.array_join("items", "\n").alias("lines"))


@query
def streaming_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events landed as JSON files, read as a stream, each micro-batch through a batch plan."""
    land, out, mark = (fs.scratch(spark, x) for x in ("landed", "out", "checkpoint"))
    events = table(spark, sf_dir, "events")
    events.select(F.col("event_id").alias("seq"), F.to_json(F.struct("event_id", "event_type")).alias("item")).write.json(land)
    run_stream(landed_stream(spark, land), lambda df: df.select("seq", F.get_json_object("item", "$.event_type").alias("event_type")), out, mark).awaitTermination()
    return spark.read.parquet(out).select(F.col("seq").alias("event_id"), "event_type")
