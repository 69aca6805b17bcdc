"""Queries that drive whole runs, sources, targets, stores and the command line, through the shipped code."""

from __future__ import annotations

import contextlib
import io
import json
import os
import sys
from unittest import mock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow import cli, fs
from quillflow.catalog.queries import LONG_CHARS, NORMALIZE, query, table
from quillflow.functions import content_key, parse_uri, uri_struct, with_retry
from quillflow.model import DEFAULT_POLICY, META, Policy, Retry
from quillflow.operators import ColumnTool, Memo, PandasTool, ProcessTool, RowTool, apply_tool
from quillflow.plans import CheckpointTree, Runner, dead_letters, list_runs, pipeline
from quillflow.sources import JsonlSource, JsonlTarget, Stream, default_registry
from quillflow.streaming.http import HttpReceiver, HttpTarget

URIS = ("jsonl://./file.jsonl?batchSize=5#part", "http://localhost:7000/in?path=/chapter", "parquet:/a/b", "jsonl:///a/b", "x://h?q", "s3a://h/p:q/r#f?g", "not-a-uri", "1x://h", "x+y-1.z://../up", "a b://c", "x://host", "mailto:me", "")


def _lines(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a JSON line for each document, in order."""
    path = fs.scratch(spark, "jsonl")
    JsonlTarget(path).write(table(spark, sf_dir, "documents").orderBy("doc_id").select(F.struct("doc_id").alias("item")))
    return path


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("item"), F.lit(None).cast(META).alias("meta"))


def _folder(spark: SparkSession, name: str) -> str:
    """A new local folder, for what the driver's own programs read and write."""
    path = fs.scratch(spark, name).removeprefix("file://")
    os.makedirs(path)
    return path


def _refuse_long(x: str) -> int:
    if len(x) > LONG_CHARS:
        raise ValueError("too long")
    return len(x)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("item"))


@query
def jsonl_source_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``?batchSize=7``: groups of seven, the tail one by one."""
    df = JsonlSource(_lines(spark, sf_dir), batch_size=7, item_schema="doc_id bigint").read(spark).df
    some = F.coalesce("items", F.array("item"))
    return df.select("seq", F.size(some).cast("bigint").alias("n_items"), F.array_join(F.transform(some, lambda x: x["doc_id"].cast("string")), ",").alias("items"))


@query
def jsonl_source_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JsonlSource(_lines(spark, sf_dir), batch_size=7, item_schema="doc_id bigint").resume(100).read(spark).df.select("seq", "item.doc_id")


@query
def jsonl_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed lines go to the dead letters of the run, the others on."""
    land, out, root = (fs.scratch(spark, x) for x in ("land", "out", "runs"))
    docs = table(spark, sf_dir, "documents").orderBy("doc_id")
    docs.select(F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit('{"item": '), F.col("doc_id").cast("string"))).otherwise(F.to_json(F.struct(F.struct("doc_id").alias("item"))))).write.text(land)
    run = Runner(spark, root).start(pipeline("lines").from_(f"jsonl:{land}?onError=dead-letter&schema=doc_id bigint").to(f"parquet:{out}"))
    good = spark.read.parquet(out).select(F.lit("ok").alias("outcome"), F.col("item.doc_id").alias("doc_id"))
    dead = dead_letters(spark, root, run).select(F.col("error.name").alias("outcome"), F.regexp_extract(F.get_json_object("envelope", "$.item"), r"\d+", 0).cast("bigint").alias("doc_id"))
    return good.union(dead)


def _dead_letters(spark: SparkSession, sf_dir: str, tool) -> DataFrame:
    out, root = fs.scratch(spark, "out"), fs.scratch(spark, "runs")
    p = pipeline("lengths", retry={"max": 0}, on_error="dead-letter").from_(_texts(spark, sf_dir).withColumnRenamed("doc_id", "seq")).use(tool).to(f"parquet:{out}")
    run = Runner(spark, root).start(p)
    good = spark.read.parquet(out).select(F.col("seq").alias("doc_id"), F.col("item").cast("bigint").alias("item"))
    dead = dead_letters(spark, root, run)
    return good if dead is None else good.union(dead.select(F.get_json_object("envelope", "$.seq").cast("bigint"), F.lit(-1).cast("bigint")))


@query
def column_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column tool's refused rows as dead letters (-1)."""
    return _dead_letters(spark, sf_dir, ColumnTool("short", "1.0.0", F.length, accepts=lambda c: F.length(c) <= LONG_CHARS))


@query
def pandas_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas tool fails a batch; the rows at fault are found and become dead letters (-1)."""

    def short(s):
        if (s.str.len() > LONG_CHARS).any():
            raise ValueError("too long")
        return s.str.len()

    return _dead_letters(spark, sf_dir, PandasTool("short", "1.0.0", short, "bigint"))


@query
def skip_item_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose tool drops what it refuses."""
    out = fs.scratch(spark, "out")
    p = pipeline("short", retry={"max": 0}, on_error="skip-item").from_(_texts(spark, sf_dir).withColumnRenamed("doc_id", "seq")).use(RowTool("short", "1.0.0", _refuse_long, "bigint")).to(f"parquet:{out}")
    Runner(spark, fs.scratch(spark, "runs")).start(p)
    return spark.read.parquet(out).select(F.col("seq").alias("doc_id"), "item")


@query
def result_shape_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that haven't the declared type are errors of their rows."""
    tool = RowTool("odd", "1.0.0", lambda x: len(x) if len(x) % 2 else str(len(x)), "bigint")
    rows = apply_tool(_nations(spark, sf_dir), tool, Policy(Retry(0), "skip-item"))
    return rows.select("seq", "item", F.col("_error").isNotNull().alias("failed"))


@query
def child_for_each_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program that is started once for each item."""
    program = "import sys,json; x=json.loads(sys.stdin.readline()); print(json.dumps({'item': x['item'].lower()}))"
    return apply_tool(_nations(spark, sf_dir).drop("meta"), ProcessTool("lower", "1.0.0", [sys.executable, "-c", program], mode="once"))


@query
def memo_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memo.has, get and delete: what one source's run has left, without the even documents' results."""
    memo, docs = Memo(spark, fs.scratch(spark, "memo")), _texts(spark, sf_dir)
    some = table(spark, sf_dir, "documents").where("source = 'src0'").select("doc_id", F.col("text").alias("item"))
    memo.apply(some, "normalize", "1.0.0", lambda todo: apply_tool(todo, NORMALIZE))
    keyed = docs.select("doc_id", content_key("normalize", "1.0.0", F.col("item")).alias("key"))
    even = keyed.where("doc_id % 2 = 0").select("key")
    memo.delete(even)
    found = keyed.join(memo.has(keyed.select("key").distinct()), "key").join(memo.get(keyed.select("key")), "key", "left")
    return found.select("doc_id", "hit", F.length("output").cast("bigint").alias("n_chars"))


@query
def memo_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    memo, rows = Memo(spark, fs.scratch(spark, "memo")), _nations(spark, sf_dir)
    memo.apply(rows, "normalize", "1.0.0", lambda todo: apply_tool(todo, NORMALIZE))
    before = memo.table().count()
    memo.clear()
    keys = rows.select(content_key("normalize", "1.0.0", F.col("item")).alias("key"))
    return memo.has(keys).agg(F.lit(before).cast("bigint").alias("known"), F.count_if("hit").alias("hits"), F.count("*").alias("n"))


def _three_runs(spark: SparkSession, sf_dir: str, root: str) -> dict[str, str]:
    """A run that is done, one that is paused, and one that has failed; their ids."""
    rows = _nations(spark, sf_dir)
    ids = {"done": Runner(spark, root).start(pipeline("done").from_(rows).use(NORMALIZE).build())}
    ids["paused"] = Runner(spark, root, pause_when=lambda step: "tool" in step).start(pipeline("paused").from_(rows).use(NORMALIZE).build())
    failing = RowTool("fails", "1.0.0", lambda x: 1 // 0, "bigint")
    try:
        Runner(spark, root).start(pipeline("failed", retry={"max": 0}).from_(rows).use(failing).build(), "failed-run")
    except Exception as e:
        if "fails: ZeroDivisionError" not in str(e):
            raise
    return ids | {"failed": "failed-run"}


@query
def runs_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fs.scratch(spark, "runs")
    _three_runs(spark, sf_dir, root)
    return list_runs(spark, root).select("pipeline_id", "state")


@query
def run_paused_and_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that stops before its target and goes on; the tool's staged result isn't made again."""
    out, root = fs.scratch(spark, "out"), fs.scratch(spark, "runs")
    p = pipeline("p").from_(_nations(spark, sf_dir)).use(RowTool("lower", "1.0.0", str.lower, "string")).to(f"parquet:{out}")
    run = Runner(spark, root, pause_when=lambda step: "target" in step).start(p)
    Runner(spark, root).resume(run, p)
    Runner(spark, root).resume(run, p)  # a finished run is left as it is
    return spark.read.parquet(out).select("seq", "item")


@query
def run_of_stored_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """persistState: what state.json keeps of each step when all of them are staged."""
    root = fs.scratch(spark, "runs")
    run = Runner(spark, root, stage_all=True).start(pipeline("p").from_(_nations(spark, sf_dir)).use(NORMALIZE).batch(4).build())
    said = json.loads(fs.read_text(spark, f"{root}/runs/{run}/state.json"))
    rows = [(c["step_id"].split("-")[1], c["state"], spark.read.parquet(c["path"]).count()) for c in said["checkpoint"]["children"]]
    return spark.createDataFrame(rows, "step string, state string, n long")


@query
def drained_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline without a target is drained; the tap's metrics tell what passed."""
    runner = Runner(spark, fs.scratch(spark, "runs"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    runner.start(pipeline("p").from_(docs, "doc_id").tap(F.count("*").alias("rows"), F.sum("item.n_chars").alias("chars"), name="seen").build())
    seen = runner.metrics["seen"]
    return spark.createDataFrame([(seen["rows"], seen["chars"])], "rows long, chars long")


@query
def no_source_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline without a source starts from one empty item."""
    runner = Runner(spark, fs.scratch(spark, "runs"))
    runner.start(pipeline("p").use(ColumnTool("made", "1.0.0", lambda c: F.lit("made"))).tap(F.count("*").alias("rows"), F.max("item").alias("item"), name="seen").build())
    return spark.createDataFrame([(runner.metrics["seen"]["rows"], runner.metrics["seen"]["item"])], "rows int, item string")


@query
def forks_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two forks, one after the other, and a window, in a run."""
    out = fs.scratch(spark, "out")
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("text").alias("item"))
    short = pipeline("short").use(NORMALIZE).build()
    size = pipeline("size").use(ColumnTool("size", "1.0.0", lambda c: F.length(c).cast("bigint"))).build()
    Runner(spark, fs.scratch(spark, "runs")).start(pipeline("p").from_(turns).fork(short).fork(size).window(3).to(f"parquet:{out}"))
    return spark.read.parquet(out).select("seq", F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query
def own_source_and_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry with a scheme, a target and a composite prefix of its own."""
    out, registry = fs.scratch(spark, "out"), default_registry()

    class Rows:
        lifecycle = "resumable"

        def __init__(self, name: str):
            self.name = name

        def read(self, spark: SparkSession) -> Stream:
            return Stream.of(table(spark, sf_dir, self.name), f"{self.name[0]}_{self.name}key")

    class Upper:
        def write(self, df: DataFrame) -> None:
            df.select("seq", F.upper(F.col("item.r_name")).alias("name")).write.parquet(out)

    registry.register_source("table", lambda u: Rows(u.host))
    registry.register_target("upper", lambda u: Upper())
    registry.register_composite("all regions", lambda raw: parse_uri("table://region"))
    Runner(spark, fs.scratch(spark, "runs"), registry).start(pipeline("p").from_("all regions").to("upper://"))
    has = F.lit(registry.has_source("table") and registry.has_target("upper") and not registry.has_target("table"))
    return spark.read.parquet(out).select("seq", "name", has.alias("known"))


@query
def uri_on_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same URIs cut on the driver and as columns."""
    rows = []
    for i, raw in enumerate(URIS):
        try:
            u = parse_uri(raw)
            rows.append((i, raw, u.scheme, u.host, u.path))
        except ValueError:
            rows.append((i, raw, "", "", ""))
    df = spark.createDataFrame(rows, "i int, raw string, scheme string, host string, path string").withColumn("u", uri_struct(F.col("raw")))
    same = (F.col("u.scheme") == F.col("scheme")) & (F.col("u.host") == F.col("host")) & (F.col("u.path") == F.col("path"))
    return df.select("i", "raw", "scheme", "host", "path", same.alias("same"))


@query
def folder_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written to folders by region and read as whole files that a glob names."""
    out, registry = fs.scratch(spark, "folder"), default_registry()
    items = table(spark, sf_dir, "nation").select(F.struct(F.col("n_name").alias("text"), "n_regionkey").alias("item")).coalesce(1)
    registry.target(f"fs:{out}?partitionBy=n_regionkey").write(items)
    files = registry.source(f"fs:{out}?glob=*.txt").read(spark).df
    lines = files.select(F.regexp_extract("item.path", r"n_regionkey=(\d+)", 1).cast("int").alias("n_regionkey"), F.explode(F.split(F.rtrim("item.text"), "\n")).alias("n_name"))
    return lines.where("n_name <> ''")


@query
def formats_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations through CSV, JSON and ORC, one after the other."""
    registry, rows = default_registry(), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    for name in ("csv", "json", "orc"):
        path = fs.scratch(spark, name)
        registry.target(f"{name}:{path}").write(rows)
        rows = registry.source(f"{name}:{path}?order=n_nationkey&schema=n_nationkey int, n_name string").read(spark).df.select("item.*")
    return rows


@query
def standard_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines from standard input to standard output."""
    said = io.StringIO()
    given = "\n".join(json.dumps({"n": r.item}) for r in _nations(spark, sf_dir).orderBy("seq").collect()) + "\n \n"
    registry = default_registry()
    with mock.patch.object(sys, "stdin", io.StringIO(given)), contextlib.redirect_stdout(said):
        registry.target("stdout://").write(registry.source("stdin://").read(spark).df.orderBy("seq"))
    rows = [(r["seq"], json.loads(r["item"])["n"]) for r in map(json.loads, said.getvalue().splitlines())]
    return spark.createDataFrame(rows, "seq long, name string")


@query
def posted_and_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows posted to a receiver, which lands them as files."""
    folder = _folder(spark, "landing")
    with HttpReceiver(folder, 0) as receiver:
        HttpTarget(f"http://127.0.0.1:{receiver.port}/ingest").write(_nations(spark, sf_dir).select("seq", "item"))
    landed = spark.read.json(f"file://{folder}").select(F.from_json("item", "seq long, item string").alias("x"))
    return landed.select("x.seq", "x.item")


@query
def retries_and_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts, outcome and waits of a call that fails k times under each strategy."""
    rows = []
    for strategy in ("fixed", "linear", "exp"):
        for failures in range(5):
            left, waits = [failures], []

            def call(left=left) -> str:
                left[0] -= 1
                if left[0] >= 0:
                    raise OSError("not yet")
                return "ok"

            try:
                outcome, attempts = with_retry(call, Retry(3, 1000, strategy), waits.append)
            except OSError as e:
                outcome, attempts = "failed", e.attempts
            rows.append((strategy, failures, outcome, attempts, int(sum(waits) * 1000)))
    return spark.createDataFrame(rows, "strategy string, failures long, outcome string, attempts long, waited_ms long")


@query
def policy_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies merge field by field: tool over pipeline over project."""
    project, own = Policy(Retry(backoff_ms=50), "dead-letter"), (Policy(), Policy(Retry(max=5)), Policy(Retry(strategy="linear"), "skip-item"))
    merged = [p.over(project).over(DEFAULT_POLICY) for p in own]
    return spark.createDataFrame([(i, m.retry.max, m.retry.backoff_ms, m.retry.strategy, m.on_error) for i, m in enumerate(merged)], "i int, most int, backoff_ms int, strategy string, on_error string")


@query
def checkpoint_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree that is made, marked, written, read back and asked."""
    tree = CheckpointTree("root")
    for step, parent in (("source-1", None), ("tool-1", None), ("fork-1", "tool-1"), ("fork-2", "tool-1")):
        tree.add(step, parent)
    tree.mark("source-1", "done")
    tree.mark("fork-1", "failed", error="no")
    tree = CheckpointTree.from_json(tree.to_json())
    before = tree.all_done()
    rows = [(n.step_id, depth, n.state, n.error, tree.find(n.step_id) is n) for n, depth in tree.walk()]
    for n, _ in tree.walk():
        n.state = "done"
    return spark.createDataFrame([(*r, before, tree.all_done()) for r in rows], "step string, depth int, state string, error string, found boolean, done_before boolean, done_after boolean")


@query
def store_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small files of the run store: written whole, appended to, read, listed and removed."""
    root = fs.scratch(spark, "store")
    fs.write_text(spark, f"{root}/a", "one")
    fs.write_text(spark, f"{root}/a", "two\n")
    fs.append_line(spark, f"{root}/a", "three")
    fs.append_line(spark, f"{root}/b", "four")
    rows = [(n, fs.exists(spark, f"{root}/{n}"), fs.read_text(spark, f"{root}/{n}")) for n in (*fs.listing(spark, root), "c")]
    fs.delete(spark, f"{root}/a")
    return spark.createDataFrame([(*r, fs.exists(spark, f"{root}/{r[0]}")) for r in rows], "name string, there boolean, text string, after boolean")


@query
def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """init, run, ls, inspect and tool of the command line, in a new project."""
    folder, said = _folder(spark, "project"), io.StringIO()
    before = os.getcwd()
    cli.init(folder)
    with open(f"{folder}/input.jsonl", "w") as f:
        f.writelines(json.dumps({"item": f"{r.item}\nX"}) + "\n" for r in _nations(spark, sf_dir).orderBy("seq").collect())
    with open(f"{folder}/tools.py", "w") as f:
        f.write("from pyspark.sql import functions as F\nfrom quillflow.operators import ColumnTool\nupper = ColumnTool('upper', '1.0.0', F.upper)\n")
    with open(f"{folder}/pipeline.py") as f:
        text = f.read().replace("jsonl://./", f"jsonl:file://{folder}/")
    with open(f"{folder}/pipeline.py", "w") as f:
        f.write(text)
    try:
        os.chdir(folder)
        with contextlib.redirect_stdout(said):
            cli.main(["run", "pipeline.py"])
            run = said.getvalue().strip()
            cli.main(["ls", "runs"])
            cli.main(["inspect", run])
            with mock.patch.object(sys, "stdin", io.StringIO('"shout"')):
                cli.main(["tool", "tools.py", "upper"])
            cli.main(["resume", run, "pipeline.py"])
    finally:
        os.chdir(before)
    out = said.getvalue()
    lines = spark.read.text(f"file://{folder}/output").select(F.get_json_object("value", "$.item").alias("line"))
    facts = [out.count(run) >= 4, "|done" in out.replace(" ", ""), "state done" in out, '{"item":"SHOUT"}' in out]
    return lines.groupBy("line").agg(F.count("*").alias("n")).withColumn("told", F.lit(all(facts)))
