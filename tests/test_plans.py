import json

import pytest
from pyspark.sql import functions as F

from quillflow import fs
from quillflow.model import MOVES
from quillflow.operators import ColumnTool, RowTool
from quillflow.plans import CheckpointTree, IllegalMove, Runner, StateMachine, count_by_state, dead_letters, first_open, illegal_moves, inspect_run, list_runs, pipeline, tree_order
from quillflow.plans.project import Project

LOWER = ColumnTool("lower", "1", F.lower)


def test_moves():
    m = StateMachine()
    for to in ("running", "paused", "resumed", "running", "done"):
        m.move(to)
    assert m.terminal and not m.active
    with pytest.raises(IllegalMove):
        m.move("running")
    assert sum(map(len, MOVES.values())) == 11


def test_moves_in_bulk(spark):
    df = spark.createDataFrame([("r", 1, "pending"), ("r", 2, "running"), ("r", 3, "pending")], "run string, t int, state string")
    assert [(r.prev_state, r.legal) for r in illegal_moves(df, "run", "state", "t").orderBy("t").collect()] == [("pending", True), ("running", False)]


def test_tree(spark):
    t = CheckpointTree("root")
    t.add("a")
    t.add("b")
    t.add("a1", "a")
    t.mark("root", "done")
    t.mark("a", "done")
    assert t.first_open().step_id == "a1" and t.count_by_state() == {"pending": 2, "in-progress": 0, "done": 2, "failed": 0}
    assert [(n.step_id, d) for n, d in t.walk()] == [("root", 0), ("a", 1), ("a1", 2), ("b", 1)]
    assert CheckpointTree.from_json(t.to_json()).rows("r") == t.rows("r")
    df = spark.createDataFrame([(r, n, p, o, s) for r, n, p, o, s, *_ in t.rows("r")], "run_id string, node_id string, parent_id string, ord int, state string")
    ordered = tree_order(df)
    assert [r.node_id for r in ordered.orderBy("path").collect()] == ["root", "a", "a1", "b"]
    assert first_open(ordered).first().node_id == "a1"
    assert {(r.state, r.n) for r in count_by_state(df).collect()} == {("done", 2), ("pending", 2)}


def test_deep_and_wide_trees(spark):
    """Beyond the levels and rows at which Spark stops a recursive query; orphans and circles aren't in a tree."""
    schema = "run_id string, node_id string, parent_id string, ord long, state string"
    chain = [("deep", f"n{i}", f"n{i - 1}" if i else None, 0, "done" if i < 299 else "failed") for i in range(300)]
    lost = [("deep", "x", "nowhere", 0, "pending"), ("deep", "y", "x", 0, "pending"), ("deep", "u", "v", 0, "pending"), ("deep", "v", "u", 0, "pending")]
    wide = [("wide", "root", None, 0, "done")]
    df = spark.createDataFrame(chain + lost + wide, schema)
    df = df.union(spark.range(1_100_000).selectExpr("'wide'", "concat('c', id)", "'root'", "id", "if(id < 7, 'done', 'pending')"))
    ordered = tree_order(df)
    assert {(r.run_id, r.n, r.d) for r in ordered.groupBy("run_id").agg(F.count("*").alias("n"), F.max("depth").alias("d")).collect()} == {("deep", 300, 299), ("wide", 1_100_001, 1)}
    assert {(r.run_id, r.node_id, r.depth) for r in first_open(ordered).collect()} == {("deep", "n299", 299), ("wide", "c7", 1)}
    paths = ordered.where("run_id = 'deep'").orderBy("path").collect()
    assert [(r.node_id, r.depth) for r in paths] == [(f"n{i}", i) for i in range(300)] and paths[2].path == "/".join(["0" * 10] * 3)
    assert tree_order(df.limit(0)).collect() == []


def docs(spark, n=6):
    return spark.createDataFrame([(i, f"Line {i}\nEND") for i in range(n)], "id long, text string")


def test_builder():
    p = pipeline("p").from_("jsonl://./x").use(LOWER).batch(5).window(3).fork(pipeline("s").build()).to("noop:")
    assert [s.type for s in p.steps] == ["source", "tool", "batch", "window", "fork", "target"]
    assert p.steps[1].step_id(1) == "1-tool-lower"
    with pytest.raises(ValueError):
        pipeline("p").to("noop:")
    with pytest.raises(ValueError):
        pipeline("p", on_error="nonsense")


def test_end_to_end_jsonl(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"item": "A B"}\n\n  {"item": "C", "meta": {"chapterId": "c1", "x": "y"}}  \n')
    sub = pipeline("sub").use(ColumnTool("mark", "1", lambda c: F.concat(c, F.lit("!")))).build()
    p = pipeline("p").from_(f"jsonl://{tmp_path}/in.jsonl").flat_map(lambda c: F.split(c, " ")).use(LOWER).fork(sub).tap(F.count("*").alias("n")).to(f"jsonl://{tmp_path}/out")
    r = Runner(spark, str(tmp_path / "store"))
    run = r.start(p)
    lines = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(x["item"] for x in lines) == ["a!", "b!", "c!"]
    assert [x["meta"]["chapterId"] for x in lines if x["item"] == "c!"] == ["c1"]
    assert r.metrics["tap"] == {"n": 3}
    assert [(x.run_id, x.state) for x in list_runs(spark, r.root).collect()] == [(run, "done")]
    assert "[done]" in inspect_run(spark, r.root, run)


def test_batch_and_window_steps(spark):
    taken = []

    class Take:
        def write(self, df):
            taken.append([r.items for r in df.orderBy("seq").collect()])

    for p in (pipeline("b").from_(docs(spark, 5).select("id"), "id").batch(2).to(Take()), pipeline("w").from_(docs(spark, 5).select("id"), "id").window(4).to(Take())):
        Runner(spark, fs.scratch(spark, "runs")).start(p)
    assert [[x.id for x in g] for g in taken[0]] == [[0, 1], [2, 3], [4]]
    assert [[x.id for x in g] for g in taken[1]] == [[0, 1, 2, 3], [1, 2, 3, 4]]


def test_resume_does_not_repeat_tools(spark, tmp_path):
    calls = tmp_path / "calls"

    def work(x):
        with calls.open("a") as f:
            f.write("x")
        return x["text"]

    class Target:
        broken = True

        def write(self, df):
            if self.broken:
                raise OSError("disk")
            df.write.parquet(str(tmp_path / "out"))

    target = Target()
    p = pipeline("p").from_(docs(spark), "id").use(RowTool("work", "1", work, "string")).to(target)
    r = Runner(spark, str(tmp_path / "store"))
    with pytest.raises(OSError):
        r.start(p, "run1")
    assert list_runs(spark, r.root).first().state == "failed"
    target.broken = False
    r.resume("run1", p)
    assert calls.read_text() == "x" * 6 and spark.read.parquet(str(tmp_path / "out")).count() == 6
    r.resume("run1", p)  # a finished run is left alone
    assert calls.read_text() == "x" * 6


def test_pause_at_a_step(spark, tmp_path):
    p = pipeline("p").from_(docs(spark), "id").use(RowTool("t", "1", lambda x: x["text"], "string")).to(f"parquet:{tmp_path}/out")
    r = Runner(spark, str(tmp_path / "store"), pause_when=lambda step: step.startswith("2-"))
    r.start(p, "r")
    assert list_runs(spark, r.root).first().state == "paused"
    r.pause_when = lambda step: False
    r.resume("r", p)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6


@pytest.mark.parametrize(("on_error", "letters"), [("skip-item", 0), ("dead-letter", 2)])
def test_bad_items(spark, tmp_path, on_error, letters):
    def work(x):
        if x["id"] % 3 == 0:
            raise ValueError("third")
        return x["id"]

    p = pipeline("p", on_error=on_error).from_(docs(spark), "id").use(RowTool("t", "1", work, "long"), retry={"max": 1, "backoff_ms": 0}).to(f"parquet:{tmp_path}/out")
    r = Runner(spark, str(tmp_path / "store"))
    run = r.start(p)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
    dead = dead_letters(spark, r.root, run)
    assert (dead.count() if dead is not None else 0) == letters


def test_project(tmp_path):
    assert Project.load(tmp_path) == Project()
    (tmp_path / "quillflow.json").write_text('{"project": {"name": "n"}, "defaults": {"concurrency": 10, "retry": {"max": 9}}}')
    p = Project.load(tmp_path)
    assert (p.name, p.concurrency, p.policy.retry.max, p.policy.retry.strategy) == ("n", 10, 9, "exp")
