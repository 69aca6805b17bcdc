import json
import os
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from quillflow.functions import parse_uri
from quillflow.plans import Runner, dead_letters, pipeline
from quillflow.sources import JsonlSource, JsonlTarget, default_registry, line_numbers
from quillflow.sources.commit import exec_git
from quillflow.sources.files import FolderSource, FolderTarget, FormatSource
from quillflow.streaming import HttpReceiver, HttpTarget, landed_stream, run_stream, stateful_batches


def test_registry():
    r = default_registry()
    assert r.has_source("jsonl") and r.has_target("jsonl") and not r.has_source("nope") and "http" in r.target_schemes()
    with pytest.raises(LookupError):
        r.source("unknown://test")
    r.register_composite("book+", lambda raw: parse_uri("jsonl://" + raw.removeprefix("book+")))
    assert r.source("book+./x.jsonl").path == "./x.jsonl"


def test_batch_size_tail(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text("".join(f'{{"item": {i}}}\n' for i in range(1, 9)))
    rows = default_registry().source(f"jsonl://{tmp_path}/f.jsonl?batchSize=3").read(spark).df.orderBy("seq").collect()
    assert [(r.item, r["items"]) for r in rows] == [("1", ["1", "2", "3"]), ("4", ["4", "5", "6"]), ("7", None), ("8", None)]


def test_cursor_counts_blank_lines(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"item":1}\n\n{"item":2}\n{"item":3}\n')
    assert [r.item for r in JsonlSource(str(tmp_path / "f.jsonl")).resume(2).read(spark).df.orderBy("seq").collect()] == ["2", "3"]


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"item":1}\n{"item":1\n')
    assert JsonlSource(str(tmp_path / "f.jsonl"), on_error="skip-item").read(spark).df.count() == 1
    with pytest.raises(Exception, match="malformed JSON at line 1"):
        JsonlSource(str(tmp_path / "f.jsonl")).read(spark).df.collect()


def test_line_numbers_over_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"{i}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        df = line_numbers(spark, str(tmp_path / "big.txt"))
        assert df.where(F.col("line_no").cast("string") != F.col("value")).count() == 0 and df.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_appends(spark, tmp_path):
    for i in (1, 2):
        JsonlTarget(str(tmp_path / "o")).write(spark.createDataFrame([(i,)], "item int"))
    assert sorted(json.loads(r.value)["item"] for r in spark.read.text(str(tmp_path / "o")).collect()) == [1, 2]


def test_folders_and_formats(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.md").write_text("one\ntwo")
    (tmp_path / "d/b.txt").write_text("no")
    rows = FolderSource(str(tmp_path / "d"), "*.md").read(spark).df.collect()
    assert [r.item.text for r in rows] == ["one\ntwo"]
    FolderTarget(str(tmp_path / "o")).write(spark.createDataFrame([("x",)], "item string"))
    assert spark.read.text(str(tmp_path / "o")).first().value == "x"
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    s = FormatSource("csv", str(tmp_path / "c.csv"), {"header": "true", "order": "a"}).read(spark)
    assert s.df.first().item.b == "2" and s.order == ("seq",)


def post(port, path, body):
    try:
        return urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}{path}", body), timeout=10).status
    except urllib.error.HTTPError as e:
        return e.code


def test_push_then_stream(spark, tmp_path):
    land, out, mark = (str(tmp_path / x) for x in ("land", "out", "mark"))
    plan = lambda df: df.select("seq", "item")
    with HttpReceiver(land, 0) as r:
        assert json.load(urllib.request.urlopen(f"http://127.0.0.1:{r.port}/health")) == {"status": "ok"}
        assert post(r.port, "/ingest", b'{"id": 1}') == 200
        assert post(r.port, "/ingest", b"{") == 400
        assert post(r.port, "/other", b"{}") == 404
        run_stream(landed_stream(spark, land), plan, out, mark).awaitTermination()
        HttpTarget(f"http://127.0.0.1:{r.port}/ingest").write(spark.createDataFrame([(2,), (3,)], "item int"))
        run_stream(landed_stream(spark, land), plan, out, mark).awaitTermination()
    got = [json.loads(x.item) for x in spark.read.parquet(out).orderBy("seq").collect()]
    assert got[0] == {"id": 1} and sorted(x["item"] for x in got[1:]) == [2, 3]


def test_count_batches_survive_a_restart(spark, tmp_path):
    land, out, mark = (str(tmp_path / x) for x in ("land", "out", "mark"))
    for rows in (range(1, 5), range(5, 8)):
        spark.createDataFrame([(i, "k", str(i)) for i in rows], "seq long, key string, item string").write.mode("append").json(land)
        stream = stateful_batches(landed_stream(spark, land, "seq long, key string, item string").drop("meta"), 3, "key")
        stream.writeStream.outputMode("append").option("checkpointLocation", mark).format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
    rows = [r.asDict() for r in spark.read.parquet(out).collect()]
    assert sorted((r["batch"], list(r["items"])) for r in rows) == [(0, ["1", "2", "3"]), (1, ["4", "5", "6"])]


def test_commit_on_close(spark, tmp_path, monkeypatch):
    from quillflow.sources.commit import GitMissing, auto_commit, exec_git

    exec_git(str(tmp_path), "init", "-q")
    for k, v in (("user.name", "a"), ("user.email", "a@b.c")):
        exec_git(str(tmp_path), "config", k, v)
    target = default_registry().target(f"jsonl://{tmp_path}/out?commit=on-close", str(tmp_path))
    target.write(spark.createDataFrame([(1,)], "item int"))
    assert exec_git(str(tmp_path), "log", "--oneline")[1].count("\n") == 1
    assert auto_commit(str(tmp_path)) is None
    assert exec_git(str(tmp_path), "no-such-command")[0] != 0
    monkeypatch.setenv("PATH", "")
    with pytest.raises(GitMissing):
        exec_git(str(tmp_path), "status")


def test_malformed_lines_become_dead_letters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"item":"a"}\n{"item":\n\n{"item":"b"}\nnope\n')
    for size in (1, 2):
        runner = Runner(spark, str(tmp_path / "runs"), log_level="debug")
        run = runner.start(pipeline("p").from_(f"jsonl:{tmp_path}/in?onError=dead-letter&batchSize={size}").to(f"jsonl:{tmp_path}/out{size}"))
        dead = dead_letters(spark, str(tmp_path / "runs"), run).collect()
        assert sorted(r.error.message for r in dead) == ["malformed JSON at line 1", "malformed JSON at line 4"] and {r.error.name for r in dead} == {"MalformedLine"}
        log = (tmp_path / "runs" / "runs" / run / "run.log").read_text()
        assert "debug step 0-source" in log and "info done" in log


def test_files_of_a_ref_and_commits(spark, tmp_path):
    folder = tmp_path / "repo"
    folder.mkdir()
    git = lambda *a: exec_git(str(folder), "-c", "user.name=a", "-c", "user.email=a@b", *a)
    git("init", "-b", "main")
    for name, value in (("user.name", "a"), ("user.email", "a@b")):
        git("config", name, value)
    for i, text in enumerate(("one", "two")):
        (folder / "a.md").write_text(text)
        (folder / "b.txt").write_text("no")
        git("add", "-A")
        git("commit", "-m", str(i))
    registry = default_registry()
    read = lambda uri: [r.item.text for r in registry.source(uri).read(spark).df.collect()]
    assert read(f"git:{folder}?ref=main~1&glob=*.md") == ["one"] and read(f"git:{folder}?glob=*.md") == ["two"]
    with pytest.raises(LookupError):
        read(f"git:{folder}?ref=none")
    registry.target(f"git:{folder}?path=out").write(spark.createDataFrame([("x",)], "item string"))
    assert git("show", "--stat", "HEAD")[1].count("out/") >= 1 and not git("status", "--short")[1]


def test_a_receiver_without_a_folder(spark):
    source = default_registry().source("http://127.0.0.1/in?port=0")
    with source.open() as r:
        assert post(r.port, "/in", b'{"id": 1}') == 200
    assert source.read(spark).df.isStreaming and len(os.listdir(source.own)) == 1
