import sys
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillflow.functions import content_key
from quillflow.model import Policy, Retry
from quillflow.operators import ColumnTool, Memo, PandasTool, ProcessTool, RowTool, apply_tool, batch, fork, numbered, sliding, split_errors, tap
from quillflow.operators import counts
from quillflow.operators.rows import domain_lines, flat_map, tap_each

quiet = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def seq(spark, n):
    return spark.range(1, n + 1).withColumnRenamed("id", "seq").repartition(3)


def groups(df):
    return [r.items for r in df.orderBy("batch").collect()]


def test_batch_tails(spark):
    assert groups(batch(seq(spark, 8), 3, "seq", item="seq")) == [[1, 2, 3], [4, 5, 6], [7, 8]]
    assert groups(batch(seq(spark, 8), 3, "seq", item="seq", tail="single")) == [[1, 2, 3], [4, 5, 6], [7], [8]]
    assert groups(batch(seq(spark, 0), 3, "seq", item="seq")) == []
    with pytest.raises(ValueError):
        batch(seq(spark, 1), 0, "seq")


def test_batch_within_starts_anew(spark):
    df = spark.createDataFrame([(g, i) for g in "ab" for i in range(3)], "g string, i int")
    rows = batch(df, 2, "i", item="i", within=["g"]).orderBy("g", "batch").collect()
    assert [(r.g, r.items) for r in rows] == [("a", [0, 1]), ("a", [2]), ("b", [0, 1]), ("b", [2])]


def test_windows(spark):
    frames = lambda **k: [r.items for r in sliding(seq(spark, 5), 3, "seq", item="seq", **k).orderBy("seq").collect()]
    assert frames() == [[1, 2, 3], [2, 3, 4], [3, 4, 5]]
    assert frames(step=2) == [[1, 2, 3], [3, 4, 5]]
    assert frames(partial=True)[:2] == [[1], [1, 2]]


@quiet
@given(n=st.integers(0, 60), w=st.integers(1, 7), size=st.integers(1, 9))
def test_windows_across_blocks(spark, n, w, size):
    old, counts.BLOCK_ROWS = counts.BLOCK_ROWS, size
    try:
        got = [r.items for r in sliding(seq(spark, n), w, "seq", item="seq").orderBy("seq").collect()]
    finally:
        counts.BLOCK_ROWS = old
    assert got == [list(range(i, i + w)) for i in range(1, n - w + 2)]


@quiet
@given(st.lists(st.integers(-50, 50), max_size=60, unique=True))
def test_numbers_are_gapless(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    rows = numbered(df, "v", parts=5).collect()
    assert sorted((r.number, r.v) for r in rows) == list(enumerate(sorted(values), 1))


def test_flat_map_drops_empty_and_copies_meta(spark):
    df = spark.createDataFrame([(1, ["a", "b"], "m"), (2, [], "n"), (3, None, "o")], "seq int, item array<string>, meta string")
    rows = flat_map(df, F.col("item"), position="p").orderBy("seq", "p").collect()
    assert [(r.seq, r.item, r.meta, r.p) for r in rows] == [(1, "a", "m", 0), (1, "b", "m", 1)]


def test_lines_keep_ids(spark):
    rows = domain_lines(spark.createDataFrame([(7, "x\n\ny")], "doc_id long, text string")).orderBy("index").collect()
    assert [(r.id, r.paragraphId, r.text) for r in rows] == [("d7-l0", "d7", "x"), ("d7-l1", "d7", ""), ("d7-l2", "d7", "y")]


def test_tap_and_fork(spark):
    df, seen = tap(seq(spark, 4), "seen", F.sum("seq").alias("total"))
    assert df.count() == 4 and seen.get == {"total": 10}
    assert fork(seq(spark, 4), lambda d: d.where("seq > 2")).count() == 2

    def refuse(row):
        raise RuntimeError("no")

    with pytest.raises(Exception, match="no"):
        tap_each(seq(spark, 1), refuse).collect()


def items(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "seq long, item string")


def test_column_tool_runs(spark):
    assert [r.item for r in apply_tool(items(spark, ["A"]), ColumnTool("t", "1", F.lower)).collect()] == ["a"]


def test_errors_are_kept_apart(spark, tmp_path):
    def work(x):
        if x == "bad":
            raise ValueError("no good")
        return len(x)

    tool, df = RowTool("len", "1", work, "int"), items(spark, ["a", "bad", "ccc"])
    staged = apply_tool(df, tool, Policy(Retry(0), "dead-letter"))
    staged.write.parquet(str(tmp_path / "s"))
    good, dead = split_errors(spark.read.parquet(str(tmp_path / "s")), "1-tool-len")
    assert sorted(r.item for r in good.collect()) == [1, 3]
    letter = dead.first()
    assert tuple(letter.error) == ("ValueError", "no good") and letter.step_id == "1-tool-len" and '"seq":1' in letter.envelope
    with pytest.raises(Exception, match="no good"):
        apply_tool(df, tool, Policy(Retry(0))).collect()


def test_process_answers_by_seq(spark):
    program = "import sys,json\nrows=[json.loads(l) for l in sys.stdin]\nfor r in reversed(rows): print(json.dumps({'seq':r['seq'],'item':r['item'].upper()}))"
    tool = ProcessTool("up", "1", [sys.executable, "-c", program])
    assert [r.item for r in apply_tool(items(spark, ["a", "b", "c"]), tool).orderBy("seq").collect()] == ["A", "B", "C"]
    once = ProcessTool("up", "1", [sys.executable, "-c", program], mode="once")
    assert [r.item for r in apply_tool(items(spark, ["a", "b"]), once).orderBy("seq").collect()] == ["A", "B"]


@pytest.mark.parametrize("program", ["import sys; sys.exit(3)", "print('{\"seq\": 0, \"item\": \"x\"}\\n' * 2)", "pass"])
def test_process_that_fails(spark, program):
    tool = ProcessTool("bad", "1", [sys.executable, "-c", program])
    rows = apply_tool(items(spark, ["a"]), tool, Policy(Retry(0), "skip-item")).collect()
    assert rows[0]._error is not None
    with pytest.raises(Exception, match="bad"):
        apply_tool(items(spark, ["a"]), tool, Policy(Retry(0))).collect()


def test_memo_calls_once_for_each_key(spark, tmp_path):
    memo, calls = Memo(spark, str(tmp_path / "memo")), []

    def work(todo):
        calls.append(todo.count())
        return apply_tool(todo, RowTool("len", "1", len, "int"))

    df = items(spark, ["a", "bb", "a"])
    for _ in range(2):
        assert sorted(r.item for r in memo.apply(df, "len", "1", work).collect()) == [1, 1, 2]
    assert calls == [2, 0]
    memo.apply(df, "len", "2", work)
    assert calls[-1] == 2
    memo.delete(memo.table().where("version = '1'").select("key"))
    assert memo.table().select("version").distinct().collect()[0].version == "2"


def test_results_must_have_the_declared_type(spark):
    tool = RowTool("t", "1", lambda x: 1 if x == "a" else "no number", "int")
    rows = apply_tool(items(spark, ["a", "b"]), tool, Policy(Retry(0), "skip-item")).orderBy("seq").collect()
    assert rows[0].item == 1 and rows[0]._error is None and rows[1]._error is not None


@pytest.mark.parametrize("n", [0, 1, 7, 400])
def test_strings_are_numbered_in_ranges(spark, n):
    rows = [(f"{(i * 7919) % 1000:03d}é" if i % 50 else None, i) for i in range(n)]
    df = spark.createDataFrame(rows, "s string, i int")
    got = numbered(df, "s", "i", parts=6)
    assert [(r.s, r.i) for r in sorted(got.collect(), key=lambda r: r.number)] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert sorted(r.number for r in got.collect()) == list(range(1, n + 1))


def test_rows_at_fault_of_every_kind_of_tool(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(6)] + [(9, None)], "seq int, item string")

    def odd(s):
        if (s.str.len() == 3).any():
            raise ValueError("three")
        return s.str.len()

    tools = (ColumnTool("t", "1", F.length, accepts=lambda c: F.length(c) != 3), PandasTool("t", "1", odd, "bigint"))
    for tool in tools:
        got = {r.seq: (r.item, r._error and r._error.name) for r in apply_tool(df, tool, Policy(Retry(0), "dead-letter")).collect()}
        assert got[3] == (None, "Refused" if isinstance(tool, ColumnTool) else "ValueError") and got[5] == (5, None)
        with pytest.raises(Exception):  # noqa: B017
            apply_tool(df, tool, Policy(Retry(0))).collect()
    once = [0]

    def flaky(s):
        once[0] += 1
        if once[0] == 1:
            raise OSError("once")
        return s.str.len()

    assert apply_tool(df.coalesce(1), PandasTool("t", "1", flaky, "bigint"), Policy(Retry(1, 0))).where("item = 5").count() == 1


def test_memo_lookups_and_versions(spark, tmp_path):
    memo = Memo(spark, str(tmp_path / "memo"))
    df = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "seq int, item string")
    keys = df.select(content_key("up", "1", F.col("item")).alias("k"))
    assert memo.has(keys).where("hit").count() == 0 and memo.get(keys).count() == 0
    memo.apply(df, "up", "1", lambda todo: todo.withColumn("item", F.upper("item")))
    assert memo.has(keys).where("hit").count() == 6
    gone = df.where("seq < 2").select(content_key("up", "1", F.col("item")).alias("k"))
    memo.delete(gone)
    memo.delete(gone)
    assert sorted(r.output for r in memo.get(keys).collect()) == ["T2", "T3", "T4", "T5"]
    assert memo.apply(df, "up", "1", lambda todo: todo.withColumn("item", F.lower("item"))).where("item = 't0'").count() == 1
    assert len([x for x in (tmp_path / "memo").iterdir() if x.is_dir()]) == 1


def test_a_value_that_most_rows_share_is_cut_by_the_next_columns(spark):
    df = spark.createDataFrame([(1 if i % 10 else i % 7, f"t{i % 50:02d}", Decimal(i), None if i % 3 else i) for i in range(3000)], "a int, s string, d decimal(12,2), x int")
    got = numbered(df, "a", "s", "d", parts=8)
    want = sorted((r.a, r.s, r.d) for r in df.collect())
    assert [(r.a, r.s, r.d) for r in got.orderBy("number").collect()] == want
    assert sorted(r.number for r in got.collect()) == list(range(1, 3001))
    cuts = counts.range_cuts(df, ["a", "s", "d"], 8, 3000)
    assert len(cuts) >= 6 and sum(c[0] == 1 for c in cuts) >= 5


@pytest.mark.parametrize("order", ["t", "i"])
def test_a_hot_key_is_numbered_in_ranges(spark, monkeypatch, order):
    monkeypatch.setattr(counts, "RANGE_ROWS", 50)
    monkeypatch.setattr(counts, "BLOCK_ROWS", 40)
    keys = ["hot" if i % 3 else None if i % 6 else f"k{i % 30}" for i in range(900)]
    rows = [(k, datetime(2024, 1, 1) + timedelta(hours=i * 7 % 900), i * 7 % 900) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "g string, t timestamp, i int")
    by = {}
    for g, _, i in sorted(rows, key=lambda r: r[2]):
        by.setdefault(g, []).append(i)
    got = numbered(df, order, within=["g"], name="n")
    assert sorted(((r.g, r.n, r.i) for r in got.collect()), key=repr) == sorted(((g, n + 1, i) for g, x in by.items() for n, i in enumerate(x)), key=repr)
    frames = sliding(df, 5, order, item="i", within=["g"]).collect()
    assert sorted(((r.g, r["items"]) for r in frames), key=repr) == sorted(((g, x[k : k + 5]) for g, x in by.items() for k in range(len(x) - 4)), key=repr)
    groups = batch(df, 4, order, item="i", within=["g"], tail="single").collect()
    cut = {g: len(x) - len(x) % 4 for g, x in by.items()}
    want = [(g, x[k : k + 4]) for g, x in by.items() for k in range(0, cut[g], 4)] + [(g, [v]) for g, x in by.items() for v in x[cut[g] :]]
    assert sorted(((r.g, r["items"]) for r in groups), key=repr) == sorted(want, key=repr)
    ranges = counts.range_cuts(df, ["g", order], 4, 900)
    assert len([c for c in ranges if c[0] == "hot"]) >= 2


@pytest.mark.parametrize("shown", [1000, 2])
def test_nulls_are_numbered_first(spark, shown):
    """Most rows have no first column, or all."""
    df = spark.createDataFrame([(i if i % 1000 >= shown else None, i) for i in range(1000)], "a int, i int")
    got = numbered(df, "a", "i", parts=4).orderBy("number").collect()
    assert [(r.a, r.i) for r in got] == sorted(((r.a, r.i) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [r.number for r in numbered(df.select("a").distinct(), "a", parts=3).orderBy("a").collect()] == list(range(1, df.select("a").distinct().count() + 1))
