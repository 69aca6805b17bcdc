import pytest

import corpus_pipeline as P
from quillflow.llm.decontaminate import Matcher
from quillflow.llm.secrets import scan
from quillflow.llm.staging import stage
from tests.llm.test_minhash import brute

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, rows before, rows after) of each stage on the smallest tables."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, f in P.STAGES:
        after = stage(f(spark, docs, DATA), name)
        out.append((name, docs.collect(), after.collect(), docs.columns == after.columns))
        docs = after
    return out


def test_stages_against_brute_force(spark, stages):
    assert [s[0] for s in stages] == ["language", "near_duplicates", "benchmark", "secrets", "packing"]
    assert all(s[3] for s in stages[:-1])
    _, before, after, _ = stages[0]
    lost = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert all(not any(c.isalpha() for c in r.text) for r in before if r.doc_id in lost)
    _, before, after, _ = stages[1]
    want = brute([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in want.items() if i == c)
    _, before, after, _ = stages[2]
    m = Matcher([(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()], 0.08)
    assert sorted(after) == sorted(r for r in before if not m.find(r.text))
    _, before, after, _ = stages[3]
    old = {r.doc_id: r for r in before}
    for r in after:
        assert r.n_chars == len(r.text) and (r.text == old[r.doc_id].text) == (not scan(old[r.doc_id].text))
    _, before, after, _ = stages[4]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    assert sum(r.length for r in after) == sum({r.doc_id: r.doc_tokens for r in after}.values())


def test_run_gives_the_last_stage(spark, stages):
    assert sum(r.length for r in P.run(spark, DATA).collect()) == sum(r.length for r in stages[-1][2])


def test_odd_rows_and_tables(spark, tmp_path):
    """Null, empty, repeated and unnamed rows, a long text, columns with names of the operators' own, and empty tables."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _language string, component_id long, item_id int"
    text = "the words of this text are here for the reader and for all who want them " * 3
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, None), (4, ""), (5, "12 34"), (6, "password = abcdefghijklmn and the rest of it is plain"), (7, "the long text of words that never ends " * 20_000), (8, "a short test item is in this text of words"), (9, "x")]
    rows = [(i, t, "en" if i != 9 else None, None if i == 2 else "h", None if t is None else len(t), False, "xx", 0, 1) for i, t in rows]
    for name, docs, items in (("full", rows, [(1, "short test item"), (2, None), (3, "")]), ("empty", [], []), ("no items", rows, [])):
        folder = tmp_path / name
        spark.createDataFrame(docs, columns).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        df, kept = spark.read.parquet(str(folder / "documents.parquet")), []
        for stage_name, f in P.STAGES:
            after = stage(f(spark, df, str(folder)), stage_name)
            assert stage_name == "packing" or after.schema.simpleString() == df.schema.simpleString()
            kept.append(sorted((-1 if r.doc_id is None else r.doc_id) for r in after.select("doc_id").distinct().collect()))
            if stage_name == "secrets" and docs:
                found = {r.doc_id: r for r in after.collect()}
                assert "abcdefghijklmn" not in found[6].text and found[6].n_chars == len(found[6].text) and found[7].text == rows[9][1]
            df = after
        if not docs:
            assert kept == [[]] * 5
        else:
            assert kept[1] == [i for i in kept[0] if i != 2] and {-1, 1, 6, 7, 8} <= set(kept[0]) and not {3, 4, 5} & set(kept[0])
            assert kept[2] == [i for i in kept[1] if i != 8 or not items] and kept[4] == kept[3] == kept[2]
        assert sum(r.length for r in df.collect()) == sum(r.length for r in P.run(spark, str(folder)).collect())
