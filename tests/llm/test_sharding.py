import pytest
from pyspark.sql import functions as F

from quillflow.llm import sharding as S


def content(df):
    return sorted(map(repr, df.collect()))


def test_round_trip_and_sizes(spark, tmp_path, words):
    rows = [(i % 90 if i % 7 else None, " ".join(words(30, i)) if i % 5 else None, f"p{i}", i) for i in range(100)] + [(1, "long " * 200_000, "x", 0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, path string, bytes int").repartition(5)
    store = S.ShardStore(spark, str(tmp_path))
    for part in range(3):
        store.append(df, rows=10)
        assert store.versions() == list(range(1, part + 2))
    before = store.manifest()
    target = before.agg(F.sum("bytes")).first()[0] // 4
    n = before.count()
    version = store.versions()[-1]
    while (after := store.compact(target)) != version:
        version = after
    live = store.manifest()
    assert live.count() < n / 3 and live.agg(F.sum("rows")).first()[0] == 3 * len(rows)
    assert content(store.read()) == content(df.union(df).union(df))
    assert store.manifest(3).count() == n  # older versions stay readable until the vacuum
    assert content(store.read(1)) == content(df)
    store.vacuum()
    assert store.versions() == [version] and content(store.read()) == content(df.union(df).union(df))


def test_similar_sizes_merge(spark, tmp_path):
    store = S.ShardStore(spark, str(tmp_path))
    sizes = [10, 11, 12, 13, 300, 310, 90_000, 5]
    entries = spark.createDataFrame([(f"/x/data/run-{i}/f", b, 1, 0) for i, b in enumerate(sizes)], S.COLUMNS)
    store.commit(entries, 1)
    plan = {r.bytes: r.merge_id for r in store.plan(1000).collect()}
    assert set(plan) == {10, 11, 12, 13, 5, 300, 310} - ({5} if 5 not in plan else set())
    assert plan[300] == plan[310] != plan[10] and plan[10] == plan[13]
    by = {}
    for r in store.plan(25).collect():
        by.setdefault(r.merge_id, []).append(r.bytes)
    assert all(sum(x[:-1]) < 25 + max(x) for x in by.values())


def test_one_of_two_writers_loses(spark, tmp_path):
    store = S.ShardStore(spark, str(tmp_path))
    entries = spark.createDataFrame([("a", 1, 1, 0)], S.COLUMNS)
    store.commit(entries, 1)
    with pytest.raises(S.Conflict):
        store.commit(entries, 1)
    assert store.versions() == [1] and store.manifest().count() == 1
    assert not [x for x in (tmp_path / "manifest").iterdir() if x.name.startswith("_new")]


def test_empty_and_clashing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "m", 2)], "doc_id long, text string, _metadata string, generation int")
    store = S.compacted(df, str(tmp_path / "a"))
    assert content(store.read()) == content(df)
    store = S.compacted(df.limit(0), str(tmp_path / "b"))
    assert store.read() is None and store.versions()
    assert S.ShardStore(spark, str(tmp_path / "none")).manifest().count() == 0


def test_query_keeps_every_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = docs.select("doc_id", F.length("text").cast("long"), F.sha2("text", 256))
    assert content(S.op7_sharding(spark, "/root/testdata/sf0.001").select("doc_id", F.col("n_chars").alias("length(text)"), F.col("text_sha256").alias("sha2(text, 256)")).toDF("a", "b", "c")) == content(want.toDF("a", "b", "c"))


def test_an_append_is_tried_again(spark, tmp_path, monkeypatch):
    """Another writer commits between an append's look at the versions and its commit."""
    store, other, n = S.ShardStore(spark, str(tmp_path)), S.ShardStore(spark, str(tmp_path)), [0]
    store.append(spark.range(3).withColumn("who", S.F.lit("first")))
    commit = store.commit

    def late(entries, version):
        n[0] += 1
        if n[0] == 1:
            other.append(spark.range(5).withColumn("who", S.F.lit("other")))
        return commit(entries, version)

    monkeypatch.setattr(store, "commit", late)
    assert store.append(spark.range(7).withColumn("who", S.F.lit("late"))) == 3
    assert {r.who: r["count"] for r in store.read().groupBy("who").count().collect()} == {"first": 3, "other": 5, "late": 7}
    # appended shards don't disturb a merge, another merge of the same shards does
    n[0] = 0
    assert store.compact(1 << 20) == 5 and store.read().count() == 20
    before = store.manifest().count()
    store.append(spark.range(1).withColumn("who", S.F.lit("x")))

    def merged(entries, version):
        monkeypatch.setattr(store, "commit", commit)
        other.compact(1 << 20)
        return commit(entries, version)

    monkeypatch.setattr(store, "commit", merged)
    with pytest.raises(S.Conflict):
        store.compact(1 << 20)
    assert store.read().count() == 21 and store.manifest().count() <= before + 1
    folders = {x.name for x in (tmp_path / "data").iterdir()}
    store.vacuum()
    assert store.read().count() == 21 and {x.name for x in (tmp_path / "data").iterdir()} < folders and not list((tmp_path / "pending").iterdir())


def test_vacuum_spares_a_writer_that_has_not_committed(spark, tmp_path, monkeypatch):
    store, other = S.ShardStore(spark, str(tmp_path)), S.ShardStore(spark, str(tmp_path))
    store.append(spark.range(3))
    commit = store.commit

    def slow(entries, version):
        other.vacuum()
        return commit(entries, version)

    monkeypatch.setattr(store, "commit", slow)
    store.append(spark.range(4))
    assert store.read().count() == 7
    # what a dead writer left goes once it is old enough
    folder = store._begin()
    spark.range(2).write.parquet(folder)
    store.vacuum()
    assert (tmp_path / "data" / folder.rsplit("/", 1)[1]).exists()
    store.vacuum(abandoned_seconds=0)
    assert not (tmp_path / "data" / folder.rsplit("/", 1)[1]).exists() and store.read().count() == 7


def test_folders_are_read_as_a_whole(spark, tmp_path):
    store = S.ShardStore(spark, str(tmp_path))
    store.append(spark.range(100, numPartitions=4), rows=5)
    store.append(spark.range(10, numPartitions=1))
    assert len(store._paths(store.manifest())) == 2 and store.read().count() == 110
