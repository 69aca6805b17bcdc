import numpy as np
import pytest
from pyspark.sql import functions as F

from quillflow.llm import toxicity as X

DATA = "/root/testdata/sf0.01"


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    names = ("quality", "toxic")
    chain = X.fit(docs, labels.where("doc_id % 4 <> 0"), names)
    held = X.score(docs, chain, names).join(labels.where("doc_id % 4 = 0"), "doc_id")
    caught, toxic, wrong, clean = held.agg(*(F.count_if(F.expr(e)) for e in (f"toxic = 1 and p_toxic >= {X.CUT}", "toxic = 1", f"toxic = 0 and p_toxic >= {X.CUT}", "toxic = 0"))).first()
    assert toxic and caught / toxic >= 0.6 and wrong / clean <= 0.05


def test_chain_feeds_probabilities_on():
    """The second category is the first one's noisy copy, which only the first one's probability shows."""
    rng = np.random.default_rng(0)
    n = 600
    y = np.column_stack([rng.random(n) < 0.5] * 2).astype(int)
    row, key = np.repeat(np.arange(n), 2), np.empty(2 * n, np.int64)
    key[0::2], key[1::2] = 10 + y[:, 0], 50 + rng.integers(0, 40, n)
    chain = X.Chain.fit(row, key, y)
    assert chain.models[1].dense.shape == (1,) and chain.models[1].dense[0] > 0
    p = chain.predict(row, key, n)
    assert ((p > 0.5) == y).mean() > 0.99
    again = chain.predict(np.concatenate([row, row]), np.concatenate([key, key]), n)
    assert np.allclose(p, again)


def test_shapes(frame, spark):
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)] + [(0, 0, 1), (None, 1, 1), (3, None, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    docs = frame([(i, "nice day" if i % 2 else "vile day") for i in range(40)] + [(None, "vile"), (50, None), (51, ""), (0, "vile day"), (52, "calm " * 100_000 + "vile")])
    names = ("quality", "toxic")
    got = X.score(docs.withColumn("p_toxic", F.lit("x")), X.fit(docs, labels, names), names).collect()
    assert len(got) == 45
    for r in got:
        if r.doc_id is not None and r.doc_id < 40:
            assert (r.p_toxic > 0.5) == (r.doc_id % 2 == 0)
    none = X.fit(docs, labels.limit(0), names)
    assert {r.p_toxic for r in X.score(docs, none, names).collect()} == {0.5}
    assert X.score(frame([]), none, names).collect() == []


@pytest.mark.parametrize("a,b", [("Vile!!", "vile"), ("ÉTÉ", "été"), ("a-b", "a b")])
def test_features_ignore_case_and_marks(a, b):
    def keys(t):
        data = np.frombuffer(t.encode(), np.uint8)
        return sorted(X.features(data, np.array([0, len(data)]))[1].tolist())

    assert keys(a) == keys(b)


def test_recall_at_the_chosen_cut(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    names = ("quality", "toxic")
    chain = X.fit(docs, labels.where("doc_id % 4 <> 0"), names)
    held = X.score(docs, chain, names).join(labels.where("doc_id % 4 = 0"), "doc_id")
    caught, toxic, wrong, clean = held.agg(*(F.count_if(F.expr(e)) for e in (f"toxic = 1 and p_toxic >= {chain.cuts[1]}", "toxic = 1", f"toxic = 0 and p_toxic >= {chain.cuts[1]}", "toxic = 0"))).first()
    assert caught / toxic >= 0.9 and wrong / clean <= 0.02


def test_rare_labels_among_many_rows(spark, monkeypatch):
    """One toxic row in a thousand, and far more labels than the sample has."""
    monkeypatch.setattr(X, "TRAIN_ROWS", 200)
    monkeypatch.setattr(X, "TRAIN_POSITIVE", 40)
    ids = spark.range(50_000)
    docs = ids.select(F.col("id").alias("doc_id"), F.expr("concat(if(id % 1000 = 0, 'vile', 'nice'), ' word', id % 97)").alias("text"))
    labels = ids.select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.expr("cast(id % 1000 = 0 as int)").alias("toxic"))
    names = ("quality", "toxic")
    chain = X.fit(docs, labels, names)
    found = X.score(docs, chain, names).where(F.col("p_toxic") >= chain.cuts[1])
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == list(range(0, 50_000, 1000))


def plain_chain(chain, words):
    """The chain's probabilities of one text in plain Python, from its distinct features."""
    p = []
    for m in chain.models:
        weights = dict(zip(m.kept.tolist(), m.weights.tolist(), strict=True))
        s = m.bias + sum(weights.get(k, 0.0) for k in words) + sum(a * b for a, b in zip(m.dense.tolist(), p, strict=True))
        p.append(1 / (1 + np.exp(-s)))
    return p


def test_equals_the_chain_in_plain_python(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    names = ("quality", "toxic")
    chain = X.fit(docs, labels, names)
    got = {r.doc_id: (r.p_quality, r.p_toxic) for r in X.score(docs, chain, names).collect()}
    for r in docs.collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        keys = set(X.features(data, np.array([0, len(data)]))[1].tolist())
        assert got[r.doc_id] == pytest.approx(plain_chain(chain, keys), abs=1e-9)
    want = {i for i, (_, p) in got.items() if p >= chain.cuts[1]}
    assert {r.doc_id for r in X.op10_toxicity(spark, "/root/testdata/sf0.001").collect()} == want
