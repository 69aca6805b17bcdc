import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillflow.llm import minhash as M
from quillflow.llm import textops as T


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=75):
    """{id: (set size, component)} by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in sets}


def corpus(words):
    rng, rows = random.Random(3), []
    for k in range(25):
        base = words(rng.randint(1, 160), k)
        rows.append(" ".join(base))
        for c in range(rng.randint(0, 6)):
            near = list(base)
            for _ in range(rng.randint(0, 1 + len(near) // 30)):
                near[rng.randrange(len(near))] = f"x{k}{c}"
            rows.append((" " if c % 2 else "\n\t").join(near).upper() if c % 3 else " ".join(near))
    passage = " ".join(words(80, 999))  # shared by documents that aren't alike
    rows += [passage + " " + " ".join(words(rng.randint(20, 90), 2000 + i)) for i in range(40)]
    return rows + ["", None, " \n", "a", "A", "a b", "a b", "é È", "é è"]


def check(df, rows):
    found = M.near_duplicates(df).collect()
    want = brute(rows)
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
        else:
            assert r.component_id is None and r.kept


def test_equals_brute_force(frame, words):
    rows = list(enumerate(corpus(words)))
    check(frame(rows), rows)


def test_small_blocks_lose_nothing(frame, words, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 4)
    monkeypatch.setattr(M, "SLAB", 7)
    rows = list(enumerate(corpus(words)))
    check(frame(rows), rows)


def test_repeated_and_unnamed_rows(frame):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (9, None), (None, None)]
    check(frame(rows), rows)
    kept = M.keep_one(frame(rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept) == [-1, -1, 2, 9]
    again = M.keep_one(frame([(1, "x"), (1, "x"), (1, None)])).collect()
    assert [r.doc_id for r in again] == [1]


def test_empty_table_and_clashing_columns(frame, spark):
    assert M.near_duplicates(frame([])).collect() == [] and M.keep_one(frame([])).collect() == []
    df = spark.createDataFrame([(1, "a b", 1, 2, "x", 3), (2, "a b", 1, 2, "x", 3)], "doc_id long, text string, kept int, rep int, bands string, component_id int")
    assert M.keep_one(df).columns == df.columns and M.keep_one(df).count() == 1


def test_long_text(frame, words):
    text = " ".join(words(200_000, 1))
    rows = [(1, text), (2, text + " end"), (3, "end")]
    assert {r.doc_id: r.component_id for r in M.near_duplicates(frame(rows)).collect()} == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("percent", [50, 75, 90])
def test_signature_agrees_with_similarity(percent):
    """Equal values of two signatures are as many as the similarity says, within chance."""
    rng = np.random.default_rng(1)
    sets = rng.integers(0, 2**64, 400, dtype=np.uint64)
    n = 100 * percent // (100 + percent) * 2
    a, b = sets[:n], np.concatenate([sets[: n * 2 * percent // (100 + percent)], sets[200 : 200 + n - n * 2 * percent // (100 + percent)]])
    true = len(set(a) & set(b)) / len(set(a) | set(b))
    odds = rng.integers(0, 2**64, 500, dtype=np.uint64) | np.uint64(1)
    same = [f(T.mix(a * m)) == f(T.mix(b * m)) for m in odds for f in (np.min, np.max)]
    assert abs(np.mean(same) - true) < 0.07


def test_word_bounds():
    def count(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return len(T.words(data, np.array([0, len(data)]))[0])

    for text in ("a b", " a\x0bb\x0c", "a b", "a　b c", "\x1ca", ""):
        assert count(text) == len(re.findall(r"[^\x20\x09-\x0D]+", text))


def test_spans_have_hashes_of_their_own():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000, dtype=np.uint8)
    starts = rng.integers(0, 2800, 30_000)
    ends = starts + rng.integers(0, 150, 30_000)
    raw, seen = data.tobytes(), {}
    for a, b, h in zip(starts.tolist(), ends.tolist(), T.hash_spans(data, starts, ends).tolist(), strict=True):
        assert seen.setdefault(raw[a:b], h) == h
    assert len(set(seen.values())) == len(seen)


def test_words_that_a_polynomial_takes_for_equal(frame):
    text = "a"
    while len(text) < 1024:
        text += text.translate({97: "b", 98: "a"})
    rows = [(1, text), (2, text.translate({97: "b", 98: "a"})), (3, text)]
    check(frame(rows), rows)


def test_rows_grow_with_the_documents_that_share_a_passage(frame, words, monkeypatch):
    """Documents that aren't alike but share a passage and so buckets; rows staged, and copied to blocks, grow in proportion."""
    passage, seen, made = " ".join(words(120, 1)), {}, M.stage

    def counted(df, name):
        out = made(df, name)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(M, "stage", counted)
    totals = []
    for n in (500, 1000, 2000):
        seen.clear()
        rows = [(i, passage + " " + " ".join(words(70, 5000 + i))) for i in range(n)]
        found = M.near_duplicates(frame(rows)).collect()
        assert all(r.component_id == r.doc_id for r in found) and seen["members"] > n
        totals.append(sum(seen.values()))
    assert totals[1] < 2.3 * totals[0] and totals[2] < 2.3 * totals[1]


def test_hot_keys_are_split(spark, monkeypatch):
    from quillflow.llm import graph as G

    monkeypatch.setattr(G, "SPLIT_ROWS", 20)
    many = spark.range(1000).select((F.col("id") % 10 * (F.col("id") % 3 == 0).cast("int")).alias("k"), "id")
    one = spark.range(11).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = G.spread_join(many, one, ["k"], "id").select("k", "id", "v")
    assert sorted(got.collect()) == sorted(many.join(one, "k").select("k", "id", "v").collect()) and got.count() == 1000
    star = spark.range(1, 500).select(F.col("id").alias("x"), F.lit(0).cast("long").alias("y")).union(spark.range(500, 900).select("id", F.lit(899).cast("long")))
    roots = {r.id: r.root for r in G.components(star).collect()}
    assert roots == {i: 0 for i in range(1, 500)} | {i: 500 for i in range(501, 900)}
