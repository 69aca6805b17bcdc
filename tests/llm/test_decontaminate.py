import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quillflow.llm import decontaminate as D


def distance(item, text):
    """Least edits of the item against any part of the text."""
    before = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return min(before)


@settings(max_examples=150, deadline=None)
@given(st.text("ab", min_size=1, max_size=10), st.text("abc", max_size=25))
def test_bit_parallel_distance(item, text):
    want, got = distance(item, text), D.myers(item, text, len(item) - 1)
    assert (got is None) == (want > len(item) - 1) and (got is None or got[0] == want)


def mutate(text, edits, rng):
    for _ in range(edits):
        at, kind = rng.randrange(len(text)), rng.randrange(3)
        text = text[:at] + (rng.choice("xyz") if kind else "") + text[at + (kind < 2) :]
    return text


def test_equals_brute_force(words):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng.randint(4, 12), i))) for i in range(6)]
    m = D.Matcher(items, 0.1)
    for k in range(60):
        i, t = rng.choice(items)
        text = " ".join(words(10, 50 + k)) + " " + mutate(t, rng.randint(0, 9), rng) + "\n " + " ".join(words(10, 90 + k))
        want = [(j, d) for j, x in items if (d := distance(D.normal(x), D.normal(text))) <= int(len(D.normal(x)) * 0.1)]
        assert [(j, d) for j, d, _ in m.find(text)] == want


def test_rows(frame, words):
    item = " ".join(words(20, 1))
    items = frame([(0, item), (1, item), (2, None), (3, ""), (4, "short")], "item_id long, text string")
    rows = [(1, "x " + item.upper().replace(" ", "\n ") + " y"), (2, "short"), (3, None), (4, ""), (None, item), (5, " ".join(words(50, 9))), (1, item), (6, ("word " * 100_000) + item)]
    found = D.contaminated(frame(rows), items).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id, r.distance) for r in found) == sorted([(d, i, 0) for d in (1, 1, -1, 6) for i in (0, 1)])
    kept = D.decontaminate(frame(rows), items)
    assert kept.columns == frame(rows).columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    assert D.contaminated(frame([]), items).collect() == []
    none = frame([], "item_id long, text string")
    assert D.contaminated(frame(rows), none).collect() == [] and D.decontaminate(frame(rows), none).count() == len(rows)


def test_items_in_several_passes(frame, words, monkeypatch):
    monkeypatch.setattr(D, "ITEM_CHARS", 100)
    texts = [" ".join(words(10, i)) for i in range(8)]
    items = frame(list(enumerate(texts)), "item_id long, text string")
    rows = list(enumerate(texts)) + [(99, "none of them")]
    assert sorted((r.doc_id, r.item_id) for r in D.contaminated(frame(rows), items).collect()) == [(i, i) for i in range(8)]
    assert [r.doc_id for r in D.decontaminate(frame(rows), items).collect()] == [99]


def test_short_items_match_as_whole_words(frame):
    items = frame([(0, "Blue moon"), (1, "x"), (2, "né 4?"), (3, "")], "item_id long, text string")
    rows = [(1, "a BLUE\n moon!"), (2, "blue moons"), (3, "xx x.y"), (4, "xx yx"), (5, "NÉ 4? 5"), (6, "bluemoon"), (7, "né 4?b"), (8, None)]
    found = D.contaminated(frame(rows), items, shortest=1)
    assert sorted((r.doc_id, r.item_id, r.distance) for r in found.collect()) == [(1, 0, 0), (3, 1, 0), (5, 2, 0)]
    assert sorted(r.doc_id for r in D.decontaminate(frame(rows), items, shortest=1).collect()) == [2, 4, 6, 7, 8]


def test_queries_find_what_brute_force_finds(spark):
    """Every document against every item, by the plain distance where a gram is shared and by search else."""
    data = "/root/testdata/sf0.001"
    items = [(r.item_id, D.normal(r.text)) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    want = set()
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        text = D.normal(r.text)
        for i, t in items:
            e = int(len(t) * D.ERRORS)
            if t in text:
                want.add((r.doc_id, i, 0))
            elif any(t[k : k + 6] in text for k in range(len(t) - 5)) and (found := D.myers(t, text, e)):
                want.add((r.doc_id, i, found[0]))
    got = {(r.doc_id, r.item_id, r.distance) for r in D.op3_decontaminate(spark, data).collect()}
    assert got == want and want
    assert {(r.doc_id, r.item_id) for r in D.decontaminate_exact(spark, data).collect()} == {(d, i) for d, i, n in want if not n}
