import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from quillflow.llm import fingerprint as P


def edited(rows, order):
    out = {}
    for k, i in enumerate(order):
        t, nxt = rows[i] or "", rows[order[(k + 1) % len(order)]] or ""
        q = len(t) // 4
        out[i] = t[: len(t) - q] + nxt[:q]
    return out


@pytest.mark.parametrize("bucket", [2, 2000])
def test_edited_texts_and_likeness(frame, words, monkeypatch, bucket):
    monkeypatch.setattr(P, "BUCKET_ROWS", bucket)
    rng = random.Random(1)
    ids = rng.sample(range(-50, 1000), 30)
    rows = {i: " ".join(words(rng.randint(0, 120), i + 100)) for i in ids}
    rows[ids[0]], rows[ids[1]], rows[ids[2]] = None, "é", rows[ids[3]]
    found = {r.doc_id: r for r in P.fingerprints(frame(list(rows.items()))).collect()}
    want = edited(rows, sorted(ids))
    assert set(found) == set(ids)
    alone = {r.doc_id: r.fingerprint for r in P.fingerprints(frame(list(want.items()))).collect()}
    order = sorted(ids)
    share = lambda a, b: sum(a[i : i + 8] == b[i : i + 8] for i in range(0, 8 * P.SLOTS, 8)) / P.SLOTS
    for k, i in enumerate(order):
        r = found[i]
        assert r.n_chars == len(rows[i] or "")
        assert r.edited_sha256 == hashlib.sha256(want[i].encode()).hexdigest()
        assert r.edited_fingerprint == alone[i]
        assert r.near_edited == share(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == share(r.fingerprint, found[order[(k + 1) % len(order)]].fingerprint)
    assert found[ids[2]].fingerprint == found[ids[3]].fingerprint


def test_order_matters_and_likeness_grows(frame, words):
    base = words(300, 5)
    moved = base[150:] + base[:150]
    shuffled = random.Random(2).sample(base, len(base))
    few = [w if i % 60 else "zz" for i, w in enumerate(base)]
    sets = P.slots(P.sampled(frame([" ".join(x) for x in (base, few, moved, shuffled)]), "text", ["doc_id"]), ["doc_id"]).collect()
    sig = {r.doc_id: r.sig for r in sets}
    like = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b], strict=True)) / P.SLOTS
    assert like(0, 1) > 0.6 > like(0, 2) > like(0, 3)


def test_repeats_nulls_and_long_texts(frame, words):
    long = " ".join(words(150_000, 3))
    rows = [(1, "a b"), (1, "a b"), (None, "c d e f g h"), (None, None), (2, ""), (3, long), (4, "x" * 100_000), (5, " \n ")]
    found = P.fingerprints(frame(rows)).collect()
    assert len(found) == len(rows) and all(len(r.fingerprint) == 8 * P.SLOTS for r in found)
    unnamed = next(r for r in found if r.doc_id is None and r.n_chars == 11)
    assert unnamed.edited_sha256 == hashlib.sha256(b"c d e f ga ").hexdigest()
    assert P.fingerprints(frame([])).collect() == []
    one = P.fingerprints(frame([(7, "abcdefgh")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1


def test_repeated_words_are_numbered(frame):
    sig = {r.doc_id: r.sig for r in P.slots(P.sampled(frame(["a b c " * 3, "a b c " * 9]), "text", ["doc_id"]), ["doc_id"]).collect()}
    assert sig[0] != sig[1]


def test_every_kmer_counts_beside_thousands_of_repeats(frame, words):
    rest = words(60, 11)
    texts = ["a b c " * 3000 + " ".join(rest), " ".join(rest) + " a b c" * 3000, "a b c " * 3000]
    rows = P.sampled(frame(texts), "text", ["doc_id"]).collect()
    for i, t in enumerate(texts):
        mine = [r for r in rows if r.doc_id == i]
        n = len(t.split()) - P.KMER + 1
        assert sorted(r.p for r in mine) == list(range(n)) and len({r.k for r in mine}) == n
    ks = [{r.k for r in rows if r.doc_id == i} for i in range(3)]
    assert len(ks[0] - ks[2]) >= len(rest) and len(ks[0] & ks[1]) > 0.99 * len(ks[0])


def test_likeness_of_repeated_passages(frame, words):
    """The share of equal slots is near that of order MinHash over all k-mers in plain Python."""
    passages = [words(60, 20 + i) for i in range(12)]
    texts = [(p * 200, p * 150 + q * 50) for p, q in zip(passages, passages[1:] + passages[:1], strict=True)]
    sig = {r.doc_id: r.sig for r in P.slots(P.sampled(frame([" ".join(t) for pair in texts for t in pair]), "text", ["doc_id"]), ["doc_id"]).collect()}
    got = [sum(a == b for a, b in zip(sig[2 * i], sig[2 * i + 1], strict=True)) / P.SLOTS for i in range(12)]

    def numbered(t):
        seen, out = {}, {}
        for i in range(len(t) - P.KMER + 1):
            k = tuple(t[i : i + P.KMER])
            seen[k] = seen.get(k, -1) + 1
            out[k, seen[k]] = i
        return out

    want, slots = [], 400
    for a, b in texts:
        one, two = numbered(a), numbered(b)
        rng = random.Random(3)
        order = sorted(one.keys() | two.keys())
        equal = 0
        for _ in range(slots):
            picks = [], []
            for _ in range(2):
                left = [None, None]  # random draws until each text has its smallest
                while None in left:
                    k = rng.choice(order)
                    for j, t in enumerate((one, two)):
                        if left[j] is None and k in t:
                            left[j] = k
                picks[0].append(left[0])
                picks[1].append(left[1])
            equal += [k[0] for k in sorted(picks[0], key=one.get)] == [k[0] for k in sorted(picks[1], key=two.get)] and set(picks[0]) == set(picks[1])
        want.append(equal / slots)
    assert all(0 < x < 1 for x in got) and abs(sum(got) - sum(want)) / 12 < 0.1
    assert max(abs(x - y) for x, y in zip(got, want, strict=True)) < 0.35


def test_no_python_in_the_plan(spark, capsys):
    P.op2_fingerprint(spark, "/root/testdata/sf0.001").explain("formatted")
    assert not any(x in capsys.readouterr().out for x in ("Python", "Arrow", "Pandas"))


def order_minhash(text):
    """The signature in plain Python: number all k-mers, then sort them anew for each slot."""

    def chain(values, raw=lambda v: v):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(raw(v), seed=h)
        return h

    long = lambda v: struct.pack("<Q", v % (1 << 64))
    mask, place = (1 << 64) - (1 << P.PLACE_BITS), (1 << P.PLACE_BITS) - 1
    other = "฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff"
    spaced = rf"[^\s{other}]"
    t = [m[0].encode() for m in re.finditer(rf"\s*(?:{spaced}{{1,{P.WORD}}}+(?!{spaced})|\S)", text, re.ASCII)]
    grams = [chain(t[i : i + P.KMER], bytes) & mask for i in range(len(t) - P.KMER + 1)] or [chain([b"|".join(t)], bytes) & mask if t else 0]
    seen, items = {}, []
    for p, g in enumerate(grams):
        n = seen[g] = seen.get(g, -1) + 1
        items.append((xxhash.xxh64_intdigest(struct.pack("<i", n), seed=xxhash.xxh64_intdigest(long(g), seed=42)) & mask | p))
    sig = []
    for start in P.STARTS:
        two = sorted(items, key=lambda x: (x - start) % (1 << 64))[:2]
        two = sorted(two * 2 if len(two) == 1 else two, key=lambda x: x & place)
        sig.append(chain([x & mask for x in two], long) & 0xFFFFFFFF)
    return sig


def test_equals_order_minhash_in_plain_python(frame, words):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(words(12, i), k=rng.randint(0, 90))) for i in range(140)]
    texts += ["".join(rng.choices("的一是在不了有和人这 ab", k=rng.randint(0, 120))) for _ in range(50)]
    texts += ["", " ", "a", "a b", "　x", "long" * 30, "ab " * 50, "\U00020001é\U0001f600", "x" * 24, "x" * 25]
    df = P.signed(P.numbered(frame(texts).select("doc_id", "text"), "text", "items"), "items", "sig")
    for r in df.collect():
        assert r.sig == order_minhash(r.text), r


@pytest.mark.parametrize("letters", ["的一是在不了有和人这中大为上个国我以要他", "abcdefghijklmnopqrstuvwxyz0123456789"])
def test_one_insertion_in_a_text_without_spaces(frame, letters):
    text = "".join(random.Random(1).choices(letters, k=4000))
    sig = {r.doc_id: r.sig for r in P.slots(P.sampled(frame([text, text[:700] + "x" + text[700:]]), "text", ["doc_id"]), ["doc_id"]).collect()}
    assert sum(a == b for a, b in zip(sig[0], sig[1], strict=True)) / P.SLOTS > 0.8


def test_buckets_with_an_outlying_id(frame, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 50)
    rows = [(i * 3, f"t{i} a b c d") for i in range(1000)] + [(1 << 62, "far"), (-(1 << 62), "near")]
    df, low = P.buckets(frame(rows).select("doc_id", "text"))
    sizes = {r.bucket: r["count"] for r in df.groupBy("bucket").count().collect()}
    assert low == -(1 << 62) and len(sizes) >= 15 and max(sizes.values()) <= 150
    last = -1
    for r in df.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("bucket").collect():
        assert r.a > last or r.a == low
        last = r.b
    found = {r.doc_id: r for r in P.fingerprints(frame(rows)).collect()}
    want = edited(dict(rows), sorted(i for i, _ in rows))
    assert all(found[i].edited_sha256 == hashlib.sha256(want[i].encode()).hexdigest() for i in want)


def test_other_columns_of_any_name(spark, words):
    names = ["bucket", "rn", "last", "sig", "edited", "_s", "_t", "after", "found"]
    rows = [(i, " ".join(words(20, i))) for i in range(6)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    more = spark.createDataFrame([(*r, *[7] * len(names)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    assert sorted(P.fingerprints(plain).collect()) == sorted(P.fingerprints(more).collect())
