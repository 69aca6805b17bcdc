import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillflow.llm import packing as K
from quillflow.llm import tokens

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def plain():
    t = tokenizers.Tokenizer.from_file(tokens.default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ODD = st.lists(st.sampled_from(list("ab c\t\n\r'.!1é ü") + ["  ", "   ", " the", "'s", " ", "　", "\U0001f600", "<|endoftext|>", "\x00"]), max_size=30).map("".join)


@settings(max_examples=250, deadline=None)
@given(st.lists(ODD, max_size=6))
def test_ids_equal_the_tokenizer(texts):
    import pyarrow as pa

    t = tokenizers.Tokenizer.from_file(tokens.default_path()) if not hasattr(test_ids_equal_the_tokenizer, "t") else test_ids_equal_the_tokenizer.t
    test_ids_equal_the_tokenizer.t = t
    got = []
    for _, flat, off in tokens.encoder(tokens.default_path()).encode(pa.array(texts, pa.string())):
        got += [flat[a:b].tolist() for a, b in itertools.pairwise(off)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_memo_starts_anew(plain, monkeypatch, words):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "MEMO", 50)
    e = tokens.Encoder(tokens.default_path())
    texts = [" ".join(words(100, i)) for i in range(20)]
    for text in texts:
        assert [f.tolist() for _, f, _ in e.encode(pa.array([text]))] == [plain(text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=30), st.integers(1, 8))
def test_differencing_is_a_partition(sizes, k):
    windows = K.differencing(sizes, k)
    assert len(windows) == k and sorted(itertools.chain(*windows)) == list(range(len(sizes)))


def test_differencing_is_near_equal():
    rng = random.Random(1)
    for k in (2, 3, 10):
        sizes = [rng.randint(1, 1000) for _ in range(40 * k)]
        sums = [sum(sizes[i] for i in w) for w in K.differencing(sizes, k)]
        assert max(sums) - min(sums) < 20
    assert sorted(sum([4, 5, 6, 7, 8][i] for i in w) for w in K.differencing([4, 5, 6, 7, 8], 2)) == [14, 16]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=25))
def test_packs_whole(lengths):
    seen = defaultdict(set)
    for seq in K.pack(lengths, 16):
        total = sum(n for *_, n in seq)
        assert 0 < total <= 16 and total & (total - 1) == 0  # nothing is padded
        for d, at, n in seq:
            assert n > 0
            span = set(range(at, at + n))
            assert not span & seen[d]
            seen[d] |= span
    assert {d: len(s) for d, s in seen.items()} == dict(enumerate(lengths)) and all(s == set(range(lengths[d])) for d, s in seen.items())


def test_pieces_are_exact(frame, plain, words):
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng.randint(0, 1500), i))) for i in range(60)] + [(100, None), (101, ""), (102, "<|endoftext|> x"), (103, "long " * 30_000)]
    found = K.pack_documents(frame(rows)).collect()
    ids = {i: np.array([*plain(t), K.END], "<u4") for i, t in rows}
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in found:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        docs[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for pieces, total in [(docs[i], len(ids[i])) for i in ids] + [(s, None) for s in seqs.values()]:
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == total if total is not None else 0 < at <= K.CAPACITY


def test_repeats_and_empty(frame):
    rows = [(1, "a"), (1, "a"), (None, "b"), (None, None)]
    found = K.pack_documents(frame(rows)).collect()
    assert sum(r.length for r in found) == 7 and sorted(str(r.doc_id) for r in found if r.start == 0) == ["1", "1", "None", "None"]
    assert K.pack_documents(frame([])).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 15), max_size=40))
def test_no_window_exceeds_the_capacity(sizes):
    windows = K.raised(sizes, 16)
    assert sorted(itertools.chain(*windows)) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 16 for w in windows) and len(windows) >= -(-sum(sizes) // 16)


def test_few_documents_are_cut():
    rng = random.Random(3)
    for draw in (lambda: rng.randint(1, 2047), lambda: min(2047, 1 + int(rng.lognormvariate(5.5, 1)))):
        lengths = [draw() for _ in range(1024)]
        pieces = defaultdict(int)
        for seq in K.pack(lengths, 2048):
            for d, *_ in seq:
                pieces[d] += 1
        assert sum(n > 1 for n in pieces.values()) <= 0.05 * len(lengths)
        assert len(K.raised(lengths, 2048)) <= 1.05 * sum(lengths) / 2048 + 1


def test_short_sequences_only_at_the_end_of_a_partition(frame, words, monkeypatch):
    monkeypatch.setattr(K, "GROUP_DOCS", 7)
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng.randint(0, 400), i))) for i in range(90)]
    seqs = defaultdict(int)
    for r in K.pack_documents(frame(rows), capacity=256).collect():
        seqs[r.sequence_id] += r.length
    by = defaultdict(list)
    for s, n in sorted(seqs.items()):
        by[s >> 40].append(n)
    for sizes in by.values():
        short = [n for n in sizes if n < 256]
        assert sizes == [256] * (len(sizes) - len(short)) + short and short == sorted(set(short), reverse=True) and all(n & (n - 1) == 0 for n in short)


def test_texts_that_a_polynomial_takes_for_equal(plain):
    import pyarrow as pa

    text = "a"
    while len(text) < 1024:
        text += text.translate({97: "b", 98: "a"})
    other = text.translate({97: "b", 98: "a"})
    got = []
    for t in (text, other):
        got += [flat.tolist() for _, flat, _ in tokens.encoder(tokens.default_path()).encode(pa.array([t]))]
    assert got == [plain(text), plain(other)]
