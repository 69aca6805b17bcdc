"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a document with at most e edits, cut into e + 1 pieces,
leaves one piece untouched. An Aho-Corasick automaton finds the exact piece hits of
all items in one pass over a text; each hit's surroundings are verified with Myers'
bit-parallel edit distance.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm.staging import small_batches, stage, table

#: Edits allowed, as a share of an item's characters; items with fewer characters than the least must occur as they are, as whole words.
ERRORS, LEAST_CHARS = 0.08, 16
#: An edit changes at most so many of an item's overlapping grams of that length, so few common ones rule a place out.
GRAM = 5
#: Characters of items that go to the workers at once; more are matched in several passes.
ITEM_CHARS = 20_000_000
_BUILT: dict[str, Matcher] = {}


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join((text or "").lower().split())


def myers(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of ``item`` in ``text`` with at most ``most`` edits, the first if several."""
    m, peq = len(item), {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = ones, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & ones, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & ones, mh << 1 & ones
        pv, mv = mh | ~(xv | ph) & ones, ph & xv
        if score <= most and (best is None or score < best[0]):
            best = score, j + 1
    return best


class Matcher:
    """Items by their pieces; find() gives each matching item of a text once."""

    def __init__(self, items: list[tuple[int, str]], errors: float, shortest: int = LEAST_CHARS):
        import ahocorasick

        self.items = [(i, t, int(len(t) * errors) if len(t) >= LEAST_CHARS else 0) for i, t in ((i, normal(t)) for i, t in items) if len(t) >= max(1, shortest)]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for at, (_, t, e) in enumerate(self.items):
            cuts = [len(t) * p // (e + 1) for p in range(e + 2)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(t[lo:hi], []).append((at, lo))
        self.grams = [[t[i : i + GRAM] for i in range(len(t) - GRAM + 1)] for _, t, _ in self.items]
        self.auto = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.auto.add_word(piece, (len(piece), places))
        if pieces:
            self.auto.make_automaton()

    def find(self, raw: str | None) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normalised text) for each item found, its best occurrence."""
        text = normal(raw)
        if not text or not self.items:
            return []
        best: dict[int, tuple[int, int]] = {}
        tried: dict[int, int] = {}
        for last, (n, places) in self.auto.iter(text):
            for at, lo in places:
                item, t, e = self.items[at]
                if at in best and best[at][0] == 0:
                    continue
                start = last + 1 - n - lo
                if n < LEAST_CHARS and len(t) == n:  # a short item
                    if not (text[start - 1 : start].isalnum() or text[last + 1 : last + 2].isalnum()):
                        best[at] = (0, last + 1)
                    continue
                if tried.get(at) == start:  # the next piece of the same place
                    continue
                tried[at] = start
                if text.startswith(t, max(start, 0)) and start >= 0:
                    best[at] = (0, start + len(t))
                    continue
                begin = max(0, start - e)
                around = text[begin : start + len(t) + e]
                there = {around[i : i + GRAM] for i in range(len(around) - GRAM + 1)}
                if sum(map(there.__contains__, self.grams[at])) < len(self.grams[at]) - GRAM * e:
                    continue
                found = myers(t, around, e)
                if found and (at not in best or found[0] < best[at][0]):
                    best[at] = found[0], begin + found[1]
        return sorted((self.items[at][0], d, end) for at, (d, end) in best.items())


def _blocks(items: DataFrame, item_id: str, item_text: str, errors: float, shortest: int) -> tuple[int, Iterator]:
    """How many blocks of items of bounded size there are, and each as a broadcast with a key for the workers' cache."""
    spark = items.sparkSession
    chosen = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    total = chosen.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // ITEM_CHARS)

    def each():
        for b in range(n):
            rows = chosen.where(F.expr(f"pmod(xxhash64(i, t), {n}) = {b}")).collect()
            yield uuid.uuid4().hex, spark.sparkContext.broadcast([(r.i, r.t) for r in rows]), errors, shortest

    return n, each()


def _matcher(key: str, items, errors: float, shortest: int) -> Matcher:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Matcher(items.value, errors, shortest)
    return _BUILT[key]


def contaminated(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", errors: float = ERRORS, shortest: int = LEAST_CHARS
) -> DataFrame:
    """A row for each document and each item found in it: doc_id, item_id, distance, end_at.

    ``end_at`` is the end of the best occurrence in the normalised text (lower case, one
    space for white space), the first of several. Null or empty texts and items, and
    items with fewer than ``shortest`` characters, match nothing; others below
    LEAST_CHARS match as whole words without edits. Texts are matched whole. Rows that
    repeat an id each give their rows; a null id stays null. Other columns, whatever
    their names, aren't read. Without items or documents there are no rows.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n, blocks = _blocks(items, item_id, item_text, errors, shortest)
    out = None
    for block in blocks:

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            m = _matcher(*block)
            for batch in batches:
                rows = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for x in m.find(t.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["doc_id", "item_id", "distance", "end_at"])

        found = texts.mapInArrow(run, "doc_id long, item_id long, distance long, end_at long")
        if n > 1:  # one block at a time is alive
            found = stage(found, "found")
            block[1].unpersist()
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance long, end_at long")


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", errors: float = ERRORS, shortest: int = LEAST_CHARS) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found, with all their columns, whatever their names.

    Items are found as in contaminated(). Rows with a null or empty text, and rows that
    repeat, stay as they are; an empty table stays empty, and without items all rows stay.
    """
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)
    n, blocks = _blocks(items, item_id, item_text, errors, shortest)
    for block in blocks:

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            m = _matcher(*block)
            for batch in batches:
                yield batch.filter(pa.array([not m.find(t.as_py()) for t in batch.column(place)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if n > 1:
            docs = stage(docs, "clean")
            block[1].unpersist()
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of ``benchmark`` in ``documents``, with at most 8 % of their characters edited; none is too short."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shortest=1)


def decontaminate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that occur without an edit, which SQL can express."""
    return op3_decontaminate(spark, sf_dir).where("distance = 0").select("doc_id", "item_id")
