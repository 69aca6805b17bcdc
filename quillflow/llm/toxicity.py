"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each model sees the probabilities of
the earlier ones beside the text's features, and is trained with out-of-fold
predictions of them, as they are no better than those it meets later. Features are
the distinct words of a text and the first letters of its longer words, hashed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm import textops as T
from quillflow.llm.language import _LETTER
from quillflow.llm.staging import small_batches, stage, table

#: Labelled rows that the chain is fitted on at most, and rows of each category added to them; hashed features, and those that a model keeps.
TRAIN_ROWS, TRAIN_POSITIVE, BITS, KEPT, FOLDS = 8000, 500, 20, 800, 3
PREFIXES = (4, 5, 6)
#: CUT is the probability from which a category is assigned where no row is labelled; else it is chosen out of fold.
STEPS, RIDGE, LEAST_COUNT, CUT = 120, 3e-4, 3, 0.3
#: Rare features are scaled up so much at most, which speeds up the fit.
MOST_SCALE = np.float32(30)
U = np.uint64


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word and word beginning; letters are lower-cased, other ASCII parts words."""
    data = _LETTER[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    upper = np.zeros(len(data), bool)
    upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    data = data + np.where(upper, np.uint8(32), np.uint8(0))
    inside = data != 32
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    row = np.searchsorted(off, starts, side="right") - 1
    rows, keys = [row], [T.hash_spans(data, starts, ends)]
    for n in PREFIXES:
        long = ends - starts > n
        rows.append(row[long])
        keys.append(T.hash_spans(data, starts[long], starts[long] + n) ^ T._MULT[n])
    return np.concatenate(rows), (np.concatenate(keys) >> U(64 - BITS)).astype(np.int64)


def distinct_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (id, found) with each row's distinct features."""
    for batch in batches:
        for at, data, off in T.chunks(batch.column(1)):
            row, key = features(data, off)
            both = np.unique(row << BITS | key)
            counts = np.bincount(both >> BITS, minlength=len(off) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(off) - 1), T.list_array((both & (1 << BITS) - 1).astype(np.int32), np.concatenate([[0], np.cumsum(counts)]))], ["id", "found"])


class Linear:
    """Ridge logistic regression on chosen features and some dense columns."""

    def __init__(self, kept: np.ndarray, weights: np.ndarray, dense: np.ndarray, bias: float):
        self.kept, self.weights, self.dense, self.bias = kept, weights, dense, bias

    @classmethod
    def fit(cls, row: np.ndarray, key: np.ndarray, dense: np.ndarray, y: np.ndarray) -> Linear:
        n, pos = len(y), max(y.sum(), 1e-9)
        seen = np.bincount(key, minlength=1 << BITS).astype(float)
        hits = np.bincount(key, weights=y[row], minlength=1 << BITS)
        expected = seen * pos / n
        gain = (hits - expected) ** 2 / np.maximum(expected * (1 - pos / n), 1e-9) * (seen >= LEAST_COUNT)
        kept = np.sort(np.argsort(-gain, kind="stable")[:KEPT])
        kept = kept[gain[kept] > 0]
        place = np.full(1 << BITS, -1)
        place[kept] = np.arange(len(kept))
        use = place[key] >= 0
        x = np.zeros((n, len(kept) + dense.shape[1] + 1), np.float32)
        x[row[use], place[key[use]]] = 1
        x[:, len(kept) : -1] = dense
        x[:, -1] = 1
        scale = np.minimum(1 / np.sqrt(np.maximum((x**2).mean(axis=0), 1e-9)), MOST_SCALE)
        x *= scale
        w, z = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
        # Nesterov's method; the step is bounded by the largest eigenvalue, found by power iteration
        v = np.ones(x.shape[1], np.float32)
        for _ in range(10):
            v = x.T @ (x @ v)
            v /= np.linalg.norm(v) or 1
        rate = 1 / (0.25 * float(np.linalg.norm(x @ v) ** 2) / n + RIDGE)
        for step in range(STEPS):
            grad = x.T @ (1 / (1 + np.exp(-(x @ z))) - y).astype(np.float32) / n + RIDGE * np.append(z[:-1], 0).astype(np.float32)
            after = z - rate * grad
            z = after + step / (step + 3) * (after - w)
            w = after
        w = w * scale
        return cls(kept, w[: len(kept)].astype(float), w[len(kept) : -1].astype(float), float(w[-1]))

    def predict(self, row: np.ndarray, key: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Probabilities of the rows of ``dense`` from their distinct (row, feature)."""
        at = np.minimum(np.searchsorted(self.kept, key), max(len(self.kept) - 1, 0))
        use = self.kept[at] == key if len(self.kept) else np.zeros(len(key), bool)
        s = np.bincount(row[use], weights=self.weights[at[use]], minlength=len(dense)) if use.any() else np.zeros(len(dense))
        return 1 / (1 + np.exp(-np.clip(s + dense @ self.dense + self.bias, -500, 500)))


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which rows are assigned to a category: the middle of those whose F2 is near the best.

    F2 counts recall above precision, as a missed row does more harm than a clean one lost.
    """
    cuts = np.arange(0.05, 0.96, 0.05)
    f2 = np.array([5 * (y[p >= c]).sum() / max(1, (p >= c).sum() + 4 * y.sum()) for c in cuts])
    return float(cuts[f2 >= f2.max() - 0.005].mean()) if y.any() else CUT


class Chain:
    """Models of the categories in order, with the probability from which each is assigned."""

    def __init__(self, models: list[Linear], cuts: Sequence[float] = ()):
        self.models, self.cuts = models, list(cuts) or [CUT] * len(models)
        self.known = np.zeros(1 << BITS, bool)
        for m in models:
            self.known[m.kept] = True

    @classmethod
    def fit(cls, row: np.ndarray, key: np.ndarray, labels: np.ndarray) -> Chain:
        """labels: rows by categories, 0 or 1."""
        n, models, cuts, earlier = len(labels), [], [], np.zeros((len(labels), 0))
        fold = np.arange(n) % FOLDS
        for c in range(labels.shape[1]):
            y = labels[:, c].astype(float)
            models.append(Linear.fit(row, key, earlier, y))
            out = np.zeros(n)
            for f in range(FOLDS):
                inside = fold != f
                new = np.cumsum(inside) - 1
                use = inside[row]
                m = Linear.fit(new[row[use]], key[use], earlier[inside], y[inside])
                new = np.cumsum(~inside) - 1
                use = ~inside[row]
                out[~inside] = m.predict(new[row[use]], key[use], earlier[~inside])
            cuts.append(best_cut(out, y))
            earlier = np.column_stack([earlier, out])
        return cls(models, cuts)

    def predict(self, row: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
        """Rows by categories, from the (row, feature) of n texts, which may repeat."""
        use = self.known[key]
        both = np.unique(row[use] << BITS | key[use])
        row, key = both >> BITS, both & (1 << BITS) - 1
        earlier = np.zeros((n, 0))
        for m in self.models:
            earlier = np.column_stack([earlier, m.predict(row, key, earlier)])
        return earlier


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], *, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """A chain from a bounded sample of labelled documents, those whose ids have the lowest hashes.

    The lowest rows of each category are added, so that a rare one has examples at any
    size. Labels that are null, or whose document is missing, are left out; of repeated
    labels the largest counts. Without labels every probability is one half.
    """
    whole = labels.select(F.col(id_col).cast("long").alias("id"), *(F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories))).dropna()
    whole = whole.groupBy("id").agg(*(F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories)))).orderBy(F.xxhash64("id"), "id")
    chosen = whole.limit(TRAIN_ROWS)
    for i in range(len(categories)):
        chosen = chosen.union(whole.where(f"y{i} > 0").limit(TRAIN_POSITIVE))
    chosen = stage(chosen.distinct(), "chosen")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen.select("id")), "id", "left_semi").mapInArrow(distinct_features, "id long, found array<int>").join(F.broadcast(chosen), "id")
    rows = found.toArrow().combine_chunks().sort_by("id")
    lists = rows["found"].combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    row = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) if len(rows) else np.zeros(0, np.int64)
    key = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    y = np.column_stack([rows[f"y{i}"].to_numpy() for i in range(len(categories))]) if len(rows) else np.zeros((0, len(categories)))
    if not len(rows):
        return Chain([Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(i), 0.0) for i in range(len(categories))])
    return Chain.fit(row, key, y)


def score(docs: DataFrame, chain: Chain, categories: Sequence[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and a probability ``p_<category>`` for each category, from the whole text.

    A null or empty text has no features and gets the models' base rates; a long one
    counts whole, a chunk of rows is in memory at once. Rows that
    repeat an id give a row each, a null id stays null, other columns aren't read, an
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = ["doc_id", *(f"p_{c}" for c in categories)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, off in T.chunks(batch.column(1)):
                p = shared.value.predict(*features(data, off), len(off) - 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(off) - 1), *(pa.array(p[:, c]) for c in range(p.shape[1]))], names)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, " + ", ".join(f"`{x}` double" for x in names[1:]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``documents`` that the chain over quality and toxic finds toxic, with their probabilities."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    categories = ("quality", "toxic")
    chain = fit(docs, labels, categories)
    return score(docs, chain, categories).where(F.col("p_toxic") >= chain.cuts[-1])
