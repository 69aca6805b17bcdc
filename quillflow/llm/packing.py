"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

Every full window's worth of a document is a sequence of its own. The rests of a
group of documents are dealt to k windows by differencing: starting with one partial
partition for each rest, the two with the largest imbalance are merged, the larger
sums of one on the smaller sums of the other, which leaves near-equal windows. While
one exceeds the capacity, k rises. The fullest windows, as many as the ids can fill,
are kept whole; the others are dissolved and their documents fill the room in those
kept, cut only where none fits. What is left goes to the next group, at the end of a
partition into sequences at powers of two, which need no padding: only those, with
fewer ids together than the capacity, are shorter than it. Groups are formed within
a partition, so nothing is shuffled.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillflow.llm import tokens
from quillflow.llm.staging import small_batches, stage, table

CAPACITY, END = 2048, 1
#: A group that is packed together ends at so many documents, or ids.
GROUP_DOCS, GROUP_IDS = 1024, 4_000_000
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Partition the items into k windows with near-equal sums; items by their place in ``sizes``.

    A partial partition is its non-zero sums in descending order, each with its items as
    a nested pair; the windows that it leaves empty are implied.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    heap = [(-s, i, [s], [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a, ax = heapq.heappop(heap)
        # while windows are empty, the next item takes one, and the imbalance stays the largest sum
        while heap and len(a) < k - 1 and len(heap[0][2]) == 1 and heap[0][2][0] <= a[-1]:
            _, _, b, bx = heapq.heappop(heap)
            a += b
            ax += bx
        if not heap:
            heapq.heappush(heap, (-a[0], tick, a, ax))
            break
        _, _, b, bx = heapq.heappop(heap)
        free = k - len(a)
        # b's largest sums meet a's empty windows first, then a's smallest sums
        sums = a + b[:free]
        items = ax + bx[:free]
        for j, (s, x) in enumerate(zip(b[free:], bx[free:], strict=True)) if len(b) > free else ():
            at = len(a) - 1 - j
            sums[at] += s
            items[at] = (items[at], x)
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, items = [sums[i] for i in order], [items[i] for i in order]
        heapq.heappush(heap, (-(sums[0] - (sums[-1] if len(sums) == k else 0)), tick, sums, items))
        tick += 1
    out: list[list[int]] = []
    for x in heap[0][3] if heap else []:
        flat, todo = [], [x]
        while todo:
            y = todo.pop()
            todo.extend(y) if isinstance(y, tuple) else flat.append(y)
        out.append(sorted(flat))
    return out + [[] for _ in range(k - len(out))]


def raised(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows by differencing, as few as the total asks for and more while one exceeds the capacity."""
    k = -(-sum(sizes) // capacity)
    while k:
        windows = differencing(sizes, k)
        most = max(sum(sizes[i] for i in w) for w in windows)
        if most <= capacity:
            return windows
        k = max(k + 1, k * most // capacity)
    return []


Piece = tuple[int, int, int]


def fill(rests: list[Piece], capacity: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences of pieces (item, start, length), each shorter than the capacity, and the pieces that are left over."""
    full = sum(x[2] for x in rests) // capacity
    windows = [[rests[i] for i in w] for w in raised([x[2] for x in rests], capacity)] if full else [rests]
    windows.sort(key=lambda w: -sum(x[2] for x in w))
    kept = windows[:full]
    loose = sorted(((n, d, at) for w in windows[full:] for d, at, n in w))
    for w in kept:
        room = capacity - sum(x[2] for x in w)
        while room:
            i = bisect_right(loose, (room, float("inf"), 0)) - 1
            n, d, at = loose.pop(max(i, 0))  # the longest that fits, else a part of the shortest
            take = min(n, room)
            w.append((d, at, take))
            room -= take
            if take < n:
                insort(loose, (n - take, d, at + take))
    return kept, [(d, at, n) for n, d, at in loose]


def whole(d: int, n: int, capacity: int) -> tuple[list[list[Piece]], list[Piece]]:
    """The full sequences of one document, and its rest."""
    full = n - n % capacity
    return [[(d, at, capacity)] for at in range(0, full, capacity)], [(d, full, n - full)] if n > full else []


def tail(rests: list[Piece], capacity: int) -> list[list[Piece]]:
    """Sequences at descending powers of two from pieces that have fewer ids together than the capacity."""
    total, todo, out = sum(x[2] for x in rests), rests[::-1], []
    for bit in range(capacity.bit_length(), -1, -1):
        left = total & 1 << bit
        if left:
            out.append([])
        while left:
            d, at, n = todo.pop()
            take = min(n, left)
            out[-1].append((d, at, take))
            left -= take
            if take < n:
                todo.append((d, at + take, n - take))
    return out


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[Piece]]:
    """Sequences of pieces (item, start, length) for documents of the given lengths, as one group."""
    parts = [whole(d, n, capacity) for d, n in enumerate(lengths)]
    kept, left = fill([x for _, rest in parts for x in rest], capacity)
    return [seq for seqs, _ in parts for seq in seqs] + kept + tail(left, capacity)


def packer(path: str, capacity: int, end: int):
    """A mapInArrow function from (doc_id, text) to pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base, made = tokens.encoder(path).encode, TaskContext.get().partitionId() << 40, 0
        #: Of each document of the group, and of those carried on from the group before: id, its length, ids that start at a place.
        group: list[tuple[int | None, int, int, np.ndarray]] = []
        carried: list[Piece] = []
        held = 0

        def written(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal made
            rows = []
            for seq in sequences:
                at = 0
                for d, start, n in seq:
                    who, total, first, ids = group[d]
                    rows.append((who, start, n, zlib.crc32(ids[start - first : start - first + n]), total, base + made, at))
                    at += n
                made += 1
            cols = list(zip(*rows, strict=True)) or [()] * len(NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], NAMES)

        def flush() -> pa.RecordBatch:
            nonlocal carried, held
            parts = [whole(d, group[d][1], capacity) for d in range(len(carried), len(group))]
            kept, left = fill(carried + [x for _, rest in parts for x in rest], capacity)
            out = written([seq for seqs, _ in parts for seq in seqs] + kept)
            group[:] = [(group[d][0], group[d][1], at, group[d][3][at - group[d][2] :][:n].copy()) for d, at, n in left]
            carried, held = [(i, at, n) for i, (_, at, n) in enumerate(left)], 0
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, flat, off in encode(batch.column(1)):
                with_end = np.insert(flat, off[1:], end).astype("<u4")
                offs = off + np.arange(len(off))
                for i, (lo, hi) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                    group.append((ids[at + i], hi - lo, 0, with_end[lo:hi]))
                    held += hi - lo
                    if len(group) - len(carried) >= GROUP_DOCS or held >= GROUP_IDS:
                        yield flush()
        if len(group) > len(carried):
            yield flush()
        if carried:
            yield written(tail(carried, capacity))

    return run


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A document's ids are its text's, then ``end``; a null or empty text has just ``end``.
    Each id lies in one piece. Rows that repeat an id, or have a null id, are documents of
    their own (their pieces carry the same doc_id, or null). Every sequence has
    ``capacity`` ids, but for the last of a partition at powers of two; its offsets run
    from 0 without gaps. Long texts are whole; a batch and a group of documents are in
    memory at once. Other columns aren't read. An empty table gives no pieces.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(packer(tokenizer or tokens.default_path(), capacity, end), ", ".join(f"{x} long" for x in NAMES))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all ``documents`` in windows of 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"))


def packing_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's pieces, and the sequences that they lie in, are gapless and of the right size."""
    pieces = op9_packing(spark, sf_dir)
    pieces = stage(pieces, "pieces")  # sequence ids depend on how the input is split
    near = lambda key, at: F.coalesce(F.lag(F.expr(f"`{at}` + length")).over(Window.partitionBy(key).orderBy(at)), F.lit(0)) == F.col(at)
    sequences = pieces.withColumn("fits", near("sequence_id", "offset")).groupBy("sequence_id").agg((F.min("fits") & (F.sum("length") <= CAPACITY)).alias("fits"))
    pieces = pieces.withColumn("joins", near("doc_id", "start")).join(sequences, "sequence_id")
    return pieces.groupBy("doc_id").agg((F.min("joins") & F.min("fits") & (F.sum("length") == F.max("doc_tokens"))).alias("whole"))
