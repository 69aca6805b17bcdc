"""MinHash near-duplicate detection with min-max hashing.

Each permutation contributes both the smallest and the largest hash of a document's
word shingles, so 64 permutations give 128 signature values. Four values of one side
form a band; 32 bands find a pair of similarity 0.75 with probability 1 - 5e-6.
Documents with the same shingle set collapse into one class first. In every bucket
of a band each class is compared with one hub; only the classes that don't come out in
their hub's component are compared with all that share a bucket with this hub, in
blocks, so a large group of copies makes no more rows than its size. Links are
confirmed on the full shingle sets and joined to connected components.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm import textops as T
from quillflow.llm.graph import components, spread_join
from quillflow.llm.staging import small_batches, stage, table

PERMUTATIONS, ROWS, WORDS, PERCENT = 64, 4, 5, 75
#: At most so many ids (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Bounds of a block in which sets are compared, and the columns of a slab of its incidence matrix.
BLOCK_ROWS, BLOCK_SHINGLES, SLAB = 300, 300_000, 4096
U = np.uint64


def signatures(permutations: int, rows: int, k: int):
    """A mapInArrow function: set size, two sums that identify the set, and the band keys."""
    rng = np.random.Generator(np.random.PCG64(75))
    flips, odds, odds2 = rng.integers(0, 2**64, (3, permutations), dtype=U) | U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, off in T.chunks(batch.column(1)):
                ids = batch.column(0).slice(at, len(off) - 1)
                sh, soff = T.shingles(*T.words(data, off), k)
                own, ooff = T.distinct(sh, soff)
                full = np.flatnonzero(np.diff(ooff))
                starts = ooff[:-1][full]
                low = np.zeros((2, permutations, len(off) - 1), U)
                v, t = np.empty_like(own), np.empty_like(own)
                for p in range(permutations if len(full) else 0):
                    np.bitwise_xor(own, flips[p], out=v)
                    np.multiply(v, odds[p], out=v)
                    np.right_shift(v, U(32), out=t)
                    np.bitwise_xor(v, t, out=v)
                    np.multiply(v, odds2[p], out=v)
                    low[0, p, full] = np.minimum.reduceat(v, starts)
                    low[1, p, full] = np.maximum.reduceat(v, starts)
                values = low.reshape(-1, rows, len(off) - 1)
                keys = np.zeros((len(off) - 1, len(values)), U)
                for b, band in enumerate(values):
                    key = np.full(len(off) - 1, b + 1, U) * T._MULT[61]
                    for r in range(rows):
                        key = T.mix(key ^ band[r]) * T._MULT[r]
                    keys[:, b] = key
                n = np.diff(ooff)
                bands = T.list_array(keys[full].ravel().view(np.int64), np.concatenate([[0], np.cumsum(np.where(n > 0, len(values), 0))]))
                sums = [T.segment_sum(T.mix(own ^ T._MULT[c]), ooff).view(np.int64) for c in (50, 51)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), *map(pa.array, sums), bands], ["doc_id", "n_shingles", "s1", "s2", "bands"])

    return run


def shingle_sets(k: int):
    """A mapInArrow function: the sorted distinct shingle hashes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, off in T.chunks(batch.column(1)):
                own, ooff = T.distinct(*T.shingles(*T.words(data, off), k))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(off) - 1), T.list_array(own.view(np.int64), ooff)], ["id", "own"])

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", permutations: int = PERMUTATIONS, rows: int = ROWS, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable) and kept.

    Words are runs without ASCII white space, A-Z lower-cased; the set of a row has its
    distinct k-word shingles, or the whole sequence if it has fewer words. Two rows are
    linked if 100 * intersection >= percent * union. A null or wordless text has the
    empty set and is linked with nothing. Rows that repeat an id are one document with
    the same component; where their texts differ, one of the texts speaks for all. A row whose id is null can't be named: it is linked with
    nothing, has a null component and is kept. Texts count whole, however long; one
    chunk of rows and its sets are in memory at once. Of pairs with the same similarity
    all are links. Columns besides the two named are not read, whatever their names. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stage(texts.mapInArrow(signatures(permutations, rows, k), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"), "signatures")
    named = signed.where("doc_id is not null and n_shingles > 0")
    classes = stage(named.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")

    buckets = classes.select(F.explode("bands").alias("bucket"), F.struct("rep", "n_shingles").alias("doc"))
    hubs = buckets.groupBy("bucket").agg(F.min("doc").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = buckets.join(hubs, "bucket").where("doc.rep <> hub.rep")
    stars = stage(stars.select(F.col("hub.rep").alias("a"), F.col("doc.rep").alias("b"), F.col("hub.n_shingles").alias("n"), F.col("doc.n_shingles").alias("m")).distinct(), "stars")
    ids = stage(stars.select(F.col("a").alias("doc_id")).union(stars.select("b")).distinct(), "ids")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = stage(texts.join(few, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(shingle_sets(k), "id long, own array<long>").dropDuplicates(["id"]), "sets")
    links = confirm(stars.where(f"least(n, m) * 100 >= greatest(n, m) * {percent}").select("a", "b"), sets, percent)
    roots = components(links)
    more = strays(stars, links, roots, sets, percent)
    if more is not None:
        roots = components(links.union(more))
    named = classes.select("s1", "s2", "n_shingles", F.col("rep").alias("id")).join(roots, "id", "left").withColumn("component_id", F.coalesce("root", "id")).drop("id", "root")
    here = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    found = spread_join(signed.drop("bands").where(here), named, ["s1", "s2", "n_shingles"], "doc_id")
    found = found.select("doc_id", "n_shingles", "component_id").union(signed.where(~here).select("doc_id", "n_shingles", "doc_id"))
    return found.withColumn("kept", F.expr("doc_id is null or doc_id = component_id"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough, staged."""
    both = spread_join(pairs, sets.select(F.col("id").alias("a"), F.col("own").alias("x")), ["a"], "b").join(sets.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
    both = both.select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("i"))
    return stage(both.where(f"i * 100 >= (n + m - i) * {percent}").select("a", "b"), "links")


def strays(stars: DataFrame, links: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Further links, staged, that join the components of documents that share a bucket.

    Whoever isn't in its hub's component is compared with all that share a bucket with
    this hub, in blocks of bounded size; a block yields just the links that join
    components, never its pairs.
    """
    ids = sets.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    # a pair that isn't a link itself may still lie in one component
    apart = stars.join(links, ["a", "b"], "left_anti").join(ids.select(F.col("id").alias("b"), F.col("root").alias("b_root")), "b")
    apart = spread_join(stage(apart, "open"), ids.select(F.col("id").alias("a"), F.col("root").alias("a_root")), ["a"], "b")
    apart = stage(apart.where("a_root <> b_root").select("a", "b", F.col("m").alias("size"), "b_root"), "apart")
    near = stage(apart.groupBy("a").agg(F.count("*").alias("outer_rows"), F.sum("size").alias("outer_size")), "outer")
    if near.isEmpty():
        return None
    hubs = F.broadcast(near.select("a")) if near.count() <= BROADCAST_IDS else near.select("a")
    own = stars.join(hubs, "a", "left_semi")
    members = own.select("a", F.col("b").alias("id"), F.col("m").alias("size")).union(own.select("a", F.col("a").alias("id"), F.col("n").alias("size")).distinct())
    members = stage(members.join(ids, "id").select(F.col("a").alias("hub"), "id", "size", F.col("root").alias("own_root")), "members")
    every = members.groupBy("hub").agg(F.count("*").alias("all_rows"), F.sum("size").alias("all_size"))
    blocks = near.withColumnRenamed("a", "hub").join(every, "hub").select("hub", *(F.expr(f"cast(greatest(ceil({x}_size / {BLOCK_SHINGLES}), ceil({x}_rows / {BLOCK_ROWS})) as int)").alias(f"{x}_blocks") for x in ("outer", "all")))
    blocks = stage(blocks, "blocks")
    blocks = F.broadcast(blocks) if blocks.count() <= BROADCAST_IDS else blocks
    left = apart.select(F.col("a").alias("hub"), F.col("b").alias("id"), F.col("b_root").alias("own_root")).join(blocks, "hub")
    left = left.select("hub", "id", "own_root", F.expr("pmod(xxhash64(id), outer_blocks)").alias("i"), F.expr("explode(sequence(0L, all_blocks - 1L))").alias("j"), F.lit(True).alias("left"))
    right = members.join(blocks, "hub")
    right = right.select("hub", "id", "own_root", F.expr("explode(sequence(0L, outer_blocks - 1L))").alias("i"), F.expr("pmod(xxhash64(id), all_blocks)").alias("j"), F.lit(False).alias("left"))
    both = left.unionByName(right).join(sets, "id")
    return stage(both.groupBy("hub", "i", "j").applyInArrow(block_links(percent), "a long, b long"), "links")


def block_links(percent: int):
    """For applyInArrow: links between rows of the left and the right block, those only that join two components."""

    def run(group: pa.Table) -> pa.Table:
        side = group["left"].to_numpy(zero_copy_only=False)
        ids, comp = group["id"].to_numpy(), group["own_root"].to_numpy()
        own = group["own"].combine_chunks()
        flat, off = own.flatten().to_numpy(), np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy())])
        size = np.diff(off)
        _, place, seen = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(ids)), size)
        common = seen[place] > 1  # a shingle that one row has alone adds nothing
        order = np.argsort(place[common], kind="stable")
        row, place = row[common][order], place[common][order]
        place = np.unique(place, return_inverse=True)[1]
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        at = np.zeros(len(ids), np.int64)
        at[left], at[right] = np.arange(len(left)), np.arange(len(right))
        both = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, int(place[-1]) + 1 if len(place) else 0, SLAB):
            a, b = np.searchsorted(place, [lo, lo + SLAB])
            m = [np.zeros((len(x), SLAB), np.float32) for x in (left, right)]
            for which, s in enumerate((side, ~side)):
                r, p = row[a:b], place[a:b]
                m[which][at[r[s[r]]], p[s[r]] - lo] = 1
            both += m[0] @ m[1].T
        inter = both.astype(np.int64)
        ok = (inter * 100 >= (size[left][:, None] + size[right][None, :] - inter) * percent) & (comp[left][:, None] != comp[right][None, :])
        found, up = [], {}

        def top(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        for x, y in zip(*np.nonzero(ok), strict=True):
            p, q = top(comp[left[x]]), top(comp[right[y]])
            if p != q:
                up[max(p, q)] = min(p, q)
                found.append((ids[left[x]], ids[right[y]]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, of the documents that near_duplicates() keeps.

    Rows that repeat an id are one document, of which one row stays. Rows without an id
    stay, as does one row of every id with a null, empty or wordless text. Texts count
    whole. Other columns, whatever their names, pass through; an empty table stays empty.
    """
    found = stage(near_duplicates(docs, id_col=id_col, text_col=text_col), "found")
    key, other = F.col(id_col).cast("long"), "_" + uuid.uuid4().hex

    def among(ids: DataFrame, how: str) -> DataFrame:
        ids = ids.select(F.col("doc_id").alias(other)).distinct()
        return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key == F.col(other), how)

    gone = found.where("not kept").select("doc_id")
    again = stage(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1"), "again")
    if again.isEmpty():
        return among(gone, "left_anti")
    return among(gone.union(again.select("doc_id")), "left_anti").unionByName(among(again, "left_semi").dropDuplicates([id_col]))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of ``documents``: 5-word shingles, similarity 0.75."""
    return near_duplicates(table(spark, sf_dir, "documents"))
