"""Document fingerprints by order MinHash, in DataFrame and SQL functions only.

A text is cut into pieces (words; letters of scripts that don't space words, and of runs
longer than a word) and every run of three pieces is a k-mer. All k-mers are numbered by
their occurrence and hashed with that number. For each of 32 slots a permutation selects
the two smallest of all (k-mer, occurrence) pairs of the text; they are put back into
text order and hashed together, so moved passages change slots that a plain MinHash
would leave alone. Likeness is the share of equal slots. The permutations are rotations
of the order of the hashes by fixed distances, so a slot's two smallest lie next to
each other in the sorted array of hashes and a binary search finds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillflow.llm.staging import stage, table

SLOTS, KMER = 32, 3
#: Scripts that don't space words, by code points, and the letters of the longest run that counts as a word.
UNSPACED, WORD = r"\\u0E00-\\u0EFF\\u1000-\\u109F\\u1780-\\u17FF\\u3040-\\u30FF\\u3400-\\u9FFF\\uF900-\\uFAFF\\x{20000}-\\x{3FFFF}", 24
PIECE = rf"\\s*(?:[\\S&&[^{UNSPACED}]]{{1,{WORD}}}+(?![\\S&&[^{UNSPACED}]])|\\S)"
#: The low bits of a packed value hold a place in the text, the rest a hash; Spark's arrays have fewer than 2**28 values.
PLACE_BITS = 28
#: Adjacent ids in one bucket of the succession, about; more if there would be more than so many buckets.
BUCKET_ROWS, MOST_BUCKETS = 2000, 1 << 17
#: Ids of the sample that bounds a bucket; it moves bounds, no rows.
SAMPLE_IDS = 20
#: At most so many ids are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_PLACE, _HASH = (1 << PLACE_BITS) - 1, -(1 << PLACE_BITS)
#: Where each slot's order begins on the circle of 64-bit values: multiples of the golden ratio.
STARTS = [((i + 1) * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63) for i in range(SLOTS)]


def below(sorted_array: str, x: str, powers: str) -> str:
    """SQL: how many values of a sorted array are less than x, by binary search; ``powers`` has descending powers of two up to its size."""
    return f"aggregate({powers}, 0, (m, b) -> if(m + b <= size({sorted_array}) and {sorted_array}[m + b - 1] < {x}, m + b, m))"


def powers(n: int) -> str:
    return f"array({', '.join(str(1 << i) for i in reversed(range(n)))})"


def numbered(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: the sorted hashes of a text's (k-mer, occurrence) pairs, each with its place in the low bits.

    Equal k-mers lie next to each other in a first sorted array, by place; a binary
    search finds how many of them come before one. A text of fewer than three pieces
    has one k-mer, the whole; an empty one has a value of its own.
    """
    keep = df.columns
    df = df.withColumn("_t", F.expr(f"regexp_extract_all({text}, '{PIECE}', 0)"))
    grams = ", ".join(f"_t[i + {j}]" for j in range(KMER))
    packed = f"""case when size(_t) >= {KMER} then transform(sequence(0, size(_t) - {KMER}), i -> (xxhash64({grams}) & {_HASH}L) | cast(i as bigint))
                 when size(_t) > 0 then array(xxhash64(array_join(_t, '|')) & {_HASH}L) else array(0L) end"""
    df = df.select(*keep, F.expr(f"sort_array({packed})").alias("_s"))
    df = df.withColumn("_b", F.expr(f"filter({powers(PLACE_BITS)}, b -> b < size(_s))"))
    same = f"j >= {{0}} and (_s[j - ({{0}})] & {_HASH}L) = (x & {_HASH}L)"
    before = f"if({same.format('1')}, aggregate(_b, 0, (m, b) -> if({same.format('m + b')}, m + b, m)), 0)"
    items = f"transform(_s, (x, j) -> (xxhash64(x & {_HASH}L, {before}) & {_HASH}L) | (x & {_PLACE}L))"
    return df.select(*keep, F.expr(f"sort_array({items})").alias(name))


def signed(df: DataFrame, hashes: str, name: str) -> DataFrame:
    """Replaces the sorted array ``hashes`` by ``name``, an array of SLOTS values."""
    keep = [c for c in df.columns if c != hashes]
    df = df.select(*keep, F.col(hashes).alias("_n"), F.expr(f"filter({powers(PLACE_BITS + 1)}, b -> b <= size({hashes}))").alias("_b"))
    starts = f"array({', '.join(f'{x}L' if x > -(1 << 63) else f'({x + 1}L)' for x in STARTS)})"
    first = f"transform({starts}, s -> {below('_n', 's', '_b')} % size(_n))"
    two = f"transform({first}, i -> struct(_n[i] as a, _n[(i + 1) % size(_n)] as b))"
    pair = f"xxhash64({{0}} & {_HASH}L, {{1}} & {_HASH}L) & 4294967295L"
    return df.select(*keep, F.expr(f"transform({two}, v -> if(v.a & {_PLACE}L <= v.b & {_PLACE}L, {pair.format('v.a', 'v.b')}, {pair.format('v.b', 'v.a')}))").alias(name))


def sampled(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """A row (k, p) for each k-mer of each row: the hash with its occurrence number, and its place."""
    items = f"inline(transform(_items, x -> struct(x & {_HASH}L as k, x & {_PLACE}L as p)))"
    return numbered(df.select(*keep, F.col(text)), text, "_items").select(*keep, F.expr(items))


def slots(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and ``sig``, an array of SLOTS values, from the rows of sampled(); keys must tell rows apart."""
    return signed(df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.expr("k | p"))).alias("_items")), "_items", "sig")


def hexed(sig: str) -> F.Column:
    return F.lower(F.concat(*(F.lpad(F.hex(F.col(sig)[i]), 8, "0") for i in range(SLOTS))))


def likeness(a: str, b: str) -> F.Column:
    return F.expr("(" + " + ".join(f"if({a}[{i}] = {b}[{i}], 1, 0)" for i in range(SLOTS)) + f") / {float(SLOTS)}D")


def buckets(base: DataFrame) -> tuple[DataFrame, int | None]:
    """``base`` with ``bucket``, which rises with doc_id, and the smallest id.

    Bounds are quantiles of a sample of the ids by hash, so buckets have about the same
    number of rows wherever the ids lie. Rows without an id are spread by their text.
    """
    low, n = base.agg(F.min("doc_id"), F.count("doc_id")).first()
    count = min(MOST_BUCKETS, -(-n // BUCKET_ROWS))
    cuts: list[int] = []
    if count > 1:
        share = min(1.0, SAMPLE_IDS * count / n)
        some = base.where(F.expr(f"doc_id is not null and (xxhash64(doc_id) & 2147483647) <= {int(share * 2147483647)}"))
        shares = ",".join(str(i / count) for i in range(1, count))
        quantiles = f"percentile_approx(doc_id, cast(split('{shares}', ',') as array<double>), {max(10_000, SAMPLE_IDS * count)})"
        cuts = sorted(set(some.agg(F.expr(quantiles)).first()[0] or []))
    place = "0"
    if cuts:
        array = f"cast(split('{','.join(map(str, cuts))}', ',') as array<bigint>)"
        place = f"aggregate({powers(len(cuts).bit_length())}, 0, (m, b) -> if(m + b <= {len(cuts)} and {array}[least(m + b, {len(cuts)}) - 1] <= doc_id, m + b, m))"
    return base.withColumn("bucket", F.expr(f"if(doc_id is null, -1 - cast(pmod(xxhash64(text), 4096) as int), {place})")), low


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last quarter of code points (rounded down) replaced by the
    first as many of the next document's, in ascending order of id and text; the first
    follows the last. A null text is empty; empty texts have a fingerprint of their own.
    Texts count whole; one text's k-mers are in memory at once. A row without an id has no
    place in the order: the first document is its next. Rows that repeat follow one
    another. Other columns, whatever their names, aren't read; an empty table gives an
    empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base, low = buckets(base)

    # The first document of the bucket that follows each bucket: one row for some BUCKET_ROWS documents.
    firsts = base.where("doc_id is not null").groupBy("bucket").agg(F.min("doc_id").alias("first"))
    firsts = stage(firsts.withColumn("next_first", F.lead("first").over(Window.orderBy("bucket"))).withColumn("next_first", F.coalesce("next_first", F.lit(low))), "firsts")
    ids = firsts.select(F.col("next_first").alias("doc_id"))
    ids = F.broadcast(ids) if firsts.count() <= BROADCAST_IDS else ids
    heads = base.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("next_text"))
    heads = stage(signed(numbered(heads, "next_text", "_n"), "_n", "next_sig"), "heads")
    bounds = firsts.join(heads, F.col("next_first") == F.col("doc_id")).select("bucket", "next_text", "next_sig")
    one = stage(heads.where(F.col("doc_id") == F.lit(low)).select(F.col("next_text").alias("one_text"), F.col("next_sig").alias("one_sig")).limit(1), "one")

    order = Window.partitionBy("bucket").orderBy("doc_id", "text")
    rows = base.withColumns({"rn": F.row_number().over(order), "after": F.lead("text").over(order)})
    rows = follow(rows.withColumn("last", F.expr("after is null or doc_id is null")), bounds.select("bucket", F.col("next_text").alias("found")), one.select(F.col("one_text").alias("found")))
    quarter = "cast(length(text) div 4 as int)"
    rows = rows.withColumn("follower", F.expr("if(last, coalesce(found, ''), after)"))
    rows = rows.select("bucket", "rn", "doc_id", "last", "text", F.expr("cast(length(text) as bigint)").alias("n_chars"), F.expr(f"concat(substring(text, 1, length(text) - {quarter}), substring(follower, 1, {quarter}))").alias("edited"))
    rows = signed(numbered(rows, "text", "_n"), "_n", "sig").drop("text")
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = signed(numbered(rows, "edited", "_n"), "_n", "edited_sig").drop("edited")
    rows = rows.withColumn("after", F.lead("sig").over(Window.partitionBy("bucket").orderBy("rn")))
    rows = follow(rows, bounds.select("bucket", F.col("next_sig").alias("found")), one.select(F.col("one_sig").alias("found")))
    rows = rows.withColumn("follower", F.expr("if(last, coalesce(found, sig), after)"))
    return rows.select("doc_id", "n_chars", "edited_sha256", hexed("sig").alias("fingerprint"), hexed("edited_sig").alias("edited_fingerprint"), likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "follower").alias("near_next"))


def follow(rows: DataFrame, bounds: DataFrame, one: DataFrame) -> DataFrame:
    """Adds ``found``: what follows the row's bucket, or the whole order's first for a row without an id.

    ``rows`` keeps its partitioning by bucket; ``one`` has at most one row.
    """
    first = one.limit(1).select(F.col("found").alias("first_found"))
    rows = rows.join(bounds, "bucket", "left").join(F.broadcast(first), F.lit(True), "left")
    return rows.withColumn("found", F.expr("if(doc_id is null, first_found, found)")).drop("first_found")


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text of ``documents`` and of its edited text."""
    return fingerprints(table(spark, sf_dir, "documents"))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of the fingerprints: the edited texts' hashes."""
    return op2_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")
