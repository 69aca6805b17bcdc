"""Numbering in arrival order, tumbling count batches and sliding count windows, without a single-task window."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block of a sliding window; each block also reads the rows before it that its first windows need.
BLOCK_ROWS = 10_000
#: Rows for each range in the sample that cuts ranges; fewer rows than this a range aren't worth another range.
SAMPLE_ROWS, RANGE_ROWS = 20, 100_000


def numbered(df: DataFrame, *order: str, name: str = "number", parts: int | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Adds the position 1, 2, ... of each row in the order of the columns (which should have no ties).

    ``within`` starts anew for each value of those columns; nulls are one value. Rows are
    cut into ranges by all these columns, so neither a value that many rows share nor a
    key that holds most rows is one task; each range is numbered by itself and starts at
    the number of rows before it (of its key). Cuts come from a sample by hash and only
    balance the work, the numbers don't depend on them. They are found by a count and a
    pass over these columns when the plan is made; without ``parts`` a small table is one
    range. Where the first column is binary, an array, a map or a struct all is one range.
    """
    keys = [*within, *order]
    total = df.count()
    if parts is None:
        parts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS))
    plain = list(itertools.takewhile(lambda c: not isinstance(df.schema[c].dataType, (T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)), keys))
    cuts = range_cuts(df, plain, parts, total) if parts > 1 and plain else []
    # columns that tell the cuts apart; by one column, rows with a null are in the first range
    width = next((i for i in range(1, len(plain) + 1) if len({c[:i] for c in cuts}) == len(cuts)), 1)
    cuts = [c[:width] for c in cuts if width > 1 or c[0] is not None]
    if not cuts:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("bigint"))
    if width == 1:
        found, own = F.array_sort(F.lit([c[0] for c in cuts]).cast(T.ArrayType(df.schema[plain[0]].dataType))), F.col(f"`{plain[0]}`")
    else:
        kinds = ",".join(f"c{i}:{df.schema[c].dataType.simpleString()}" for i, c in enumerate(plain[:width]))
        found = F.array_sort(F.arrays_zip(*(F.lit(list(values)) for values in zip(*cuts, strict=True))).cast(f"array<struct<{kinds}>>"))
        own = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(plain[:width])))
    powers = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))
    # how many cuts lie below the row, by binary search
    ranged = df.withColumn("_range", F.aggregate(powers, F.lit(0), lambda m, b: F.when((m + b <= len(cuts)) & (F.get(found, m + b - 1) < own), m + b).otherwise(m)))
    counts = ranged.groupBy("_range", *within).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # only the first key of a range can have rows before it, so at most ``parts`` rows are broadcast
    before = counts.withColumn("_before", F.sum("_n").over(earlier)).where("_before > 0")
    before = before.select(F.col("_range").alias("_at"), *(F.col(f"`{c}`").alias(f"_key{i}") for i, c in enumerate(within)), "_before")
    same = F.col("_range") == F.col("_at")
    for i, c in enumerate(within):
        same &= F.col(f"`{c}`").eqNullSafe(F.col(f"_key{i}"))
    local = F.row_number().over(Window.partitionBy("_range", *within).orderBy(*order))
    rows = ranged.withColumn(name, local).join(F.broadcast(before), same, "left")
    return rows.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0).cast("bigint"))).select(*(c for c in df.columns if c != name), name)


def range_cuts(df: DataFrame, keys: list[str], parts: int, total: int) -> list[tuple]:
    """At most ``parts`` - 1 rows of the columns, which cut ``df`` into ranges of about the same number of rows.

    About SAMPLE_ROWS rows for each range are drawn by hash; equal ones are one row on the
    driver, with their number.
    """
    share = min(1.0, SAMPLE_ROWS * parts / max(1, total))
    some = df.select(*keys).where(F.expr(f"xxhash64({', '.join(f'`{c}`' for c in keys)}) & 2147483647") <= int(share * 2147483647))
    rows = some.groupBy(*keys).agg(F.count("*").alias("_n")).orderBy(*keys).collect()
    drawn, seen, cuts = sum(r[-1] for r in rows), 0, []
    for r in rows:
        seen += r[-1]
        if seen * parts >= drawn * (len(cuts) + 1) and len(cuts) < parts - 1:
            cuts.append(tuple(r[:-1]))
    return cuts


def batch(df: DataFrame, n: int, *order: str, item: Column | str = "item", tail: str = "short", within: list[str] | None = None) -> DataFrame:
    """Tumbling groups of n rows in order: (within..., batch, items).

    The last group is short with tail="short"; with tail="single" its rows are batches
    of one, numbered on. ``within`` starts anew for each value of those columns.
    """
    if n < 1:
        raise ValueError("n must be positive")
    value = F.col(item) if isinstance(item, str) else item
    keys = within or []
    rows = numbered(df, *order, name="_number", within=keys)
    group = F.expr(f"(_number - 1) div {n}")
    if tail == "single":
        totals = df.groupBy(*(F.col(f"`{c}`").alias(f"_key{i}") for i, c in enumerate(keys))).agg(F.count("*").alias("_total"))
        same = F.lit(True)
        for i, c in enumerate(keys):
            same &= F.col(f"`{c}`").eqNullSafe(F.col(f"_key{i}"))
        rows = rows.join(totals, same) if keys else rows.crossJoin(F.broadcast(totals))  # one row
        group = F.expr(f"if(_number <= _total - _total % {n}, (_number - 1) div {n}, _total div {n} + (_number - (_total - _total % {n})) - 1)")
    elif tail != "short":
        raise ValueError("tail must be short or single")
    rows = rows.select(*keys, group.alias("batch"), F.struct("_number", value.alias("_value")).alias("_pair"))
    pairs = F.array_sort(F.collect_list("_pair"), lambda a, b: F.signum(a["_number"] - b["_number"]).cast("int"))
    return rows.groupBy(*keys, "batch").agg(F.transform(pairs, lambda p: p["_value"]).alias("items"))


def sliding(df: DataFrame, n: int, *order: str, item: Column | str = "item", step: int = 1, partial: bool = False, within: list[str] | None = None) -> DataFrame:
    """Each row with ``items``, its own value and those of the n - 1 rows before it.

    Only full frames are kept, unless ``partial``; with a step, each step-th frame is.
    """
    if n < 1 or step < 1:
        raise ValueError("n and step must be positive")
    value = F.col(item) if isinstance(item, str) else item
    df = df.withColumn("_value", value)
    size = max(BLOCK_ROWS, n)
    rows = numbered(df, *order, name="_number", within=within or [])
    block = F.expr(f"(_number - 1) div {size}")
    halo = F.expr(f"if(pmod(_number - 1, {size}) > {size - n}, array((_number - 1) div {size}, (_number - 1) div {size} + 1), array((_number - 1) div {size}))")
    rows = rows.withColumn("_home", block).withColumn("_block", F.explode(halo)).withColumn("_own", F.col("_home") == F.col("_block"))
    frame = Window.partitionBy(*(within or []), "_block").orderBy("_number")
    rows = rows.withColumn("items", F.transform(F.collect_list(F.struct("_value")).over(frame.rowsBetween(-(n - 1), 0)), lambda p: p["_value"])).where("_own")
    if not partial:
        rows = rows.where(F.size("items") == n)
    if step > 1:
        rows = rows.where(F.expr(f"pmod(_number - {1 if partial else n}, {step}) = 0"))
    return rows.drop("_value", "_number", "_own", "_home", "_block")
