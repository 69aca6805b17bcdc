"""Connected components by alternating large-star and small-star steps, and joins whose hot keys are split.

Every step is a grouped minimum and a join on DataFrames; each round is staged, so
neither links nor components pass through the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.staging import forget, stage

#: A key with more rows than this is split, or than the share of all rows that at most MOST_HOT keys can have.
SPLIT_ROWS, MOST_HOT = 500, 1_000_000


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], by: str, counts: DataFrame | None = None) -> DataFrame:
    """``many.join(one, keys)`` where the rows of a hot key are dealt to several tasks by a hash of ``by``.

    ``one`` has a row for each key, which is repeated once for each part of a hot key.
    ``counts`` has the keys and their number of rows ``n``, by default counted here. Hot
    keys are broadcast: as each has more than 1 / MOST_HOT of all rows, there are fewer
    than MOST_HOT. Rows with a null key have no partner.
    """
    if counts is None:
        counts = stage(many.groupBy(*keys).agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(SPLIT_ROWS, total // MOST_HOT)
    part, parts = ("_" + uuid.uuid4().hex[:8] for _ in range(2))
    hot = counts.where(F.col("n") > least).select(*keys, F.expr(f"cast(n div {least} + 1 as int)").alias(parts))
    if hot.isEmpty():
        return many.join(one, keys)
    hot = F.broadcast(hot)
    many = many.join(hot, keys, "left").withColumn(part, F.expr(f"cast(pmod(xxhash64(`{by}`), coalesce({parts}, 1)) as int)")).drop(parts)
    one = one.join(hot, keys, "left").withColumn(part, F.expr(f"explode(sequence(0, coalesce({parts}, 1) - 1))")).drop(parts)
    return many.join(one, [*keys, part]).drop(part)


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every linked id that isn't the smallest of its component.

    ``links`` has two columns of ids; direction, repeats and self-links don't matter,
    rows with a null id are ignored. An empty input gives an empty result.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    edges = stage(edges, "links")
    while True:
        # each id's smallest neighbour, to which its larger neighbours are linked
        down = edges.groupBy("a").agg(F.min("b").alias("m"), F.lit(0).cast("long").alias("n"))
        up = edges.groupBy(F.col("b").alias("a")).agg(F.count("*").alias("n")).withColumn("m", F.col("a"))
        low = stage(down.unionByName(up).groupBy("a").agg(F.min("m").alias("m"), F.sum("n").alias("n")), "low")
        large = spread_join(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), low.select("a", "m"), ["a"], "b", low.where("n > 0"))
        large = stage(large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # and each id's smaller neighbours to the smallest of them
        few = stage(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "low")
        joined = spread_join(large, few.select("a", "m"), ["a"], "b", few)
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(few.select("a", F.col("m").alias("b")))
        after = stage(small.where("a <> b").distinct(), "stars")
        rows, sources = after.agg(F.count("*"), F.countDistinct("a")).first()
        for old in (edges, low, large, few):
            forget(old)
        edges = after
        if rows == sources and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
