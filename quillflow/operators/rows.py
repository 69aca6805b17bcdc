"""flat_map, tap and fork, and the split of documents into lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def flat_map(df: DataFrame, items: Column, *, item: str = "item", position: str | None = None) -> DataFrame:
    """A row for each element of the array ``items``, as column ``item``; the other columns are copied.

    A null or empty array drops the row; a group column ``items`` isn't passed on.
    """
    rest = [c for c in df.columns if c not in (item, "items", position)]
    at = position or "_position"
    out = df.select(*rest, F.posexplode(items).alias(at, item))
    return out if position else out.drop(at)


def tap(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` unchanged, and an observation that has the metrics once an action has run over it."""
    seen = Observation(name)
    return df.observe(seen, *metrics), seen


def tap_each(df: DataFrame, effect: Callable[[dict], None]) -> DataFrame:
    """``df`` unchanged; ``effect`` is called with each row on the executors, at least once if tasks are repeated."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                effect(row)
            yield batch

    return df.mapInArrow(run, df.schema)


def fork(df: DataFrame, sub: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The sub-plan's result takes the place of its input."""
    return df.transform(sub)


def domain_lines(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parent: str = "d") -> DataFrame:
    """Lines with ids, parent ids and index from the texts of documents (empty lines are kept)."""
    doc = F.concat(F.lit(parent), F.col(id_col).cast("string"))
    lines = documents.select(doc.alias("paragraphId"), F.posexplode(F.split(text_col, "\n", -1)).alias("index", "text"))
    return lines.select(F.concat("paragraphId", F.lit("-l"), F.col("index").cast("string")).alias("id"), "paragraphId", "text", "index")
