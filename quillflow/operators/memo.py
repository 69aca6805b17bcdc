"""Memo table: results of tools by content key, so that known work isn't done again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow import fs
from quillflow.functions.keys import content_key

KEY = "_memo_key"


class Memo:
    """Parquet rows (key, tool, version, output, created_at) in a folder of versions; rows are appended, never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _place(self) -> str:
        """The folder of the latest version; delete() makes a new one and names it in a small file, in one step."""
        named = fs.read_text(self.spark, f"{self.path}/current")
        return f"{self.path}/{named.strip() if named else 'v0'}"

    def table(self) -> DataFrame | None:
        place = self._place()
        return self.spark.read.parquet(place) if fs.exists(self.spark, f"{place}/_SUCCESS") else None

    def clear(self) -> None:
        fs.delete(self.spark, self.path)

    def has(self, keys: DataFrame) -> DataFrame:
        """The one-column frame's keys as ``key``, with ``hit``."""
        known, keys = self.table(), keys.toDF("key")
        if known is None:
            return keys.withColumn("hit", F.lit(False))
        return keys.join(known.select("key").distinct().withColumn("hit", F.lit(True)), "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("hit"))

    def get(self, keys: DataFrame) -> DataFrame:
        """(key, output) for the known ones of the frame's keys."""
        known, keys = self.table(), keys.toDF("key").distinct()
        if known is None:
            return keys.withColumn("output", F.lit(None).cast("string")).limit(0)
        return known.select("key", "output").dropDuplicates(["key"]).join(keys, "key", "left_semi")

    def delete(self, keys: DataFrame) -> None:
        """Drop the keys of the one-column frame: the rest is a new version, and the old one stays until the new one is named."""
        if (known := self.table()) is None:
            return
        old, name = self._place(), f"v-{uuid.uuid4().hex}"
        known.join(keys.toDF("key"), "key", "left_anti").write.parquet(f"{self.path}/{name}")
        fs.write_text(self.spark, f"{self.path}/current", name)
        fs.delete(self.spark, old)

    def apply(self, df: DataFrame, tool: str, version: str, work: Callable[[DataFrame], DataFrame], *fields: Column, item: str = "item") -> DataFrame:
        """``df`` with the tool's result as ``item``; ``work`` gets one row for each key that isn't known yet.

        ``work`` maps a frame (key, item) to one with the results in ``item``; results
        that are null aren't remembered. The new results are appended before the join.
        """
        keyed = df.withColumn(KEY, content_key(tool, version, *(fields or (F.col(item).alias("item"),))))
        known = self.table()
        todo = keyed.select(F.col(KEY).alias("key"), item).dropDuplicates(["key"])
        if known is not None:
            todo = todo.join(known.select("key"), "key", "left_anti")
        made = work(todo).where(F.col(item).isNotNull())
        made = made.select("key", F.lit(tool).alias("tool"), F.lit(version).alias("version"), F.col(item).alias("output"), F.current_timestamp().alias("created_at"))
        made.write.mode("append").parquet(self._place())
        all_ = self.table().where((F.col("tool") == tool) & (F.col("version") == version)).select(F.col("key").alias(KEY), "output").dropDuplicates([KEY])
        return keyed.join(all_, KEY, "left").select(*(F.col("output").alias(c) if c == item else c for c in df.columns))
