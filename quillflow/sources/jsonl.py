"""JSON lines: a source with line numbers, count batches, a resume cursor and a policy for bad lines; an append target."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillflow.functions.uri import ParsedUri
from quillflow.model import META
from quillflow.operators.counts import batch
from quillflow.sources.registry import Registry, Stream


def line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 0, value) of all physical lines, over files in path order.

    A split's rows are consecutive in their task, so a line's number is its place in the
    split and the lines of the splits before it; only a row for each split is gathered.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    splits = lines.groupBy("f", "b").agg(F.min("m").alias("low"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(splits.select("f", "b", "low", before.alias("before")), ["f", "b"]).select((F.col("before") + F.col("m") - F.col("low")).alias("line_no"), "value")


@dataclass
class JsonlSource:
    """Options of the URI: batchSize, onError (fail-run, skip-item, dead-letter), schema (DDL of the item; text without one).

    A line is either an item or an object with ``item`` and perhaps ``meta``. With
    dead-letter, malformed lines are the stream's ``refused`` rows, which a run writes to
    its dead letters.
    """

    path: str
    batch_size: int = 1
    cursor: int = 0
    on_error: str = "fail-run"
    item_schema: str | None = None
    lifecycle: str = "resumable"

    def resume(self, cursor: int) -> JsonlSource:
        """The same source from the physical line ``cursor`` on (blank lines count), without batches."""
        return JsonlSource(self.path, 1, cursor, self.on_error, self.item_schema)

    def read(self, spark: SparkSession) -> Stream:
        lines = line_numbers(spark, self.path).select(F.col("line_no").alias("seq"), F.trim("value").alias("raw"))
        if self.cursor:
            lines = lines.where(F.col("seq") >= self.cursor)
        lines = lines.where(F.trim(F.regexp_replace("raw", r"[\s\x{FEFF}]+", "")) != "")
        good = F.try_parse_json("raw").isNotNull()
        refused = None
        if self.on_error in ("skip-item", "dead-letter"):
            if self.on_error == "dead-letter":
                said = F.concat(F.lit("malformed JSON at line "), F.col("seq").cast("string"))
                error = F.struct(F.lit("MalformedLine").alias("name"), said.alias("message"))
                refused = lines.where(~good).select("seq", F.col("raw").alias("item"), error.alias("_error"))
            lines = lines.where(good)
        else:
            bad = F.concat(F.lit("malformed JSON at line "), F.col("seq").cast("string"))
            lines = lines.withColumn("raw", F.when(good, F.col("raw")).otherwise(F.raise_error(bad).cast("string")))
        wrapped = F.get_json_object("raw", "$.item")
        text = F.coalesce(wrapped, F.col("raw"))
        item = F.from_json(text, T._parse_datatype_string(self.item_schema)) if self.item_schema else text
        known = F.from_json(F.get_json_object("raw", "$.meta"), "map<string,string>")
        meta = F.when(known.isNotNull(), F.struct(*(known[n].alias(n) for n in META.names[:3]), F.map_filter(known, lambda k, _: ~k.isin(META.names[:3])).alias("extra")))
        df = lines.select("seq", item.alias("item"), meta.alias("meta"))
        if self.batch_size != 1:
            groups = batch(df, self.batch_size, "seq", item=F.struct("seq", "item", "meta"), tail="single")
            first = F.col("items")[0]
            many = F.when(F.size("items") == self.batch_size, F.transform("items", lambda x: x["item"]))
            df = groups.select(first["seq"].alias("seq"), first["item"].alias("item"), many.alias("items"), first["meta"].alias("meta"))
        return Stream(df, refused=refused)


@dataclass
class JsonlTarget:
    """Appends one JSON object for each envelope; a folder of part files."""

    path: str

    def write(self, df: DataFrame) -> None:
        columns = [c for c in ("item", "items", "meta") if c in df.columns] or df.columns
        df.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("append").text(self.path)


def register_jsonl(registry: Registry) -> None:
    def source(uri: ParsedUri) -> JsonlSource:
        q = uri.query
        size = int(q["batchSize"]) if q.get("batchSize", "").isdigit() and int(q["batchSize"]) > 0 else 1
        return JsonlSource(uri.file_path(), size, 0, q.get("onError", "fail-run"), q.get("schema"))

    registry.register_source("jsonl", source)
    registry.register_target("jsonl", lambda uri: JsonlTarget(uri.file_path()))
