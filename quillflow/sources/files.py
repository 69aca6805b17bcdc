"""Other sources and targets: Spark's file formats, folders of whole texts, standard input and output, HTTP posts."""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.functions.uri import ParsedUri
from quillflow.model import META
from quillflow.sources.registry import Registry, Stream

FORMATS = ("parquet", "orc", "csv", "json", "text", "avro", "jdbc", "kafka")


@dataclass
class FormatSource:
    """Any of Spark's readers; ``?order=a,b`` names the columns that give the order, other parameters are the reader's."""

    format: str
    path: str
    options: dict[str, str] = field(default_factory=dict)
    lifecycle: str = "resumable"

    def read(self, spark: SparkSession) -> Stream:
        options = dict(self.options)
        order = [c for c in options.pop("order", "").split(",") if c]
        schema = options.pop("schema", None)
        reader = spark.read.format(self.format).options(**options)
        reader = reader.schema(schema) if schema else reader
        return Stream.of(reader.load(self.path) if self.path else reader.load(), *order)


@dataclass
class FormatTarget:
    """Any of Spark's writers; ``?mode=`` (append by default) and ``?partitionBy=a,b``."""

    format: str
    path: str
    options: dict[str, str] = field(default_factory=dict)

    def write(self, df: DataFrame) -> None:
        options = dict(self.options)
        mode, parts = options.pop("mode", "append"), [c for c in options.pop("partitionBy", "").split(",") if c]
        df.write.format(self.format).mode(mode).partitionBy(*parts).options(**options).save(self.path)


@dataclass
class FolderSource:
    """``fs://folder?glob=*.md``: an item (path, text) for each file, in path order."""

    path: str
    glob: str | None = None
    lifecycle: str = "resumable"

    def read(self, spark: SparkSession) -> Stream:
        files = spark.read.text(self.path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=self.glob).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        return Stream(files.select(F.col("path").alias("seq"), F.struct("path", "text").alias("item"), F.lit(None).cast(META).alias("meta")))


@dataclass
class FolderTarget:
    """``fs://folder``: items as text, in folders by ``?partitionBy=`` fields of the item."""

    path: str
    partition_by: tuple[str, ...] = ()

    def write(self, df: DataFrame) -> None:
        kind = df.schema["item"].dataType.simpleString()
        value = F.col("item") if kind == "string" else F.col("item.text") if "text:string" in kind else F.to_json("item")
        df.select(value.alias("value"), *(F.col(f"item.{c}").alias(c) for c in self.partition_by)).write.mode("append").partitionBy(*self.partition_by).text(self.path)


@dataclass
class StdinSource:
    """JSON lines of standard input, read by the driver: for small inputs."""

    lifecycle: str = "resumable"

    def read(self, spark: SparkSession) -> Stream:
        rows = [(i, x.strip()) for i, x in enumerate(sys.stdin) if x.strip()]
        return Stream(spark.createDataFrame(rows, "seq long, item string").withColumn("meta", F.lit(None).cast(META)))


@dataclass
class StdoutTarget:
    """JSON lines on standard output, a partition at a time, so the driver never holds them all."""

    def write(self, df: DataFrame) -> None:
        for row in df.select(F.to_json(F.struct(*df.columns)).alias("line")).toLocalIterator():
            sys.stdout.write(row.line + "\n")


@dataclass
class NoopTarget:
    def write(self, df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()


def register_files(registry: Registry) -> None:
    for name in FORMATS:
        registry.register_source(name, lambda u, name=name: FormatSource(name, u.file_path(), u.query))
        registry.register_target(name, lambda u, name=name: FormatTarget(name, u.file_path(), u.query))
    registry.register_source("fs", lambda u: FolderSource(u.file_path(), u.query.get("glob")))
    registry.register_target("fs", lambda u: FolderTarget(u.file_path(), tuple(c for c in u.query.get("partitionBy", "").split(",") if c)))
    registry.register_source("stdin", lambda u: StdinSource())
    registry.register_target("stdout", lambda u: StdoutTarget())
    registry.register_target("noop", lambda u: NoopTarget())
