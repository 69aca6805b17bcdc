"""Tables that must be computed once: written to the shared folder and read again.

A staged table cuts the lineage, so a lost executor only costs the tasks it ran.
The folder is the session's ``spark.checkpoint.dir``; a local temporary folder is
used only where that is unset and the master is local, as in tests. On a cluster an
unset folder is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        key = spark.sparkContext.applicationId
        if key not in _LOCAL:
            _LOCAL[key] = "file://" + tempfile.mkdtemp(prefix="quillflow-")
        return _LOCAL[key]
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillflow/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, name)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bound the rows and bytes of the Arrow batches that go to Python workers; a longer text is a batch of its own.

    Spark reads these options of the session when a plan runs, so all operators ask for
    the same bounds, and a lower one that is set already stays.
    """
    to_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    at_most, bound = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(at_most)) <= rows:
        spark.conf.set(at_most, str(rows))
    if not 0 < to_bytes(spark.conf.get(bound)) <= to_bytes(size):
        spark.conf.set(bound, size)
