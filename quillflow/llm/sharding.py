"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small Parquet shards. Compaction groups shards of a similar
size (a tier spans a factor of four) until a group has the target size, merges each
group of two or more into one file by one task, and commits a new manifest that names
the live shards. A manifest is a folder written beside its place and renamed to the next
version, which fails if that version exists, so readers see one version or the next
and of two writers one loses and tries again on what the other has committed. That
rename is atomic on HDFS; on object stores and local file systems, where renaming a
folder isn't, one process must commit at a time. Only DataFrame and SQL functions touch
the rows. The driver holds the paths that a read names: one for each run folder whose
shards are all live, else one for each live shard, as Spark's own file index does.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillflow.llm.staging import delete, new_path, stage, table

#: Rows of an arriving shard at most; bytes of a merged file; factor between the sizes of a tier.
ARRIVAL_ROWS, TARGET_BYTES, TIER_FACTOR = 5000, 64 << 20, 4
#: Manifest rows (some 200 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_SHARDS = 50_000
#: Times that a commit is tried again after another writer's, and seconds after which an unfinished writer's files may go.
TRIES, ABANDONED_SECONDS = 20, 24 * 3600
CODEC = "zstd"
COLUMNS = "path string, bytes long, rows long, generation int"


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class Overtaken(Conflict):
    """Another writer has merged the same shards, so trying again can't help."""


class ShardStore:
    """A folder with immutable shards and the manifests that name the live ones."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(x[1:]) for x in names if x.startswith("v"))

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards of a version, by default the last: path, bytes, rows, generation."""
        version = version if version is not None else (self.versions() or [0])[-1]
        if not version:
            return self.spark.createDataFrame([], COLUMNS)
        return self.spark.read.schema(COLUMNS).parquet(f"{self.root}/manifest/v{version:08d}")

    def commit(self, entries: DataFrame, version: int) -> int:
        """Make ``entries`` the given version; raises Conflict if it exists already."""
        jvm, final = self.spark._jvm, f"{self.root}/manifest/v{version:08d}"
        temp = f"{self.root}/manifest/_new-{uuid.uuid4().hex}"
        entries.coalesce(1).write.parquet(temp)
        path = jvm.org.apache.hadoop.fs.Path
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(final).toUri(), self.spark._jsc.hadoopConfiguration()).rename(path(temp), path(final), none)
        except Exception as e:
            delete(self.spark, temp)
            if version in self.versions():
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    def _begin(self) -> str:
        """The folder of a new run of shards; a mark says that its writer hasn't committed."""
        run = f"run-{uuid.uuid4().hex}"
        self._fs().mkdirs(self._path(f"pending/{run}"))
        return f"{self.root}/data/{run}"

    def _end(self, folder: str, keep: bool) -> None:
        if not keep:
            delete(self.spark, folder)
        delete(self.spark, f"{self.root}/pending/{folder.rsplit('/', 1)[1]}")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _finish(self, folder: str, change: Callable[[DataFrame], DataFrame]) -> int:
        """Commit the last manifest as changed; after another writer's commit, change that one."""
        try:
            for left in range(TRIES, -1, -1):
                version = (self.versions() or [0])[-1]
                try:
                    done = self.commit(change(self.manifest(version)), version + 1)
                    break
                except Conflict as e:
                    if not left or isinstance(e, Overtaken):
                        raise
        except BaseException:
            self._end(folder, keep=False)
            raise
        self._end(folder, keep=True)
        return done

    def _entries(self, folder: str, generation: int) -> DataFrame:
        files = self.spark.read.parquet(folder)
        of = files.metadataColumn("_metadata")
        found = files.groupBy(of["file_path"].alias("path"), of["file_size"].alias("bytes")).agg(F.count("*").alias("rows"))
        return stage(found.withColumn("generation", F.lit(generation)), "entries")

    def append(self, df: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        """Write ``df`` as new small shards and commit them beside the live ones, whoever else commits meanwhile."""
        folder = self._begin()
        df.write.option("maxRecordsPerFile", rows).option("compression", CODEC).parquet(folder)
        new = self._entries(folder, 0)
        return self._finish(folder, lambda live: live.unionByName(new))

    def _paths(self, live: DataFrame) -> list[str]:
        """The shards' paths, or that of their folder where all its files are among them."""
        runs = live.withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).groupBy("folder").agg(F.count("*").alias("n"))
        fs, whole = self._fs(), []
        for r in runs.collect():
            files = fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(r.folder)) if r.n > 1 else ()
            if r.n > 1 and sum(f.getPath().getName().endswith(".parquet") for f in files) == r.n:
                whole.append(r.folder)
        rest = live.where(~F.regexp_extract("path", "^(.*)/[^/]*$", 1).isin(whole)) if whole else live
        return whole + [r.path for r in rest.select("path").collect()]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with their shard as ``_metadata``; files that it doesn't name aren't read."""
        paths = self._paths(self.manifest(version))
        return self.spark.read.parquet(*paths) if paths else None

    def plan(self, target: int = TARGET_BYTES) -> DataFrame:
        """The shards to merge and their group: path, bytes, generation, merge_id.

        Shards below half the target are ordered within their tier; a group ends where
        the sum of sizes passes a multiple of the target. A lone shard stays as it is.
        """
        small = self.manifest().where(F.col("bytes") * 2 <= target)
        tier = small.withColumn("tier", F.floor(F.log(F.greatest("bytes", F.lit(1))) / F.log(F.lit(float(TIER_FACTOR)))))
        order = Window.partitionBy("tier").orderBy("path")
        before = F.sum("bytes").over(order) - F.col("bytes")
        tier = tier.withColumn("part", F.floor(before / target)).withColumn("n", F.count("*").over(Window.partitionBy("tier", "part"))).where("n > 1")
        return tier.select("path", "bytes", "generation", F.concat_ws("-", F.lit("t"), "tier", "part").alias("merge_id"))

    def compact(self, target: int = TARGET_BYTES) -> int:
        """One round of merges, committed as one version; the version stays if there is nothing to merge.

        One task writes one merged file, of the target size or less than twice as much.
        Raises Overtaken, and leaves nothing behind, if another writer has merged one of
        the same shards meanwhile; appended shards don't matter.
        """
        version = (self.versions() or [0])[-1]
        plan = stage(self.plan(target), "plan")
        groups, shards, oldest = plan.agg(F.countDistinct("merge_id"), F.count("*"), F.max("generation")).first()
        if not groups:
            return version
        folder = self._begin()
        rows = self.spark.read.parquet(*self._paths(plan))
        columns, merge = rows.columns, "_merge_" + uuid.uuid4().hex[:8]
        number = plan.select("merge_id").distinct().withColumn("number", F.row_number().over(Window.orderBy("merge_id")) - 1)
        to = plan.join(number, "merge_id").select(F.col("path").alias(merge + "_path"), F.col("number").alias(merge))
        to = F.broadcast(to) if shards <= BROADCAST_SHARDS else to
        rows = rows.withColumn(merge + "_path", rows.metadataColumn("_metadata")["file_path"]).join(to, merge + "_path")
        rows.repartitionById(groups, F.col(merge)).select(*columns).write.option("compression", CODEC).parquet(folder)
        made = self._entries(folder, oldest + 1)

        def change(live: DataFrame) -> DataFrame:
            if plan.join(live, "path", "left_semi").count() != shards:
                raise Overtaken("another writer has merged some of these shards")
            return live.join(plan.select("path"), "path", "left_anti").select("path", "bytes", "rows", "generation").unionByName(made)

        return self._finish(folder, change)

    def vacuum(self, abandoned_seconds: float = ABANDONED_SECONDS) -> None:
        """Delete all manifests but the last and the folders of data in which it names no shard.

        Folders of writers that haven't committed stay until they are as old as
        ``abandoned_seconds``. Data are listed before the marks of such writers and those
        before the manifest, so a writer that commits meanwhile keeps its files.
        """
        fs, now = self._fs(), time.time() * 1000
        data = [s.getPath() for s in fs.listStatus(self._path("data"))] if fs.exists(self._path("data")) else []
        marks = fs.listStatus(self._path("pending")) if fs.exists(self._path("pending")) else []
        marks = {s.getPath().getName(): now - s.getModificationTime() < abandoned_seconds * 1000 for s in marks}
        keep = self.versions()[-1:]
        live = {r.run for r in self.manifest().select(F.regexp_extract("path", "/data/(run-[0-9a-f]+)/", 1).alias("run")).distinct().collect()}
        for path in data:
            if path.getName() not in live and not marks.get(path.getName()):
                fs.delete(path, True)
                fs.delete(self._path(f"pending/{path.getName()}"), True)
        for v in self.versions():
            if keep and v < keep[0]:
                delete(self.spark, f"{self.root}/manifest/v{v:08d}")


def compacted(docs: DataFrame, root: str, *, target: int = TARGET_BYTES, rows: int = ARRIVAL_ROWS) -> ShardStore:
    """A store with the rows of ``docs``, appended as small shards and compacted until no merge is left.

    All columns of any names, nulls, empty and long texts and repeated rows are kept as
    they are; shards of the same size merge in the order of their paths. An empty table
    gives a version with no rows.
    """
    store = ShardStore(docs.sparkSession, root)
    version = store.append(docs, rows)
    while (after := store.compact(target)) != version:
        version = after
    return store


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` as read back from its shard of the committed version: doc_id, n_chars, text_sha256, shard, shard_bytes, shard_rows, generation, version."""
    docs = table(spark, sf_dir, "documents")
    store = compacted(docs, new_path(spark, "shards"))
    store.vacuum()
    live, rows = store.manifest(), store.read()
    path = F.lit("") if rows is None else rows.metadataColumn("_metadata")["file_path"]
    rows = docs if rows is None else rows
    live = F.broadcast(live) if live.count() <= BROADCAST_SHARDS else live
    out = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), path.alias("path")).join(live, "path")
    return out.select("doc_id", "n_chars", "text_sha256", F.regexp_extract("path", "/data/(.*)$", 1).alias("shard"), F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"), "generation", F.lit(store.versions()[-1]).alias("version"))


def sharding_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shards hold, without their names, which differ from run to run."""
    return op7_sharding(spark, sf_dir).select("doc_id", "n_chars", "text_sha256")
