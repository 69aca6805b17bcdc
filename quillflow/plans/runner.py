"""Runs a pipeline: folds its steps into a lazy plan, stages what must run once, keeps state for pause and resume."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow import fs
from quillflow.model import DEFAULT_POLICY, META, Policy
from quillflow.operators.counts import batch, sliding
from quillflow.operators.memo import Memo
from quillflow.operators.rows import flat_map, tap, tap_each
from quillflow.operators.tools import ColumnTool, apply_tool, split_errors
from quillflow.plans.builder import Pipeline, Step
from quillflow.plans.checkpoint import CheckpointTree
from quillflow.plans.state import StateMachine
from quillflow.sources import Registry, Stream, default_registry


LEVELS = ("debug", "info", "warn", "error")


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


@dataclass
class Runner:
    """Runs under ``root/runs/<run id>``: state.json, run.log, staged steps and dead letters; memo under ``root/memo``.

    A tool that runs on workers is staged: its result is written once, so two sinks, a
    retry of the run, or a resume never call it again. ``stage_all`` stages every step.
    ``pause_when`` is asked before each step. The log has lines of ``log_level`` and above.
    """

    spark: SparkSession
    root: str = ".quillflow"
    registry: Registry = field(default_factory=default_registry)
    policy: Policy = DEFAULT_POLICY
    concurrency: int | None = None
    stage_all: bool = False
    log_level: str = "info"
    pause_when: Callable[[str], bool] = lambda step_id: False
    metrics: dict[str, dict] = field(default_factory=dict)

    def start(self, pipeline: Pipeline, run_id: str | None = None) -> str:
        self.run_id = run_id or str(uuid.uuid4())
        self.machine, self.tree, self.started = StateMachine(), CheckpointTree(pipeline.id), now()
        self._save(pipeline)
        self.machine.move("running")
        return self._execute(pipeline)

    def resume(self, run_id: str, pipeline: Pipeline) -> str:
        """Go on after the last step whose result is stored. A finished run is left as it is."""
        raw = fs.read_text(self.spark, f"{self.root}/runs/{run_id}/state.json")
        if raw is None:
            raise LookupError(f"no run {run_id}")
        said = json.loads(raw)
        self.run_id, self.started = run_id, said["startedAt"]
        self.tree = CheckpointTree.from_json(json.dumps(said["checkpoint"]))
        self.machine = StateMachine(said["state"])
        if said["state"] == "done":
            return run_id
        if said["state"] == "failed":
            self.machine.reset("paused")
        elif said["state"] in ("running", "pending", "checkpoint", "resumed"):  # the driver was lost
            self.machine.reset("paused")
        self.machine.move("resumed")
        self.machine.move("running")
        return self._execute(pipeline)

    def _dir(self) -> str:
        return f"{self.root}/runs/{self.run_id}"

    def _save(self, pipeline: Pipeline, error: str | None = None) -> None:
        data = {"runId": self.run_id, "pipelineId": pipeline.id, "state": self.machine.state, "startedAt": self.started, "updatedAt": now(), "error": error, "checkpoint": json.loads(self.tree.to_json())}
        fs.write_text(self.spark, f"{self._dir()}/state.json", json.dumps(data, indent=1))
        self._log("error" if error else "info", self.machine.state + (f" {error}" if error else ""))

    def _execute(self, pipeline: Pipeline) -> str:
        self._save(pipeline)
        try:
            paused = not self._steps(pipeline, None, None)
        except Exception as e:
            self.machine.move("failed")
            if (node := self.tree.first_open()) is not None:
                for n, _ in self.tree.walk():
                    if n.state == "in-progress":
                        n.state, n.error = "failed", f"{type(e).__name__}: {e}"[:2000]
                node.error = node.error or f"{type(e).__name__}: {e}"[:2000]
            self._save(pipeline, f"{type(e).__name__}: {e}"[:2000])
            raise
        self.machine.move("paused" if paused else "done")
        if not paused:
            self.tree.root.state = "done"
        self._save(pipeline)
        return self.run_id

    def _steps(self, p: Pipeline, stream: Stream | None, parent: str | None) -> bool | Stream:
        """All steps of the pipeline; False if paused. A forked pipeline gives its stream."""
        ids = [(f"{parent}/" if parent else "") + s.step_id(i) for i, s in enumerate(p.steps)]
        for i in ids:
            self.tree.add(i, parent)
        begin = 0
        for i in range(len(ids) - 1, -1, -1):
            node = self.tree.find(ids[i])
            if node.state == "done" and node.path and parent is None:
                order = tuple(json.loads(node.cursor or '["seq"]'))
                stream, begin = Stream(self.spark.read.parquet(node.path), order), i + 1
                break
        wrote = False
        for i in range(begin, len(ids)):
            step, node = p.steps[i], self.tree.find(ids[i])
            if node.state == "done" and step.type == "target":
                wrote = True
                continue
            if parent is None and self.pause_when(ids[i]):
                return False
            node.state = "in-progress"
            self._log("debug", f"step {ids[i]}")
            if stream is None and step.type != "source":
                stream = Stream(self.spark.createDataFrame([(0,)], "seq long").select("seq", F.struct().alias("item"), F.lit(None).cast(META).alias("meta")))
            if step.type == "target":
                target = step.config["target"]
                (self.registry.target(target) if isinstance(target, str) else target).write(stream.df)
                wrote, node.state = True, "done"
                self._metrics()
            else:
                stream = self._one(step, ids[i], stream, p)
                must = step.type == "tool" and not isinstance(step.config["tool"], ColumnTool)
                if parent is None and (self.stage_all or must) and not node.path:
                    node.path = f"{self._dir()}/steps/{i:03d}-{step.type}"
                    fs.delete(self.spark, node.path)  # of an attempt that was cut short
                    stream.df.write.parquet(node.path)
                    stream = Stream(self.spark.read.parquet(node.path), stream.order)
                if node.path:
                    node.cursor = json.dumps(list(stream.order))
                # a step that isn't stored is lazy: it is done when something after it is
                node.state = "done" if node.path or parent else "in-progress"
            if node.state == "done":
                for j in ids[: i + 1]:
                    self.tree.find(j).state = "done"
                if parent is None:
                    self._save(p)
        if parent:
            return stream
        if not wrote and stream is not None:
            stream.df.write.format("noop").mode("overwrite").save()
            self._metrics()
        for j in ids:
            self.tree.find(j).state = "done"
        return True

    def _metrics(self) -> None:
        for name, seen in getattr(self, "_seen", {}).items():
            self.metrics[name] = seen.get
        self._seen = {}

    def _one(self, step: Step, step_id: str, stream: Stream, p: Pipeline) -> Stream:
        c = step.config
        if step.type == "source":
            source = c["source"]
            if isinstance(source, DataFrame):
                stream = Stream.of(source, *c["order"])
            else:
                stream = (self.registry.source(source) if isinstance(source, str) else source).read(self.spark)
                if stream.refused is not None:
                    self._bury(split_errors(stream.refused, step_id)[1], step_id)
            return Stream(stream.df.repartition(self.concurrency), stream.order) if self.concurrency else stream
        if step.type == "tool":
            return Stream(self._tool(c["tool"], c["policy"].over(p.policy).over(self.policy), step_id, stream.df), stream.order)
        if step.type == "flatmap":
            at = f"seq_{len(stream.order)}"
            df = flat_map(stream.df, c["items"](F.col("item")), position=at)
            return Stream(df.withColumn(at, F.col(at).cast("bigint")), (*stream.order, at))
        if step.type == "batch":
            rows = batch(stream.df, c["n"], *stream.order, item=F.struct("item", "meta"))
            return Stream(rows.select(F.col("batch").alias("seq"), F.col("items")[0]["item"].alias("item"), F.transform("items", lambda x: x["item"]).alias("items"), F.col("items")[0]["meta"].alias("meta")))
        if step.type == "window":
            return Stream(sliding(stream.df.drop("items"), c["n"], *stream.order, step=c["step"], partial=c["partial"]), stream.order)
        if step.type == "fork":
            sub = c["sub"]
            inner = Pipeline(sub.id, tuple(s for s in sub.steps if s.type not in ("source", "target")), sub.policy.over(p.policy))
            return self._steps(inner, stream, step_id)
        if step.type == "tap":
            df = tap_each(stream.df, c["effect"]) if c["effect"] else stream.df
            if c["metrics"]:
                df, seen = tap(df, f"{c['name']}-{uuid.uuid4().hex[:8]}", *c["metrics"])
                self.__dict__.setdefault("_seen", {})[c["name"]] = seen
            return Stream(df, stream.order)
        raise ValueError(f"unknown step {step.type}")

    def _tool(self, tool, policy: Policy, step_id: str, df: DataFrame) -> DataFrame:
        if tool.cacheable and not isinstance(tool, ColumnTool):
            memo = Memo(self.spark, f"{self.root}/memo/{tool.name}")
            return memo.apply(df, tool.name, tool.version, lambda todo: self._checked(apply_tool(todo, tool, policy), policy, step_id))
        return self._checked(apply_tool(df, tool, policy), policy, step_id)

    def _checked(self, df: DataFrame, policy: Policy, step_id: str) -> DataFrame:
        """Rows without an error; dead letters are written from the staged result, so the tool runs once."""
        if policy.on_error in (None, "fail-run"):
            return df
        path = f"{self._dir()}/attempts/{step_id.replace('/', '_')}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        good, dead = split_errors(self.spark.read.parquet(path), step_id)
        if policy.on_error == "dead-letter":
            self._bury(dead, step_id)
        return good

    def _bury(self, dead: DataFrame, step_id: str) -> None:
        """One folder of dead letters for each step, replaced by a repeated attempt."""
        dead.write.mode("overwrite").parquet(f"{self._dir()}/dead-letters/step={step_id.replace('/', '_')}")

    def _log(self, level: str, text: str) -> None:
        if LEVELS.index(level) >= LEVELS.index(self.log_level):
            fs.append_line(self.spark, f"{self._dir()}/run.log", f"{now()} {level} {text}")


def dead_letters(spark: SparkSession, root: str, run_id: str) -> DataFrame | None:
    """The dead letters of all steps of a run, or None without any."""
    path = f"{root}/runs/{run_id}/dead-letters"
    return spark.read.parquet(path).drop("step") if fs.listing(spark, path) else None


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, pipeline_id, state, started_at), the latest first."""
    rows = []
    for name in fs.listing(spark, f"{root}/runs"):
        raw = fs.read_text(spark, f"{root}/runs/{name}/state.json")
        if raw:
            d = json.loads(raw)
            rows.append((d["runId"], d["pipelineId"], d["state"], d["startedAt"]))
    return spark.createDataFrame(rows, "run_id string, pipeline_id string, state string, started_at string").orderBy(F.desc("started_at"))


def inspect_run(spark: SparkSession, root: str, run_id: str, tail: int = 5) -> str:
    """Header, checkpoint tree and the last lines of the log."""
    raw = fs.read_text(spark, f"{root}/runs/{run_id}/state.json")
    if raw is None:
        raise LookupError(f"no run {run_id}")
    d = json.loads(raw)
    tree = CheckpointTree.from_json(json.dumps(d["checkpoint"]))
    out = [f"run {run_id}", f"pipeline {d['pipelineId']}", f"state {d['state']}", f"started {d['startedAt']}", f"updated {d['updatedAt']}", ""]
    out += [f"{'  ' * depth}{n.step_id} [{n.state}]" + (f" {n.error}" if n.error else "") for n, depth in tree.walk()]
    log = (fs.read_text(spark, f"{root}/runs/{run_id}/run.log") or "").splitlines()
    return "\n".join([*out, "", *log[-tail:]])
