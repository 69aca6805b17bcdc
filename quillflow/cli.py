"""Command line: init, run, resume, ls, inspect, tool.

    python -m quillflow.cli run pipeline.py
"""

from __future__ import annotations

import argparse
import importlib.util
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillflow.operators.tools import apply_tool
from quillflow.plans.builder import Pipeline
from quillflow.plans.project import FILE, Project
from quillflow.plans.runner import Runner, inspect_run, list_runs

SAMPLE = '''"""A pipeline: lower-cased lines of a JSONL file."""
from pyspark.sql import functions as F

from quillflow.operators import ColumnTool
from quillflow.plans import pipeline

pipeline = (
    pipeline("sample")
    .from_("jsonl://./input.jsonl")
    .flat_map(lambda item: F.split(item, "\\n"))
    .use(ColumnTool("lower", "1.0.0", F.lower))
    .to("jsonl://./output")
)
'''


def load_module(path: str):
    spec = importlib.util.spec_from_file_location(Path(path).stem, path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def load_pipeline(path: str) -> Pipeline:
    """The module's ``pipeline``."""
    found = getattr(load_module(path), "pipeline", None)
    if not isinstance(found, Pipeline):
        raise SystemExit(f"{path} has no pipeline")
    return found


def init(folder: str) -> None:
    """Writes what isn't there yet."""
    root = Path(folder)
    for d in ("runs", "memo"):
        (root / Project.storage / d).mkdir(parents=True, exist_ok=True)
    for name, text in ((FILE, json.dumps({"project": {"name": root.resolve().name}, "defaults": {"concurrency": 4}}, indent=2)), ("pipeline.py", SAMPLE)):
        if not (root / name).exists():
            (root / name).write_text(text + "\n")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillflow")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("init").add_argument("folder", nargs="?", default=".")
    sub.add_parser("run").add_argument("file")
    p = sub.add_parser("resume")
    p.add_argument("run_id")
    p.add_argument("file")
    sub.add_parser("ls").add_argument("what", choices=["runs"], nargs="?", default="runs")
    sub.add_parser("inspect").add_argument("run_id")
    p = sub.add_parser("tool", help="apply a tool of a module to the JSON item on standard input")
    p.add_argument("file")
    p.add_argument("name")
    a = parser.parse_args(argv)
    if a.command == "init":
        init(a.folder)
        return 0
    project = Project.load()
    spark = SparkSession.builder.appName(project.name).getOrCreate()
    root = str(Path(project.storage).resolve())
    if a.command in ("run", "resume"):
        path = project.pipelines.get(a.file, a.file)
        runner = Runner(spark, root, policy=project.policy, concurrency=project.concurrency)
        print(runner.start(load_pipeline(path)) if a.command == "run" else runner.resume(a.run_id, load_pipeline(path)))
    elif a.command == "ls":
        list_runs(spark, root).show(1000, truncate=False)
    elif a.command == "inspect":
        print(inspect_run(spark, root, a.run_id))
    elif a.command == "tool":
        item = json.loads(sys.stdin.read())
        df = spark.createDataFrame([(item if isinstance(item, str) else json.dumps(item),)], "item string")
        print(apply_tool(df, getattr(load_module(a.file), a.name)).select(F.to_json(F.struct("item"))).first()[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())
