"""Tools map the item of each row. Column tools stay in the JVM; the others run in Arrow batches on the workers.

A worker tool retries row by row. What happens to a row that still fails is the
policy's choice: the run fails, or the row carries an ``_error`` that later steps drop
or write to the dead letters.
"""

from __future__ import annotations

import json
import os
import queue
import subprocess
import threading
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillflow.functions.retry import with_retry
from quillflow.model import DEFAULT_POLICY, ERROR, Policy

ERROR_COLUMN = "_error"


class ToolError(RuntimeError):
    """A tool failed and its policy is to fail the run."""


@dataclass(frozen=True)
class ColumnTool:
    """A Column expression of the item: optimised and compiled by Spark, the first choice.

    ``accepts`` is a condition of the item; where it isn't true, the row is at fault and
    the expression isn't evaluated.
    """

    name: str
    version: str
    expression: Callable[[Column], Column]
    cacheable: bool = False
    accepts: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class PandasTool:
    """A function from a pandas Series of items to one of results.

    Under a policy other than fail-run, or with retries, a batch that fails is tried
    again row by row, to find the rows at fault.
    """

    name: str
    version: str
    function: Callable
    returns: str
    cacheable: bool = False


@dataclass(frozen=True)
class RowTool:
    """A Python function of one item, with retries and error capture per row."""

    name: str
    version: str
    function: Callable[[Any], Any]
    returns: str
    cacheable: bool = False


@dataclass(frozen=True)
class ProcessTool:
    """A program that reads a JSON line per item and writes one per result.

    ``mode`` "stream" starts one process for each Arrow batch, "once" one for each item.
    Lines are ``{"seq": n, "item": ...}``; a result may be in any order and names its
    seq. A missing or doubled result, a bad line, or a non-zero exit is an error.
    """

    name: str
    version: str
    command: Sequence[str]
    returns: str = "string"
    mode: str = "stream"
    timeout_s: float | None = None
    env: dict[str, str] = field(default_factory=dict)
    cacheable: bool = False


Tool = ColumnTool | PandasTool | RowTool | ProcessTool


def _type(ddl: str) -> T.DataType:
    return T._parse_datatype_string(ddl)


def _once(tool: ProcessTool, item: Any) -> Any:
    line = json.dumps({"seq": 0, "item": item}, default=str) + "\n"
    done = subprocess.run(list(tool.command), input=line, capture_output=True, text=True, timeout=tool.timeout_s, env=os.environ | tool.env)
    if done.returncode:
        raise RuntimeError(f"{tool.name} ended with {done.returncode}: {done.stderr[-500:]}")
    out = json.loads(done.stdout)
    return out["item"] if isinstance(out, dict) and "item" in out else out


def _streamed(tool: ProcessTool, items: list[Any]) -> list[Any]:
    """Results of all items from one process, by seq."""
    run = subprocess.Popen(list(tool.command), stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, env=os.environ | tool.env)
    said: queue.Queue[str] = queue.Queue()

    def feed() -> None:
        try:
            for i, x in enumerate(items):
                run.stdin.write(json.dumps({"seq": i, "item": x}, default=str) + "\n")
            run.stdin.close()
        except OSError:
            pass  # the exit code tells

    threads = [threading.Thread(target=feed, daemon=True), threading.Thread(target=lambda: said.put(run.stderr.read()), daemon=True)]
    for t in threads:
        t.start()
    clock = threading.Timer(tool.timeout_s, run.kill) if tool.timeout_s else None
    if clock:
        clock.start()
    out: dict[int, Any] = {}
    try:
        for line in run.stdout:
            if line.strip():
                row = json.loads(line)
                if row["seq"] in out or not 0 <= row["seq"] < len(items):
                    raise RuntimeError(f"{tool.name} answered {row['seq']} twice or unasked")
                out[row["seq"]] = row["item"]
    except BaseException:
        run.kill()
        raise
    finally:
        code = run.wait()
        if clock:
            clock.cancel()
    if code:
        raise RuntimeError(f"{tool.name} ended with {code}: {said.get()[-500:]}")
    if len(out) != len(items):
        raise RuntimeError(f"{tool.name} left {len(items) - len(out)} items unanswered")
    return [out[i] for i in range(len(items))]


def _series(tool: PandasTool, batch: pa.RecordBatch, kind: pa.DataType, place: int) -> list[Any]:
    """Results of a batch's items from one call."""
    out = tool.function(batch.column(place).to_pandas())
    if len(out) != batch.num_rows:
        raise RuntimeError(f"{tool.name} gave {len(out)} results for {batch.num_rows} items")
    return pa.Array.from_pandas(out, type=kind).to_pylist()


def apply_tool(df: DataFrame, tool: Tool, policy: Policy | None = None, *, item: str = "item") -> DataFrame:
    """``df`` with the tool's result as column ``item``; with a policy other than fail-run also ``_error`` (null if well).

    A column tool's row is at fault where the tool doesn't accept it; what its expression
    raises fails the run.
    """
    policy = (policy or Policy()).over(DEFAULT_POLICY)
    captured = policy.on_error != "fail-run"
    columns = [c for c in df.columns if c != ERROR_COLUMN]
    if isinstance(tool, ColumnTool):
        value, error = tool.expression(F.col(item)), F.lit(None).cast(ERROR)
        if tool.accepts is not None:
            fine, said = F.coalesce(tool.accepts(F.col(item)), F.lit(False)), F.lit(f"{tool.name} doesn't accept the item")
            error = F.when(~fine, F.struct(F.lit("Refused").alias("name"), said.alias("message")).cast(ERROR))
            value = F.when(fine, value) if captured else F.when(fine, value).otherwise(F.raise_error(said))
        out = [value.alias(c) if c == item else F.col(c) for c in columns]
        return df.select(*out, error.alias(ERROR_COLUMN)) if captured else df.select(*out)
    if isinstance(tool, PandasTool) and not captured and not policy.retry.max:
        return df.select(*(F.pandas_udf(tool.function, tool.returns)(F.col(item)).alias(c) if c == item else c for c in columns))
    df = df.select(*columns)
    place, kind = columns.index(item), _type(tool.returns)
    schema = T.StructType([T.StructField(f.name, kind) if f.name == item else f for f in df.schema] + ([T.StructField(ERROR_COLUMN, ERROR)] if captured else []))
    arrow, error_type = to_arrow_type(kind), to_arrow_type(ERROR)
    all_at_once = isinstance(tool, PandasTool) or isinstance(tool, ProcessTool) and tool.mode == "stream"
    one = tool.function if isinstance(tool, RowTool) else lambda x: _once(tool, x)

    def shaped(result: Any) -> Any:
        """The result, if it has the declared type; its row is at fault else."""
        pa.scalar(result, arrow)
        return result

    def attempt(call: Callable[[], Any]) -> tuple[Any, dict | None]:
        try:
            return with_retry(call, policy.retry)[0], None
        except Exception as e:
            if not captured:
                raise ToolError(f"{tool.name}: {type(e).__name__}: {e}") from e
            return None, {"name": type(e).__name__, "message": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(place).to_pylist()
            if all_at_once:
                many = (lambda part: _series(tool, part, arrow, place)) if isinstance(tool, PandasTool) else (lambda part: _streamed(tool, part.column(place).to_pylist()))
                results, failed = attempt(lambda batch=batch: list(map(shaped, many(batch))))
                found = [(None, failed)] * len(items) if failed else [(r, None) for r in results]
                if failed and len(items) > 1:  # find the rows that are at fault
                    found = [(r[0] if r else None, e) for r, e in (attempt(lambda i=i, batch=batch: list(map(shaped, many(batch.slice(i, 1))))) for i in range(len(items)))]
            else:
                found = [attempt(lambda x=x: shaped(one(x))) for x in items]
            cols = [pa.array([r for r, _ in found], arrow) if i == place else c for i, c in enumerate(batch.columns)]
            if captured:
                cols.append(pa.array([e for _, e in found], error_type))
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema])

    return df.mapInArrow(run, schema)


def split_errors(staged: DataFrame, step_id: str) -> tuple[DataFrame, DataFrame]:
    """(rows without an error, dead letters); ``staged`` must have been written once, or its tool runs twice."""
    good = staged.where(F.col(ERROR_COLUMN).isNull()).drop(ERROR_COLUMN)
    rest = [c for c in staged.columns if c != ERROR_COLUMN]
    dead = staged.where(F.col(ERROR_COLUMN).isNotNull()).select(F.current_timestamp().alias("timestamp"), F.to_json(F.struct(*rest)).alias("envelope"), F.col(ERROR_COLUMN).alias("error"), F.lit(step_id).alias("step_id"))
    return good, dead
