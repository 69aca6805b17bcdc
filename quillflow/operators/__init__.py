"""Row operators as pure functions from DataFrames to DataFrames."""

from quillflow.operators.counts import batch, numbered, sliding
from quillflow.operators.memo import Memo
from quillflow.operators.rows import domain_lines, flat_map, fork, tap
from quillflow.operators.tools import ColumnTool, PandasTool, ProcessTool, RowTool, apply_tool, split_errors

__all__ = ["ColumnTool", "Memo", "PandasTool", "ProcessTool", "RowTool", "apply_tool", "batch", "domain_lines", "flat_map", "fork", "numbered", "sliding", "split_errors", "tap"]
