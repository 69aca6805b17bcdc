"""Content keys: SHA-256 of canonical JSON."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value: Any) -> str:
    """JSON with sorted keys and no spaces, so equal values have equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def driver_key(tool: str, version: str, value: Any, context: Any = None) -> str:
    return hashlib.sha256(canonical({"tool": tool, "version": version, "input": value, "context": context}).encode()).hexdigest()


def content_key(tool: str, version: str, *fields: Column) -> Column:
    """Hex SHA-256 of a JSON object with the tool, its version and the fields in the order given. Nulls are kept as null."""
    row = F.struct(F.lit(tool).alias("tool"), F.lit(version).alias("version"), *fields)
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)
