"""Retry with fixed, linear or exponential backoff, on the driver or in a worker, and the schedule as a column."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillflow.model import Retry

R = TypeVar("R")


def backoff(strategy: str | None, base_ms: int, attempt: int) -> int:
    """Milliseconds to wait after failed attempt 0, 1, ...; an unknown strategy is fixed."""
    return base_ms * {"linear": attempt + 1, "exp": 2**attempt}.get(strategy or "", 1)


def backoff_column(strategy: Column, base_ms: Column, attempt: Column) -> Column:
    factor = F.when(strategy == "linear", attempt + 1).when(strategy == "exp", F.pow(F.lit(2), attempt)).otherwise(1)
    return (base_ms * factor).cast("bigint")


def with_retry(call: Callable[[], R], retry: Retry, sleep: Callable[[float], None] = time.sleep) -> tuple[R, int]:
    """(result, attempts made). At most max + 1 attempts; the last error is raised, with the count as ``attempts``."""
    most = max(0, retry.max or 0)
    for attempt in range(most + 1):
        try:
            return call(), attempt + 1
        except Exception as e:
            if attempt == most:
                e.attempts = attempt + 1  # type: ignore[attr-defined]
                raise
            sleep(backoff(retry.strategy, retry.backoff_ms or 0, attempt) / 1000)
    raise AssertionError("unreachable")
