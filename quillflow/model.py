"""Data model: envelopes, domain relations, policies and run records as Spark schemas and plain dataclasses."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

META = T.StructType([T.StructField(x, T.StringType()) for x in ("chapterId", "paragraphId", "lineId")] + [T.StructField("extra", T.MapType(T.StringType(), T.StringType()))])
ERROR = T.StructType([T.StructField("name", T.StringType()), T.StructField("message", T.StringType())])


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _I = T.StringType(), T.IntegerType()
BOOK = _struct(id=_S, name=_S, author=_S, year=_I, meta=T.MapType(_S, _S))
CHAPTER = _struct(id=_S, bookId=_S, url=_S, title=_S, body=_S, index=_I)
PARAGRAPH = _struct(id=_S, chapterId=_S, body=_S, index=_I)
LINE = _struct(id=_S, paragraphId=_S, text=_S, index=_I)
DEAD_LETTER = _struct(timestamp=T.TimestampType(), envelope=_S, error=ERROR, step_id=_S)
CHECKPOINT = _struct(run_id=_S, node_id=_S, parent_id=_S, ord=_I, state=_S, output_hash=_S, cursor=_S, error=_S)

#: Legal moves between run states (fixed values).
MOVES: dict[str, tuple[str, ...]] = {
    "pending": ("running",),
    "running": ("checkpoint", "done", "failed", "paused"),
    "checkpoint": ("running", "paused", "done", "failed"),
    "paused": ("resumed",),
    "resumed": ("running",),
    "done": (),
    "failed": (),
}
ON_ERROR = ("fail-run", "skip-item", "dead-letter")
STRATEGIES = ("fixed", "linear", "exp")


def envelope(item: T.DataType) -> T.StructType:
    """Schema of a stream: arrival order, item, the optional group of items, and meta."""
    return T.StructType([T.StructField("seq", T.LongType()), T.StructField("item", item), T.StructField("items", T.ArrayType(item)), T.StructField("meta", META)])


@dataclass(frozen=True)
class Retry:
    """A retry policy; fields that are None are taken from the next wider scope."""

    max: int | None = None
    backoff_ms: int | None = None
    strategy: str | None = None

    def over(self, wider: Retry) -> Retry:
        pick = lambda a, b: b if a is None else a
        return Retry(pick(self.max, wider.max), pick(self.backoff_ms, wider.backoff_ms), pick(self.strategy, wider.strategy))

    @classmethod
    def of(cls, value: Retry | Mapping | None) -> Retry:
        if value is None or isinstance(value, Retry):
            return value or cls()
        return cls(value.get("max"), value.get("backoff_ms", value.get("backoffMs")), value.get("strategy"))


@dataclass(frozen=True)
class Policy:
    """What a step does about errors."""

    retry: Retry = field(default_factory=Retry)
    on_error: str | None = None

    def over(self, wider: Policy) -> Policy:
        return Policy(self.retry.over(wider.retry), self.on_error or wider.on_error)


DEFAULT_POLICY = Policy(Retry(3, 1000, "exp"), "fail-run")
