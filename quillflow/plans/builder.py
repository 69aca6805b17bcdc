"""The fluent builder: a pipeline is a list of steps that a runner folds into one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame

from quillflow.model import ON_ERROR, Policy, Retry
from quillflow.operators.tools import Tool


@dataclass(frozen=True)
class Step:
    type: str
    config: dict[str, Any]

    def step_id(self, ordinal: int) -> str:
        """The same in every run: ``<ordinal>-<type>-<name>``."""
        return f"{ordinal}-{self.type}-{self.config.get('name') or self.type}"


@dataclass(frozen=True)
class Pipeline:
    id: str
    steps: tuple[Step, ...] = ()
    policy: Policy = field(default_factory=Policy)


def _policy(retry: Retry | dict | None, on_error: str | None) -> Policy:
    if on_error is not None and on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {', '.join(ON_ERROR)}")
    return Policy(Retry.of(retry), on_error)


@dataclass(frozen=True)
class PipelineBuilder:
    """Every method returns a new builder; to() or build() ends it."""

    pipeline: Pipeline

    def _with(self, kind: str, **config: Any) -> PipelineBuilder:
        p = self.pipeline
        return PipelineBuilder(Pipeline(p.id, (*p.steps, Step(kind, config)), p.policy))

    def from_(self, source: str | DataFrame | Any, *order: str) -> PipelineBuilder:
        """A URI, a source object or a DataFrame with its order columns; a second one replaces the stream."""
        return self._with("source", source=source, order=order, name=source if isinstance(source, str) else type(source).__name__)

    def use(self, tool: Tool, *, retry: Retry | dict | None = None, on_error: str | None = None) -> PipelineBuilder:
        return self._with("tool", tool=tool, policy=_policy(retry, on_error), name=tool.name)

    def flat_map(self, items: Callable[[Column], Column]) -> PipelineBuilder:
        """``items`` makes an array of the item column; each element becomes an item."""
        return self._with("flatmap", items=items)

    def batch(self, n: int) -> PipelineBuilder:
        return self._with("batch", n=n)

    def window(self, n: int, *, step: int = 1, partial: bool = False) -> PipelineBuilder:
        return self._with("window", n=n, step=step, partial=partial)

    def fork(self, sub: Pipeline) -> PipelineBuilder:
        return self._with("fork", sub=sub, name=sub.id)

    def tap(self, *metrics: Column, effect: Callable[[dict], None] | None = None, name: str = "tap") -> PipelineBuilder:
        """Metrics are observed once by the run; an effect is called with each row."""
        return self._with("tap", metrics=metrics, effect=effect, name=name)

    def to(self, target: str | Any) -> Pipeline:
        if not any(s.type == "source" for s in self.pipeline.steps):
            raise ValueError("a target needs a source")
        return self._with("target", target=target, name=target if isinstance(target, str) else type(target).__name__).pipeline

    def build(self) -> Pipeline:
        return self.pipeline


def pipeline(id: str, *, retry: Retry | dict | None = None, on_error: str | None = None) -> PipelineBuilder:
    return PipelineBuilder(Pipeline(id, (), _policy(retry, on_error)))
