"""Registry from URI schemes to sources and targets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.functions.uri import ParsedUri, parse_uri
from quillflow.model import META


@dataclass(frozen=True)
class Stream:
    """Rows in flight: columns ``item`` and ``meta``, and perhaps ``items``, in the order of some columns.

    ``refused`` has what a source can't read, as rows with an ``_error``, for the dead letters.
    """

    df: DataFrame
    order: tuple[str, ...] = ("seq",)
    refused: DataFrame | None = None

    @classmethod
    def of(cls, df: DataFrame, *order: str) -> Stream:
        """Envelopes of a plain DataFrame: a struct of its columns as item, ordered by the columns named."""
        if "item" in df.columns:
            kept = df if "meta" in df.columns else df.withColumn("meta", F.lit(None).cast(META))
            return cls(kept, order or ("seq",))
        names = [f"seq_{i}" if i else "seq" for i in range(max(1, len(order)))]
        keys = [F.col(c) for c in order] or [F.monotonically_increasing_id()]
        return cls(df.select(*(k.alias(n) for k, n in zip(keys, names, strict=True)), F.struct(*df.columns).alias("item"), F.lit(None).cast(META).alias("meta")), tuple(names))


class Source(Protocol):
    lifecycle: str  # "resumable" or "long-lived"

    def read(self, spark: SparkSession) -> Stream: ...


class Target(Protocol):
    def write(self, df: DataFrame) -> None: ...


@dataclass
class Registry:
    sources: dict[str, Callable[[ParsedUri], Source]] = field(default_factory=dict)
    targets: dict[str, Callable[[ParsedUri], Target]] = field(default_factory=dict)
    composites: dict[str, Callable[[str], ParsedUri]] = field(default_factory=dict)

    def register_source(self, scheme: str, factory: Callable[[ParsedUri], Source]) -> None:
        self.sources[scheme] = factory

    def register_target(self, scheme: str, factory: Callable[[ParsedUri], Target]) -> None:
        self.targets[scheme] = factory

    def register_composite(self, prefix: str, resolve: Callable[[str], ParsedUri]) -> None:
        """URIs that start with the prefix are resolved by a function of their own."""
        self.composites[prefix] = resolve

    def parse(self, raw: str) -> ParsedUri:
        fitting = max((p for p in self.composites if raw.startswith(p)), key=len, default=None)
        return self.composites[fitting](raw) if fitting is not None else parse_uri(raw)

    def _make(self, kind: dict, what: str, raw: str):
        uri = self.parse(raw)
        if uri.scheme not in kind:
            raise LookupError(f"no {what} for scheme {uri.scheme!r}")
        return kind[uri.scheme](uri)

    def source(self, raw: str) -> Source:
        return self._make(self.sources, "source", raw)

    def target(self, raw: str, project: str = ".") -> Target:
        """The target of a URI; with ``?commit=on-close`` the project's folder is committed after the write."""
        made = self._make(self.targets, "target", raw)
        if self.parse(raw).query.get("commit") == "on-close":
            from quillflow.sources.commit import CommitOnClose

            return CommitOnClose(made, project)
        return made

    def has_source(self, scheme: str) -> bool:
        return scheme in self.sources

    def has_target(self, scheme: str) -> bool:
        return scheme in self.targets

    def source_schemes(self) -> list[str]:
        return sorted(self.sources)

    def target_schemes(self) -> list[str]:
        return sorted(self.targets)
