"""Project settings from a JSON file."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from quillflow.model import DEFAULT_POLICY, Policy, Retry

FILE = "quillflow.json"


@dataclass(frozen=True)
class Project:
    name: str = "project"
    storage: str = ".quillflow"
    concurrency: int = 4
    policy: Policy = DEFAULT_POLICY
    pipelines: dict[str, str] = field(default_factory=dict)
    env: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, raw: dict[str, Any]) -> Project:
        defaults = raw.get("defaults", {})
        policy = Policy(Retry.of(defaults.get("retry")), defaults.get("onError")).over(DEFAULT_POLICY)
        return cls(raw.get("project", {}).get("name", cls.name), raw.get("storage", {}).get("root", cls.storage), int(defaults.get("concurrency", cls.concurrency)), policy, raw.get("pipelines", {}), raw.get("env", {}))

    @classmethod
    def load(cls, folder: str | Path = ".") -> Project:
        """Defaults where there is no file; a file that can't be read is an error."""
        path = Path(folder) / FILE
        return cls.of(json.loads(path.read_text())) if path.exists() else cls()
