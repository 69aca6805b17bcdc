"""Sources and targets by URI scheme."""

from quillflow.sources.files import register_files
from quillflow.sources.jsonl import JsonlSource, JsonlTarget, line_numbers, register_jsonl
from quillflow.sources.registry import Registry, Source, Stream, Target

__all__ = ["JsonlSource", "JsonlTarget", "Registry", "Source", "Stream", "Target", "default_registry", "line_numbers"]


def default_registry() -> Registry:
    """A registry with all built-in schemes."""
    from quillflow.sources.commit import register_git
    from quillflow.streaming.http import register_http

    registry = Registry()
    for register in (register_jsonl, register_files, register_git, register_http):
        register(registry)
    return registry
