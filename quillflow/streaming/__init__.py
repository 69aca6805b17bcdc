"""Long-lived input: records pushed over HTTP, landed as files and read by Structured Streaming."""

from quillflow.streaming.http import HttpReceiver, HttpSource, HttpTarget
from quillflow.streaming.micro import landed_stream, run_stream, stateful_batches

__all__ = ["HttpReceiver", "HttpSource", "HttpTarget", "landed_stream", "run_stream", "stateful_batches"]
