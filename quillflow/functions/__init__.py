"""Scalar functions: URI parts, backoff, content keys."""

from quillflow.functions.keys import canonical, content_key, driver_key
from quillflow.functions.retry import backoff, backoff_column, with_retry
from quillflow.functions.uri import ParsedUri, parse_query, parse_uri, query_params, uri_fragment, uri_struct

__all__ = ["ParsedUri", "backoff", "backoff_column", "canonical", "content_key", "driver_key", "parse_query", "parse_uri", "query_params", "uri_fragment", "uri_struct", "with_retry"]
