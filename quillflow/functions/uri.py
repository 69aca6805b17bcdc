"""URIs of sources and targets: ``scheme://host/path?query#fragment`` or ``scheme:path``, on the driver and as columns."""

from __future__ import annotations

import string
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = frozenset(string.ascii_letters)
SCHEME_LETTERS = LETTERS | frozenset(string.digits + "+-.")


@dataclass(frozen=True)
class ParsedUri:
    scheme: str
    host: str
    path: str
    query: dict[str, str]
    fragment: str
    raw: str

    def file_path(self) -> str:
        """Host and path together, for schemes that name files."""
        return self.host + self.path


def parse_query(text: str | None) -> dict[str, str]:
    """Percent-decoded parameters; a value keeps what follows its first ``=``, an empty key is dropped."""
    pairs = (p.partition("=") for p in (text or "").split("&"))
    return {unquote(k): unquote(v) for k, _, v in pairs if k}


def cut_uri(raw: str) -> tuple[str, str, str, str, str] | None:
    """(scheme, host, path, query, fragment), cut at the first ``#``, then ``?``, then ``:``; None without a scheme.

    After ``//`` the host goes up to the next slash; a host ``.`` or ``..`` belongs to the path.
    """
    address, _, fragment = raw.partition("#")
    address, _, query = address.partition("?")
    scheme, colon, path = address.partition(":")
    if not colon or scheme[:1] not in LETTERS or not SCHEME_LETTERS.issuperset(scheme):
        return None
    host = ""
    if path.startswith("//"):
        end = path.find("/", 2)
        host, path = (path[2:], "") if end < 0 else (path[2:end], path[end:])
        if host and not host.strip(".") and len(host) <= 2:
            host, path = "", host + path
    return scheme, host, path, query, fragment


def parse_uri(raw: str) -> ParsedUri:
    """Raises ValueError for what has no scheme."""
    parts = cut_uri(raw)
    if parts is None:
        raise ValueError(f"{raw!r} doesn't begin with a scheme")
    scheme, host, path, query, fragment = parts
    return ParsedUri(scheme, host, path, parse_query(query), fragment, raw)


def _before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def _after(text: Column, mark: str) -> Column:
    return F.substr(text, F.length(_before(text, mark)) + F.lit(len(mark) + 1))


def uri_struct(uri: Column) -> Column:
    """scheme, host, path and query string as a struct, cut like cut_uri(); empty strings where the URI has no such part, or no scheme."""
    whole = _before(uri, "#")
    address = _before(whole, "?")
    scheme, rest = _before(address, ":"), _after(address, ":")
    deep = F.startswith(rest, F.lit("//"))
    named = F.when(deep, _before(F.substr(rest, F.lit(3)), "/")).otherwise("")
    below = F.when(deep, F.substr(rest, F.length(named) + 3)).otherwise(rest)
    dots = named.isin(".", "..")
    host, path = F.when(dots, "").otherwise(named), F.when(dots, F.concat(named, below)).otherwise(below)
    bad = ~(F.contains(address, F.lit(":")) & F.rlike(scheme, F.lit(r"\A[A-Za-z][A-Za-z0-9+.\-]*\z")))
    parts = {"scheme": scheme, "host": host, "path": path, "query": _after(whole, "?")}
    return F.struct(*(F.when(bad, "").otherwise(c).alias(n) for n, c in parts.items()))


def uri_fragment(uri: Column) -> Column:
    return _after(uri, "#")


def query_params(query: Column) -> Column:
    """An array of (key, value) for ``a=1&b=2``; empty keys are dropped, a missing value is empty."""
    pairs = F.transform(F.split(query, "&"), lambda p: F.struct(F.element_at(F.split(p, "=", 2), 1).alias("key"), F.coalesce(F.try_element_at(F.split(p, "=", 2), F.lit(2)), F.lit("")).alias("value")))
    return F.filter(pairs, lambda p: p["key"] != "")
