"""Secret scans: pattern matches, and candidates confirmed by their decoded structure.

Besides assignments, access key ids and hex digests, the scan decodes long base64 and
hex runs and reports them only if the bytes are a private key whose nested lengths
fit (PKCS#1, PKCS#8, SEC 1 or OpenSSH), and signed tokens only if their header and
payload decode to JSON objects and the header names an algorithm.

A key may also be spread over lines: what begins like one is joined over line ends,
their escapes, quotes and prefixes for as many bytes as its own lengths ask for (64 KB at
most), with or without an armour, its header lines and its END line. An encrypted body
can't be confirmed by its bytes; its header lines, END line and whole blocks do that.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm.staging import small_batches, table

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "armour", "key", "token")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
ARMOUR = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END [A-Z0-9 ]*PRIVATE KEY-----")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
#: What may stand between two parts of a key: a join of strings, a comment's prefix, an escape, white space, quotes.
_BETWEEN = r"""(?:["'`]\s*+[+&]\s*+(?=["'`])|(?:[\r\n]|\\++[nr])[ \t]*+(?://++|--)(?=[ \t])|\\++[nrt]|[\s"'`,;.>#*|\\])"""
_BETWEEN_HEX = rf"(?:{_BETWEEN}|\\++x|0x|:)"
_HEADERS = rf"(?:{_BETWEEN}*+[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+(?=[\r\n\\]))"
_LABEL = "[A-Z0-9 ]*PRIVATE KEY-----"
BEFORE = re.compile(rf"-----BEGIN {_LABEL}{_HEADERS}*+{_BETWEEN}*+")
AFTER = re.compile(rf"={{0,2}}{_BETWEEN}*+-----END {_LABEL}")
ENCRYPTED = re.compile(rf"-----BEGIN {_LABEL}({_HEADERS}++)((?:[A-Za-z0-9+/=]++|{_BETWEEN})++)-----END {_LABEL}")
CIPHER = re.compile(r"DEK-Info:\s*[A-Z0-9-]+,[0-9A-Fa-f]{16,}")


def _starts(between: str, *heads: list[str]) -> re.Pattern[str]:
    return re.compile("|".join((between + "*+").join(head) for head in heads))


_B64, _ANY = "[A-Za-z0-9+/_-]", "[0-9a-fA-F]"
#: How a sequence (of a short length, of one or two bytes of length) with the version 0 or 1 begins, and an OpenSSH key.
START64 = _starts(_BETWEEN, ["M", "[A-H]", _B64, *"CAQ", "[AE]"], [*"MI", "[E-H]", _B64, *"AgE", "[AB]"], [*"MI", "[I-L]", _B64, _B64, "[AQgw]", *"IBA", "[ADQT]"], [*"b3BlbnNzaC1rZXktdjEA"])
START16 = _starts(_BETWEEN_HEX, [*"30", "[0-7]", _ANY, *"02010", "[01]"], [*"3081", _ANY, _ANY, *"02010", "[01]"], [*"3082", *[_ANY] * 4, *"02010", "[01]"], [f"[{c}{c.upper()}]" for c in b"openssh-key-v1\0".hex()])
PART64, PART16 = re.compile(rf"({_B64}++)({_BETWEEN}*+)"), re.compile(rf"({_ANY}++)({_BETWEEN_HEX}*+)")
SPREAD_BYTES = 1 << 16
#: The object identifiers of password-based encryption begin so: 1.2.840.113549.1.5 and 1.2.840.113549.1.12.1 (fixed values).
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
Span = tuple[int, str, int, int]


def from_base64(text: str) -> bytes | None:
    text = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """The tags and contents of consecutive DER elements that fill ``data`` exactly, else None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            w = n & 0x7F
            if not 1 <= w <= 4 or at + w > len(data):
                return None
            n, at = int.from_bytes(data[at : at + w]), at + w
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def private_key(data: bytes | None) -> bool:
    """Whether the bytes are a private key with consistent lengths throughout."""
    if not data:
        return False
    if data.startswith(b"openssh-key-v1\0"):
        at, fields = 15, []
        for part in range(6):
            if at + 4 > len(data):
                return False
            n, at = int.from_bytes(data[at : at + 4]), at + 4
            if part == 3:  # the number of keys
                if n != 1:
                    return False
                continue
            if at + n > len(data):
                return False
            fields.append(data[at : at + n])
            at += n
        return at == len(data) and len(fields[3]) > 8 and len(fields[4]) > 8
    top = elements(data) if data[0] == 0x30 else None
    if not top or len(top) != 1:
        return False
    inner = elements(top[0][1])
    if inner and [t for t, _ in inner] == [0x30, 4]:  # encrypted PKCS#8: a password-based scheme and whole blocks
        scheme = elements(inner[0][1])
        return bool(scheme and scheme[0][0] == 6 and scheme[0][1].startswith(PASSWORD_BASED) and len(inner[1][1]) >= 16)
    if not inner or inner[0][0] != 2:
        return False
    tags, version = [t for t, _ in inner], int.from_bytes(inner[0][1])
    if version in (0, 1) and len(tags) >= 9 and set(tags[:9]) == {2}:
        return True
    if version == 1 and tags[1:2] == [4] and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return len(inner[1][1]) >= 16
    if version in (0, 1) and tags[1:3] == [0x30, 4]:
        algorithm = elements(inner[1][1])
        return bool(algorithm and algorithm[0][0] == 6 and len(inner[2][1]) >= 16 and elements(inner[2][1]))
    return False


def gather(text: str, at: int, stop: int, part: re.Pattern[str], most: int) -> tuple[str, int]:
    """At most so many digits of parts that follow one another, and where they end."""
    out, n, end = [], 0, at
    while n < most and (m := part.match(text, at, stop)):
        out.append(m[1][: most - n])
        n += len(out[-1])
        at, end = m.end(), m.start() + len(out[-1])
        if not m[2]:
            break
    return "".join(out), end


def length_of(data: bytes) -> int | None:
    """How many bytes a key that begins like this has by its own lengths."""
    if data[0] == 0x30:
        return 2 + data[1] if data[1] < 0x80 else 3 + data[2] if data[1] == 0x81 else 4 + int.from_bytes(data[2:4])
    at = 15
    for part in range(6):
        if at + 4 > len(data):
            return None
        at += 4 + (int.from_bytes(data[at : at + 4]) if part != 3 else 0)
    return at


def spread_keys(text: str) -> Iterator[Span]:
    """Keys whose digits are in several parts, with their armour as far as there is one."""
    for start, part, bits, decode in ((START64, PART64, 6, from_base64), (START16, PART16, 4, bytes.fromhex)):
        digits = re.compile(_B64 if bits == 6 else _ANY)
        at, stop = 0, -1
        while m := start.search(text, at):
            at, own = m.start() + 1, m.start()
            before = text[max(0, own - 5) : own]
            if digits.match(before[-1:]) and before != "-----" and not re.search(r"\\[nrt]$", before):
                continue
            if stop < own:
                stop = text.find("-----", own)
                stop = len(text) if stop < 0 else stop
            least = 8 if text[own] in "M3" else SPREAD_BYTES * 8 // bits
            head = gather(text, own, stop, part, least)[0]
            head = decode(head[: len(head) // 4 * 4])
            size = length_of(head) if head else None
            if size is None or size > SPREAD_BYTES:
                continue
            need = -(-size * 8 // bits)
            body, end = gather(text, own, stop, part, need)
            if len(body) < need or not private_key(decode(body)):
                continue
            at = end
            begin = text.rfind("-----BEGIN ", 0, own)
            if begin >= 0 and BEFORE.fullmatch(text, begin, own):
                after = AFTER.match(text, end)
                yield begin, "armour", after.end() if after else end + len(re.match("={0,2}", text[end : end + 2])[0]), begin
            else:
                yield own, "key", end + (len(re.match("={0,2}", text[end : end + 2])[0]) if bits == 6 else 0), own


def armoured(data: bytes | None) -> bool:
    """Whether the bytes are a text that holds a key in its armour, as in a key file that was encoded as a whole."""
    if not data or b"-----BEGIN " not in data or not data.isascii():
        return False
    text = data.decode()
    return any(private_key(from_base64(m[1])) for m in ARMOUR.finditer(text)) or any(encrypted_body(m[1], m[2]) for m in ENCRYPTED.finditer(text))


def encrypted_body(headers: str, body: str) -> bool:
    """Whether header lines name a cipher and the body has whole blocks."""
    data = from_base64(re.sub(_BETWEEN, "", body)) if "ENCRYPTED" in headers and CIPHER.search(headers) else None
    return bool(data) and len(data) >= 32 and len(data) % 8 == 0


def signed_token(header: str, payload: str) -> bool:
    try:
        head, body = (json.loads(from_base64(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def scan(text: str | None) -> list[Span]:
    """(start, kind, end, start of the secret itself), by start, then kind."""
    text, out = text or "", []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), "hex", m.end(), m.start()) for m in HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        out += [(m.start(), "armour", m.end(), m.start()) for m in ARMOUR.finditer(text) if private_key(from_base64(m[1]))]
    for m in RUN.finditer(text):
        raw = m[0]
        data = from_base64(raw)
        if private_key(data) or armoured(data) or len(raw) % 2 == 0 and re.fullmatch("[0-9a-fA-F]+", raw) and private_key(bytes.fromhex(raw)):
            out.append((m.start(), "key", m.end(), m.start()))
    if "-Info:" in text:
        out += [(m.start(), "armour", m.end(), m.start()) for m in ENCRYPTED.finditer(text) if encrypted_body(m[1], m[2])]
    keys = list(spread_keys(text))
    out = [s for s in out if s[1] != "key" or not any(x[0] <= s[0] and s[2] <= x[2] for x in keys)]
    whole = [s for s in out if s[1] in ("armour", "key")]
    out += [s for s in keys if not any(x[0] <= s[0] and s[2] <= x[2] for x in whole)]
    if "eyJ" in text:
        out += [(m.start(), "token", m.end(), m.start()) for m in TOKEN.finditer(text) if signed_token(m[1], m[2])]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def render(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end, _ in spans)


def redacted(text: str, spans: list[Span], mark: str) -> str:
    """The text with each secret, or run of overlapping ones, replaced by the mark."""
    out, at = [], 0
    for own, end in sorted((own, end) for _, _, end, own in spans):
        if own >= at:
            out += [text[at:own], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256 and spans; a null text is empty.

    ``spans`` has all findings as kind:start:end (code points, end exclusive) by start,
    then kind; ``base_sha256`` hashes the same of the first three kinds. Rows that
    repeat an id give a row each, a null id stays null, other columns aren't read, an
    empty table gives no rows. Texts are scanned whole.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py()) for t in batch.column(1)]
            counts = [pa.array([sum(s[1] == k for s in spans) for spans in found], pa.int64()) for k in BASE]
            base = [hashlib.sha256(render([s for s in spans if s[1] in BASE]).encode()).hexdigest() for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(base, pa.string()), pa.array(map(render, found), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret replaced by the mark; a column n_chars, if any, follows the new length.

    Null and empty texts, rows that repeat, other columns of any names and an empty table
    stay as they are. Texts are scanned whole; overlapping secrets become one mark.
    """
    small_batches(docs.sparkSession)
    place, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(place)]
            clean = pa.array([t if not t or not (s := scan(t)) else redacted(t, s, mark) for t in texts], batch.column(place).type)
            yield pa.RecordBatch.from_arrays([clean if i == place else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    out = docs.mapInArrow(run, schema)
    if "n_chars" in docs.columns and text_col != "n_chars":
        out = out.withColumn("n_chars", F.coalesce(F.length(text_col), F.col("n_chars")).cast(schema["n_chars"].dataType))
    return out


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of ``documents``."""
    return scan_documents(table(spark, sf_dir, "documents"))


def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans' numbers and places, which SQL can express."""
    return op8_secrets(spark, sf_dir).drop("spans")
