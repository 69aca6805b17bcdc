import base64
import hashlib
import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillflow.llm import secrets as S


def tlv(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8)
    return bytes([tag]) + size + body


RSA = tlv(0x30, tlv(2, b"\0") + b"".join(tlv(2, bytes([k]) * 40) for k in range(1, 9)))
EC = tlv(0x30, tlv(2, b"\1") + tlv(4, b"k" * 32) + tlv(0xA0, tlv(6, b"\x2b\x81")))
PKCS8 = tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, b"\x2a\x86") + tlv(5, b"")) + tlv(4, RSA))
SSH = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4) + x for x in (b"none", b"none", b"")) + (1).to_bytes(4) + b"".join(len(x).to_bytes(4) + x for x in (b"p" * 20, b"s" * 40))
url64 = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")


def base(text):
    """The three base patterns, plainly."""
    text, found = text or "", []
    for k, (kind, pattern, least, group, flags) in enumerate([("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, re.I | re.A), ("access", "AKIA[A-Z0-9]+", 18, 0, 0), ("hex", "[0-9a-f]+", 16, 0, 0)]):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return [x for *_, x in sorted(found)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("aA09f=: \"'K_-") + ["token", "TOKEN", "secret", "api_key", "apikey", "AKIA", "0123456789abcdef", "x" * 12, "ſ", "é", "\U0001f600"]), max_size=40).map("".join))
def test_base_spans(text):
    assert S.render([s for s in S.scan(text) if s[1] in S.BASE]) == ",".join(base(text))


def kinds(text):
    return [k for _, k, *_ in S.scan(text) if k not in S.BASE]


def test_keys_are_confirmed():
    for key in (RSA, EC, PKCS8, SSH):
        assert S.private_key(key) and not S.private_key(key[:-1]) and not S.private_key(key + b"x")
        body = base64.b64encode(key).decode()
        assert kinds(f"see {body} end") == ["key"]
        assert "key" in kinds(f"see {key.hex()} end")
        lines = "\n".join(body[i : i + 64] for i in range(0, len(body), 64))
        assert "armour" in kinds(f"x\n-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----\n")
        assert kinds(f"-----BEGIN PRIVATE KEY-----\n{lines[:-8]}\n-----END PRIVATE KEY-----") == []
    assert kinds("A" * 200) == [] and not S.private_key(b"\x30\x80") and not S.private_key(b"") and not S.private_key(b"\x30\x84\xff\xff\xff\xff")


def test_keys_spread_over_lines():
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    for key in (RSA, EC, PKCS8, SSH):
        body = base64.b64encode(key).decode()
        for width in (16, 64, 76):
            lines = [body[i : i + width] for i in range(0, len(body), width)]
            hexed = [key.hex()[i : i + width] for i in range(0, 2 * len(key), width)]
            armoured = [begin, *lines, end]
            cases = [
                (json.dumps({"k": "\n".join(armoured)}), json.dumps("\n".join(armoured))[1:-1], "armour"),
                ("\r\n".join(armoured).replace("\r\n", r"\r\n"), None, "armour"),
                ("\n".join([begin, "Proc-Type: 4,MIC-ONLY", "Comment: a", "", *lines, end]), None, "armour"),
                ("\n".join([begin, *lines]), None, "armour"),
                ("\n".join(lines), None, "key"),
                ("\n".join("    " + x for x in lines), "\n    ".join(lines), "key"),
                ("\n".join("> " + x for x in lines), "\n> ".join(lines), "key"),
                ("\n".join("// " + x for x in lines), "\n// ".join(lines), "key"),
                (" +\n".join(f'"{x}"' for x in lines), '" +\n"'.join(lines), "key"),
                ("\n".join(hexed), None, "key"),
                ("\n".join(hexed).upper(), None, "key"),
                (", ".join(f"0x{b:02x}" for b in key), ", ".join(f"0x{b:02x}" for b in key)[2:], "key"),
            ]
            for text, whole, kind in cases:
                text = f"see:\n{text}\n. end"
                spans = [(k, text[a:b]) for a, k, b, _ in S.scan(text) if k not in S.BASE]
                assert spans == [(kind, whole or text[5:-6])], (text, spans)
            assert kinds("\n".join([begin, *lines[:-1], end])) == [] and kinds("\n".join(hexed[:-1])) == []


def test_encrypted_keys_and_no_others():
    lines = [base64.b64encode(bytes(range(48))).decode() for _ in range(8)]
    head = ["-----BEGIN RSA PRIVATE KEY-----", "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF", ""]
    for eol in ("\n", r"\n"):
        text = eol.join([*head, *lines, "-----END RSA PRIVATE KEY-----"])
        assert [text[a:b] for a, k, b, _ in S.scan(text) if k == "armour"] == [text]
        assert "armour" not in kinds(eol.join([*head, *lines, "AAAA", "-----END RSA PRIVATE KEY-----"]))
        assert "armour" not in kinds(eol.join([*head[:2], "", *lines, "-----END RSA PRIVATE KEY-----"]))
    certificate = base64.b64encode(tlv(0x30, tlv(0x30, tlv(2, b"\1") + tlv(0x30, b"")) + tlv(3, b"x" * 90))).decode()
    assert kinds("\n".join(certificate[i : i + 64] for i in range(0, len(certificate), 64))) == []
    assert kinds("MIIEpAIBAAK " * 20_000) == [] and kinds("a:" * 50_000 + head[0] + "\n" + "a:" * 50_000) == []


def test_tokens_are_confirmed():
    head, body = url64(b'{"alg":"HS256","typ":"JWT"}'), url64(json.dumps({"sub": "é"}).encode())
    text = f"ü {head}.{body}.sig-_9 end"
    (span,) = [s for s in S.scan(text) if s[1] == "token"]
    assert text[span[0] : span[2]] == f"{head}.{body}.sig-_9"
    assert kinds(f"{url64(b'{"a":1}')}.{body}.sig") == [] and kinds(f"{head}.{url64(b'[1]')}.sig") == [] and kinds("eyJ.eyJ.x") == []


def test_rows(frame):
    secret = "password = 'abcdefghijkl'"
    rows = [(1, secret), (2, None), (3, ""), (None, secret), (1, secret), (4, "w " * 200_000 + secret), (5, "clean text")]
    got = S.scan_documents(frame(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id)
        spans = base(text)
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and r.spans == ",".join(spans)
        assert r.n_assign == sum(s.startswith("assign") for s in spans)
    clean = S.redact(frame(rows))
    assert clean.columns == frame(rows).columns
    by = {r.doc_id: r for r in clean.collect()}
    assert by[1].text == "password = '[secret]'" and by[1].n_chars == len(by[1].text) and by[2].text is None and by[5].text == "clean text"
    assert S.scan_documents(frame([])).collect() == [] and S.redact(frame([])).collect() == []


def test_overlapping_secrets_become_one_mark():
    text = "token=0123456789abcdef0123 x"
    assert S.redacted(text, S.scan(text), "#") == "token=# x"


def test_encrypted_and_doubly_encoded_keys():
    """An encrypted PKCS#8 key is confirmed by its scheme, a key file encoded as a whole by decoding it again."""
    scheme = tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d01050d")) + tlv(0x30, b""))
    for data, want in ((tlv(0x30, scheme + tlv(4, b"\1" * 64)), 1), (tlv(0x30, tlv(0x30, tlv(6, b"\x2a\x03")) + tlv(4, b"\1" * 64)), 0), (tlv(0x30, scheme + tlv(4, b"\1" * 8)), 0)):
        raw = base64.b64encode(data).decode()
        pem = "-----BEGIN ENCRYPTED PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", raw)) + "\n-----END ENCRYPTED PRIVATE KEY-----\n"
        for text in (f"x {pem} y", f"key {raw} end", f"tls.key: {base64.b64encode(pem.encode()).decode()}\n"):
            assert len([s for s in S.scan(text) if s[1] in ("armour", "key")]) == want, (text, S.scan(text))
    assert not [s for s in S.scan(base64.b64encode(b"-----BEGIN of a long text that is no key at all-----").decode()) if s[1] == "key"]
