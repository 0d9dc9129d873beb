"""Secret scans with structural confirmation.

Base kinds are patterns (assignments of long values to telling names, access ids, hex runs). On top of them,
base64 and hex candidates are decoded and parsed before anything is reported: tag-length-value key encodings
whose nested lengths must add up exactly, key files with length-prefixed fields, armoured keys whose body
parses, in the text or itself in base64, and signed tokens whose header and payload are JSON and whose signature has
the length that the header's algorithm asks for. A wrapped key counts only if what it wraps parses as a key; of an
encrypted one, which can't be looked into, the scheme and its parameters must parse.

Defined results: null and empty texts have no secrets; each repeated row is scanned; an empty table gives an
empty table; columns named like the results are replaced, all others stay. Spans are in code points, end
exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from scoreline.llm.common import with_arrow

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "token", "key", "keyfile", "armour")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*")
#: A break inside a key: of lines, indented or not, or one that is written out as in JSON and settings files.
_BREAK = r"(?:\r?\n[ \t]*|(?:\\r)?\\n)"
#: Where base64 of a sequence may begin: after anything but a letter or digit, so after =, /, - and _ too.
_SEQUENCE = re.compile(r"(?<![A-Za-z0-9])(?=M[A-P][A-Za-z0-9+/_-]{14})")
#: Where base64 of a key file or of an armour may begin, and how far such a run goes.
_NAMED = re.compile(r"(?<![A-Za-z0-9])(?=b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi)")
_RUN = re.compile(rf"[A-Za-z0-9+/_-]+(?:{_BREAK}[A-Za-z0-9+/_-]+)*={{0,2}}")
_PIECE = re.compile(rf"[A-Za-z0-9+/_-]+|{_BREAK}")
_LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")
_ARMOUR = re.compile(rf"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]|{_BREAK})+)-----END \1-----")
_SIGNATURE_BYTES = {"HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114), "RS": (128, 1024), "PS": (128, 1024)}


def decode64(text: str) -> bytes | None:
    """Standard or URL-safe base64, padded or not; None where it isn't."""
    body = text.rstrip("=").translate({45: 43, 95: 47})
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def read_tlv(data: bytes, at: int, end: int, depth: int = 0) -> list | None:
    """The (tag, content or children) elements that fill data[at:end] exactly, or None."""
    out = []
    while at < end:
        if depth > 12 or end - at < 2:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or end - at < n:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if size > end - at:
            return None
        inner = read_tlv(data, at, at + size, depth + 1) if tag & 0x20 else data[at : at + size]
        if inner is None:
            return None
        out.append((tag, inner))
        at += size
    return out


def number(field: tuple) -> int | None:
    """The value of an integer field; None where it isn't one in its shortest form, or negative."""
    tag, raw = field
    if tag != 2 or not raw or raw[0] & 0x80 or (len(raw) > 1 and raw[0] == 0 and not raw[1] & 0x80):
        return None
    return int.from_bytes(raw, "big")


def is_scalar_key(fields: list) -> bool:
    """An elliptic-curve key: version 1, a scalar, then at most the curve's name and the public point."""
    tags = [t for t, _ in fields]
    return len(fields) >= 2 and tags[:2] == [2, 4] and fields[0][1] == b"\1" and 16 <= len(fields[1][1]) <= 72 and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1])


def is_list_key(fields: list) -> bool:
    """A key that is a list of six or nine whole numbers, the first of them its version."""
    values = [number(f) for f in fields]
    return len(fields) in (6, 9) and None not in values and values[0] in (0, 1) and values[1] >= 1 << 255 and min(values[2:]) > 0


def is_inner_key(algorithm: list, octets: bytes) -> bool:
    """What a wrapper's octets hold: a list of numbers, an elliptic-curve key, a bare number, or octets of a fixed size."""
    if not algorithm or algorithm[0][0] != 6:
        return False
    top = read_tlv(octets, 0, len(octets))
    if not top or len(top) != 1:
        return False
    tag, inner = top[0]
    if tag == 0x30:
        return is_list_key(inner) or is_scalar_key(inner)
    if tag == 2:  # its parameters stand in the algorithm
        return (number(top[0]) or 0) >= 1 << 127 and len(algorithm) == 2 and algorithm[1][0] == 0x30
    return tag == 4 and len(inner) in (32, 56, 57) and len(algorithm) == 1


def is_private_key(data: bytes) -> bool:
    """A private key in its usual encodings: one sequence that fills the data and, down to its last length, parses.

    It is a list of numbers, an elliptic-curve key, a wrapper (version, algorithm, the key as octets, attributes) or
    an encrypted wrapper (algorithm with parameters, octets).
    """
    if len(data) < 24 or data[0] != 0x30:
        return False
    top = read_tlv(data, 0, len(data))
    if not top or len(top) != 1:
        return False
    fields = top[0][1]
    tags = [t for t, _ in fields]
    if tags == [0x30, 4]:  # encrypted: a named scheme, its parameters, whole octets
        scheme = fields[0][1]
        return [t for t, _ in scheme] == [6, 0x30] and bool(scheme[1][1]) and len(fields[1][1]) >= 24
    if tags[:3] == [2, 0x30, 4]:
        return number(fields[0]) in (0, 1) and tags[3:] in ([], [0xA0], [0x81], [0xA1], [0xA0, 0x81], [0xA0, 0xA1]) and is_inner_key(fields[1][1], fields[2][1])
    return is_scalar_key(fields) or is_list_key(fields)


def is_key_file(data: bytes) -> bool:
    """A key file of length-prefixed fields: cipher, derivation, options, key count, public keys, private part."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, fields, count = len(magic), [], 0
    while at + 4 <= len(data) and (len(fields) < 3 or len(fields) < 3 + count + 1):
        size, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if len(fields) == 3 and not count:
            count = size
            if not 1 <= count <= 16:
                return False
            continue
        if size > len(data) - at:
            return False
        fields.append(data[at : at + size])
        at += size
    return len(fields) == 3 + count + 1 and count > 0 and at == len(data) and bool(fields[0]) and min(map(len, fields[3:])) > 0


def unbroken(text: str) -> str:
    """Base64 without the breaks in it."""
    return "".join(text.replace("\\r", "").replace("\\n", "").split())


def sequence_size(text: str, start: int) -> int:
    """How many bytes the sequence takes whose base64 begins here, as its first lengths say; 0 where they can't be a key's."""
    head = decode64(text[start : start + 16])
    if head is None or head[0] != 0x30:
        return 0
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 4 or (head[1] & 0x80 and not n):
        return 0
    size = int.from_bytes(head[2 : 2 + n], "big") if n else head[1]
    # A key's first field is its version, or the name of its scheme in a sequence.
    return 2 + n + size if head[2 + n] in (2, 0x30) else 0


def whole_base64(text: str, start: int, chars: int) -> tuple[str, int] | None:
    """So many characters of base64 from here, breaks skipped, and where they end with their padding; None if they don't end there."""
    parts, at = [], start
    while chars > 0 and (m := _PIECE.match(text, at)):
        if text[at] in "\r\n\\":
            at = m.end()
        else:
            part = text[at : min(m.end(), at + chars)]
            parts.append(part)
            chars, at = chars - len(part), at + len(part)
    if chars or re.compile("[A-Za-z0-9]").match(text, at):
        return None
    return "".join(parts), re.compile("={0,2}").match(text, at).end()


def keys_in_base64(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans of private keys whose lengths say where they end, and of key files and armours in runs of base64."""
    done = 0
    for m in _SEQUENCE.finditer(text):
        size = sequence_size(text, m.start()) if m.start() >= done else 0
        if size >= 24 and size <= len(text) and (found := whole_base64(text, m.start(), -(-size * 4 // 3))):
            data = decode64(found[0])
            if data and len(data) == size and is_private_key(data):
                yield m.start(), found[1], "key"
                done = found[1]
    for m in _NAMED.finditer(text):
        if m.start() >= done and (run := _RUN.match(text, m.start())) and (data := decode64(unbroken(run[0]))):
            kind = "keyfile" if is_key_file(data) else "armour" if any(armoured(data.decode("latin-1"))) else None
            if kind:
                yield run.start(), run.end(), kind
                done = run.end()


def armoured(text: str) -> Iterator[tuple[int, int]]:
    """Where armoured keys stand whose body parses."""
    for m in _ARMOUR.finditer(text):
        data = decode64(unbroken(m[2]))
        if data and (is_private_key(data) or is_key_file(data)):
            yield m.start(), m.end()


def is_signed_token(text: str) -> bool:
    """header.payload.signature: JSON objects, an algorithm, and a signature of its length."""
    head, payload, signature = text.split(".")
    try:
        header, claims = (json.loads(decode64(x) or b"") for x in (head, payload))
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(claims, dict) or not isinstance(header.get("alg"), str):
        return False
    low, high = _SIGNATURE_BYTES.get(header["alg"]) or _SIGNATURE_BYTES.get(header["alg"][:2], (None, None))
    raw = decode64(signature)
    return low is not None and raw is not None and low <= len(raw) <= high


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, leftmost and non-overlapping within each kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of candidates whose decoded structure holds."""
    out = []
    if "eyJ" in text:
        out += [(m.start(), m.end(), "token") for m in _TOKEN.finditer(text) if is_signed_token(m[0])]
    armours = list(armoured(text)) if "-----BEGIN" in text else []
    # What stands inside an armour is reported with it.
    out += [(a, b, kind) for a, b, kind in keys_in_base64(text) if not any(low <= a and b <= high for low, high in armours)]
    for m in _LONG_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and (is_private_key(data := bytes.fromhex(m[0])) or is_key_file(data)):
            out.append((m.start(), m.end(), "key"))
    return out + [(a, b, "armour") for a, b in armours]


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each stretch that spans cover replaced by one mark."""
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs with secrets, array<struct<kind, start, end>> in order, and redacted, the text without them."""
    kept = docs.drop("secrets", "redacted")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, clean = [], []
            for text in batch.column("text").to_pylist():
                spans = in_order(base_spans(text) + confirmed_spans(text)) if text else []
                found.append([{"kind": k, "start": a, "end": b} for a, b, k in spans])
                clean.append(redact(text, spans) if spans else text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _SPANS), pa.array(clean, pa.string())], names=[*batch.schema.names, "secrets", "redacted"])

    return with_arrow(kept, scan, "secrets array<struct<kind:string,start:int,end:int>>, redacted string")


def digest(spans: list[tuple[int, int, str]]) -> str:
    """Lower-case hex SHA-256 of the base spans as text."""
    return hashlib.sha256(joined([s for s in spans if s[2] in BASE]).encode()).hexdigest()
