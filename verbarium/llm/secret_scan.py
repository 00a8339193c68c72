r"""Secret scans with structural confirmation.

Base detectors are patterns (``assign``, ``access``, ``hex``). The others report
a candidate only when what it encodes has the structure of a secret:

* ``der_key``: base64 or hex that decodes to a DER private key (PKCS#1, PKCS#8 plain or
  encrypted, SEC1, or DSA) whose nested lengths fit together to the last byte;
* ``openssh_key``: base64 of an ``openssh-key-v1`` container whose length-prefixed
  fields end with its last byte;
* ``jwt``: three base64url parts of which the header is a JSON object with ``alg``
  and the body a JSON object;
* ``pem_key``: the lines from a private-key marker to the next one, if that ends it and what they
  hold decodes so, or is whole cipher blocks under a DEK-Info header.

A null text is empty: no spans. Spans are code points, the end exclusive; a
repeated row gets its own result; spans of several kinds may overlap. Null and repeated ids,
and columns of any name, pass through; an empty table gives an empty one. Each detector
passes over a text once, so that time grows with its length, whatever stands in it.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, releasing

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem_key", "der_key", "openssh_key", "jwt")

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ASSIGN_WORD = re.compile(r"password|passwd|secret|token|api_?key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
_BIG_HEX = re.compile(r"[0-9A-Fa-f]{80,}")
_URL_RUN = re.compile(r"[A-Za-z0-9_-]+")
_PEM_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*)PRIVATE KEY-----")
_DEK_INFO = re.compile(r"^DEK-Info: ?([A-Z0-9-]+),([0-9A-Fa-f]+)\s*$", re.M)


def _tlv(data: bytes, at: int) -> tuple[int, int, int]:
    """Tag, start and end of the DER value at a place; ValueError if it does not fit."""
    if at + 2 > len(data):
        raise ValueError("short")
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        width = n & 0x7F
        if not 1 <= width <= 4 or at + width > len(data):
            raise ValueError("length")
        n, at = int.from_bytes(data[at : at + width], "big"), at + width
    if at + n > len(data):
        raise ValueError("overrun")
    return tag, at, at + n


def _members(data: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    """Tag, start and end of the values that fill a place; ValueError if they do not fit."""
    found = []
    while at < end:
        tag, start, at = _tlv(data, at)
        if at > end:
            raise ValueError("overrun")
        found.append((tag, start, at))
    return found


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE over the whole with the members of a private key, plain or encrypted."""
    try:
        tag, at, end = _tlv(data, 0)
        if tag != 0x30 or end != len(data):
            return False
        members = _members(data, at, end)
        tags = [t for t, _, _ in members]
        if tags == [0x30, 0x04]:  # PKCS#8, encrypted: the scheme's OID and parameters, then octets
            scheme = _members(data, *members[0][1:])
            return [t for t, _, _ in scheme] == [0x06, 0x30] and data[scheme[0][1] : scheme[0][2]].startswith(_PKCS) and members[1][2] - members[1][1] >= 16
        if len(tags) < 2 or tags[0] != 0x02:
            return False
        _, at, end = members[0]
        if end - at != 1 or data[at] > 2:  # the version
            return False
        if tags[1] == 0x30:  # PKCS#8: algorithm, the key as octets, tagged attributes
            return len(tags) > 2 and tags[2] == 0x04 and _members(data, *members[1][1:])[0][0] == 0x06 and all(t & 0xA0 == 0xA0 for t in tags[3:])
        if tags[1] == 0x04:  # SEC1: the scalar, then tagged parameters
            return 16 <= members[1][2] - members[1][1] <= 66 and all(t & 0xA0 == 0xA0 for t in tags[2:])
        if set(tags[:9]) != {0x02}:
            return False
        return len(tags) == 6 or len(tags) == 9 or tags[9:] == [0x30]  # DSA: p, q, g, y, x; PKCS#1: eight numbers, then other primes
    except (ValueError, IndexError):
        return False


#: Fixed value: the arc of the password-based schemes, 1.2.840.113549.1, of PKCS#5 and PKCS#12.
_PKCS = bytes.fromhex("2a864886f70d01")


def is_openssh_key(data: bytes) -> bool:
    """The magic, names of cipher and key derivation, its options, a count of keys, that many public blobs and one private blob, which ends it."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field() -> bytes:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            raise ValueError("overrun")
        at += 4 + n
        return data[at - n : at]

    try:
        names = field(), field()
        field()
        if not all(n.isascii() and n for n in names):
            return False
        count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if not 1 <= count <= 16:
            return False
        for _ in range(count):
            field()
        private = field()
    except ValueError:
        return False
    return at == len(data) and len(private) >= 8


def _b64(text: str, urlsafe: bool = False) -> bytes:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        raise ValueError("length")
    raw = (text + "=" * (-len(text) % 4)).encode("ascii")
    return base64.b64decode(raw, altchars=b"-_" if urlsafe else None, validate=True)


def _key_kind(data: bytes) -> str | None:
    return "der_key" if is_der_key(data) else "openssh_key" if is_openssh_key(data) else None


def is_jwt(token: str) -> bool:
    try:
        head, body, _ = token.split(".")
        header = json.loads(_b64(head, True))
        return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(json.loads(_b64(body, True)), dict)
    except (ValueError, binascii.Error, RecursionError):
        return False


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of signed tokens: three runs with dots between, the first from where it says ``eyJ``."""
    runs = [m.span() for m in _URL_RUN.finditer(text)]
    i = 0
    while i + 1 < len(runs):
        (a, b), (c, d) = runs[i], runs[i + 1]
        i += 1
        if c != b + 1 or text[b] != "." or text[d : d + 1] != "." or (start := text.find("eyJ", a, b)) < 0:
            continue
        third = runs[i + 1] if i + 1 < len(runs) and runs[i + 1][0] == d + 1 else (d + 1, d + 1)
        if is_jwt(text[start : third[1]]):
            yield start, third[1]
            i += 2


def _pem(text: str) -> Iterator[tuple[int, int]]:
    """Spans from a BEGIN marker to the next one, if that is its END and a key stands between."""
    before = None
    for m in _PEM_MARK.finditer(text):
        if m[1] == "END" and before and before[2] == m[2] and _holds_key(text[before.end() : m.start()]):
            yield before.start(), m.end()
        before = m if m[1] == "BEGIN" else None


def _holds_key(body: str) -> bool:
    cipher = _DEK_INFO.search(body)
    try:
        data = _b64(re.sub(r"\s", "", "".join(x for x in body.split("\n") if ":" not in x)))
    except (ValueError, binascii.Error):
        return False
    if cipher:
        block = 16 if cipher[1].startswith("AES") else 8
        return len(cipher[2]) == 2 * block and len(data) >= 2 * block and len(data) % block == 0
    return _key_kind(data) is not None


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """Start, end and kind of every secret of one whole text, by start, then kind as in KINDS."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    if _ASSIGN_WORD.search(text.lower()):
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    for m in _BASE64.finditer(text):
        try:
            if kind := _key_kind(_b64(m[0])):
                found.append((*m.span(), kind))
        except (ValueError, binascii.Error):
            pass
    for m in _BIG_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := _key_kind(bytes.fromhex(m[0]))):
            found.append((*m.span(), kind))
    if "eyJ" in text:
        found += [(a, b, "jwt") for a, b in _tokens(text)]
    if "PRIVATE KEY-----" in text:
        found += [(a, b, "pem_key") for a, b in _pem(text)]
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(found), key=lambda x: (x[0], rank[x[2]], x[1]))


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``secrets``: array of struct(kind, start, end)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    bound_batches(docs.sparkSession)
    slim = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("_text"))
    span = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])
    out = StructType([*slim.schema.fields[:-1], StructField("secrets", ArrayType(span))])
    schema, at = to_arrow_schema(out), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in scan(t)] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(at)), pa.array(spans, schema.field("secrets").type)], schema=schema)

    return slim.mapInArrow(releasing(run), out).select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "secrets")
