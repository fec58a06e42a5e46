"""Secrets in texts: plain patterns, and structures that are decoded before they are reported.

The method takes long base64 and hex stretches as candidates, also behind ``NAME=`` and ``0x``,
decodes them and reports one only if its bytes parse: nested lengths of a DER structure that fill it
exactly, the length-led fields of a public key line, the magic of a private key container, or a
signed token whose header and payload are JSON objects and whose header names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.common import plain

KINDS = ("assign", "access", "hex", "der", "ssh", "token")
SCHEMA = "doc_id bigint, spans array<struct<kind:string,start:int,end:int>>"
ASSIGN = re.compile(
    r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: A cheap test for texts that cannot hold an assignment: one word of each that must be there.
ASSIGN_WORDS = ("passw", "secret", "token", "key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Candidates have this many characters at least.
LEAST = 24
#: Runs are taken whole and begin where a run begins, so a run without dots is read once.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*+")
#: Stretches of base64 with their pad signs: both alphabets, then each alone (a name joined by a sign of
#: the other alphabet does not hide the key); and stretches of hex.
LONG = tuple(re.compile(rf"{signs}{{24,}}={{0,2}}") for signs in ("[A-Za-z0-9+/_-]", "[A-Za-z0-9+/]", "[A-Za-z0-9_-]"))
LONG_HEX = re.compile(r"[0-9a-fA-F]{24,}")
#: First fields of a key line that are accepted.
KEY_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")


def unbase64(text: str) -> bytes | None:
    """Bytes of base64 in either alphabet, padded or not; None if it is none."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1 or "=" in body:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_length(raw: bytes, at: int) -> tuple[int, int] | None:
    """Length of the element at ``at`` and where its content begins."""
    if at + 2 > len(raw):
        return None
    size = raw[at + 1]
    if size < 0x80:
        return size, at + 2
    more = size & 0x7F
    if not 1 <= more <= 4 or at + 2 + more > len(raw):
        return None
    return int.from_bytes(raw[at + 2 : at + 2 + more], "big"), at + 2 + more


def is_der(raw: bytes) -> bool:
    """A DER sequence whose length fills all bytes, made of known elements that fill it in turn, with
    at least two elements and an integer, bit string or octet string of 16 bytes or more."""
    if len(raw) < 24 or raw[0] != 0x30:
        return False
    head = der_length(raw, 0)
    if head is None or head[1] + head[0] != len(raw):
        return False
    todo, elements, longest = [(head[1], len(raw))], 0, 0
    while todo:
        at, end = todo.pop()
        while at < end:
            own = der_length(raw, at)
            if own is None or own[1] + own[0] > end:
                return False
            tag = raw[at]
            if tag in (0x30, 0x31) or 0xA0 <= tag <= 0xA3:
                todo.append((own[1], own[1] + own[0]))
            elif tag in (0x02, 0x03, 0x04):
                longest = max(longest, own[0])
            elif tag not in (0x01, 0x05, 0x06, 0x0C, 0x13, 0x16, 0x17, 0x18):
                return False
            elements += 1
            at = own[1] + own[0]
    return elements >= 2 and longest >= 16


def is_ssh(raw: bytes) -> bool:
    """Fields led by 32-bit lengths that fill all bytes, the first a known key name; or the magic
    of the container of private keys."""
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    at, fields = 0, []
    while at + 4 <= len(raw) and len(fields) < 16:
        size = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 + size > len(raw):
            return False
        fields.append(raw[at + 4 : at + 4 + size])
        at += 4 + size
    return at == len(raw) and len(fields) >= 2 and fields[0] in KEY_NAMES


def is_token(text: str) -> bool:
    """Three parts by dots, the first two JSON objects in base64, the first with an ``alg``."""
    parts = text.split(".")
    if len(parts) != 3:
        return False
    try:
        head, body = (json.loads((unbase64(p) or b"").decode("utf-8")) for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)


def confirmed(text: str) -> str | None:
    """The kind of a candidate whose decoded structure parses, or None."""
    if text.count(".") == 2:
        return "token" if is_token(text) else None
    for raw in (unbase64(text), bytes.fromhex(text) if re.fullmatch(r"(?:[0-9a-fA-F]{2})+", text) else None):
        if raw and is_der(raw):
            return "der"
        if raw and is_ssh(raw):
            return "ssh"
    return None


def blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """Bodies of armoured blocks: base64 over several lines, as one candidate."""
    for m in re.finditer(r"-----BEGIN [A-Z0-9 ]+-----\s*((?:[A-Za-z0-9+/=]{1,120}\s+)+)-----END ", text):
        yield m.start(1), m.start(1) + len(m.group(1).rstrip()), "".join(m.group(1).split())


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text: kind, start, end (code points, end not included), by start and kind."""
    low, out = text.lower(), []
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if any(len(w) >= LEAST for w in text.split()):
        tried = {m.span() for pattern in (TOKEN, *LONG, LONG_HEX) for m in pattern.finditer(text)}
        told: list[tuple[str, int, int]] = []
        for start, end in sorted(tried, key=lambda x: (x[0], -x[1])):
            kind = confirmed(text[start:end]) if end - start >= LEAST else None
            # of stretches inside each other the longest is reported
            if kind and not any(k == kind and s <= start and end <= e for k, s, e in told[-1:]):
                told.append((kind, start, end))
        out += told
    if "-----BEGIN " in text:
        for start, end, body in blocks(text):
            kind = confirmed(body)
            if kind and (kind, start, end) not in out:
                out.append((kind, start, end))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of every row; null and empty texts have none, repeated rows are repeated,
    an empty table gives no rows; columns other than doc_id and text are ignored, whatever their names.

    ``kind`` is one of KINDS. ASCII letters match in either case where case is free.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [
                [{"kind": k, "start": s, "end": e} for k, s, e in find(t.as_py() or "")] for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return plain(docs, "doc_id", "text").mapInArrow(search, SCHEMA)
