"""Secret scan with structural confirmation.

Three plain patterns give the base findings.  Beside them, runs of base64 or
hex characters are decoded and their bytes are parsed: nested tag-length-value
encodings of keys (PKCS#1, PKCS#8 plain or encrypted, SEC 1, DSA,
SubjectPublicKeyInfo), length-prefixed key blobs, and the JSON headers of signed
tokens.  Only what parses to the end of its stated lengths is reported, so a
random run of the same characters isn't.  Keys inside a longer run are found by
the lengths that their first bytes state, one that is wrapped over lines with or
without armour by joining them; line ends may be written as escapes.

The scan is local to a row: no shuffle, memory bounded by one Arrow batch.

Defined results
    Null text counts as empty and has no findings.  Texts are scanned whole.
    Offsets are code points, the end exclusive.  Repeated rows are scanned
    alike, an empty table gives an empty result, other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# The base patterns and the least lengths of their findings, in listed order.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
RANK = {kind: i for i, kind in enumerate(["assign", "access", "hex", "jwt", "key_der", "key_blob", "pem"])}

SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
DER_HEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{38,}(?![0-9A-Fa-f])")
ARMOUR = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*(?:PRIVATE|PUBLIC) KEY)-----((?:[A-Za-z0-9+/=\s]|\\[nrt])+)-----END \1-----")
LINE_END = re.compile(r"\\[nrt]|\s+")
#: Lines of base64 as encoders wrap them, the last one shorter; line ends may be escapes.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:M[A-P]|AAAA)[A-Za-z0-9+/]{58,74}(?:(?:\r?\n|\\n)[ \t]*[A-Za-z0-9+/]{60,76})*(?:\r?\n|\\n)[ \t]*[A-Za-z0-9+/]{2,76}={0,2}")
#: Heads of base64 text that a key encoding can start with: a sequence tag, or the four bytes of a blob's first length.
HEADS = re.compile(r"M[A-P]|AAAA")
#: A key's first bytes in base64: a sequence with a length of one, two or three bytes, then the tag of its first member.
INNER = re.compile(r"(?=(M[A-P][A-Za-z0-9+/_-]{6}))")
LEAST_KEY = 32


class Node(NamedTuple):
    tag: int
    body: bytes
    children: list[Node]


def parse_der(data: bytes, depth: int = 0) -> list[Node] | None:
    """The tag-length-value nodes that fill ``data`` exactly, or None."""
    nodes, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None  # a short length in the long form isn't distinguished encoding
        if at + size > len(data):
            return None
        body, at = data[at : at + size], at + size
        inner: list[Node] = []
        if tag & 0x20:
            if depth > 12 or (found := parse_der(body, depth + 1)) is None:
                return None
            inner = found
        nodes.append(Node(tag, body, inner))
    return nodes


def is_key_der(data: bytes) -> bool:
    """One outer sequence whose members are those of a private or public key."""
    if len(data) < 16 or data[0] != 0x30 or not (nodes := parse_der(data)) or len(nodes) != 1:
        return False
    tags = [n.tag for n in nodes[0].children]
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return True  # PKCS#1 private key: nine integers
    if tags == [0x02] * 6 and nodes[0].children[0].body == b"\x00" and len(nodes[0].children[1].body) >= 64:
        return True  # DSA private key: version and five integers
    if tags == [0x30, 0x04] and nodes[0].children[0].children[:1] and nodes[0].children[0].children[0].tag == 0x06 and len(nodes[0].children[1].body) >= LEAST_KEY:
        return True  # encrypted PKCS#8
    if tags[:3] == [0x02, 0x30, 0x04] and nodes[0].children[1].children[:1] and nodes[0].children[1].children[0].tag == 0x06:
        return True  # PKCS#8
    if tags[:2] == [0x02, 0x04] and nodes[0].children[0].body == b"\x01":
        return True  # SEC 1 private key
    if tags == [0x30, 0x03] and nodes[0].children[0].children[:1] and nodes[0].children[0].children[0].tag == 0x06:
        return True  # SubjectPublicKeyInfo
    return tags == [0x02, 0x02] and len(nodes[0].children[0].body) >= 64  # PKCS#1 public key


def stated_size(head: bytes) -> int:
    """Bytes of the sequence that ``head`` begins, its own tag and length included; 0 if it begins none."""
    if len(head) < 5 or head[0] != 0x30:
        return 0
    if head[1] < 0x80:
        return 2 + head[1] if head[2] in (0x02, 0x30) else 0
    n = head[1] & 0x7F
    if n not in (1, 2, 3) or (n < 3 and head[2 + n] not in (0x02, 0x30)):
        return 0
    return 2 + n + int.from_bytes(head[2 : 2 + n], "big")


def keys_inside(run: str) -> Iterator[tuple[int, int]]:
    """Start and end of the keys that stand anywhere in a run of base64, by the lengths they state; none overlaps the one before."""
    whole, after = len(run.rstrip("=")), 0
    for m in INNER.finditer(run):
        if m.start() < after:
            continue
        head = decoded(m[1])
        size = stated_size(head) if head else 0
        if size < LEAST_KEY:
            continue
        end = m.start() + -(-size * 4 // 3)  # characters that hold so many bytes
        if end > whole:
            continue
        data = decoded(run[m.start() : end])
        if data and is_key_der(data[:size]):
            while (end - m.start()) % 4 and run[end : end + 1] == "=":
                end += 1
            yield m.start(), end
            after = end


def is_key_blob(data: bytes) -> bool:
    """Length-prefixed fields filling the bytes, the first of which names a key kind."""
    fields, at = [], 0
    while at < len(data):
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if at + n > len(data):
            return False
        fields.append(data[at : at + n])
        at += n
    return len(fields) >= 2 and re.match(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+$", fields[0]) is not None


def decoded(text: str) -> bytes | None:
    """Bytes of base64 text in either alphabet, padded or not."""
    core = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(core) % 4 == 1:
        return None
    try:
        return base64.b64decode(core + "=" * (-len(core) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(header: str, payload: str) -> bool:
    """A JSON header naming an algorithm, and a payload that decodes to a JSON object."""
    for part, wanted in ((header, "alg"), (payload, None)):
        data = decoded(part)
        try:
            found = json.loads(data) if data else None
        except (UnicodeDecodeError, ValueError, RecursionError):
            return False
        if not isinstance(found, dict) or (wanted and not isinstance(found.get(wanted), str)):
            return False
    return True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern, group, least in BASE:
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((kind, m.start(), m.end()))
    return out


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "eyJ" in text:
        out += [("jwt", m.start(), m.end()) for m in SIGNED.finditer(text) if is_signed_token(m[1], m[2])]
    if "-----BEGIN " in text:
        for m in ARMOUR.finditer(text):
            data = decoded(LINE_END.sub("", m[2]))
            if data and (is_key_der(data) or data.startswith(b"openssh-key-v1\0")):
                out.append(("pem", m.start(), m.end()))
    for m in ENCODED.finditer(text):
        run = m[0]
        if HEADS.match(run) and (data := decoded(run)):
            if is_key_der(data):
                out.append(("key_der", m.start(), m.end()))
                continue
            if is_key_blob(data):
                out.append(("key_blob", m.start(), m.end()))
                continue
        out += [("key_der", m.start() + a, m.start() + b) for a, b in keys_inside(run)]
    for m in WRAPPED.finditer(text):
        data = decoded(LINE_END.sub("", m[0]))
        if data and (is_key_der(data) or is_key_blob(data)):
            out.append(("key_der" if is_key_der(data) else "key_blob", m.start(), m.end()))
    for m in DER_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and is_key_der(bytes.fromhex(m[0])):
            out.append(("key_der", m.start(), m.end()))
    return out


def find_secrets(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base findings and all findings, each by start, then kind as listed, then end."""
    text = text or ""
    order = lambda x: (x[1], RANK[x[0]], x[2])
    base = sorted(base_spans(text), key=order)
    return base, sorted({*base, *confirmed_spans(text)}, key=order)


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, findings (array of kind, start, end, base, value): all findings of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("value", pa.string())])
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = find_secrets(text)
                base = set(base)
                rows.append([{"kind": k, "start": a, "end": b, "base": (k, a, b) in base, "value": text[a:b]} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(item))], ["doc_id", "findings"])

    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"doc_id {kind}, findings array<struct<kind:string,start:bigint,end:bigint,base:boolean,value:string>>"
    return docs.select(id_col, text_col).mapInArrow(scan, shape)


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, digest of the base findings, all findings as text."""
    from pyspark.sql import functions as F

    found = secret_scan(docs, id_col, text_col)
    base = F.filter("findings", lambda x: x["base"])
    line = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(kind) for kind, *_ in BASE], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("findings")).alias("spans"))


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()
