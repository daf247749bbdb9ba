"""Secrets: patterns, and encoded candidates confirmed by what they decode to."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.frames import slices, table

# The patterns of the plain kinds.
_ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MIN_VALUE, _MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "pem", "key", "jwt")

# Armoured blocks; lines may end in written-out escapes, and headers may stand before the body.
_BREAK = r"(?:\s|\\[nr])"
_ARMOUR = re.compile(
    rf"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----((?:{_BREAK}+[A-Za-z-]+: [^\n\\]*)*)((?:{_BREAK}|[A-Za-z0-9+/=])+)-----END \1-----")
_ESCAPES = re.compile(rf"{_BREAK}+")
_ENCRYPTED = re.compile(r"DEK-Info: [A-Za-z0-9-]+,([0-9A-Fa-f]{16,32})")
# Dotted tokens, and runs that can be base64 or hex of at least 18 bytes: no private key is shorter.
_DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{12,}(?:\.[A-Za-z0-9_-]*){2,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}(?:\r?\n[A-Za-z0-9+/_-]{24,})*(?:\r?\n[A-Za-z0-9+/_-]+)?={0,2}")
_HEX_RUN = re.compile(r"(?:[0-9a-f]{2}){18,}|(?:[0-9A-F]{2}){18,}")
# Object identifiers under which encrypted keys are kept: PKCS #5 and PKCS #12 password schemes.
_PASSWORD_SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of each ASN.1 element, or None unless the lengths fill ``data`` exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            wide = size & 0x7F
            if not 1 <= wide <= 4 or at + wide > len(data):
                return None
            size = int.from_bytes(data[at:at + wide], "big")
            at += wide
        if at + size > len(data):
            return None
        out.append((tag, data[at:at + size]))
        at += size
    return out


def is_private_key(data: bytes) -> bool:
    """Whether nested lengths and types are those of a private key (PKCS#1, PKCS#8 plain or encrypted, SEC1 or OpenSSH)."""
    magic = b"openssh-key-v1\0"
    if data.startswith(magic):
        at, fields = len(magic), 0
        while fields < 3:  # cipher, key derivation, its options
            size = int.from_bytes(data[at:at + 4], "big")
            if at + 4 + size > len(data):
                return False
            at, fields = at + 4 + size, fields + 1
        count = int.from_bytes(data[at:at + 4], "big")
        at += 4
        if not 1 <= count <= 64:
            return False
        for _ in range(count + 1):  # public keys, then the private block
            size = int.from_bytes(data[at:at + 4], "big")
            if at + 4 > len(data) or size == 0 or at + 4 + size > len(data):
                return False
            at += 4 + size
        return at == len(data)
    outer = elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = elements(outer[0][1])
    if not inner:
        return False
    tags = [t for t, _ in inner]
    if tags == [0x30, 0x04]:  # scheme, encrypted key
        named = elements(inner[0][1])
        return bool(named) and named[0][0] == 0x06 and named[0][1].startswith(_PASSWORD_SCHEMES)
    if tags[:3] == [0x02, 0x30, 0x04]:  # version, algorithm, key
        named = elements(inner[1][1])
        return bool(named) and named[0][0] == 0x06
    if tags[:2] == [0x02, 0x04]:  # version, elliptic-curve key
        return inner[0][1] == b"\x01"
    if len(tags) >= 6 and set(tags[:6]) == {0x02}:  # version and numbers of an RSA or DSA key
        return inner[0][1] in (b"\x00", b"\x01") and len(inner[1][1]) >= 32
    return False


def decoded(run: str) -> Iterator[bytes]:
    """What a run can stand for in base64 of either alphabet."""
    body = run.rstrip("=")
    if len(body) % 4 == 1:
        return
    body = body.replace("-", "+").replace("_", "/")
    try:
        yield base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return


def is_signed_token(run: str) -> bool:
    """Whether the first part is a JSON header that names an algorithm, and the count of parts fits it."""
    parts = run.split(".")
    if len(parts) not in (3, 5):
        return False
    for raw in decoded(parts[0]):
        try:
            header = json.loads(raw)
        except (ValueError, RecursionError):
            return False
        if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
            return False
        if len(parts) == 5:
            return isinstance(header.get("enc"), str)
        for body in decoded(parts[1]):
            try:
                return isinstance(json.loads(body), dict)
            except (ValueError, RecursionError):
                return False
    return False


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _MIN_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= _MIN_ACCESS]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def armoured(text: str) -> Iterator[re.Match]:
    """Armoured blocks whose body is a private key, or is enciphered as its headers say."""
    if "PRIVATE KEY" in text:
        for m in _ARMOUR.finditer(text):
            for raw in decoded(_ESCAPES.sub("", m[3])):
                sealed = _ENCRYPTED.search(m[2])
                if is_private_key(raw) or sealed and raw and len(raw) % (len(sealed[1]) // 2) == 0:
                    yield m


def is_key_material(data: bytes) -> bool:
    """Whether bytes are a private key, or a file with one in armour."""
    if data[:1] in (b"0", b"o") and is_private_key(data):
        return True
    return b"PRIVATE KEY" in data and any(armoured(data.decode("latin-1")))


def run_key(run: str) -> int | None:
    """Where in a base64 run a key begins that fills the rest of it: at its start or behind a slash."""
    at = 0
    while at is not None and len(run) - at >= 24:
        # The first three bytes tell whether any structure can begin here.
        for head in decoded(run[at:at + 4]):
            if head[0] in b"0o-" or head[:1].isspace():
                whole = "".join(run[at:].split())
                if any(map(is_key_material, decoded(whole))):
                    return at
        after = run.find("/", at)
        at = after + 1 if after >= 0 else None
    return None


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Encoded candidates that decode to a private key or carry a signed token's header."""
    out = [("pem", *m.span()) for m in armoured(text)]
    if "." in text:
        for m in _DOTTED.finditer(text):
            parts = m[0].split(".")
            for n in (5, 3):  # encrypted or signed; more parts are text that follows
                run = ".".join(parts[:n])
                if len(parts) >= n and is_signed_token(run):
                    out.append(("jwt", m.start(), m.start() + len(run)))
                    break
    blocks = [(a, b) for _, a, b in out]
    for m in _RUN.finditer(text):
        if any(a < m.end() and m.start() < b for a, b in blocks):
            continue  # the body of an armoured block or a token
        found = _first_key(m[0])
        if found:
            out.append(("key", m.start() + found[0], m.start() + found[1]))
            continue
        for h in _HEX_RUN.finditer(m[0]):
            if is_key_material(bytes.fromhex(h[0])):
                out.append(("key", m.start() + h.start(), m.start() + h.end()))
    return out


def _first_key(run: str) -> tuple[int, int] | None:
    """Place of a key in a run that may go over several lines: the whole run, or one of its lines."""
    at = run_key(run)
    if at is not None:
        return at, len(run)
    if "\n" in run:
        begin = 0
        for line in run.splitlines(keepends=True):
            at = run_key(line.strip())
            if at is not None:
                return begin + at, begin + len(line.rstrip())
            begin += len(line)
    return None


def in_text_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, confirmed, value) of every row, in text order.

    Plain kinds are found by pattern. Beside them, armoured blocks, base64 and hex runs (also over several lines, behind a slash,
    or of a whole armoured file) and dotted tokens are decoded, and reported only if the nested lengths and types of a
    private key, plain or encrypted, or a signed token's header and body, can be read from the whole of them. Places count code points, end exclusive.

    Null and empty texts have no spans. Every row is read on its own and whole, so repeated rows repeat
    their result; other columns are ignored, and an empty table gives no rows.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                      ("confirmed", pa.bool_()), ("value", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = []
            for text in part.column("text").to_pylist():
                text = text or ""
                sure = confirmed_spans(text)
                found.append([
                    {"kind": k, "start": a, "end": b, "confirmed": k in KINDS[3:], "value": text[a:b]}
                    for k, a, b in in_text_order(plain_spans(text) + sure)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(span))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(
        scan, "doc_id long, spans array<struct<kind:string,start:long,end:long,confirmed:boolean,value:string>>")


def secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: ~s["confirmed"])

    def line(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS[:3]),
        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
