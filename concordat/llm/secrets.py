"""Secret scans with structural confirmation.

Three base kinds are patterns: assign, access and hex. Longer base64 or hex candidates are also
decoded, and are reported only when their bytes parse: DER key encodings whose nested lengths
all add up (at most DEPTH deep), length-prefixed OpenSSH keys, and signed tokens whose header is a JSON object that
names an algorithm. Confirmed spans are added to the base spans, which always stay.

Kinds, in order: assign, access, hex, token (a signed token), key (a key encoding on one or more lines,
at the start of a run of coded characters or behind one of / = . in it), pem (a key encoding between
BEGIN and END lines, line ends possibly written out as \\n). Positions are code points, end exclusive.
Null and empty texts have no spans; repeated rows are scanned each; a narrow stage, no shuffle.
Candidates are found in byte arrays of whole groups of texts, so only texts that hold one reach
a regex.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.llm.common import ASCII_LOWER, byte_table, text_groups
from concordat.session import in_arrow, read_table

NAME = "op4_secret_scan"
KINDS = ("assign", "access", "hex", "token", "key", "pem")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*KEY)-----((?:[A-Za-z0-9+/=\s]|\\[nr])+)-----END \1-----")
#: White space, and line ends written out, between the lines of a wrapped encoding.
BREAKS = re.compile(rb"(?:[ \t\r\n]|\\[nr])*")
CODED_LINE = re.compile(rb"[A-Za-z0-9+/_-]+")
HEX_LINE = re.compile(rb"[0-9a-fA-F]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Characters from which a candidate is decoded.
LEAST_DECODED = 32
#: Most characters of a key encoding, and how deep its elements may nest; what is beyond isn't reported.
MOST_DECODED, DEPTH = 1 << 17, 12

_HEX = byte_table([*range(0x30, 0x3A), *range(0x61, 0x67)])
_CODED = byte_table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *map(ord, "+/_=.-")])


def runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of at least `least` bytes that don't cross rows."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    edge = np.unique(np.concatenate([[0], change, offsets, [n]]))
    a, b = edge[:-1], edge[1:]
    keep = mask[a] & (b - a >= least)
    return a[keep], b[keep]


# --- structure ------------------------------------------------------------------------------


def der_items(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """Tag and content of the elements that fill data exactly, nested ones checked too."""
    out, i, n = [], 0, len(data)
    while i < n:
        if i + 2 > n or data[i] & 0x1F == 0x1F:
            return None
        tag, size = data[i], data[i + 1]
        i += 2
        if size >= 0x80:
            k = size & 0x7F
            if not 1 <= k <= 4 or i + k > n or data[i] == 0:
                return None
            size = int.from_bytes(data[i : i + k], "big")
            if size < 0x80:
                return None
            i += k
        if i + size > n:
            return None
        body = data[i : i + size]
        if tag & 0x20 and (depth >= DEPTH or der_items(body, depth + 1) is None):
            return None
        out.append((tag, body))
        i += size
    return out


_INT, _OCTETS, _BITS, _OID, _SEQ = 0x02, 0x04, 0x03, 0x06, 0x30


def is_der_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8 (plain or encrypted), SEC1 and DSA private keys."""
    if len(data) < 24 or data[0] != _SEQ:
        return False
    top = der_items(data)
    if not top or len(top) != 1:
        return False
    inner = der_items(top[0][1])
    if not inner:
        return False
    tags = [t for t, _ in inner]
    if all(t == _INT for t in tags) and len(tags) in (6, 9) and inner[0][1] == b"\0":
        return True
    if tags[:2] == [_INT, _OCTETS] and inner[0][1] == b"\1":
        return all(t in (0xA0, 0xA1) for t in tags[2:])
    oid = lambda body: bool(x := der_items(body)) and x[0][0] == _OID and len(x[0][1]) >= 2
    if tags[:3] == [_INT, _SEQ, _OCTETS]:
        return oid(inner[1][1])
    return tags == [_SEQ, _OCTETS] and oid(inner[0][1])


def ssh_key_size(data: bytes) -> int | None:
    """Bytes of the OpenSSH private key that data begins with: magic, then fields whose length
    prefixes fit. None if it begins with none."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    i, fields = len(magic), []

    def field(i: int) -> int | None:
        if i + 4 > len(data):
            return None
        end = i + 4 + int.from_bytes(data[i : i + 4], "big")
        if end > len(data):
            return None
        fields.append(data[i + 4 : end])
        return end

    for _ in range(3):
        if (i := field(i)) is None:
            return None
    if i + 4 > len(data) or not 1 <= (keys := int.from_bytes(data[i : i + 4], "big")) <= 16:
        return None
    i += 4
    for _ in range(keys + 1):
        if (i := field(i)) is None:
            return None
    return i if fields[0] and fields[0].isascii() else None


def is_ssh_key(data: bytes) -> bool:
    return ssh_key_size(data) == len(data)


def der_size(head: bytes) -> int | None:
    """Bytes of the sequence whose first bytes are head, by its length field."""
    if len(head) < 6 or head[0] != _SEQ:
        return None
    if head[1] < 0x80:
        return 2 + head[1]
    k = head[1] & 0x7F
    return 2 + k + int.from_bytes(head[2 : 2 + k], "big") if 1 <= k <= 4 else None


def decode64(text: str) -> bytes | None:
    """Standard or URL-safe base64 with or without padding."""
    body = text.rstrip("=")
    if "=" in body or len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_token_header(part: str) -> bool:
    if len(part) < 12 or (raw := decode64(part)) is None or raw[:1] != b"{":
        return False
    try:
        head = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def coded(raw: bytes, start: int, end: int, line: re.Pattern, most: int) -> tuple[bytes, list[tuple[int, int]]]:
    """Up to `most` characters of an encoding from start on, its lines joined, and the lines' spans."""
    out, spans, at, size = [], [], start, 0
    while size < most and (m := line.match(raw, at, min(end, at + most - size))):
        out.append(m[0])
        spans.append(m.span())
        size += len(m[0])
        at = BREAKS.match(raw, m.end(), end).end()
        if at == m.end():
            break
    return b"".join(out), spans


def key_end(raw: bytes, start: int, end: int) -> int | None:
    """Where the key encoding that begins at start ends (base64 on one or more lines, or hex), or None.
    The length that its head states says how much of the text to take."""
    head = raw[start : start + 8]
    if head.startswith(b"b3BlbnNz"):
        found, spans = coded(raw, start, end, CODED_LINE, MOST_DECODED)
        data = decode64(found[: len(found) // 4 * 4].decode("ascii") if len(found) % 4 == 1 else found.decode("ascii"))
        size = ssh_key_size(data) if data else None
        if size is None:
            return None
        return _closed(raw, spans, -(-size * 4 // 3), end, CODED_LINE)
    if head.startswith(b"M") and (data := decode64(head.decode("ascii", "replace"))) and (size := der_size(data)):
        need = -(-size * 4 // 3)
        if LEAST_DECODED <= need <= MOST_DECODED:
            found, spans = coded(raw, start, end, CODED_LINE, need)
            if len(found) == need and (data := decode64(found.decode("ascii"))) and is_der_key(data):
                return _closed(raw, spans, need, end, CODED_LINE)
    if head.startswith(b"30"):
        found, spans = coded(raw, start, end, HEX_LINE, 12)
        if len(found) == 12 and (size := der_size(bytes.fromhex(found.decode("ascii")))) and LEAST_DECODED <= 2 * size <= MOST_DECODED:
            found, spans = coded(raw, start, end, HEX_LINE, 2 * size)
            if len(found) == 2 * size and is_der_key(bytes.fromhex(found.decode("ascii"))):
                return _closed(raw, spans, 2 * size, end, HEX_LINE)
    if head.lower().startswith(b"6f70656e"):
        found, spans = coded(raw, start, end, HEX_LINE, MOST_DECODED)
        size = ssh_key_size(bytes.fromhex(found[: len(found) // 2 * 2].decode("ascii")))
        return None if size is None else _closed(raw, spans, 2 * size, end, HEX_LINE)
    return None


def _closed(raw: bytes, spans: list[tuple[int, int]], need: int, end: int, line: re.Pattern) -> int | None:
    """Where `need` characters of lines end, with their padding; None if a line goes on there."""
    for a, b in spans:
        if need <= b - a:
            at = a + need
            while at < end and raw[at] == 0x3D and at < a + need + 2:
                at += 1
            return None if line.match(raw, at, end) else at
        need -= b - a
    return None


def is_key(text: str) -> bool:
    raw = text.encode()
    return key_end(raw, 0, len(raw)) == len(raw)


def keys_in(raw: bytes, start: int, stop: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans of key encodings that begin in raw[start:stop] (a run of coded characters) at its start
    or behind one of / = . and may go on over the next lines up to end."""
    at = start
    while at < stop:
        if (found := key_end(raw, at, end)) is not None:
            yield at, found
            at = found
        else:
            at += 1
        while at < stop and not (raw[at - 1] in b"/=." and raw[at] in b"Mb36"):
            at += 1


def tokens(run: str) -> list[tuple[int, int]]:
    """Spans of signed tokens within a run: three parts, the first a header that parses."""
    out, at = [], 0
    parts = run.split(".")
    k = 0
    while k < len(parts):
        part = parts[k]
        head = part[part.rfind("=") + 1 :] if not part.endswith("=") else part
        if k + 2 < len(parts) and decode64(parts[k + 1]) and is_token_header(head):
            size = len(part) + len(parts[k + 1]) + len(parts[k + 2]) + 2
            if parts[k + 2] and decode64(parts[k + 2]) is None:
                size -= len(parts[k + 2])
            out.append((at + len(part) - len(head), at + size))
            at += len(part) + len(parts[k + 1]) + len(parts[k + 2]) + 3
            k += 3
            continue
        at += len(part) + 1
        k += 1
    return out


# --- scan -----------------------------------------------------------------------------------


def scan_group(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
    """Sorted spans (kind, start, end in code points) of the rows that have any."""
    found: dict[int, list[tuple[str, int, int]]] = {}
    if not len(data):
        return found
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = points[offsets]
    row_of = lambda at: np.searchsorted(offsets, at, side="right") - 1
    raw, low = data.tobytes(), ASCII_LOWER[data].tobytes()

    def add(kind: str, a, b) -> None:
        a, b = np.asarray(a), np.asarray(b)
        rows = row_of(a)
        for r, s, e in zip(rows.tolist(), (points[a] - base[rows]).tolist(), (points[b] - base[rows]).tolist(), strict=True):
            found.setdefault(r, []).append((kind, s, e))

    def rows_with(hay: bytes, needles) -> list[int]:
        rows = set()
        for needle in needles:
            at = hay.find(needle)
            while at >= 0:
                r = int(row_of(at))
                if at + len(needle) <= offsets[r + 1]:
                    rows.add(r)
                    at = hay.find(needle, int(offsets[r + 1]))
                else:
                    at = hay.find(needle, at + 1)
        return sorted(rows)

    text = lambda r: raw[offsets[r] : offsets[r + 1]].decode("utf-8")
    for r in rows_with(low, ASSIGN_WORDS):
        found.setdefault(r, []).extend(("assign", m.start(), m.end()) for m in ASSIGN.finditer(text(r)) if len(m[2]) >= LEAST_ASSIGN)
    for r in rows_with(raw, (b"AKIA",)):
        found.setdefault(r, []).extend(("access", m.start(), m.end()) for m in ACCESS.finditer(text(r)) if len(m[0]) >= LEAST_ACCESS)
    add("hex", *runs(_HEX[data], offsets, LEAST_HEX))
    pem: dict[int, list[tuple[int, int]]] = {}
    for r in rows_with(raw, (b"-----BEGIN ",)):
        for m in PEM.finditer(text(r)):
            if (x := decode64(re.sub(r"\s|\\[nr]", "", m[2]))) is not None and (is_der_key(x) or is_ssh_key(x)):
                found.setdefault(r, []).append(("pem", m.start(), m.end()))
                pem.setdefault(r, []).append(m.span())
    for a, b in zip(*runs(_CODED[data], offsets, LEAST_DECODED), strict=True):
        a, b = int(a), int(b)
        for s, e in tokens(raw[a:b].decode("ascii")):
            add("token", [a + s], [a + e])
        row = int(row_of(a))
        for s, e in keys_in(raw, a, b, int(offsets[row + 1])):
            at = int(points[s] - base[row])
            if not any(x <= at < y for x, y in pem.get(row, ())):  # it is told as that
                add("key", [s], [e])
    order = {k: i for i, k in enumerate(KINDS)}
    return {r: sorted(s, key=lambda x: (x[1], order[x[0]], x[2])) for r, s in found.items() if s}


_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """df with an array of (kind, start, end), sorted by start and kind; `out` replaces a column of that name."""
    keep = [c for c in df.columns if c != out]
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_groups(batch.column(keep.index(text))):
                found = scan_group(data, offsets)
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in found.get(r, ())] for r in range(b - a)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(spans, _KIND)], names=[*keep, out])

    return df.select(*keep).transform(in_arrow, run, schema)


def redact(df: DataFrame, text: str = "text", spans: str = "secrets", mark: str = "[REDACTED]") -> DataFrame:
    """df with every span of `spans` in the text replaced by a mark; overlapping spans share one.
    A null text stays null."""
    piece = F.aggregate(
        spans,
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(
                F.when(s["start"] < acc["at"], acc["done"])
                .otherwise(F.concat(acc["done"], F.substr(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)))
                .alias("done"),
                s["end"].alias("at"),
            )
        ),
        lambda acc: F.concat(acc["done"], F.substr(F.col(text), (acc["at"] + 1).cast("int"))),
    )
    return df.withColumn(text, F.when(F.size(spans) > 0, piece).otherwise(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
