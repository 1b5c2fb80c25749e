"""Canonical JSON: members in byte order, integers as decimal strings, no nulls, few escapes."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.functions.text import sha256


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- expressions -----------------------------------------------------------------------------

_CONTROLS = "".join(map(chr, range(0x20)))


def string(c: Column | str) -> Column:
    """A quoted string: quote and backslash escaped by a backslash, control characters as \\u00xx.
    The controls are looked for once and replaced only in texts that hold any."""
    c = F.replace(F.replace(_col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    plain = c
    for k in range(0x20):
        plain = F.replace(plain, F.lit(chr(k)), F.lit(f"\\u{k:04x}"))
    body = F.when(c.rlike(r"[\x00-\x1F]"), plain).otherwise(c)
    return F.concat(F.lit('"'), body, F.lit('"'))


def integer(c: Column | str) -> Column:
    return F.concat(F.lit('"'), _col(c).cast("string"), F.lit('"'))


def boolean(c: Column | str) -> Column:
    return _col(c).cast("string")


def object_of(members: Mapping[str, Column]) -> Column:
    """An object of rendered members; null members are left out."""
    parts = [F.concat(F.lit(f'"{name}":'), members[name]) for name in sorted(members, key=lambda n: n.encode())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def array_of(items: Column | str) -> Column:
    """An array of rendered items in the order given."""
    return F.concat(F.lit("["), F.array_join(_col(items), ","), F.lit("]"))


def set_of(items: Column | str) -> Column:
    """An array of rendered items in byte order, each once."""
    return array_of(F.sort_array(F.array_distinct(_col(items))))


def tagged(tag: str, value: Column) -> Column:
    """A member of a union: its tag, a literal, and its value."""
    return object_of({"tag": F.lit(emit(tag)), "value": value})


def content_hash(rendered: Column) -> Column:
    return sha256(rendered)


def local_names(ids: Column | str) -> Column:
    """Ids replaced by i0, i1, ... in order of first appearance, so that renaming changes nothing."""
    ids = _col(ids)
    return F.transform(ids, lambda x: F.concat(F.lit("i"), (F.array_position(F.array_distinct(ids), x) - 1).cast("string")))


def structural_hash(ids: Column | str) -> Column:
    return sha256(array_of(F.transform(local_names(ids), string)))


# --- driver side -----------------------------------------------------------------------------


class CanonError(ValueError):
    """A value that has no canonical form, or text that isn't in it."""


def emit(value: Any) -> str:
    """Canonical text of a Python value: dicts, lists, strings, integers, booleans."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f'"{value}"'
    if isinstance(value, str):
        if any(0xD800 <= ord(c) < 0xE000 for c in value):
            raise CanonError("lone surrogate")
        out = value.replace("\\", "\\\\").replace('"', '\\"')
        return '"' + re.sub(r"[\x00-\x1f]", lambda m: f"\\u{ord(m[0]):04x}", out) + '"'
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(emit, value)) + "]"
    if isinstance(value, (set, frozenset)):
        return "[" + ",".join(sorted((emit(v) for v in value), key=str.encode)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{emit(k)}:{emit(v)}" for k, v in sorted(value.items(), key=lambda kv: kv[0].encode()) if v is not None) + "}"
    raise CanonError(f"no canonical form for {type(value).__name__}")


def read(text: str) -> Any:
    """The value of canonical text; any other encoding of it is refused. Integers stay strings."""
    import json

    def pairs(items: list[tuple[str, Any]]) -> dict:
        names = [k for k, _ in items]
        if names != sorted(set(names), key=str.encode):
            raise CanonError("members unsorted or repeated")
        return dict(items)

    def refuse(x: str) -> None:
        raise CanonError(f"bare number {x}")

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_int=refuse, parse_float=refuse, parse_constant=refuse)
    except json.JSONDecodeError as e:
        raise CanonError(str(e)) from None
    if emit(value) != text:
        raise CanonError("not the canonical encoding")
    return value


# --- typed strict reader ---------------------------------------------------------------------


class ReadError(CanonError):
    """Text that isn't the canonical form of its type; kind is one of KINDS."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind} {detail}".strip())
        self.kind = kind


# What can be wrong with text that should be canonical.
KINDS = ("Syntax", "Eof", "Trailing", "Token", "Str", "Integer", "UnknownField", "MissingField", "Unsorted", "RationalNotReduced", "Unnormalized", "Policy")

_ESCAPED = re.compile(r'\\(?:(["\\])|u00([01][0-9a-f])|(.?))', re.DOTALL)
_INTEGER = re.compile(r"\A(?:0|-?[1-9][0-9]*)\Z")
_NAME = re.compile(r"\A[a-z0-9_:./-]+\Z")


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        if self.at >= len(self.text):
            raise ReadError("Eof")
        return self.text[self.at]

    def expect(self, sign: str) -> None:
        if self.peek() != sign:
            raise ReadError("Syntax", sign)
        self.at += 1

    def value_start(self, sign: str) -> None:
        """A value of another JSON type is a token where none may be."""
        c = self.peek()
        if c != sign and (c in "-0123456789" or self.text.startswith(("null", "true", "false"), self.at)):
            raise ReadError("Token", c)
        self.expect(sign)

    def string(self) -> str:
        self.value_start('"')
        out = []
        while True:
            c = self.peek()
            if c == '"':
                self.at += 1
                return "".join(out)
            if c < " ":
                raise ReadError("Str", "control")
            if c != "\\":
                out.append(c)
                self.at += 1
                continue
            m = _ESCAPED.match(self.text, self.at)
            if m[1] is None and m[2] is None:
                raise ReadError("Str", "escape")
            out.append(m[1] if m[1] is not None else chr(int(m[2], 16)))
            self.at = m.end()


def _read(r: _Reader, kind: Any) -> Any:
    """kind: "string", "name", "folded", "integer", "rational", [kind], {kind} as ("set", kind), a dict of
    members (an optional one has a name that ends in ?), or ("map", kind)."""
    if kind in ("string", "name", "folded", "integer"):
        text = r.string()
        if kind == "integer":
            if not _INTEGER.match(text):
                raise ReadError("Integer", text)
            return int(text)
        if kind == "name" and not _NAME.match(text):
            raise ReadError("Policy", text)
        if kind == "folded":
            from concordat.sources.registry import fold_ja

            if fold_ja(text) != text:
                raise ReadError("Unnormalized", text)
        return text
    if kind == "rational":
        from math import gcd

        got = _read(r, {"den": "integer", "num": "integer"})
        if got["den"] <= 0 or gcd(got["num"], got["den"]) != 1:
            raise ReadError("RationalNotReduced")
        return got
    if isinstance(kind, list) or (isinstance(kind, tuple) and kind[0] == "set"):
        inner, ordered = (kind[0], False) if isinstance(kind, list) else (kind[1], True)
        out, last = [], None
        r.value_start("[")
        while r.peek() != "]":
            if out:
                r.expect(",")
            begin = r.at
            out.append(_read(r, inner))
            mark = r.text[begin : r.at].encode()
            if ordered and last is not None and mark <= last:
                raise ReadError("Unsorted")
            last = mark
        r.at += 1
        return out
    r.value_start("{")
    found: dict[str, Any] = {}
    if isinstance(kind, tuple):  # a map by name
        while r.peek() != "}":
            if found:
                r.expect(",")
            name = r.string()
            if found and name.encode() <= max(found, key=str.encode).encode():
                raise ReadError("Unsorted", name)
            r.expect(":")
            found[name] = _read(r, kind[1])
        r.at += 1
        return found
    names = sorted(kind, key=lambda n: n.rstrip("?").encode())
    while r.peek() != "}":
        if found:
            r.expect(",")
        name = r.string()
        while names and names[0].rstrip("?") != name and names[0].endswith("?"):
            names.pop(0)
        if not names or names[0].rstrip("?") != name:
            raise ReadError("MissingField" if any(n.rstrip("?") == name for n in names) else "UnknownField", name)
        r.expect(":")
        found[name] = _read(r, kind[names.pop(0)])
    if any(not n.endswith("?") for n in names):
        raise ReadError("MissingField", names[0])
    r.at += 1
    return found


def read_typed(text: str, kind: Any) -> Any:
    """The value of the canonical text of a type; ReadError says what is wrong first."""
    r = _Reader(text)
    out = _read(r, kind)
    if r.at < len(text):
        raise ReadError("Trailing")
    return out


def read_errors(df: Any, column: str, kind: Any, out: str = "error") -> Any:
    """df with the kind of error that reading a text column as a type meets first, null for none. A
    narrow stage in Arrow batches: reading is a recursive descent that no expression says."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from concordat.session import in_arrow

    names = [c for c in df.columns if c != out]
    at = names.index(column)

    def run(batches):
        for batch in batches:
            found = []
            for x in batch.column(at).to_pylist():
                try:
                    if x is None:
                        raise ReadError("Eof")
                    read_typed(x, kind)
                    found.append(None)
                except ReadError as e:
                    found.append(e.kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*names, out])

    kept = df.select(*names)
    return kept.transform(in_arrow, run, T.StructType([*kept.schema, T.StructField(out, T.StringType())]))


def policy_hash(ident: str, version: str) -> str:
    """The content hash of a policy's descriptor."""
    import hashlib

    return "sha256:" + hashlib.sha256(emit({"id": ident, "version": version}).encode()).hexdigest()
