"""Object syntax: bytes to Python values and back.

Values: None, bool, int, float, bytes (strings), Name, list, dict (names to values, in order), Ref, Stream.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any, NamedTuple


class Name(str):
    """A name, with its escapes resolved."""


class Ref(NamedTuple):
    num: int
    gen: int


@dataclass
class Stream:
    """A dictionary with raw bytes: a slice of the file, or made in memory."""

    dict: dict
    raw: bytes
    offset: int = -1


class Operator(str):
    """A bare word."""


class SyntaxFault(ValueError):
    pass


_BLANK = b"\x00\t\n\x0c\r "
_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_NUMBER = re.compile(rb"[+-]*\d*\.?\d*(?:-\d*)?$")
_REST = re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_INTEGERS = re.compile(rb"\[([0-9\t\n\r ]*)\]")
_STRING = re.compile(rb"[^()\\\r]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_END = object()
_MARKS = {"]": object(), ">>": object(), "}": object()}


def number(word: bytes) -> int | float | None:
    """A number, read as far as it makes sense; None for other words."""
    if not _NUMBER.match(word) or not any(48 <= c <= 57 for c in word):
        return None
    try:
        return float(word) if b"." in word else int(word)
    except ValueError:
        m = re.match(rb"[+-]?[+-]*(\d*\.?\d*)", word)
        sign = -1 if word[:1] == b"-" else 1
        digits = m[1] if m else b""
        return sign * (float(digits) if b"." in digits and digits != b"." else int(digits or 0))


def hex_bytes(body: bytes) -> bytes:
    """A hexadecimal string; other characters are skipped, a last odd digit is followed by a zero."""
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", body)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def unescape_name(word: bytes) -> Name:
    word = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), word) if b"#" in word else word
    return Name(word.decode("latin-1"))


class Reader:
    """Values one after another from a buffer."""

    def __init__(self, data: bytes, pos: int = 0, references: bool = True):
        self.data, self.pos, self.references = data, pos, references

    def blank(self) -> None:
        self.pos = _SKIP.match(self.data, self.pos).end()

    def value(self, depth: int = 0) -> Any:
        """The next value, an Operator, or _END; unexpected words inside containers count as null."""
        if depth > 200:
            raise SyntaxFault("nested too deep")
        self.blank()
        data, at = self.data, self.pos
        if at >= len(data):
            return _END
        c = data[at : at + 1]
        if c == b"/":
            m = _WORD.match(data, at + 1)
            self.pos = m.end() if m else at + 1
            return unescape_name(m[0] if m else b"")
        if c == b"(":
            return self.literal()
        if c == b"<":
            if data[at + 1 : at + 2] == b"<":
                self.pos = at + 2
                return self.dictionary(depth)
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            self.pos = end + 1
            return hex_bytes(data[at + 1 : end])
        if c == b"[":
            if m := _INTEGERS.match(data, at):
                self.pos = m.end()
                return [int(x) for x in m[1].split()]
            self.pos = at + 1
            items = []
            while True:
                v = self.value(depth + 1)
                if v is _END or v is _MARKS["]"]:
                    return items
                if v is _MARKS[">>"] or v is _MARKS["}"]:
                    continue
                items.append(None if isinstance(v, Operator) else v)
        if c == b"]":
            self.pos = at + 1
            return _MARKS["]"]
        if c == b">":
            self.pos = at + (2 if data[at + 1 : at + 2] == b">" else 1)
            return _MARKS[">>"]
        if c in b"{})":
            self.pos = at + 1
            return _MARKS["}"]
        m = _WORD.match(data, at)
        word, self.pos = m[0], m.end()
        v = number(word)
        if v is not None:
            if self.references and isinstance(v, int) and v >= 0 and (r := _REST.match(data, self.pos)):
                self.pos = r.end()
                return Ref(v, int(r[1]))
            return v
        if word in (b"true", b"false"):
            return word == b"true"
        if word == b"null":
            return None
        return Operator(word.decode("latin-1"))

    def dictionary(self, depth: int) -> dict:
        out: dict = {}
        while True:
            key = self.value(depth + 1)
            if key is _END or key is _MARKS[">>"]:
                return out
            if not isinstance(key, Name):
                continue
            v = self.value(depth + 1)
            if v is _END or v is _MARKS[">>"]:
                out[str(key)] = None
                return out
            out[str(key)] = None if isinstance(v, Operator) or v in _MARKS.values() else v

    def literal(self) -> bytes:
        data, at, level, out = self.data, self.pos + 1, 1, []
        while at < len(data):
            m = _STRING.match(data, at)
            if m:
                out.append(m[0])
                at = m.end()
                continue
            c = data[at : at + 1]
            at += 1
            if c == b"(":
                level += 1
            elif c == b")":
                level -= 1
                if not level:
                    break
            elif c == b"\r":
                at += data[at : at + 1] == b"\n"
                out.append(b"\n")
                continue
            elif c == b"\\":
                m = re.compile(rb"[0-7]{1,3}").match(data, at)
                if m:
                    out.append(bytes([int(m[0], 8) & 255]))
                    at = m.end()
                    continue
                e = data[at : at + 1]
                at += 1
                if e == b"\r":
                    at += data[at : at + 1] == b"\n"
                elif e != b"\n":
                    out.append(_ESCAPES.get(e, e))
                continue
            out.append(c)
        self.pos = at
        return b"".join(out)


def is_end(v: Any) -> bool:
    return v is _END


def is_mark(v: Any) -> bool:
    return any(v is m for m in _MARKS.values())


def real(v: float) -> str:
    return f"{v:.6f}"


def serialise(v: Any) -> bytes:
    """A value in file syntax; reals with six decimals, names and strings escaped."""
    if v is None:
        return b"null"
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, Ref):
        return b"%d %d R" % v
    if isinstance(v, int):
        return b"%d" % v
    if isinstance(v, float):
        return real(v).encode()
    if isinstance(v, bytes):
        return b"(" + re.sub(rb"([()\\])", rb"\\\1", v).replace(b"\r", b"\\r") + b")"
    if isinstance(v, Name):
        return b"/" + re.sub(rb"[^!-~]|[#()<>\[\]{}/%]", lambda m: b"#%02X" % m[0][0], str(v).encode("latin-1"))
    if isinstance(v, list):
        if set(map(type, v)) == {int}:
            return b"[" + " ".join(map(str, v)).encode() + b"]"
        return b"[" + b" ".join(serialise(x) for x in v) + b"]"
    if isinstance(v, dict):
        return b"<<" + b" ".join(serialise(Name(k)) + b" " + serialise(x) for k, x in v.items()) + b">>"
    if isinstance(v, Stream):
        return serialise({**v.dict, "Length": len(v.raw)}) + b"\nstream\n" + v.raw + b"\nendstream"
    raise TypeError(type(v).__name__)


def plain(v: Any) -> Any:
    """A value for JSON: names as /name, strings as hex:..., references as [num, gen] under a tag."""
    if isinstance(v, Name):
        return "/" + v
    if isinstance(v, bytes):
        return "hex:" + v.hex()
    if isinstance(v, Ref):
        return {"$ref": [v.num, v.gen]}
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, Stream):
        return plain(v.dict)
    return v
