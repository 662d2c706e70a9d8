"""One file: cross-reference sections, objects, page tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, NamedTuple

from .crypt import Crypt
from .filters import FilterFault, chain, decode, status_of
from .syntax import Name, Operator, Reader, Ref, Stream, SyntaxFault, is_end

#: A file may name at most so many objects.
MAX_OBJECTS = 10_000_000


class Entry(NamedTuple):
    num: int
    gen: int
    kind: str  # offset, objstm or free
    offset: int
    stream: int
    index: int
    rank: int  # 0 for the newest section


class Fault(ValueError):
    """A file that cannot be opened; the message is its status."""


@dataclass
class Box:
    x0: float
    y0: float
    x1: float
    y1: float


@dataclass
class Page:
    index: int
    num: int
    dict: dict
    media: Box
    crop: Box
    rotate: int
    resources: dict = field(default_factory=dict)

    @property
    def size(self) -> tuple[float, float]:
        """Width and height as shown."""
        w, h = self.crop.x1 - self.crop.x0, self.crop.y1 - self.crop.y0
        return (h, w) if self.rotate in (90, 270) else (w, h)


def num(v: Any, default: float = 0.0) -> float:
    return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else default


def box(v: Any) -> Box | None:
    if not isinstance(v, list) or len(v) != 4:
        return None
    a, b, c, d = (num(x) for x in v)
    return Box(min(a, c), min(b, d), max(a, c), max(b, d))


class Document:
    """Parsed lazily; objects are kept once read."""

    def __init__(self, data: bytes):
        self.data = data
        self.entries: list[Entry] = []
        self.table: dict[int, Entry] = {}
        self.trailer: dict = {}
        self.cache: dict[int, Any] = {}
        self.reading: set[int] = set()
        self.streams: dict[int, list[tuple[int, Any]]] = {}
        self.crypt: Crypt | None = None
        self._load()
        encrypt = self.get(self.trailer.get("Encrypt"))
        if isinstance(encrypt, dict):
            ids = self.get(self.trailer.get("ID"))
            first = self.get(ids[0]) if isinstance(ids, list) and ids else b""
            encrypt = {k: self.get(v) for k, v in encrypt.items()}
            self.encrypt_num = self.trailer["Encrypt"].num if isinstance(self.trailer["Encrypt"], Ref) else -1
            self.cache, self.streams = {}, {}
            self.crypt = Crypt(encrypt, first if isinstance(first, bytes) else b"")

    # cross references

    def _load(self) -> None:
        at = self.data.rfind(b"startxref", max(0, len(self.data) - 2048))
        m = re.compile(rb"startxref[\x00\t\n\x0c\r ]*(\d+)").match(self.data, at) if at >= 0 else None
        if not m:
            raise Fault("BADARG")
        todo, seen, rank = [int(m[1])], set(), 0
        while todo:
            offset = todo.pop(0)
            if offset in seen or not 0 <= offset < len(self.data):
                if not rank:
                    raise Fault("BADARG")
                continue
            seen.add(offset)
            found = self._section(offset, rank)
            if found is None:
                if not rank:
                    raise Fault("SYNTAX")
                continue
            trailer, entries = found
            hybrid = trailer.get("XRefStm")
            if isinstance(hybrid, int) and hybrid not in seen and 0 <= hybrid < len(self.data):
                seen.add(hybrid)
                extra = self._section(hybrid, rank)
                if extra:  # a section's own stream comes before what its table says is free
                    kept = {e.num for e in entries if e.kind != "free"}
                    own = [e for e in extra[1] if e.num not in kept]
                    entries = [e for e in entries if e.kind != "free" or e.num not in {x.num for x in own}] + own
            self.entries += entries
            for e in entries:
                self.table.setdefault(e.num, e)
            if not rank:
                self.trailer = dict(trailer)
            else:
                for k, v in trailer.items():
                    self.trailer.setdefault(k, v)
            if isinstance(trailer.get("Prev"), int):
                todo.append(trailer["Prev"])
            rank += 1
        size = self.trailer.get("Size")
        if isinstance(size, int):
            self.table = {n: e for n, e in self.table.items() if n < size}

    def _section(self, offset: int, rank: int) -> tuple[dict, list[Entry]] | None:
        reader = Reader(self.data, offset)
        reader.blank()
        if self.data.startswith(b"xref", reader.pos):
            return self._classic(reader.pos + 4, rank)
        try:
            _, _, v = self.indirect(reader.pos, None)
        except (SyntaxFault, Fault):
            return None
        return self._xref_stream(v, rank) if isinstance(v, Stream) else None

    def _classic(self, at: int, rank: int) -> tuple[dict, list[Entry]] | None:
        head = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]*")
        row = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+([nf])")
        out: list[Entry] = []
        while m := head.match(self.data, at):
            first, count, at = int(m[1]), int(m[2]), m.end()
            if first + count > MAX_OBJECTS:
                return None
            for i in range(count):
                r = row.match(self.data, at)
                if not r:
                    return None
                at = r.end()
                out.append(Entry(first + i, int(r[2]), "offset" if r[3] == b"n" else "free", int(r[1]), -1, -1, rank))
        reader = Reader(self.data, at)
        if reader.value() != Operator("trailer"):
            return None
        trailer = reader.value()
        return (trailer, out) if isinstance(trailer, dict) else None

    def _xref_stream(self, v: Stream, rank: int) -> tuple[dict, list[Entry]] | None:
        try:
            raw = decode(v.raw, chain(v.dict))
        except FilterFault:
            return None
        widths = v.dict.get("W")
        if not isinstance(widths, list) or len(widths) < 3 or not all(isinstance(x, int) and 0 <= x <= 8 for x in widths[:3]):
            return None
        size = v.dict.get("Size", 0)
        index = v.dict.get("Index") or [0, size]
        step, at, out = sum(widths[:3]), 0, []
        a, b = widths[0], widths[0] + widths[1]
        for first, count in zip(index[::2], index[1::2], strict=False):
            for i in range(count):
                row = raw[at : at + step]
                if len(row) < step or not step:
                    break
                at += step
                kind = int.from_bytes(row[:a], "big") if a else 1
                x, y = int.from_bytes(row[a:b], "big"), int.from_bytes(row[b:], "big")
                if kind == 0:
                    out.append(Entry(first + i, y, "free", x, -1, -1, rank))
                elif kind == 1:
                    out.append(Entry(first + i, y, "offset", x, -1, -1, rank))
                elif kind == 2:
                    out.append(Entry(first + i, 0, "objstm", -1, x, y, rank))
        return v.dict, out

    # objects

    def indirect(self, offset: int, crypt: Crypt | None) -> tuple[int, int, Any]:
        """(number, generation, value) of the object at an offset."""
        reader = Reader(self.data, offset)
        head = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj").match(self.data, offset)
        if not head:
            raise SyntaxFault("no object here")
        reader.pos = head.end()
        v = reader.value()
        v = None if is_end(v) or isinstance(v, Operator) else v
        n, g = int(head[1]), int(head[2])
        m = re.compile(rb"[\x00\t\n\x0c\r ]*stream(\r\n|\n|\r)?").match(self.data, reader.pos) if isinstance(v, dict) else None
        if m:
            start = m.end()
            length = v.get("Length")
            length = self.get(length) if isinstance(length, Ref) else length
            end = start + length if isinstance(length, int) and length >= 0 else -1
            if end < 0 or not re.compile(rb"[\x00\t\n\x0c\r ]*endstream").match(self.data, end):
                end = self.data.find(b"endstream", start)
                end = len(self.data) if end < 0 else end
                while end > start and self.data[end - 1 : end] in (b"\n", b"\r") and end > start:
                    end -= 1
            raw = self.data[start:end]
            if crypt and v.get("Type") != "XRef" and n != getattr(self, "encrypt_num", -1):
                raw = crypt.decrypt(n, g, raw)
            v = Stream(v, raw, start)
        return n, g, v

    def object(self, n: int, gen: int | None = None) -> Any:
        """An object by number; None if there is none, it is free, or of another generation."""
        entry = self.table.get(n)
        if entry is None or entry.kind == "free" or gen is not None and entry.gen != gen:
            return None
        if n in self.cache:
            return self.cache[n]
        if n in self.reading:
            return None
        self.reading.add(n)
        try:
            if entry.kind == "offset":
                found, _, v = self.indirect(entry.offset, self.crypt)
                v = v if found == n else None
            else:
                v = self._from_stream(entry)
        except (SyntaxFault, FilterFault, RecursionError):
            v = None
        finally:
            self.reading.discard(n)
        self.cache[n] = v
        return v

    def _from_stream(self, entry: Entry) -> Any:
        if entry.stream not in self.streams:
            holder = self.object(entry.stream)
            self.streams[entry.stream] = []
            if isinstance(holder, Stream):
                raw = decode(holder.raw, chain(holder.dict, self.get), self.get)
                first, count = self.get(holder.dict.get("First", 0)), self.get(holder.dict.get("N", 0))
                reader, pairs = Reader(raw, 0, references=False), []
                for _ in range(min(count, 200_000)):
                    a, b = reader.value(), reader.value()
                    if not isinstance(a, int) or not isinstance(b, int):
                        break
                    pairs.append((a, b))
                for a, b in pairs:
                    v = Reader(raw, first + b).value()
                    self.streams[entry.stream].append((a, None if is_end(v) or isinstance(v, Operator) else v))
        held = self.streams[entry.stream]
        if 0 <= entry.index < len(held) and held[entry.index][0] == entry.num:
            return held[entry.index][1]
        return next((v for a, v in held if a == entry.num), None)

    def get(self, v: Any) -> Any:
        """A value, with a reference followed."""
        for _ in range(32):
            if not isinstance(v, Ref):
                return v
            v = self.object(v.num, v.gen)
        return None

    def stream_bytes(self, v: Any) -> bytes:
        v = self.get(v)
        return decode(v.raw, chain(v.dict, self.get), self.get) if isinstance(v, Stream) else b""

    # pages

    def root(self) -> dict:
        v = self.get(self.trailer.get("Root"))
        return v if isinstance(v, dict) else {}

    def declared_pages(self) -> int:
        v = self.get(self.root().get("Pages"))
        return int(num(self.get(v.get("Count")))) if isinstance(v, dict) else 0

    def pages(self) -> Iterator[Page]:
        """Leaves of the page tree in order; boxes, rotation and resources come from the nearest ancestor."""
        top = self.root().get("Pages")
        stack, seen, index = [(top, {})], set(), 0
        while stack:
            ref, held = stack.pop()
            node = self.get(ref)
            key = ref.num if isinstance(ref, Ref) else id(node)
            if not isinstance(node, dict) or key in seen:
                continue
            seen.add(key)
            held = {**held, **{k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if node.get(k) is not None}}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                stack += [(k, held) for k in reversed(kids)]
                continue
            media = box([self.get(x) for x in self.get(held.get("MediaBox")) or []]) or Box(0.0, 0.0, 612.0, 792.0)
            crop = box([self.get(x) for x in self.get(held.get("CropBox")) or []])
            if crop:
                crop = Box(max(crop.x0, media.x0), max(crop.y0, media.y0), min(crop.x1, media.x1), min(crop.y1, media.y1))
            if not crop or crop.x1 <= crop.x0 or crop.y1 <= crop.y0:
                crop = media
            turn = ((int(num(self.get(held.get("Rotate")))) % 360 + 45) // 90 * 90) % 360
            resources = self.get(held.get("Resources"))
            yield Page(index, ref.num if isinstance(ref, Ref) else 0, node, media, crop, turn, resources if isinstance(resources, dict) else {})
            index += 1

    def content(self, page: Page) -> bytes:
        return self.content_and_status(page)[0]

    def content_and_status(self, page: Page) -> tuple[bytes, str]:
        """The page's content streams, decoded and joined, and OK; or the status of the last one that fails, which
        is left out."""
        parts = self.get(page.dict.get("Contents"))
        out, status = [], "OK"
        for p in parts if isinstance(parts, list) else [parts]:
            try:
                out.append(self.stream_bytes(p))
            except FilterFault as e:
                status = status_of(e)
        return b"\n".join(out), status

    def inherited(self, node: dict, ref: Ref | None, key: str) -> tuple[Any, Ref | None]:
        """(value, owner) of a field's attribute, its own or that of the nearest of 32 ancestors."""
        for _ in range(33):
            if node.get(key) is not None:
                return self.get(node[key]), ref
            up = node.get("Parent")
            ref, node = (up if isinstance(up, Ref) else None), self.get(up)
            if not isinstance(node, dict):
                break
        return None, None


def name_of(v: Any) -> str | None:
    return str(v) if isinstance(v, Name) else None
