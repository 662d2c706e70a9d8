"""Font programs: TrueType and compact (CFF) outlines, widths and names, in units of the em.

An outline is a list of closed contours of points. Faulty programs raise FontFault.
"""

from __future__ import annotations

import struct
from functools import cached_property

from .raster import curve

Point = tuple[float, float]
Contours = list[list[Point]]


class FontFault(ValueError):
    pass


def _quadratic(a: Point, b: Point, c: Point) -> list[Point]:
    """Points along a quadratic curve, without its start, by way of the cubic one."""
    third = lambda p, q: (p[0] + 2 / 3 * (q[0] - p[0]), p[1] + 2 / 3 * (q[1] - p[1]))
    return curve(a, third(a, b), third(c, b), c)


class TrueType:
    """Tables are read as they are needed."""

    def __init__(self, data: bytes):
        self.data = data
        try:
            count = struct.unpack_from(">H", data, 4)[0]
            rows = [struct.unpack_from(">4sIII", data, 12 + 16 * i) for i in range(count)]
            self.tables = {tag.decode("latin-1"): data[at : at + size] for tag, _, at, size in rows}
            head = self.tables["head"]
            self.em, self.long_offsets = struct.unpack_from(">H", head, 18)[0] or 1000, struct.unpack_from(">h", head, 50)[0]
            self.glyphs = struct.unpack_from(">H", self.tables["maxp"], 4)[0]
        except (struct.error, KeyError) as e:
            raise FontFault("not a TrueType font") from e

    @cached_property
    def maps(self) -> dict[tuple[int, int], dict[int, int]]:
        """(platform, encoding) to code to glyph, for formats 0, 4, 6 and 12."""
        raw, out = self.tables.get("cmap", b""), {}
        try:
            for i in range(struct.unpack_from(">H", raw, 2)[0]):
                platform, encoding, at = struct.unpack_from(">HHI", raw, 4 + 8 * i)
                out[platform, encoding] = self._map(raw, at)
        except struct.error:
            pass
        return out

    def _map(self, raw: bytes, at: int) -> dict[int, int]:
        kind = struct.unpack_from(">H", raw, at)[0]
        if kind == 0:
            return {c: g for c, g in enumerate(raw[at + 6 : at + 262]) if g}
        if kind == 6:
            first, n = struct.unpack_from(">HH", raw, at + 6)
            return {first + i: g for i, g in enumerate(struct.unpack_from(f">{n}H", raw, at + 10)) if g}
        if kind == 12:
            out: dict[int, int] = {}
            for i in range(struct.unpack_from(">I", raw, at + 12)[0]):
                a, b, g = struct.unpack_from(">III", raw, at + 16 + 12 * i)
                out.update((c, g + c - a) for c in range(a, min(b, a + 0xFFFF) + 1))
            return out
        if kind != 4:
            return {}
        n = struct.unpack_from(">H", raw, at + 6)[0] // 2
        ends, starts = struct.unpack_from(f">{n}H", raw, at + 14), struct.unpack_from(f">{n}H", raw, at + 16 + 2 * n)
        deltas, places = struct.unpack_from(f">{n}H", raw, at + 16 + 4 * n), struct.unpack_from(f">{n}H", raw, at + 16 + 6 * n)
        out = {}
        for i, (a, b, delta, place) in enumerate(zip(starts, ends, deltas, places, strict=True)):
            for c in range(a, b + 1):
                if c == 0xFFFF:
                    continue
                g = c
                if place:
                    where = at + 16 + 6 * n + 2 * i + place + 2 * (c - a)
                    g = struct.unpack_from(">H", raw, where)[0] if where + 2 <= len(raw) else 0
                    if not g:
                        continue
                if g := (g + delta) & 0xFFFF:
                    out[c] = g
        return out

    def glyph_of(self, unicode: int, code: int | None = None) -> int:
        """The glyph of a character, or of a code of a symbol font (its own codes, or those from F000)."""
        for key in ((3, 10), (0, 4), (0, 6), (3, 1), (0, 3), (0, 1), (0, 0)):
            if g := self.maps.get(key, {}).get(unicode):
                return g
        if code is not None:
            for key in ((3, 0), (1, 0)):
                held = self.maps.get(key, {})
                if g := held.get(code) or held.get(0xF000 + code):
                    return g
        return 0

    def advance(self, glyph: int) -> float:
        try:
            n = struct.unpack_from(">H", self.tables["hhea"], 34)[0]
            return struct.unpack_from(">H", self.tables["hmtx"], 4 * min(glyph, n - 1))[0] / self.em
        except (struct.error, KeyError):
            return 0.0

    @cached_property
    def names(self) -> dict[int, str]:
        """Entries of the name table by number; 1 is the family and 2 the style."""
        raw, out = self.tables.get("name", b""), {}
        try:
            count, base = struct.unpack_from(">HH", raw, 2)
            for i in range(count):
                platform, _, _, number, size, at = struct.unpack_from(">6H", raw, 6 + 12 * i)
                text = raw[base + at : base + at + size].decode("utf-16-be" if platform in (0, 3) else "latin-1", "replace")
                if text:
                    out.setdefault(number, text)
        except struct.error:
            pass
        return out

    def _raw(self, glyph: int) -> bytes:
        kind = ">II" if self.long_offsets else ">HH"
        a, b = struct.unpack_from(kind, self.tables["loca"], glyph * struct.calcsize(kind) // 2)
        by = 1 if self.long_offsets else 2
        return self.tables["glyf"][a * by : b * by]

    def outline(self, glyph: int, depth: int = 0) -> Contours:
        """The contours of a glyph; parts of composite ones are placed by their matrices, at most six deep."""
        if not 0 <= glyph < self.glyphs or depth > 6:
            return []
        try:
            raw = self._raw(glyph)
            if len(raw) < 10:
                return []
            n = struct.unpack_from(">h", raw)[0]
            return self._simple(raw, n) if n >= 0 else self._composite(raw, depth)
        except (struct.error, KeyError, IndexError) as e:
            raise FontFault("bad glyph") from e

    def _simple(self, raw: bytes, n: int) -> Contours:
        ends = struct.unpack_from(f">{n}H", raw, 10)
        if not ends:
            return []
        at = 10 + 2 * n
        at += 2 + struct.unpack_from(">H", raw, at)[0]
        count, flags = ends[-1] + 1, []
        while len(flags) < count:
            f, at = raw[at], at + 1
            flags.append(f)
            if f & 8:
                flags += [f] * raw[at]
                at += 1
        axes = []
        for short, same in ((2, 16), (4, 32)):
            v, values = 0, []
            for f in flags[:count]:
                if f & short:
                    v += raw[at] if f & same else -raw[at]
                    at += 1
                elif not f & same:
                    v += struct.unpack_from(">h", raw, at)[0]
                    at += 2
                values.append(v / self.em)
            axes.append(values)
        out, first = [], 0
        for end in ends:
            points = [(axes[0][i], axes[1][i], bool(flags[i] & 1)) for i in range(first, end + 1)]
            first = end + 1
            if len(points) > 1:
                out.append(self._contour(points))
        return out

    @staticmethod
    def _contour(points: list[tuple[float, float, bool]]) -> list[Point]:
        """Points on and off the curve, with those between two off it put in, flattened."""
        full: list[tuple[float, float, bool]] = []
        for i, p in enumerate(points):
            before = points[i - 1]
            if not p[2] and not before[2]:
                full.append(((p[0] + before[0]) / 2, (p[1] + before[1]) / 2, True))
            full.append(p)
        start = next(i for i, p in enumerate(full) if p[2])
        full = full[start:] + full[:start] + [full[start]]
        out, i = [full[0][:2]], 1
        while i < len(full):
            if full[i][2]:
                out.append(full[i][:2])
                i += 1
            else:
                out += _quadratic(out[-1], full[i][:2], full[i + 1][:2])
                i += 2
        return out[:-1]

    def _composite(self, raw: bytes, depth: int) -> Contours:
        out, at, flags = [], 10, 32
        while flags & 32:
            flags, glyph = struct.unpack_from(">HH", raw, at)
            at += 4
            dx, dy = struct.unpack_from(">hh" if flags & 1 else ">bb", raw, at)
            at += 4 if flags & 1 else 2
            a, b, c, d = 1.0, 0.0, 0.0, 1.0
            if flags & 8:
                a = d = struct.unpack_from(">h", raw, at)[0] / 16384
                at += 2
            elif flags & 64:
                a, d = (v / 16384 for v in struct.unpack_from(">hh", raw, at))
                at += 4
            elif flags & 128:
                a, b, c, d = (v / 16384 for v in struct.unpack_from(">4h", raw, at))
                at += 8
            dx, dy = (dx / self.em, dy / self.em) if flags & 2 else (0.0, 0.0)
            out += [[(a * x + c * y + dx, b * x + d * y + dy) for x, y in contour] for contour in self.outline(glyph, depth + 1)]
        return out


#: Numbers of standard strings that subset fonts use for their own codes.
STANDARD_NAMES = {
    8: "quoteright", 65: "quoteleft", 105: "quotedblleft", 109: "fi", 110: "fl", 111: "endash", 116: "bullet", 119: "quotedblright",
    121: "ellipsis", 137: "emdash", 140: "Lslash", 145: "dotlessi", 146: "lslash", 149: "germandbls", 153: "trademark", 159: "divide",
    165: "registered", 166: "minus", 168: "multiply", 170: "copyright",
}


class Compact:
    """A CFF font that is not keyed by character identifiers (such ones map codes to glyphs one to one)."""

    def __init__(self, data: bytes):
        self.data = data
        try:
            at = data[2]
            _, at = self._index(at)
            tops, at = self._index(at)
            self.strings, at = self._index(at)
            self.shared, _ = self._index(at)
            top = self._dict(tops[0])
            self.chars, _ = self._index(int(top[17][0]))
            self.keyed = (12, 30) in top
            size, place = (int(v) for v in top.get(18, [0, 0]))
            private = self._dict(data[place : place + size])
            self.subroutines = self._index(place + int(private[19][0]))[0] if 19 in private else []
            self.default, self.nominal = private.get(20, [0])[0], private.get(21, [0])[0]
            self.scale = top.get((12, 7), [0.001])[0]
            self.charset = self._charset(int(top.get(15, [0])[0]))
            self.encoding = self._encoding(int(top.get(16, [0])[0]))
        except (IndexError, KeyError, struct.error, ValueError) as e:
            raise FontFault("not a compact font") from e

    def _index(self, at: int) -> tuple[list[bytes], int]:
        count = struct.unpack_from(">H", self.data, at)[0]
        if not count:
            return [], at + 2
        size = self.data[at + 2]
        places = [int.from_bytes(self.data[at + 3 + size * i : at + 3 + size * (i + 1)], "big") for i in range(count + 1)]
        base = at + 2 + size * (count + 1)
        if size not in (1, 2, 3, 4) or any(a > b for a, b in zip(places, places[1:], strict=False)):
            raise FontFault("bad index")
        return [self.data[base + a : base + b] for a, b in zip(places, places[1:], strict=False)], base + places[-1]

    @staticmethod
    def _dict(raw: bytes) -> dict:
        out: dict = {}
        held: list[float] = []
        at = 0
        while at < len(raw):
            b, at = raw[at], at + 1
            if b <= 21:
                key: int | tuple[int, int] = b
                if b == 12:
                    key, at = (12, raw[at]), at + 1
                out[key], held = held, []
            elif b == 28:
                held.append(struct.unpack_from(">h", raw, at)[0])
                at += 2
            elif b == 29:
                held.append(struct.unpack_from(">i", raw, at)[0])
                at += 4
            elif b == 30:
                text = ""
                while not text.endswith("f"):
                    text += raw[at : at + 1].hex()
                    at += 1
                text = text[: text.index("f")]
                held.append(float(text.replace("c", "E-").replace("a", ".").replace("b", "E").replace("e", "-") or 0))
            elif b <= 246:
                held.append(b - 139)
            elif b <= 250:
                held.append((b - 247) * 256 + raw[at] + 108)
                at += 1
            elif b <= 254:
                held.append(-(b - 251) * 256 - raw[at] - 108)
                at += 1
        return out

    def _charset(self, at: int) -> list[int]:
        """The string number of each glyph."""
        n = len(self.chars)
        if at <= 2:
            return list(range(n))
        kind, at, out = self.data[at], at + 1, [0]
        while len(out) < n:
            first = struct.unpack_from(">H", self.data, at)[0]
            at += 2
            if kind == 0:
                out.append(first)
                continue
            left = self.data[at] if kind == 1 else struct.unpack_from(">H", self.data, at)[0]
            at += 1 if kind == 1 else 2
            out += range(first, first + left + 1)
        return out[:n]

    def _encoding(self, at: int) -> dict[int, int]:
        """Code to glyph; the predefined encoding holds the printable ASCII codes, by their string numbers."""
        if at <= 1:
            by = {s: g for g, s in enumerate(self.charset)}
            return {c: by[c - 31] for c in range(32, 127) if c - 31 in by}
        kind, count, at, out, glyph = self.data[at] & 127, self.data[at + 1], at + 2, {}, 1
        for _ in range(count):
            if kind == 0:
                out[self.data[at]] = glyph
                at, glyph = at + 1, glyph + 1
            else:
                first, left = self.data[at], self.data[at + 1]
                at += 2
                for c in range(first, first + left + 1):
                    out[c] = glyph
                    glyph += 1
        return out

    def name_of(self, code: int) -> str | None:
        """The name of a code's glyph, as far as it is the font's own string or one of STANDARD_NAMES."""
        glyph = self.encoding.get(code)
        if glyph is None or self.keyed or glyph >= len(self.charset):
            return None
        number = self.charset[glyph]
        if number >= 391:
            return self.strings[number - 391].decode("latin-1") if number - 391 < len(self.strings) else None
        return STANDARD_NAMES.get(number)

    def glyph_of(self, code: int) -> int:
        return code if self.keyed else self.encoding.get(code, 0)

    def advance(self, glyph: int) -> float:
        return self._run(glyph)[1] * self.scale

    def outline(self, glyph: int) -> Contours:
        return self._run(glyph)[0]

    def _run(self, glyph: int) -> tuple[Contours, float]:
        """(contours, width in font units) by the operators of type 2 charstrings."""
        if not 0 <= glyph < len(self.chars):
            return [], 0.0
        pen = _Pen(self.scale)
        try:
            self._execute(self.chars[glyph], pen, 0)
        except (IndexError, struct.error) as e:
            raise FontFault("bad charstring") from e
        return pen.contours(), self.default if pen.width is None else self.nominal + pen.width

    def _execute(self, raw: bytes, pen: _Pen, depth: int) -> bool:
        """Run a charstring; True if it ended the glyph."""
        if depth > 10:
            raise FontFault("nested too deep")
        at, stack = 0, pen.stack
        while at < len(raw):
            b, at = raw[at], at + 1
            if b >= 32 or b == 28:
                if b == 28:
                    stack.append(struct.unpack_from(">h", raw, at)[0])
                    at += 2
                elif b <= 246:
                    stack.append(b - 139)
                elif b <= 250:
                    stack.append((b - 247) * 256 + raw[at] + 108)
                    at += 1
                elif b <= 254:
                    stack.append(-(b - 251) * 256 - raw[at] - 108)
                    at += 1
                else:
                    stack.append(struct.unpack_from(">i", raw, at)[0] / 65536)
                    at += 4
                continue
            if b in (10, 29):
                held = self.subroutines if b == 10 else self.shared
                bias = 107 if len(held) < 1240 else 1131 if len(held) < 33900 else 32768
                number = int(stack.pop()) + bias
                if not 0 <= number < len(held):
                    raise FontFault("no such subroutine")
                if self._execute(held[number], pen, depth + 1):
                    return True
            elif b == 11:
                return False
            elif b == 14:
                pen.take_width(len(stack) in (1, 5))
                return True
            elif b in (1, 3, 18, 23):
                pen.hint()
            elif b in (19, 20):
                pen.hint()
                at += (pen.hints + 7) // 8
            elif b == 12:
                pen.flex(raw[at])
                at += 1
            else:
                pen.draw(b)
                stack.clear()
        return False


class _Pen:
    """The state of a charstring: operands, position, and the contours so far."""

    def __init__(self, scale: float):
        self.stack: list[float] = []
        self.scale, self.x, self.y, self.hints = scale, 0.0, 0.0, 0
        self.width: float | None = None
        self.seen = False
        self.parts: Contours = []

    def contours(self) -> Contours:
        return [[(x * self.scale, y * self.scale) for x, y in p] for p in self.parts if len(p) > 1]

    def take_width(self, extra: bool) -> None:
        """The first operand of the first operator that moves or hints may be a width."""
        if not self.seen and extra:
            self.width = self.stack.pop(0)
        self.seen = True

    def hint(self) -> None:
        self.take_width(len(self.stack) % 2 == 1)
        self.hints += len(self.stack) // 2
        self.stack.clear()

    def line(self, dx: float, dy: float) -> None:
        self.x, self.y = self.x + dx, self.y + dy
        if self.parts:
            self.parts[-1].append((self.x, self.y))

    def bend(self, a: float, b: float, c: float, d: float, e: float, f: float) -> None:
        p = (self.x, self.y)
        q = (p[0] + a, p[1] + b)
        r = (q[0] + c, q[1] + d)
        self.x, self.y = r[0] + e, r[1] + f
        if self.parts:
            self.parts[-1] += curve(p, q, r, (self.x, self.y))

    def move(self, dx: float, dy: float) -> None:
        self.x, self.y = self.x + dx, self.y + dy
        self.parts.append([(self.x, self.y)])

    def draw(self, op: int) -> None:
        s = self.stack
        if op in (21, 22, 4):
            self.take_width(len(s) > (2 if op == 21 else 1))
            self.move(*(s[-2:] if op == 21 else (s[-1], 0) if op == 22 else (0, s[-1])))
        elif op == 5:
            for i in range(0, len(s) - 1, 2):
                self.line(s[i], s[i + 1])
        elif op in (6, 7):
            for i, v in enumerate(s):
                self.line(*((v, 0) if (op == 6) == (i % 2 == 0) else (0, v)))
        elif op == 8:
            for i in range(0, len(s) - 5, 6):
                self.bend(*s[i : i + 6])
        elif op == 24:
            for i in range(0, len(s) - 7, 6):
                self.bend(*s[i : i + 6])
            self.line(*s[-2:])
        elif op == 25:
            for i in range(0, len(s) - 7, 2):
                self.line(s[i], s[i + 1])
            self.bend(*s[-6:])
        elif op in (26, 27):
            extra = s.pop(0) if len(s) % 4 == 1 else 0.0
            for i in range(0, len(s) - 3, 4):
                a, b, c, d = s[i : i + 4]
                self.bend(*((extra, a, b, c, 0, d) if op == 26 else (a, extra, b, c, d, 0)))
                extra = 0.0
        elif op in (30, 31):
            across, i = op == 31, 0
            while i + 4 <= len(s):
                a, b, c, d = s[i : i + 4]
                i += 4
                last = s[i] if len(s) - i == 1 else 0.0
                self.bend(*((a, 0, b, c, last, d) if across else (0, a, b, c, d, last)))
                across = not across

    def flex(self, op: int) -> None:
        s = self.stack
        if op == 35:
            self.bend(*s[:6])
            self.bend(*s[6:12])
        elif op == 34:
            self.bend(s[0], 0, s[1], s[2], s[3], 0)
            self.bend(s[4], 0, s[5], -s[2], s[6], 0)
        elif op == 36:
            self.bend(*s[:4], s[4], 0)
            self.bend(s[5], 0, s[6], s[7], s[8], -(s[1] + s[3] + s[7]))
        elif op == 37:
            dx, dy = s[0] + s[2] + s[4] + s[6] + s[8], s[1] + s[3] + s[5] + s[7] + s[9]
            self.bend(*s[:6])
            self.bend(*s[6:10], *((s[10], -dy) if abs(dx) > abs(dy) else (-dx, s[10])))
        s.clear()
