"""Font programs built here, read back."""

import struct

import numpy as np
import pytest

from quire.sources.document import Document
from quire.sources.outlines import Compact, FontFault, TrueType
from quire.sources.render import render_page
from quire.sources.syntax import Name, Stream
from test_render import page

SQUARE = [(0, 0), (500, 0), (500, 500), (0, 500)]


def area(contours):
    total = 0.0
    for c in contours:
        x, y = np.array(c).T
        total += (x * np.roll(y, -1) - y * np.roll(x, -1)).sum() / 2
    return abs(total)


def simple(contours, off=()):
    raw, ends, points = b"", [], []
    for c in contours:
        points += c
        ends.append(len(points) - 1)
    xs, ys = zip(*points, strict=True)
    raw = struct.pack(">hhhhh", len(contours), min(xs), min(ys), max(xs), max(ys)) + struct.pack(f">{len(ends)}H", *ends) + struct.pack(">H", 0)
    raw += bytes(0 if i in off else 1 for i in range(len(points)))
    for axis in (xs, ys):
        raw += b"".join(struct.pack(">h", b - a) for a, b in zip((0, *axis), axis, strict=False))
    return raw + b"\0" * (len(raw) % 2)


def truetype(kind=4):
    ring = [(500, 0), (500, 500), (0, 500), (0, 0)]  # all four off the curve: a round shape
    part = struct.pack(">hhhhh", -1, 0, 0, 0, 0) + struct.pack(">HHhhh", 1 | 2 | 8 | 32, 1, 100, 50, 8192) + struct.pack(">HHbb", 2, 1, 10, 0)
    glyphs = [b"", simple([SQUARE]), simple([ring], range(4)), part + b"\0" * (len(part) % 2)]
    places = np.cumsum([0, *map(len, glyphs)])
    codes = [(65, 1), (66, 2), (67, 3)]
    if kind == 4:
        ends, starts = struct.pack(">HH", 67, 0xFFFF), struct.pack(">HH", 65, 0xFFFF)
        table = struct.pack(">HHHHHHH", 4, 32, 0, 4, 4, 1, 0) + ends + b"\0\0" + starts + struct.pack(">HH", (1 - 65) & 0xFFFF, 1) + struct.pack(">HH", 0, 0)
    elif kind == 12:
        table = struct.pack(">HHIII", 12, 0, 28, 0, 1) + struct.pack(">III", 65, 67, 1)
    elif kind == 6:
        table = struct.pack(">HHHHH", 6, 16, 0, 65, 3) + struct.pack(">3H", 1, 2, 3)
    else:
        table = struct.pack(">HHH", 0, 262, 0) + bytes(dict(codes).get(c, 0) for c in range(256))
    name = "Made".encode("utf-16-be") + "Bold".encode("utf-16-be")
    tables = {
        b"cmap": struct.pack(">HHHHI", 0, 1, 3, 10 if kind == 12 else 1, 12) + table,
        b"glyf": b"".join(glyphs),
        b"head": struct.pack(">18xH30xhh", 1000, 0, 0),
        b"hhea": struct.pack(">34xH", 2),
        b"hmtx": struct.pack(">HhHh", 0, 0, 600, 0) + b"\0" * 4,
        b"loca": struct.pack(">5H", *(places // 2)),
        b"maxp": struct.pack(">IH", 0x10000, 4),
        b"name": struct.pack(">HHH", 0, 2, 30) + struct.pack(">6H", 3, 1, 0, 1, 8, 0) + struct.pack(">6H", 3, 1, 0, 2, 8, 8) + name,
    }
    out, at = struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0), 12 + 16 * len(tables)
    body = b""
    for tag, raw in tables.items():
        out += struct.pack(">4sIII", tag, 0, at + len(body), len(raw))
        body += raw
    return out + body


@pytest.mark.parametrize("kind", [0, 4, 6, 12])
def test_truetype(kind):
    font = TrueType(truetype(kind))
    assert [font.glyph_of(c) for c in (65, 66, 67, 68)] == [1, 2, 3, 0]
    assert font.outline(1) == [[(x / 1000, y / 1000) for x, y in SQUARE]]
    assert area(font.outline(2)) == pytest.approx(0.25 * 5 / 6, rel=0.01)
    assert font.outline(3)[0][0] == (0.1, 0.05) and area(font.outline(3)[:1]) == pytest.approx(0.0625)
    assert font.outline(3)[1][0] == (0.01, 0.0) and font.outline(0) == font.outline(99) == []
    assert font.advance(1) == font.advance(3) == 0.6 and font.names == {1: "Made", 2: "Bold"}


def test_faults():
    for data in (b"", b"x" * 40, truetype()[:60]):
        with pytest.raises(FontFault):
            TrueType(data)
        with pytest.raises(FontFault):
            Compact(data)


def operand(v):
    return b"\x1c" + struct.pack(">h", v)


def charstring(*items):
    return b"".join(operand(v) if isinstance(v, int) else v for v in items)


RMOVE, RLINE, HLINE, CURVE, END, CALL, SHARED, RETURN = (bytes([b]) for b in (21, 5, 6, 8, 14, 10, 29, 11))


def index(items):
    if not items:
        return b"\0\0"
    places = np.cumsum([1, *map(len, items)])
    return struct.pack(">HB", len(items), 2) + b"".join(struct.pack(">H", p) for p in places) + b"".join(items)


def compact():
    square = charstring(111, 10, 20, RMOVE, 500, 500, -500, HLINE, END)  # width 500 + 111
    called = charstring(0, 0, RMOVE, -107, CALL, END)
    disc = charstring(50, b"\x16", 28, 0, 22, 22, 0, 28, CURVE, 0, 28, -22, 22, -28, 0, CURVE, -28, 0, -22, -22, 0, -28, CURVE, 0, -28, 22, -22, 28, 0, CURVE, END)
    chars = [END, square, called, disc, charstring(5, 1, 2, b"\x12", b"\x13", b"\x80", 0, 0, RMOVE, -107, SHARED, END)]
    local, shared = [charstring(100, 0, 0, 100, -100, 0, RLINE, RETURN)], [charstring(10, 0, 0, 10, RLINE, RETURN)]
    strings = [b"ffi"]
    head, names = b"\1\0\4\2", index([b"Made"])

    def top(charset, encoding, glyphs, private, size):
        return charstring(charset, b"\x0f", encoding, b"\x10", glyphs, b"\x11", size, private, b"\x12")

    private = charstring(700, b"\x14", 500, b"\x15", 12, b"\x13")
    fixed = len(head) + len(names) + len(index([top(0, 0, 0, 0, 0)])) + len(index(strings)) + len(index(shared))
    charset, encoding = b"\0" + struct.pack(">4H", 34, 391, 109, 35), b"\1\1" + bytes([65, 3])
    at = {"charset": fixed, "encoding": fixed + len(charset)}
    at["glyphs"] = at["encoding"] + len(encoding)
    at["private"] = at["glyphs"] + len(index(chars))
    made = top(at["charset"], at["encoding"], at["glyphs"], at["private"], len(private))
    return head + names + index([made]) + index(strings) + index(shared) + charset + encoding + index(chars) + private + index(local)


def test_compact():
    font = Compact(compact())
    assert font.encoding == {65: 1, 66: 2, 67: 3, 68: 4}
    assert font.name_of(66) == "ffi" and font.name_of(67) == "fi" and font.name_of(65) is None and font.name_of(99) is None
    assert np.allclose(font.outline(1)[0], [(0.01, 0.02), (0.51, 0.02), (0.51, 0.52), (0.01, 0.52)])
    assert font.advance(1) == pytest.approx(0.611) and font.advance(2) == pytest.approx(0.7)
    assert area(font.outline(2)) == pytest.approx(0.01)
    assert area(font.outline(3)) == pytest.approx(np.pi * 0.05**2, rel=0.02)
    assert np.allclose(font.outline(4)[0], [(0, 0), (0.01, 0), (0.01, 0.01)]) and font.advance(4) == pytest.approx(0.505)
    assert font.outline(77) == []


@pytest.mark.parametrize(("key", "program"), [("FontFile2", truetype()), ("FontFile3", compact())])
def test_embedded_outlines_are_drawn(key, program):
    descriptor = {"Type": Name("FontDescriptor"), key: None}
    font = {"Type": Name("Font"), "Subtype": Name("TrueType"), "BaseFont": Name("X"), "FirstChar": 65, "Widths": [600], "FontDescriptor": descriptor}
    from quire.sources.writer import Builder

    b = Builder()
    descriptor[key] = b.add(Stream({}, program))
    f, pages = b.add(font), b.add({})
    made = {"Type": Name("Page"), "Contents": b.add(Stream({}, b"BT /F 20 Tf 5 5 Td (A) Tj ET")), "MediaBox": [0, 0, 40, 30], "Resources": {"Font": {"F": f}}}
    b.objects[pages.num] = {"Type": Name("Pages"), "Kids": [b.add(made)], "Count": 1}
    doc = Document(b.build(b.add({"Type": Name("Catalog"), "Pages": pages})))
    got = np.rint(render_page(doc, next(doc.pages())).rgb * 255).astype(int)
    assert 90 <= (got < 128).all(2).sum() <= 110 and (got[17:24, 6:14] == 0).all()
    assert page(b"")
