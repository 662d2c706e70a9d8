"""Content streams: operations, and the positioned glyphs they show."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any, NamedTuple

from .document import Document, Page, num
from .filters import FilterFault
from .fonts import Font
from .syntax import Name, Operator, Reader, Stream, is_end, is_mark

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: Saved states and nested forms beyond these depths are ignored.
MAX_STATES, MAX_FORMS = 32, 16


def times(m: Matrix, n: Matrix) -> Matrix:
    """m followed by n."""
    return (
        m[0] * n[0] + m[1] * n[2],
        m[0] * n[1] + m[1] * n[3],
        m[2] * n[0] + m[3] * n[2],
        m[2] * n[1] + m[3] * n[3],
        m[4] * n[0] + m[5] * n[2] + n[4],
        m[4] * n[1] + m[5] * n[3] + n[5],
    )


def operations(data: bytes) -> Iterator[tuple[str, list[Any]]]:
    """(operator, operands); an inline image is BI with its dictionary and bytes."""
    reader, args = Reader(data, 0, references=False), []
    while True:
        v = reader.value()
        if is_end(v):
            return
        if is_mark(v):
            continue
        if not isinstance(v, Operator):
            args.append(v)
            continue
        if v == "BI":
            yield "BI", [*_inline_image(reader)]
        else:
            yield str(v), args
        args = []


def _inline_image(reader: Reader) -> tuple[dict, bytes]:
    keys: dict = {}
    while True:
        k = reader.value()
        if is_end(k) or isinstance(k, Operator):
            break
        v = reader.value()
        if isinstance(k, Name):
            keys[str(k)] = None if isinstance(v, Operator) or is_mark(v) or is_end(v) else v
    start = reader.pos + 1
    m = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|\Z)").search(reader.data, start)
    reader.pos = m.end() if m else len(reader.data)
    return keys, reader.data[start : m.start() if m else len(reader.data)]


class Glyph(NamedTuple):
    unicode: int
    code: int
    x0: float
    y0: float
    advance: float
    height: float
    rotation: float
    mode: int


@dataclass
class State:
    ctm: Matrix = IDENTITY
    font: Font | None = None
    size: float = 0.0
    char_space: float = 0.0
    word_space: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0


@dataclass
class Interpreter:
    """Folds the operations of a page into glyphs, in page space with y down."""

    doc: Document
    page: Page
    state: State = field(default_factory=State)
    saved: list[State] = field(default_factory=list)
    over: int = 0
    text: Matrix = IDENTITY
    line: Matrix = IDENTITY
    fonts: dict = field(default_factory=dict)
    glyphs: list[Glyph] = field(default_factory=list)

    def point(self, m: Matrix, x: float, y: float) -> tuple[float, float]:
        """A point of text space in page space."""
        px, py = m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]
        crop = self.page.crop
        w, h = crop.x1 - crop.x0, crop.y1 - crop.y0
        u, v = px - crop.x0, h - (py - crop.y0)
        return {0: (u, v), 90: (h - v, u), 180: (w - u, h - v), 270: (v, w - u)}[self.page.rotate]

    def run(self, data: bytes, resources: dict, depth: int = 0) -> None:
        for op, args in operations(data):
            handler = _HANDLERS.get(op)
            if handler:
                handler(self, args, resources, depth)

    def show(self, raw: Any) -> None:
        """Glyphs of a string. All of them lie on one line, so its start and direction are mapped once."""
        if not isinstance(raw, bytes):
            return
        s = self.state
        font, step = s.font, s.font.step if s.font else 1
        m = times(self.text, s.ctm)
        x0, y0 = self.point(m, 0.0, s.rise)
        dx, dy = {0: (m[0], -m[1]), 90: (m[1], m[0]), 180: (-m[0], m[1]), 270: (-m[1], -m[0])}[self.page.rotate]
        em, height = s.size * s.scale, abs(s.size) * math.hypot(m[2], m[3])
        length = abs(em) * math.hypot(m[0], m[1])
        turn = math.degrees(math.atan2(-dy * em, dx * em)) if length else 0.0
        height = height if height > 0 else s.size
        at, known, out = 0.0, {}, self.glyphs
        for i in range(0, len(raw) - step + 1, step):
            code = raw[i] if step == 1 else raw[i] << 8 | raw[i + 1]
            if code not in known:
                w = (font.width(code) if font else 500.0) / 1000.0
                tx = (w * s.size + s.char_space + (s.word_space if step == 1 and code == 32 else 0.0)) * s.scale
                known[code] = (font.to_unicode(code) if font else code, w * length, turn if w * length > 0.0001 else 0.0, tx)
            char, advance, angle, tx = known[code]
            out.append(Glyph(char, code, x0 + at * dx, y0 + at * dy, advance, height, angle, s.mode))
            at += tx
        self.text = times((1.0, 0.0, 0.0, 1.0, at, 0.0), self.text)

    def next_line(self, x: float, y: float) -> None:
        self.line = times((1.0, 0.0, 0.0, 1.0, x, y), self.line)
        self.text = self.line

    def set_font(self, args: list, resources: dict) -> None:
        fonts = self.doc.get(resources.get("Font"))
        ref = fonts.get(str(args[-2])) if isinstance(fonts, dict) and len(args) > 1 else None
        d = self.doc.get(ref)
        key = ref if ref is not None and not isinstance(ref, dict) else id(d)
        if isinstance(d, dict) and key not in self.fonts:
            self.fonts[key] = Font(self.doc, d)
        self.state.font = self.fonts.get(key) if isinstance(d, dict) else None
        self.state.size = num(args[-1]) if args else 0.0

    def form(self, args: list, resources: dict, depth: int) -> None:
        held = self.doc.get(resources.get("XObject"))
        v = self.doc.get(held.get(str(args[-1]))) if isinstance(held, dict) and args else None
        if not isinstance(v, Stream) or v.dict.get("Subtype") != "Form" or depth >= MAX_FORMS:
            return
        try:
            data = self.doc.stream_bytes(v)
        except FilterFault:
            return
        before, text, line = replace(self.state), self.text, self.line
        m = self.doc.get(v.dict.get("Matrix"))
        if isinstance(m, list) and len(m) == 6:
            self.state.ctm = times(tuple(num(self.doc.get(x)) for x in m), self.state.ctm)
        own = self.doc.get(v.dict.get("Resources"))
        self.run(data, own if isinstance(own, dict) else resources, depth + 1)
        self.state, self.text, self.line = before, text, line


def _save(i: Interpreter, a: list, r: dict, d: int) -> None:
    if len(i.saved) < MAX_STATES:
        i.saved.append(replace(i.state))


def _restore(i: Interpreter, a: list, r: dict, d: int) -> None:
    if i.saved:
        i.state = i.saved.pop()


def _concat(i: Interpreter, a: list, r: dict, d: int) -> None:
    if len(a) >= 6:
        i.state.ctm = times(tuple(num(x) for x in a[-6:]), i.state.ctm)


def _begin(i: Interpreter, a: list, r: dict, d: int) -> None:
    i.text = i.line = IDENTITY


def _setter(name: str, by: float = 1.0):
    def run(i: Interpreter, a: list, r: dict, d: int) -> None:
        if a:
            setattr(i.state, name, num(a[-1]) * by)

    return run


def _mode(i: Interpreter, a: list, r: dict, d: int) -> None:
    if a:
        i.state.mode = int(num(a[-1]))


def _move(leading: bool):
    def run(i: Interpreter, a: list, r: dict, d: int) -> None:
        if len(a) >= 2:
            if leading:
                i.state.leading = -num(a[-1])
            i.next_line(num(a[-2]), num(a[-1]))

    return run


def _set_matrix(i: Interpreter, a: list, r: dict, d: int) -> None:
    if len(a) >= 6:
        i.text = i.line = tuple(num(x) for x in a[-6:])


def _star(i: Interpreter, a: list, r: dict, d: int) -> None:
    i.next_line(0.0, -i.state.leading)


def _show(i: Interpreter, a: list, r: dict, d: int) -> None:
    if a:
        i.show(a[-1])


def _quote(i: Interpreter, a: list, r: dict, d: int) -> None:
    _star(i, a, r, d)
    _show(i, a, r, d)


def _double_quote(i: Interpreter, a: list, r: dict, d: int) -> None:
    if len(a) >= 3:
        i.state.word_space, i.state.char_space = num(a[-3]), num(a[-2])
        _quote(i, a, r, d)


def _show_array(i: Interpreter, a: list, r: dict, d: int) -> None:
    for x in a[-1] if a and isinstance(a[-1], list) else []:
        if isinstance(x, bytes):
            i.show(x)
        else:
            i.text = times((1.0, 0.0, 0.0, 1.0, -num(x) / 1000.0 * i.state.size * i.state.scale, 0.0), i.text)


_HANDLERS = {
    "q": _save,
    "Q": _restore,
    "cm": _concat,
    "BT": _begin,
    "Tf": lambda i, a, r, d: i.set_font(a, r),
    "Tc": _setter("char_space"),
    "Tw": _setter("word_space"),
    "Tz": _setter("scale", 0.01),
    "TL": _setter("leading"),
    "Ts": _setter("rise"),
    "Tr": _mode,
    "Td": _move(False),
    "TD": _move(True),
    "Tm": _set_matrix,
    "T*": _star,
    "Tj": _show,
    "'": _quote,
    '"': _double_quote,
    "TJ": _show_array,
    "Do": lambda i, a, r, d: i.form(a, r, d),
}


def page_glyphs(doc: Document, page: Page) -> list[Glyph]:
    """The glyphs that a page shows, in order, spaces and invisible text included."""
    run = Interpreter(doc, page)
    run.run(doc.content(page), page.resources)
    return run.glyphs
