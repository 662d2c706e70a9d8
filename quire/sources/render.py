"""Pages to pictures: a content interpreter that paints.

Glyphs are drawn by the outlines of embedded font programs, and as boxes of their width where there are none.
Colours follow the number of operands; profiles are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np

from . import raster
from .content import _HANDLERS, MAX_FORMS, Glyph, Interpreter, Matrix, State, operations, times
from .document import Document, Page, num
from .filters import FilterFault, status_of
from .images import decode_image, space_of, to_rgb
from .syntax import Stream


#: The widest box of samples, in samples along a side, that is averaged for a pixel of a reduced image.
BOX = 32


@dataclass
class Paint(State):
    fill: tuple = (0.0, 0.0, 0.0)
    stroke: tuple = (0.0, 0.0, 0.0)
    width: float = 1.0
    fill_alpha: float = 1.0
    stroke_alpha: float = 1.0
    mode_name: str = "Normal"
    clip: np.ndarray | None = None
    soft: np.ndarray | None = None
    pattern: Any = None
    fill_pattern: bool = False


def colour_of(args: list) -> tuple | None:
    """A colour by its number of components: grey, RGB or CMYK."""
    v = [min(1.0, max(0.0, num(x))) for x in args if isinstance(x, int | float)]
    if len(v) == 1:
        return (v[0],) * 3
    if len(v) == 3:
        return tuple(v)
    return tuple(1.0 - min(1.0, c + v[3]) for c in v[:3]) if len(v) == 4 else None


def load_function(doc: Document, v: Any) -> Callable[[np.ndarray], np.ndarray] | None:
    """A function of one input as one of arrays, giving outputs along a last axis; None if unsupported."""
    v = doc.get(v)
    if isinstance(v, list):
        parts = [load_function(doc, x) for x in v]
        return (lambda x: np.concatenate([p(x)[..., :1] for p in parts], -1)) if all(parts) and parts else None
    d = v.dict if isinstance(v, Stream) else v
    if not isinstance(d, dict):
        return None
    numbers = lambda key, default: [num(doc.get(x)) for x in doc.get(d.get(key)) or default]
    low, high = numbers("Domain", [0.0, 1.0])[:2]
    kind = doc.get(d.get("FunctionType"))
    held = lambda x: np.clip(np.asarray(x, float), low, high)
    if kind == 2:
        c0, c1, n = np.array(numbers("C0", [0.0])), np.array(numbers("C1", [1.0])), num(doc.get(d.get("N")), 1.0)
        return lambda x: c0 + (held(x) ** n)[..., None] * (c1 - c0)
    if kind == 3:
        parts = [load_function(doc, x) for x in doc.get(d.get("Functions")) or []]
        bounds, encode = numbers("Bounds", []), numbers("Encode", [])
        if not parts or not all(parts) or len(bounds) < len(parts) - 1 or len(encode) < 2 * len(parts):
            return None
        edges = [low, *bounds, high]

        def stitched(x):
            x = held(x)
            at = np.searchsorted(np.array(bounds[: len(parts) - 1]), x, "right")
            out = None
            for k, p in enumerate(parts):
                a, b = edges[k], edges[k + 1]
                inner = encode[2 * k] + (x - a) * (encode[2 * k + 1] - encode[2 * k]) / (b - a) if b > a else np.full_like(x, encode[2 * k])
                y = p(inner)
                out = y if out is None else np.where((at == k)[..., None], y, out)
            return out

        return stitched
    if kind == 0 and isinstance(v, Stream):
        bits, size = int(num(doc.get(d.get("BitsPerSample")), 8)), int((numbers("Size", [0]) or [0])[0])
        out_range = numbers("Range", [])
        n = len(out_range) // 2
        if size < 1 or not n or bits not in (1, 2, 4, 8, 16, 24, 32):
            return None
        raw = np.unpackbits(np.frombuffer(doc.stream_bytes(v), np.uint8))[: size * n * bits]
        raw = np.concatenate([raw, np.zeros(size * n * bits - len(raw), np.uint8)]).reshape(size, n, bits)
        table = (raw * (2.0 ** np.arange(bits - 1, -1, -1))).sum(2) / (2.0**bits - 1)
        encode, span = numbers("Encode", [0.0, size - 1.0]), numbers("Decode", out_range)
        lows, highs = np.array(span[::2]), np.array(span[1::2])

        def sampled(x):
            e = encode[0] + (held(x) - low) * (encode[1] - encode[0]) / (high - low) if high > low else np.full_like(held(x), encode[0])
            e = np.clip(e, 0, size - 1)
            i = np.floor(e).astype(int)
            y = table[i] + (e - i)[..., None] * (table[np.minimum(i + 1, size - 1)] - table[i])
            return lows + y * (highs - lows)

        return sampled
    return None


def shading_colours(doc: Document, d: dict, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(RGB, whether painted) of an axial or radial shading at points of its own space; None if unsupported."""
    kind = doc.get(d.get("ShadingType"))
    coords = [num(doc.get(v)) for v in doc.get(d.get("Coords")) or []]
    function = load_function(doc, d.get("Function"))
    if function is None or kind not in (2, 3) or len(coords) < (4 if kind == 2 else 6):
        return None
    extend = [doc.get(v) is True for v in doc.get(d.get("Extend")) or [False, False]]
    domain = [num(doc.get(v)) for v in doc.get(d.get("Domain")) or [0.0, 1.0]]

    def limited(s):
        ok = ((s >= 0) | extend[0]) & ((s <= 1) | extend[1])
        return np.clip(s, 0, 1), ok

    if kind == 2:
        x0, y0, x1, y1 = coords[:4]
        dx, dy = x1 - x0, y1 - y0
        size = dx * dx + dy * dy
        s, seen = limited(((x - x0) * dx + (y - y0) * dy) / size if size >= 1e-12 else np.zeros_like(x))
    else:
        x0, y0, r0, x1, y1, r1 = coords[:6]
        dx, dy, dr = x1 - x0, y1 - y0, r1 - r0
        px, py = x - x0, y - y0
        a, b, c = dx * dx + dy * dy - dr * dr, -2 * (px * dx + py * dy + r0 * dr), px * px + py * py - r0 * r0
        with np.errstate(invalid="ignore", divide="ignore"):
            if abs(a) < 1e-9:
                roots = [np.where(np.abs(b) > 1e-12, -c / b, np.nan)]
            else:
                root = np.sqrt(b * b - 4 * a * c)
                one, two = (-b + root) / (2 * a), (-b - root) / (2 * a)
                roots = [np.fmax(one, two), np.fmin(one, two)]
        s, seen = np.zeros_like(x), np.zeros(x.shape, bool)
        for r in roots:
            t, ok = limited(r)
            ok &= np.isfinite(r) & (r0 + r * dr >= 0) & (r0 + t * dr >= 0) & ~seen
            s, seen = np.where(ok, t, s), seen | ok
    values = function(domain[0] + s * (domain[1] - domain[0]))
    space = space_of(doc, d.get("ColorSpace"))
    values = values if values.shape[-1] >= space[1] else np.repeat(values[..., :1], space[1], -1)
    rgb = np.clip(to_rgb(doc, space, np.clip(values, 0, 1)), 0, 1)
    back = doc.get(d.get("Background"))
    if isinstance(back, list) and (c := colour_of([doc.get(v) for v in back])):
        rgb, seen = np.where(seen[..., None], rgb, c), np.ones_like(seen)
    return rgb, seen


@dataclass
class Painter(Interpreter):
    """Paints a page's operations on a bitmap of its size at a scale."""

    scale: float = 1.0
    state: Paint = field(default_factory=Paint)
    paths: list = field(default_factory=list)
    closed: list = field(default_factory=list)
    at: tuple = (0.0, 0.0)
    clipping: str = ""
    bitmap: raster.Bitmap | None = None  # given: a spare one
    status: str = "OK"

    def __post_init__(self) -> None:
        w, h = self.page.size
        self.size = (max(1, round(w * self.scale)), max(1, round(h * self.scale)))
        if self.size[0] * self.size[1] > 100_000_000:
            raise FilterFault("page too large")
        self.bitmap = raster.Bitmap.blank(*self.size, spare=self.bitmap)

    def pixel(self, x: float, y: float, m: Matrix | None = None) -> tuple[float, float]:
        u, v = self.point(m or self.state.ctm, x, y)
        return u * self.scale, v * self.scale

    def run(self, data: bytes, resources: dict, depth: int = 0) -> None:
        for op, args in operations(data):
            handler = _PAINT.get(op) or _HANDLERS.get(op)
            if handler:
                handler(self, args, resources, depth)

    def cover(self, mask: np.ndarray, alpha: float, at: tuple[int, int] = (0, 0)) -> np.ndarray:
        """A mask, of the bitmap or of a window that begins at a row and a column, within clip and soft mask."""
        held = tuple(slice(k, k + n) for k, n in zip(at, mask.shape, strict=True))
        for part in (self.state.clip, self.state.soft):
            mask = mask if part is None else mask * part[held]
        return mask * alpha

    def paint_paths(self, paths: list, colour: tuple, alpha: float, even_odd: bool = False) -> None:
        at, mask = raster.covered(paths, *self.size, even_odd=even_odd)
        self.bitmap.paint(self.cover(mask, alpha, at), colour, self.state.mode_name, at)

    def show(self, raw: Any) -> None:
        before, s = len(self.glyphs), self.state
        super().show(raw)
        if s.mode in (3, 7):
            return
        shapes = [c for g in self.glyphs[before:] if g.unicode != 32 and g.advance > 0 for c in self._glyph_shape(g)]
        if shapes:
            self.paint_paths(shapes, s.fill, s.fill_alpha)

    def _glyph_shape(self, g: Glyph) -> list[list[tuple[float, float]]]:
        """A glyph's contours on the bitmap; an outline is stretched to the width that the page gives it."""
        turn = np.radians(g.rotation)
        along, up = (np.cos(turn), -np.sin(turn)), (-np.sin(turn), -np.cos(turn))
        contours, natural = self.state.font.outline(g.code) if self.state.font else ([], 0.0)
        wide = g.advance / natural if natural > 0.001 else g.height
        wide = min(2.5 * g.height, max(0.4 * g.height, wide))
        shapes = [[(x * wide, y * g.height) for x, y in c] for c in contours]
        if not shapes:
            edge = min(0.08 * g.height, 0.25 * g.advance)
            shapes = [[(edge, 0.0), (g.advance - edge, 0.0), (g.advance - edge, 0.62 * g.height), (edge, 0.62 * g.height)]]
        return [[((g.x0 + a * along[0] + b * up[0]) * self.scale, (g.y0 + a * along[1] + b * up[1]) * self.scale) for a, b in c] for c in shapes]

    def move(self, x: float, y: float) -> None:
        self.paths.append([self.pixel(x, y)])
        self.closed.append(False)
        self.at = (x, y)

    def line_to(self, x: float, y: float) -> None:
        if not self.paths:
            self.move(x, y)
        else:
            self.paths[-1].append(self.pixel(x, y))
        self.at = (x, y)

    def curve_to(self, b: tuple, c: tuple, d: tuple) -> None:
        if not self.paths:
            self.move(*b)
        self.paths[-1] += raster.curve(self.paths[-1][-1], self.pixel(*b), self.pixel(*c), self.pixel(*d))
        self.at = d

    def finish(self, fill: str = "", stroke: bool = False, close: bool = False) -> None:
        """Paint the current path and clip by it, as asked for, and forget it."""
        s = self.state
        if close and self.closed:
            self.closed[-1] = True
        if fill and self.paths:
            shaded = self.shaded(s.pattern) if s.fill_pattern and s.pattern else None
            if shaded:
                mask = raster.coverage(self.paths, *self.size, even_odd=fill == "even")
                self.bitmap.paint(self.cover(mask * shaded[1], s.fill_alpha), shaded[0], s.mode_name)
            else:
                self.paint_paths(self.paths, s.fill, s.fill_alpha, fill == "even")
        if stroke and self.paths:
            m = s.ctm
            width = s.width * abs(m[0] * m[3] - m[1] * m[2]) ** 0.5 * self.scale
            outline = raster.stroke(list(zip(self.paths, self.closed, strict=True)), width)
            self.paint_paths(outline, s.stroke, s.stroke_alpha)
        if self.clipping:
            mask = raster.coverage(self.paths, *self.size, even_odd=self.clipping == "even")
            s.clip = mask if s.clip is None else s.clip * mask
        self.paths, self.closed, self.clipping = [], [], ""

    def shaded(self, found: tuple[dict, Matrix]) -> tuple[np.ndarray, np.ndarray] | None:
        """Colours of a shading for every pixel. found: its dictionary and the matrix of its space."""
        d, m = found
        ox, oy = self.pixel(0, 0, m)
        ax, ay = self.pixel(1, 0, m)
        bx, by = self.pixel(0, 1, m)
        forward = np.array([[ax - ox, bx - ox], [ay - oy, by - oy]])
        if abs(np.linalg.det(forward)) < 1e-12:
            return None
        back = np.linalg.inv(forward)
        px, py = np.meshgrid(np.arange(self.size[0]) + 0.5 - ox, np.arange(self.size[1]) + 0.5 - oy)
        return shading_colours(self.doc, d, back[0, 0] * px + back[0, 1] * py, back[1, 0] * px + back[1, 1] * py)

    def resource(self, resources: dict, kind: str, name: Any) -> Any:
        held = self.doc.get(resources.get(kind))
        return self.doc.get(held.get(str(name))) if isinstance(held, dict) else None

    def form(self, args: list, resources: dict, depth: int) -> None:
        v = self.resource(resources, "XObject", args[-1]) if args else None
        if not isinstance(v, Stream):
            return
        if self.doc.get(v.dict.get("Subtype")) == "Image":
            self.image(v)
            return
        self.draw(v, resources, depth)

    def draw(self, v: Stream, resources: dict, depth: int, apart: bool = True) -> None:
        """A form's content, clipped to its box; a transparency group on its own first, unless not wanted apart."""
        if depth >= MAX_FORMS:
            return
        saved, text, line = replace(self.state), self.text, self.line
        held = [num(self.doc.get(x)) for x in self.doc.get(v.dict.get("Matrix")) or []]
        if len(held) == 6:
            self.state.ctm = times(tuple(held), self.state.ctm)
        bounds = [num(self.doc.get(x)) for x in self.doc.get(v.dict.get("BBox")) or []]
        if len(bounds) == 4:
            corners = [self.pixel(bounds[i], bounds[j]) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3))]
            mask = raster.coverage([corners], *self.size)
            self.state.clip = mask if self.state.clip is None else self.state.clip * mask
        own = self.doc.get(v.dict.get("Resources"))
        try:
            data = self.doc.stream_bytes(v)
        except FilterFault:
            data = b""
        under, group = self.bitmap, self.doc.get(v.dict.get("Group"))
        apart = apart and isinstance(group, dict) and self.doc.get(group.get("S")) == "Transparency"
        if apart:
            self.bitmap = raster.Bitmap.blank(*self.size, opaque=False)
            if self.doc.get(group.get("K")) is True:
                self.bitmap.touched = np.zeros(self.bitmap.opacity.shape, bool)
            self.state.fill_alpha = self.state.stroke_alpha = 1.0
            self.state.mode_name, self.state.soft = "Normal", None
        self.run(data, own if isinstance(own, dict) else resources, depth + 1)
        if apart:
            done, self.bitmap = self.bitmap, under
            seen = done.alpha if saved.soft is None else done.alpha * saved.soft
            self.bitmap.paint(seen * saved.fill_alpha, done.rgb, saved.mode_name)
        self.state, self.text, self.line = saved, text, line

    def soft_mask(self, held: Any, resources: dict, depth: int) -> np.ndarray | None:
        """The luminosity of a mask's group, painted on black in the current space; None for other masks."""
        get = self.doc.get
        v = get(held.get("G")) if isinstance(held, dict) and get(held.get("S")) == "Luminosity" else None
        if not isinstance(v, Stream):
            return None
        before = self.state, self.saved, self.bitmap, self.paths, self.closed
        self.state = replace(self.state, soft=None, pattern=None, fill_pattern=False, fill_alpha=1.0, stroke_alpha=1.0, mode_name="Normal")
        self.saved, self.paths, self.closed = [], [], []
        mask = self.bitmap = raster.Bitmap(np.zeros_like(before[2].colours), np.full_like(before[2].opacity, 255))
        self.draw(v, resources, depth, apart=False)
        self.state, self.saved, self.bitmap, self.paths, self.closed = before
        return np.minimum(255, np.floor(mask.colours @ raster.LUMINANCE + 0.5)) / 255

    def image(self, v: Stream) -> None:
        """An image by its nearest samples or, where it is reduced, by the means of boxes of samples."""
        try:
            w, h, rgb, alpha = decode_image(self.doc, v)
        except (FilterFault, ValueError, IndexError, KeyError) as e:
            self.status = status_of(e)
            return
        s = self.state
        ox, oy = self.pixel(0, 0)
        ax, ay = self.pixel(1, 0)
        bx, by = self.pixel(0, 1)
        forward = np.array([[ax - ox, bx - ox], [ay - oy, by - oy]])
        if abs(np.linalg.det(forward)) < 1e-9:
            return
        back = np.linalg.inv(forward)
        mask = raster.coverage([[(ox, oy), (ax, ay), (ax + bx - ox, ay + by - oy), (bx, by)]], *self.size)
        px, py = np.meshgrid(np.arange(self.size[0]) + 0.5 - ox, np.arange(self.size[1]) + 0.5 - oy)
        u, t = back[0, 0] * px + back[0, 1] * py, back[1, 0] * px + back[1, 1] * py
        cols, rows = np.clip((u * w).astype(int), 0, w - 1), np.clip(((1 - t) * h).astype(int), 0, h - 1)
        stencil = self.doc.get(v.dict.get("ImageMask")) is True
        high, wide = (min(BOX, max(1, int(n / max(1.0, abs(a) + abs(b)) + 0.5))) for n, a, b in ((h, *forward[1]), (w, *forward[0])))
        if stencil and alpha is not None and (high > 1 or wide > 1):  # painted where at least half of a box is
            mask = mask * (raster.box_means(2 * (alpha > 0), rows, cols, high, wide) >= 1)
        elif alpha is not None:
            mask = mask * alpha[rows, cols] / 255.0
        if stencil:
            colours = np.broadcast_to(np.array(s.fill), (*mask.shape, 3))
        elif high > 1 or wide > 1:
            colours = np.stack([raster.box_means(rgb[..., i], rows, cols, high, wide) for i in range(3)], -1) / 255.0
        else:
            colours = rgb[rows, cols] / 255.0
        self.bitmap.paint(self.cover(mask, s.fill_alpha), colours, s.mode_name)


def _numbers(n: int, then: Callable) -> Callable:
    def run(p: Painter, a: list, r: dict, d: int) -> None:
        if len(a) >= n:
            then(p, *[num(x) for x in a[-n:]])

    return run


def _rect(p: Painter, x: float, y: float, w: float, h: float) -> None:
    p.move(x, y)
    for q in ((x + w, y), (x + w, y + h), (x, y + h)):
        p.line_to(*q)
    p.closed[-1] = True
    p.at = (x, y)


def _close(p: Painter, a: list, r: dict, d: int) -> None:
    if p.closed:
        p.closed[-1] = True


def _colour(name: str, count: int = 0) -> Callable:
    def run(p: Painter, a: list, r: dict, d: int) -> None:
        s = p.state
        if name == "fill":
            s.fill_pattern = False
            if a and isinstance(a[-1], str):
                found = p.resource(r, "Pattern", a[-1])
                found = found.dict if isinstance(found, Stream) else found
                if isinstance(found, dict) and p.doc.get(found.get("PatternType")) == 2:
                    shading = p.doc.get(found.get("Shading"))
                    m = [num(p.doc.get(x)) for x in p.doc.get(found.get("Matrix")) or [1, 0, 0, 1, 0, 0]]
                    s.pattern, s.fill_pattern = (shading.dict if isinstance(shading, Stream) else shading, tuple(m)), True
                return
        c = colour_of(a[-count:] if count else a)
        if c:
            setattr(s, name, c)

    return run


def _graphics(p: Painter, a: list, r: dict, d: int) -> None:
    g = p.resource(r, "ExtGState", a[-1]) if a else None
    if isinstance(g, dict):
        s, get = p.state, p.doc.get
        s.fill_alpha, s.stroke_alpha = num(get(g.get("ca")), s.fill_alpha), num(get(g.get("CA")), s.stroke_alpha)
        s.width = num(get(g.get("LW")), s.width)
        mode = get(g.get("BM"))
        if mode is not None:
            s.mode_name = str(get(mode[0]) if isinstance(mode, list) and mode else mode)
        mask = get(g.get("SMask"))
        if mask is not None:
            s.soft = p.soft_mask(mask, r, d)


def _shade(p: Painter, a: list, r: dict, d: int) -> None:
    v = p.resource(r, "Shading", a[-1]) if a else None
    v = v.dict if isinstance(v, Stream) else v
    found = p.shaded((v, p.state.ctm)) if isinstance(v, dict) else None
    if found:
        p.bitmap.paint(p.cover(found[1].astype(float), p.state.fill_alpha), found[0], p.state.mode_name)


def _finish(**how) -> Callable:
    return lambda p, a, r, d: p.finish(**how)


def _clip(rule: str) -> Callable:
    def run(p: Painter, a: list, r: dict, d: int) -> None:
        p.clipping = rule

    return run


def _line_width(p: Painter, a: list, r: dict, d: int) -> None:
    if a:
        p.state.width = num(a[-1])


_PAINT: dict[str, Callable] = {
    "m": _numbers(2, Painter.move),
    "l": _numbers(2, Painter.line_to),
    "c": _numbers(6, lambda p, a, b, c, d, e, f: p.curve_to((a, b), (c, d), (e, f))),
    "v": _numbers(4, lambda p, a, b, c, d: p.curve_to(p.at, (a, b), (c, d))),
    "y": _numbers(4, lambda p, a, b, c, d: p.curve_to((a, b), (c, d), (c, d))),
    "re": _numbers(4, _rect),
    "h": _close,
    "S": _finish(stroke=True),
    "s": _finish(stroke=True, close=True),
    "f": _finish(fill="nonzero"),
    "F": _finish(fill="nonzero"),
    "f*": _finish(fill="even"),
    "B": _finish(fill="nonzero", stroke=True),
    "B*": _finish(fill="even", stroke=True),
    "b": _finish(fill="nonzero", stroke=True, close=True),
    "b*": _finish(fill="even", stroke=True, close=True),
    "n": _finish(),
    "W": _clip("nonzero"),
    "W*": _clip("even"),
    "w": _line_width,
    "gs": _graphics,
    "sh": _shade,
    "g": _colour("fill", 1),
    "rg": _colour("fill", 3),
    "k": _colour("fill", 4),
    "G": _colour("stroke", 1),
    "RG": _colour("stroke", 3),
    "K": _colour("stroke", 4),
    "sc": _colour("fill"),
    "scn": _colour("fill"),
    "SC": _colour("stroke"),
    "SCN": _colour("stroke"),
}


def render_page(doc: Document, page: Page, scale: float = 1.0) -> raster.Bitmap:
    """A page on white, with its visible annotations' appearances over it."""
    return rendered(doc, page, scale)[0]


def rendered(doc: Document, page: Page, scale: float = 1.0, spare: raster.Bitmap | None = None) -> tuple[raster.Bitmap, str]:
    """render_page's bitmap, and OK; or the status of a content stream or an image that it lacks. spare: a bitmap whose
    memory may be taken."""
    p = Painter(doc, page, scale=scale, bitmap=spare)
    data, status = doc.content_and_status(page)
    p.run(data, page.resources)
    rows = doc.get(page.dict.get("Annots"))
    for ref in rows if isinstance(rows, list) else []:
        _annotation(p, doc.get(ref))
    return p.bitmap, status if status != "OK" else p.status


def _annotation(p: Painter, a: Any) -> None:
    """An annotation's normal appearance, its box mapped onto the rectangle; hidden ones are skipped."""
    get = p.doc.get
    if not isinstance(a, dict) or int(num(get(a.get("F")))) & 34:
        return
    look = get(a.get("AP"))
    v = get(look.get("N")) if isinstance(look, dict) else None
    if isinstance(v, dict):
        v = get(v.get(str(get(a.get("AS")) or "Off")))
    rect = [num(get(x)) for x in get(a.get("Rect")) or []]
    if not isinstance(v, Stream) or len(rect) != 4:
        return
    b = [num(get(x)) for x in get(v.dict.get("BBox")) or []]
    if len(b) != 4 or b[2] == b[0] or b[3] == b[1]:
        return
    sx, sy = (rect[2] - rect[0]) / (b[2] - b[0]), (rect[3] - rect[1]) / (b[3] - b[1])
    p.state, p.saved = Paint(), []
    p.state.ctm = (sx, 0.0, 0.0, sy, rect[0] - b[0] * sx, rect[1] - b[1] * sy)
    p.form(["A"], {"XObject": {"A": v}}, 0)
