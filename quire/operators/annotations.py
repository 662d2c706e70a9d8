"""Annotations and fields as objects: reading their attributes, and making new ones with an appearance."""

from __future__ import annotations

import math
import re

from ..sources.document import Document, Page, box, num
from ..sources.fonts import standard_width
from ..sources.syntax import Name, Ref, Stream
from .forms import PUSH, RADIO, READ_ONLY

#: The note's font size, padding, width of text, line height, tail, and lines at most.
TIP_SIZE, TIP_PAD, TIP_WIDTH, TIP_LINE, TIP_TAIL, TIP_TAIL_WIDTH, TIP_LINES = 9.0, 6.0, 200.0, 9.0 * 1.3, 14.0, 10.0, 20
#: Bytes of a wrapped line, and of a note's text.
LINE_BYTES, TIP_BYTES = 127, 300
KAPPA = 0.5522847498307936


def field_row(doc: Document, page: Page, ref: Ref, widget: dict) -> tuple:
    """(type, name, value, on_state, read_only, obj_num, obj_gen, x0, y0, x1, y1) of a widget; the rectangle
    is in the page's crop box with y down, without rotation."""
    own = ref if ref.num else None
    look = lambda key: doc.inherited(widget, own, key)
    kind, flags, (value, owner), name = look("FT")[0], int(num(look("Ff")[0])), look("V"), look("T")[0]
    state = None
    if kind == "Tx":
        found, text = "text", value if isinstance(value, bytes) else b""
    elif kind == "Btn" and not flags & (RADIO | PUSH):
        found, text = "checkbox", str(value).encode("latin-1", "replace") if isinstance(value, Name) else b"Off"
        look_of = doc.get(widget.get("AP"))
        normal = doc.get(look_of.get("N")) if isinstance(look_of, dict) else None
        state = next((k for k in normal if k != "Off"), None) if isinstance(normal, dict) else None
    else:
        found, text = "other", b""
    holder = (owner or Ref(0, 0)) if value is not None else ref
    r = box([doc.get(x) for x in doc.get(widget.get("Rect")) or []])
    rect = (r.x0 - page.crop.x0, page.crop.y1 - r.y1, r.x1 - page.crop.x0, page.crop.y1 - r.y0) if r else (0.0,) * 4
    title = name.decode("latin-1") if isinstance(name, bytes) else ""
    return (found, title, text, state, bool(flags & READ_ONLY), holder.num, holder.gen, *rect)


def word_width(word: str, size: float) -> float:
    """The width of a word in Helvetica; unknown characters count half an em."""
    return sum((standard_width("Helvetica", ord(c)) or 500) / 1000.0 * size for c in word)


def wrap(text: str, size: float = TIP_SIZE, width: float = TIP_WIDTH, most: int = TIP_LINES) -> list[tuple[str, float]]:
    """(line, width): words put on lines as long as they fit; line ends (CR, LF, or a pair) are kept, words
    longer than a line's bytes are cut, and a last line of `most` ends in ... if text is left."""
    blank, out = word_width(" ", size), []
    paragraphs = re.split(r"\r\n|\n\r|\r|\n", text)
    left = False
    for i, paragraph in enumerate(paragraphs):
        words = [w[:LINE_BYTES] for w in paragraph.split(" ") if w]
        if not words:
            if i + 1 == len(paragraphs):
                break
            if len(out) >= most:
                left = True
                break
            out.append(("", 0.0))
            continue
        line, total = "", 0.0
        for w in words:
            extent = word_width(w, size)
            if line and (total + blank + extent > width or len(line) + 1 + len(w) > LINE_BYTES):
                if len(out) >= most:
                    break
                out.append((line, total))
                line, total = "", 0.0
            line, total = (f"{line} {w}", total + blank + extent) if line else (w, extent)
        if len(out) >= most:
            left = True
            break
        out.append((line, total))
    if left and out and len(out[-1][0]) + 3 <= LINE_BYTES:
        out[-1] = (out[-1][0] + "...", out[-1][1] + word_width("...", size))
    return out or [("", 0.0)]


def _escape(text: str) -> str:
    return re.sub(r"([()\\])", r"\\\1", text)


def _form(content: str, bounds: tuple, resources: dict | None = None) -> Stream:
    d: dict = {"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [float(v) for v in bounds]}
    if resources:
        d["Resources"] = resources
    return Stream(d, content.encode("latin-1", "replace"))


def _annotation(subtype: str, bounds: tuple, rgb: tuple, appearance: Ref, **more) -> dict:
    return {"Type": Name("Annot"), "Subtype": Name(subtype), "Rect": [float(v) for v in bounds], "C": [float(v) for v in rgb], "F": 4, "AP": {"N": appearance}, **more}


def highlight(quads: list[list[float]], rgb: tuple, alpha: float) -> tuple[Stream, tuple]:
    """(appearance, bounds) of quadrilaterals given as top left, top right, bottom left, bottom right."""
    xs, ys = [v for q in quads for v in q[::2]], [v for q in quads for v in q[1::2]]
    bounds = (min(xs), min(ys), max(xs), max(ys))
    order = (0, 1, 3, 2)  # around the edge
    paths = ["{:.2f} {:.2f} m\n".format(*q[:2]) + "".join("{:.2f} {:.2f} l\n".format(*q[2 * k : 2 * k + 2]) for k in order[1:]) + "h\nf\n" for q in quads]
    content = "/GS0 gs\n{:.3f} {:.3f} {:.3f} rg\n".format(*rgb) + "".join(paths)
    return _form(content, bounds, {"ExtGState": {"GS0": {"ca": float(alpha), "BM": Name("Multiply")}}}), bounds


def line_shape(a: tuple, b: tuple, rgb: tuple, width: float) -> tuple[Stream, tuple] | None:
    """An arrow; None if it has no direction."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = math.hypot(dx, dy)
    if size < 0.001:
        return None
    ux, uy = dx / size, dy / size
    bx, by = b[0] - 10.0 * ux, b[1] - 10.0 * uy
    wings = [(bx - 4.0 * uy, by + 4.0 * ux), (bx + 4.0 * uy, by - 4.0 * ux)]
    points = [a, b, *wings]
    edge = width / 2.0 + 1.0
    bounds = (min(p[0] for p in points) - edge, min(p[1] for p in points) - edge, max(p[0] for p in points) + edge, max(p[1] for p in points) + edge)
    color = "{:.3f} {:.3f} {:.3f}".format(*rgb)
    at = lambda p: f"{p[0]:.2f} {p[1]:.2f}"
    content = f"{width:.3f} w\n{color} RG\n{at(a)} m\n{at(b)} l\nS\n{color} rg\n{at(b)} m\n{at(wings[0])} l\n{at(wings[1])} l\nh\nf\n"
    return _form(content, bounds), bounds


def square_shape(x0: float, y0: float, x1: float, y1: float, rgb: tuple, width: float) -> tuple[Stream, tuple] | None:
    if x1 <= x0 or y1 <= y0:
        return None
    edge = width / 2.0
    content = f"{width:.3f} w\n{rgb[0]:.3f} {rgb[1]:.3f} {rgb[2]:.3f} RG\n{x0:.2f} {y0:.2f} {x1 - x0:.2f} {y1 - y0:.2f} re\nS\n"
    bounds = (x0 - edge, y0 - edge, x1 + edge, y1 + edge)
    return _form(content, bounds), bounds


def circle_shape(x0: float, y0: float, x1: float, y1: float, rgb: tuple, width: float) -> tuple[Stream, tuple] | None:
    """An ellipse of four curves."""
    if x1 <= x0 or y1 <= y0:
        return None
    cx, cy, rx, ry, edge = (x0 + x1) / 2.0, (y0 + y1) / 2.0, (x1 - x0) / 2.0, (y1 - y0) / 2.0, width / 2.0
    turns = [((1, 0), (0, 1)), ((0, 1), (-1, 0)), ((-1, 0), (0, -1)), ((0, -1), (1, 0))]
    content = f"{width:.3f} w\n{rgb[0]:.3f} {rgb[1]:.3f} {rgb[2]:.3f} RG\n{cx + rx:.2f} {cy:.2f} m\n"
    for (ax, ay), (bx, by) in turns:
        points = [(ax + KAPPA * bx, ay + KAPPA * by), (bx + KAPPA * ax, by + KAPPA * ay), (bx, by)]
        content += " ".join(f"{cx + rx * u:.2f} {cy + ry * v:.2f}" for u, v in points) + " c\n"
    bounds = (x0 - edge, y0 - edge, x1 + edge, y1 + edge)
    return _form(content + "h\nS\n", bounds), bounds


def ink_shape(points: list[tuple], rgb: tuple, width: float) -> tuple[Stream, tuple] | None:
    """A polyline of two points or more."""
    if len(points) < 2:
        return None
    edge = width / 2.0 + 1.0
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    bounds = (min(xs) - edge, min(ys) - edge, max(xs) + edge, max(ys) + edge)
    path = "".join(f"{x:.2f} {y:.2f} {'l' if i else 'm'}\n" for i, (x, y) in enumerate(points))
    return _form("{:.3f} w\n{:.3f} {:.3f} {:.3f} RG\n".format(width, *rgb) + path + "S\n", bounds), bounds


def tip(x: float, y: float, text: str) -> tuple[Stream, tuple] | None:
    """A note above and to the right of a point; None for no text, or one of over TIP_BYTES bytes."""
    if not text or len(text.encode("latin-1", "replace")) > TIP_BYTES:
        return None
    lines = wrap(text)
    width = max(20.0, *(w for _, w in lines)) + 2 * TIP_PAD
    height = len(lines) * TIP_LINE + 2 * TIP_PAD
    x0, y0 = x, y + TIP_TAIL
    x1, y1 = x0 + width, y0 + height
    content = "1.000 0.980 0.720 rg\n0.350 0.300 0.050 RG\n1.0 w\n"
    content += f"{x0:.2f} {y0:.2f} {width:.2f} {height:.2f} re\nb\n{x:.2f} {y:.2f} m\n{x0 + 4:.2f} {y0:.2f} l\n{x0 + 4 + TIP_TAIL_WIDTH:.2f} {y0:.2f} l\nh\nb\nBT\n/Helv {TIP_SIZE:.2f} Tf\n0 g\n"
    for i, (line, _) in enumerate(lines, 1):
        base = y1 - TIP_PAD - i * TIP_LINE + (TIP_LINE - TIP_SIZE) / 2.0
        content += f"1 0 0 1 {x0 + TIP_PAD:.2f} {base:.2f} Tm\n({_escape(line)}) Tj\n"
    font = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}
    return _form(content + "ET\n", (x, y, x1, y1), {"Font": {"Helv": font}}), (x, y, x1, y1)


def text_value(doc: Document, widget: dict, ref: Ref, value: str) -> tuple[dict, Stream]:
    """A text widget with a new value, and the stream of its appearance (to be its AP's N)."""
    r = box([doc.get(x) for x in doc.get(widget.get("Rect")) or []])
    width, height = (max(1.0, r.x1 - r.x0), max(1.0, r.y1 - r.y0)) if r else (1.0, 1.0)
    da = doc.inherited(widget, ref, "DA")[0]
    m = re.search(rb"/([^ \t\r\n]*)[ \t\r\n]*(-?\d+\.?\d*|-?\.\d+)?", da) if isinstance(da, bytes) else None
    font = (m[1].decode("latin-1") if m else "") or "Helv"
    size = float(m[2]) if m and m[2] else 0.0
    size = size if size > 0 else max(4.0, min(12.0, 0.65 * height))
    pad = lambda v: v - 2.0 if v > 2.0 else v
    content = f"/Tx BMC\nq\n1 1 {pad(width):.2f} {pad(height):.2f} re\nW n\nBT\n/{font} {size:.2f} Tf\n0 g\n2 {max(1.0, (height - size) / 2.0):.2f} Td\n({_escape(value)}) Tj\nET\nQ\nEMC"
    shared = doc.get(doc.root().get("AcroForm"))
    shared = doc.get(shared.get("DR")) if isinstance(shared, dict) else None
    resources = shared if isinstance(shared, dict) else {"Font": {font: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}}}
    return {**widget, "V": value.encode("latin-1", "replace")}, _form(content, (0.0, 0.0, width, height), resources)


def new_annotation(kind: str, shape: tuple[Stream, tuple], rgb: tuple, appearance: Ref, text: str = "", quads: list[list[float]] | None = None) -> dict:
    """The dictionary of a new annotation, whose appearance is written under a reference."""
    more: dict = {}
    if quads:
        more["QuadPoints"] = [float(v) for q in quads for v in q]
    if kind == "FreeText":
        more |= {"Contents": text.encode("latin-1", "replace"), "DA": b"/Helv 9 Tf 0 g", "IC": [1.0, 0.98, 0.72], "CA": 1.0}
    out = _annotation(kind, shape[1], rgb, appearance, **more)
    if kind == "FreeText":
        del out["C"]
    return out
