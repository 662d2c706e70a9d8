"""Paths to coverage, and painting with blending, on numpy bitmaps."""

from __future__ import annotations

import math

import numpy as np

#: Scan lines for each row of pixels, and straight pieces of a curve.
ROWS, PIECES = 4, 12

#: Meetings of edges and scan lines that are held at once, for paths of fewer edges.
CROSSINGS = 1 << 18

Point = tuple[float, float]


def curve(a: Point, b: Point, c: Point, d: Point) -> list[Point]:
    """Points along a cubic curve, without its start."""
    t = np.arange(1, PIECES + 1) / PIECES
    u = 1 - t
    w = [u**3, 3 * u * u * t, 3 * u * t * t, t**3]
    xs, ys = (sum(k * p[i] for k, p in zip(w, (a, b, c, d), strict=True)) for i in (0, 1))
    return list(zip(xs.tolist(), ys.tolist(), strict=True))


def coverage(paths: list[list[Point]], width: int, height: int, even_odd: bool = False) -> np.ndarray:
    """How much of each pixel lies inside closed paths, 0 to 1: exact along a scan line, sampled across."""
    (top, left), held = covered(paths, width, height, even_odd)
    out = np.zeros((height, width))
    out[top : top + held.shape[0], left : left + held.shape[1]] = held
    return out


def covered(paths: list[list[Point]], width: int, height: int, even_odd: bool = False) -> tuple[tuple[int, int], np.ndarray]:
    """coverage's values in a window that holds all that are over zero, and the row and column at which it begins."""
    edges = []
    for path in paths:
        if len(path) < 2 or not all(math.isfinite(v) for p in path for v in p):
            continue
        p = np.array([*path, path[0]])
        e = np.concatenate([p[:-1], p[1:]], 1)
        edges.append(e[e[:, 1] != e[:, 3]])
    edges = np.concatenate(edges) if edges else np.empty((0, 4))
    if not len(edges) or not width or not height:
        return (0, 0), np.empty((0, 0))
    ys, xs = edges[:, 1::2], edges[:, ::2]
    first, last = max(0, int(np.floor(ys.min()))), min(height, int(np.ceil(ys.max())))
    left, right = (int(np.clip(np.floor(x), 0, width)) for x in (xs.min() - 1, xs.max() + 2))
    if last <= first or right <= left:
        return (0, 0), np.empty((0, 0))
    out = np.empty((last - first, right - left))
    band = max(1, CROSSINGS // (ROWS * len(edges)))
    for row in range(first, last, band):
        end = min(row + band, last)
        out[row - first : end - first] = _band(edges, row, end, left, right, width, even_odd)
    return (first, left), np.clip(out / ROWS, 0, 1)


def _band(edges: np.ndarray, top: int, end: int, left: int, right: int, width: int, even_odd: bool) -> np.ndarray:
    """The sums over scan lines of what is inside, for rows from top to before end and columns from left to before right."""
    shape = (end - top, right - left + 1)
    low, high = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    # each edge meets the scan lines from low to before high
    lines = top + (np.arange(ROWS * shape[0]) + 0.5) / ROWS
    start, n = np.searchsorted(lines, low), np.searchsorted(lines, high)
    n -= start
    of = np.repeat(np.arange(len(edges)), n)
    line = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + start[of]
    slope = (edges[:, 2] - edges[:, 0]) / (edges[:, 3] - edges[:, 1])
    x = edges[of, 0] + (lines[line] - edges[of, 1]) * slope[of]
    order = np.lexsort((x, line))
    line, x = line[order], np.clip(x[order], 0, width)
    if even_odd:
        inside = (np.arange(len(line)) - np.searchsorted(line, line)) % 2 == 0
    else:  # the paths are closed, so a line's senses add up to zero
        inside = np.cumsum(np.where(edges[:, 3] > edges[:, 1], 1, -1)[of[order]]) != 0
    k = np.flatnonzero(inside[:-1] & (line[1:] == line[:-1]))
    row, a, b = line[k] // ROWS, x[k], x[k + 1]
    i, j = a.astype(int), b.astype(int)
    one = i == j
    # a span's first and last pixels in part, and those between as the sum of steps up and down
    parts, steps = np.zeros(shape), np.zeros(shape)
    np.add.at(parts, (row, i - left), np.where(one, b - a, i + 1 - a))
    np.add.at(parts, (row, j - left), np.where(one, 0, b - j))
    np.add.at(steps, (row, np.minimum(i + 1, j) - left), ~one)
    np.subtract.at(steps, (row, j - left), ~one)
    return (parts + np.cumsum(steps, 1))[:, :-1]


def stroke(paths: list[tuple[list[Point], bool]], width: float) -> list[list[Point]]:
    """The outlines of lines along paths (points, whether closed): a quadrilateral for each piece, all of one
    sense, to be filled by the nonzero rule. Lines are at least a pixel wide."""
    half, out = max(width, 1.0) / 2, []
    for points, closed in paths:
        ends = [*points, points[0]] if closed and len(points) > 1 else points
        for (ax, ay), (bx, by) in zip(ends, ends[1:], strict=False):
            size = math.hypot(bx - ax, by - ay)
            if size < 1e-9:
                continue
            nx, ny = -(by - ay) / size * half, (bx - ax) / size * half
            out.append([(ax + nx, ay + ny), (bx + nx, by + ny), (bx - nx, by - ny), (ax - nx, ay - ny)])
    return out


def _soft(b, s):
    bright = np.where(b <= 0.25, ((16 * b - 12) * b + 4) * b, np.sqrt(b))
    return np.where(s <= 0.5, b - (1 - 2 * s) * b * (1 - b), b + (2 * s - 1) * (bright - b))


def _hard(chooser, b, s):
    return np.where(chooser <= 0.5, 2 * b * s, 1 - 2 * (1 - b) * (1 - s))


def _hsl(v):
    """Hue (0 to 1), saturation and lightness of colours along the last axis, kept as planes with one component."""
    r, g, b = (v[..., i : i + 1] for i in range(3))
    high, low = v.max(-1, keepdims=True), v.min(-1, keepdims=True)
    d, light = high - low, (high + low) / 2
    flat = d == 0
    d = np.where(flat, 1, d)
    hue = np.where(high == r, (g - b) / d + np.where(g < b, 6, 0), np.where(high == g, (b - r) / d + 2, (r - g) / d + 4)) / 6
    span = 1 - np.abs(2 * light - 1)
    return np.where(flat, 0, hue), np.where(flat, 0, d / np.where(flat, 1, span)), light


def _from_hsl(hue, sat, light):
    q = np.where(light < 0.5, light * (1 + sat), light + sat - light * sat)
    p = 2 * light - q
    t = (hue + np.array([1 / 3, 0, -1 / 3])) % 1
    rise = np.where(t < 1 / 6, p + (q - p) * 6 * t, np.where(t < 1 / 2, q, np.where(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6, p)))
    return np.where(sat == 0, light, rise)


#: Shares of red, green and blue in a luminance.
LUMINANCE = np.array([0.30, 0.59, 0.11])


def _saturated(b, s):
    """The backdrop's range of components scaled to the source's saturation, at the backdrop's luminance."""
    low, d = b.min(-1, keepdims=True), np.ptp(b, -1, keepdims=True)
    scaled = np.where(d <= 0, 0, np.clip((b - low) * _hsl(s)[1] / np.where(d <= 0, 1, d), 0, 1))
    return np.clip(scaled + ((b - scaled) @ LUMINANCE)[..., None], 0, 1)


#: Blend modes of arrays of colours, backdrop and source: the separable ones, then those by hue, saturation and lightness.
MODES = {
    "Multiply": lambda b, s: b * s,
    "Screen": lambda b, s: b + s - b * s,
    "Overlay": lambda b, s: _hard(b, b, s),
    "Darken": np.minimum,
    "Lighten": np.maximum,
    "ColorDodge": lambda b, s: np.where(s >= 1, 1.0, np.minimum(1, b / np.where(s >= 1, 1, 1 - s))),
    "ColorBurn": lambda b, s: np.where(s <= 0, 0.0, np.maximum(0, 1 - (1 - b) / np.where(s <= 0, 1, s))),
    "HardLight": lambda b, s: _hard(s, b, s),
    "SoftLight": _soft,
    "Difference": lambda b, s: np.abs(b - s),
    "Exclusion": lambda b, s: b + s - 2 * b * s,
    "Hue": lambda b, s: _from_hsl(_hsl(s)[0], *_hsl(b)[1:]),
    "Saturation": _saturated,
    "Color": lambda b, s: _from_hsl(*_hsl(s)[:2], _hsl(b)[2]),
    "Luminosity": lambda b, s: _from_hsl(*_hsl(b)[:2], _hsl(s)[2]),
}


def box_means(plane: np.ndarray, rows: np.ndarray, cols: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Means, rounded down, of boxes of a plane of bytes around places; what lies outside the plane does not count.

    Sums wrap at 32 bits, and so do their differences, which are those of a box and fit."""
    total = np.zeros((plane.shape[0] + 1, plane.shape[1] + 1), np.uint32)
    np.cumsum(plane, 0, np.uint32, out=total[1:, 1:])
    np.cumsum(total[1:, 1:], 1, out=total[1:, 1:])
    top, left = np.maximum(rows - high // 2, 0), np.maximum(cols - wide // 2, 0)
    end, right = np.minimum(rows - high // 2 + high, plane.shape[0]), np.minimum(cols - wide // 2 + wide, plane.shape[1])
    sums = total[end, right] - total[top, right] - total[end, left] + total[top, left]
    return sums // ((end - top) * (right - left))


def _bytes_of(v: np.ndarray) -> np.ndarray:
    """Values from 0 to 1 as whole steps of 255, still as reals."""
    return np.floor(np.clip(v, 0, 1) * 255 + 0.5)


class Bitmap:
    """RGB and alpha, held as bytes: values from 0 to 1 quantised after each paint. touched: for a knockout group,
    where it has been painted; what is painted there again replaces what was."""

    def __init__(self, colours: np.ndarray, opacity: np.ndarray, touched: np.ndarray | None = None):
        self.colours, self.opacity, self.touched = colours, opacity, touched

    @classmethod
    def blank(cls, width: int, height: int, opaque: bool = True, spare: Bitmap | None = None) -> Bitmap:
        """spare: a bitmap that is not needed any more; one of the same size is cleared, which is faster than fresh memory."""
        if spare and spare.opacity.shape == (height, width):
            spare.colours.fill(255 * opaque)
            spare.opacity.fill(255 * opaque)
            spare.touched = None
            return spare
        return cls(np.full((height, width, 3), 255 * opaque, np.uint8), np.full((height, width), 255 * opaque, np.uint8))

    @property
    def rgb(self) -> np.ndarray:
        """The colours from 0 to 1, as a new array."""
        return self.colours / 255

    @property
    def alpha(self) -> np.ndarray:
        return self.opacity / 255

    def paint(self, cover: np.ndarray, colour, mode: str = "Normal", at: tuple[int, int] = (0, 0)) -> None:
        """A colour (or an array of colours of the whole bitmap) where cover, opacity included, is over zero. cover
        is that of the bitmap, or of a window that begins at a row and a column of it."""
        rows, cols = np.flatnonzero(cover.any(1)), np.flatnonzero(cover.any(0))
        if not len(rows):
            return
        held = (slice(rows[0], rows[-1] + 1), slice(cols[0], cols[-1] + 1))
        part = tuple(slice(s.start + k, s.stop + k) for s, k in zip(held, at, strict=True))
        a, back, under = cover[held][..., None], self.colours[part] / 255, self.opacity[part][..., None] / 255
        live = a > 0
        if self.touched is not None:
            again = self.touched[part][..., None] & live
            back, under = np.where(again, 0, back), np.where(again, 0, under)
            self.touched[part] |= live[..., 0]
        colour = np.asarray(colour, float)
        source = np.broadcast_to(colour[part] if colour.ndim == 3 else colour, back.shape)
        mixed = MODES[mode](back, source) if mode in MODES else source
        out = a + under * (1 - a)
        with np.errstate(invalid="ignore", divide="ignore"):
            new = (mixed * a * under + source * a * (1 - under) + back * under * (1 - a)) / out
        np.copyto(self.colours[part], _bytes_of(new), "unsafe", live)
        np.copyto(self.opacity[part], _bytes_of(out)[..., 0], "unsafe", live[..., 0])

    def ppm_parts(self) -> tuple[bytes, np.ndarray]:
        """The head and the body of the binary pixmap file; the body is the bitmap's own memory."""
        return b"P6\n%d %d\n255\n" % (self.colours.shape[1], self.colours.shape[0]), self.colours

    def ppm(self) -> bytes:
        """The picture as a binary pixmap file."""
        return b"".join(self.ppm_parts())
