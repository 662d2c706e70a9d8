"""PDF functions of one input and gradients, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def exponential(x: Column, c0: float, c1: float, n: float, domain=(0.0, 1.0)) -> Column:
    """c0 + x^n (c1 - c0), x within the domain; the range is not applied."""
    x = _clamp(x, *domain)
    return float(c0) + (x if n == 1.0 else F.pow(x, F.lit(float(n)))) * (float(c1) - float(c0))


def sampled(x: Column, samples: Column, size: int, bits: int, domain=(0.0, 1.0), encode=None, decode=(0.0, 1.0)) -> Column:
    """Linear interpolation in an array of raw samples."""
    encode = encode or (0.0, size - 1.0)
    x = _clamp(x, *domain)
    e = encode[0] + (x - domain[0]) * (encode[1] - encode[0]) / (domain[1] - domain[0]) if domain[1] > domain[0] else F.lit(float(encode[0]))
    e = _clamp(e, 0.0, size - 1.0)
    low = F.floor(e).cast("int")
    top = 2.0**bits - 1.0
    a, b = F.get(samples, low) / top, F.get(samples, F.least(low + 1, F.lit(size - 1))) / top
    return decode[0] + (a + (e - low) * (b - a)) * (decode[1] - decode[0])


def stitched(x: Column, bounds: list[float], encode: list[tuple[float, float]], parts: list, domain=(0.0, 1.0)) -> Column:
    """The first part whose bound exceeds x, with x mapped into its encoding. parts: Column to Column."""
    x = _clamp(x, *domain)
    edges = [domain[0], *bounds, domain[1]]
    out = None
    for k in reversed(range(len(parts))):
        low, high = edges[k], edges[k + 1]
        inner = encode[k][0] + (x - low) * (encode[k][1] - encode[k][0]) / (high - low) if high > low else F.lit(float(encode[k][0]))
        value = parts[k](inner)
        out = value if out is None else F.when(x < bounds[k], value).otherwise(out)
    return out


def axial(x: Column, y: Column, coords: tuple[float, float, float, float], extend=(False, False), domain=(0.0, 1.0)) -> Column:
    """The parameter of an axial gradient at a point; null outside."""
    x0, y0, x1, y1 = coords
    dx, dy = x1 - x0, y1 - y0
    size = dx * dx + dy * dy
    s = F.lit(0.0) if size < 1e-12 else ((x - x0) * dx + (y - y0) * dy) / size
    t = F.when(s < 0.0, F.lit(0.0) if extend[0] else F.lit(None)).when(s > 1.0, F.lit(1.0) if extend[1] else F.lit(None)).otherwise(s)
    return domain[0] + t * (domain[1] - domain[0])


def radial(x: Column, y: Column, coords: tuple[float, ...], extend=(False, False), domain=(0.0, 1.0)) -> Column:
    """The parameter of the last circle of a radial gradient through a point; null where there is none."""
    x0, y0, r0, x1, y1, r1 = coords
    dx, dy, dr = x1 - x0, y1 - y0, r1 - r0
    px, py = x - x0, y - y0
    a = dx * dx + dy * dy - dr * dr
    b = -2.0 * (px * dx + py * dy + r0 * dr)
    c = px * px + py * py - r0 * r0

    def usable(s: Column) -> Column:
        held = F.when(s < 0.0, F.lit(0.0) if extend[0] else F.lit(None)).when(s > 1.0, F.lit(1.0) if extend[1] else F.lit(None)).otherwise(s)
        return F.when((r0 + s * dr >= 0.0) & (r0 + held * dr >= 0.0), held)

    if abs(a) < 1e-9:
        t = F.when(F.abs(b) > 1e-12, usable(F.try_divide(-c, b)))
    else:
        disc = b * b - 4.0 * a * c
        root = F.sqrt(F.greatest(disc, F.lit(0.0)))
        one, two = (-b + root) / (2.0 * a), (-b - root) / (2.0 * a)
        t = F.when(disc >= 0.0, F.coalesce(usable(F.greatest(one, two)), usable(F.least(one, two))))
    return domain[0] + t * (domain[1] - domain[0])
