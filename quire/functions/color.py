"""Colour spaces, blending and compositing, as expressions on components from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RGB = tuple[Column, Column, Column]

#: XYZ (D65) to linear sRGB, the Bradford cone matrix, its inverse, and the D65 white.
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
BRADFORD_BACK = ((0.9869929, -0.1470543, 0.1599627), (0.4323053, 0.5183603, 0.0492912), (-0.0085287, 0.0400428, 0.9684867))
D65 = (0.95047, 1.0, 1.08883)


def unit(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def byte(v: Column) -> Column:
    """A component as 0 to 255."""
    return F.floor(unit(v) * 255.0 + 0.5).cast("int")


def _apply(m, v):
    return tuple(row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in m)


def _adapt(xyz: RGB, white: tuple[float, float, float]) -> RGB:
    """XYZ under a white point, under D65."""
    cone, own, day = _apply(BRADFORD, xyz), _apply(BRADFORD, white), _apply(BRADFORD, D65)
    return _apply(BRADFORD_BACK, tuple(c * (d / (s or 1.0)) for c, s, d in zip(cone, own, day, strict=True)))


def _srgb(xyz: RGB) -> RGB:
    def curve(v: Column) -> Column:
        return unit(F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1.0 / 2.4)) - 0.055))

    return tuple(curve(v) for v in _apply(XYZ_TO_RGB, xyz))


def gray_to_rgb(g: Column) -> RGB:
    return unit(g), unit(g), unit(g)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> RGB:
    return tuple(1.0 - F.least(F.lit(1.0), unit(v) + unit(k)) for v in (c, m, y))


def calgray_to_rgb(g: Column, white=D65, gamma: float = 1.0) -> RGB:
    level = F.pow(unit(g), F.lit(float(gamma))) if gamma > 0 else unit(g)
    return _srgb(_adapt(tuple(w * level for w in white), white))


def calrgb_to_rgb(a: Column, b: Column, c: Column, white=D65, gamma: float = 1.0, matrix=((1.0, 0, 0), (0, 1.0, 0), (0, 0, 1.0))) -> RGB:
    lin = tuple(F.pow(unit(v), F.lit(float(gamma if gamma > 0 else 1.0))) for v in (a, b, c))
    return _srgb(_adapt(_apply(matrix, lin), white))


def lab_to_rgb(lightness: Column, a: Column, b: Column, white=D65, low=(-100.0, -100.0), high=(100.0, 100.0)) -> RGB:
    clamp = lambda v, x, y: F.greatest(F.lit(float(x)), F.least(F.lit(float(y)), v))
    fy = (clamp(lightness, 0, 100) + 16.0) / 116.0
    fx, fz = fy + clamp(a, low[0], high[0]) / 500.0, fy - clamp(b, low[1], high[1]) / 200.0
    delta = 6.0 / 29.0
    back = lambda t: F.when(t > delta, t * t * t).otherwise(3.0 * delta * delta * (t - 4.0 / 29.0))
    return _srgb(_adapt(tuple(w * back(t) for w, t in zip(white, (fx, fy, fz), strict=True)), white))


def _soft_light(b: Column, s: Column) -> Column:
    bright = F.when(b <= 0.25, ((16.0 * b - 12.0) * b + 4.0) * b).otherwise(F.sqrt(b))
    return F.when(s <= 0.5, b - (1.0 - 2.0 * s) * b * (1.0 - b)).otherwise(b + (2.0 * s - 1.0) * (bright - b))


def _hard(chooser: Column, b: Column, s: Column) -> Column:
    return F.when(chooser <= 0.5, 2.0 * b * s).otherwise(1.0 - 2.0 * (1.0 - b) * (1.0 - s))


#: Separable modes: backdrop and source component to the blended one.
BLEND = {
    "normal": lambda b, s: s,
    "multiply": lambda b, s: b * s,
    "screen": lambda b, s: b + s - b * s,
    "overlay": lambda b, s: _hard(b, b, s),
    "darken": lambda b, s: F.least(b, s),
    "lighten": lambda b, s: F.greatest(b, s),
    "color_dodge": lambda b, s: F.when(s >= 1.0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.try_divide(b, 1.0 - s))),
    "color_burn": lambda b, s: F.when(s <= 0.0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - F.try_divide(1.0 - b, s))),
    "hard_light": lambda b, s: _hard(s, b, s),
    "soft_light": _soft_light,
    "difference": lambda b, s: F.abs(b - s),
    "exclusion": lambda b, s: b + s - 2.0 * b * s,
}


def rgb_to_hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    light, d = (high + low) * 0.5, high - low
    hue = F.when(high == r, F.try_divide(g - b, d) + F.when(g < b, 6.0).otherwise(0.0)).when(high == g, F.try_divide(b - r, d) + 2.0).otherwise(F.try_divide(r - g, d) + 4.0)
    flat = d == 0.0
    return F.when(flat, 0.0).otherwise(hue / 6.0), F.when(flat, 0.0).otherwise(F.try_divide(d, 1.0 - F.abs(2.0 * light - 1.0))), light


def hsl_to_rgb(h: Column, s: Column, light: Column) -> RGB:
    q = F.when(light < 0.5, light * (1.0 + s)).otherwise(light + s - light * s)
    p = 2.0 * light - q

    def part(shift: float) -> Column:
        t = h + shift
        t = F.when(t < 0.0, t + 1.0).when(t > 1.0, t - 1.0).otherwise(t)
        v = F.when(t < 1.0 / 6.0, p + (q - p) * 6.0 * t).when(t < 0.5, q).when(t < 2.0 / 3.0, p + (q - p) * (2.0 / 3.0 - t) * 6.0).otherwise(p)
        return F.when(s == 0.0, light).otherwise(v)

    return part(1.0 / 3.0), part(0.0), part(-1.0 / 3.0)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.3 * r + 0.59 * g + 0.11 * b


def with_hsl_blend(df: DataFrame, mode: str, back: tuple[str, str, str], source: tuple[str, str, str], out: tuple[str, str, str]) -> DataFrame:
    """df with the blend of two colours by hue, saturation, color or luminosity, by way of HSL (saturation by
    scaling the range of components). Steps are projections of their own, so that no expression is repeated
    within another and generated code stays small."""
    b, s = [F.col(c) for c in back], [F.col(c) for c in source]
    parts = [*rgb_to_hsl(*b), *rgb_to_hsl(*s)]
    names = ["_bh", "_bs", "_bl", "_sh", "_ss", "_sl"]
    df = df.withColumns(dict(zip(names, parts, strict=True)))
    if mode == "saturation":
        low, d = F.least(*b), F.greatest(*b) - F.least(*b)
        scaled = {f"_p{i}": F.when(d <= 0.0, 0.0).otherwise(unit((v - low) * F.try_divide(F.col("_ss"), d))) for i, v in enumerate(b)}
        df = df.withColumns(scaled).withColumn("_shift", luminance(*b) - luminance(*[F.col(c) for c in scaled]))
        df = df.withColumns({n: unit(F.col(c) + F.col("_shift")) for n, c in zip(out, scaled, strict=True)})
        return df.drop(*names, *scaled, "_shift")
    h, sat, light = {"hue": ("_sh", "_bs", "_bl"), "color": ("_sh", "_ss", "_bl"), "luminosity": ("_bh", "_bs", "_sl")}[mode]
    rgb = hsl_to_rgb(F.col(h), F.col(sat), F.col(light))
    return df.withColumns(dict(zip(out, rgb, strict=True))).drop(*names)


def composite(back: RGB, back_alpha: Column, source: RGB, blended: RGB, alpha: Column) -> tuple[RGB, Column]:
    """Source over backdrop with the blended colour where both are: ((r, g, b), alpha)."""
    out = alpha + back_alpha * (1.0 - alpha)
    mix = tuple(F.try_divide(m * alpha * back_alpha + s * alpha * (1.0 - back_alpha) + b * back_alpha * (1.0 - alpha), out) for b, s, m in zip(back, source, blended, strict=True))
    return tuple(F.when(alpha <= 0.0, b).otherwise(m) for b, m in zip(back, mix, strict=True)), F.when(alpha <= 0.0, back_alpha).otherwise(out)
