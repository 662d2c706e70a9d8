"""Affine maps, page rotation and coordinate spaces, as expressions.

A matrix is a struct (a, b, c, d, e, f): x' = a x + c y + e, y' = b x + d y + f.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = "abcdef"


def matrix(*values: Column | float) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for v, n in zip(values, FIELDS, strict=True)])


def concat(m: Column, n: Column) -> Column:
    """m followed by n."""
    return matrix(
        m.a * n.a + m.b * n.c,
        m.a * n.b + m.b * n.d,
        m.c * n.a + m.d * n.c,
        m.c * n.b + m.d * n.d,
        m.e * n.a + m.f * n.c + n.e,
        m.e * n.b + m.f * n.d + n.f,
    )


def transform(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m.a * x + m.c * y + m.e).alias("x"), (m.b * x + m.d * y + m.f).alias("y"))


def invert(m: Column) -> Column:
    """The inverse map; null if the determinant is within 1e-12 of zero."""
    det = m.a * m.d - m.b * m.c
    a, b, c, d = m.d / det, -m.b / det, -m.c / det, m.a / det
    inverse = matrix(a, b, c, d, -(m.e * a + m.f * c), -(m.e * b + m.f * d))
    return F.when(F.abs(det) >= 1e-12, inverse)


def normal_rotation(degrees: Column) -> Column:
    """The nearest multiple of 90, from 0 to 270 (45 goes up)."""
    turned = F.pmod(degrees.cast("int"), F.lit(360)) + 45
    return F.pmod((F.floor(turned / 90) * 90).cast("int"), F.lit(360))


def topdown(x: Column, y: Column, width: Column, height: Column, rotate: Column, crop_x: Column | float = 0.0, crop_y: Column | float = 0.0, scale: float = 1.0) -> Column:
    """A native point (y up) in the rotated, cropped page space with y down."""
    u, v = (x - crop_x) * scale, (height - (y - crop_y)) * scale
    w, h = width * scale, height * scale
    px = F.when(rotate == 90, h - v).when(rotate == 180, w - u).when(rotate == 270, v).otherwise(u)
    py = F.when(rotate == 90, u).when(rotate == 180, h - v).when(rotate == 270, w - u).otherwise(v)
    return F.struct(px.alias("x"), py.alias("y"))


def native(x: Column, y: Column, width: Column, height: Column, rotate: Column, crop_x: Column | float = 0.0, crop_y: Column | float = 0.0) -> Column:
    """The inverse of topdown at scale one."""
    u = F.when(rotate == 90, y).when(rotate == 180, width - x).when(rotate == 270, width - y).otherwise(x)
    v = F.when(rotate == 90, height - x).when(rotate == 180, height - y).when(rotate == 270, x).otherwise(y)
    return F.struct((u + crop_x).alias("x"), (height - v + crop_y).alias("y"))
