"""Form fields and annotations as rows: kinds, hit tests, appearances and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_literal, fixed

#: Flag bits of a button field, of a read-only field, and of hidden annotations.
RADIO, PUSH, READ_ONLY, HIDDEN, NO_VIEW = 0x8000, 0x10000, 0x1, 0x2, 0x20


def field_type(kind: Column, flags: Column) -> Column:
    """text, checkbox or other."""
    button = flags.bitwiseAND(F.lit(RADIO | PUSH)) == 0
    return F.when(kind == "Tx", "text").when((kind == "Btn") & button, "checkbox").otherwise("other")


def visible(flags: Column) -> Column:
    return F.coalesce(flags, F.lit(0)).bitwiseAND(F.lit(HIDDEN | NO_VIEW)) == 0


def on_state(names: Column) -> Column:
    """The first appearance state that is not Off, of an ordered array of names."""
    return F.get(F.filter(names, lambda x: x != "Off"), F.lit(0))


def first_hit(rows: DataFrame, keys: list[str], index: str, x: Column | float, y: Column | float, condition: Column | None = None) -> DataFrame:
    """The first row of each page, in order of index, whose closed rectangle (x0, y0, x1, y1) holds a point."""
    x, y = (v if isinstance(v, Column) else F.lit(float(v)) for v in (x, y))
    inside = x.between(F.col("x0"), F.col("x1")) & y.between(F.col("y0"), F.col("y1"))
    if condition is not None:
        inside = inside & condition
    return rows.where(inside).groupBy(*keys).agg(F.min(index).alias(index))


def delete_first(rows: DataFrame, keys: list[str], index: str, x: Column | float, y: Column | float, condition: Column | None = None) -> DataFrame:
    """Rows without the first hit of each page."""
    return rows.join(first_hit(rows, keys, index, x, y, condition), [*keys, index], "left_anti")


def parse_da(da: Column) -> tuple[Column, Column]:
    """(font name, size) of a default appearance string: its first name and the number after it."""
    name = F.regexp_extract(da, r"/([^ \t\r\n]*)", 1)
    size = F.regexp_extract(da, r"/[^ \t\r\n]*[ \t\r\n]*(-?(?:[0-9]+\.?[0-9]*|\.[0-9]+))", 1)
    return F.nullif(name, F.lit("")), F.coalesce(size.try_cast("double"), F.lit(0.0))


def font_size(da_size: Column, height: Column) -> Column:
    """The size to write a field's text in: the appearance string's, or a share of the height from 4 to 12."""
    return F.when(da_size > 0, da_size).otherwise(F.greatest(F.lit(4.0), F.least(F.lit(12.0), height * 0.65)))


def text_appearance(value: Column, width: Column, height: Column, font: Column, size: Column) -> Column:
    """The content stream of a text field."""
    width, height = F.greatest(width, F.lit(1.0)), F.greatest(height, F.lit(1.0))
    pad = lambda v: F.when(v > 2.0, v - 2.0).otherwise(v)
    base = F.greatest(F.lit(1.0), (height - size) / 2.0)
    shape = "/Tx BMC\nq\n1 1 %s %s re\nW n\nBT\n/%s %s Tf\n0 g\n2 %s Td\n(%s) Tj\nET\nQ\nEMC"
    numbers = [fixed(v, 2) for v in (pad(width), pad(height), size, base)]
    return F.format_string(shape, *numbers[:2], F.coalesce(font, F.lit("Helv")), *numbers[2:], escape_literal(value))


def square_appearance(x0: Column, y0: Column, x1: Column, y1: Column, rgb: tuple[float, float, float], line: float) -> Column:
    """The content stream of a rectangle's outline; null if it is empty."""
    pen = "%.3f w\n%.3f %.3f %.3f RG\n" % (line, *rgb)
    stream = F.format_string(pen + "%s %s %s %s re\nS\n", *[fixed(v, 2) for v in (x0, y0, x1 - x0, y1 - y0)])
    return F.when((x1 > x0) & (y1 > y0), stream)


def arrow(x1: Column, y1: Column, x2: Column, y2: Column, line: float, length: float = 10.0, width: float = 4.0) -> Column:
    """Wings and bounding box of an arrow from one point to another; null if it has no direction."""
    dx, dy = x2 - x1, y2 - y1
    size = F.sqrt(dx * dx + dy * dy)
    ux, uy = F.try_divide(dx, size), F.try_divide(dy, size)
    bx, by = x2 - length * ux, y2 - length * uy
    wings = [bx - width * uy, by + width * ux, bx + width * uy, by - width * ux]
    edge = line / 2.0 + 1.0
    xs, ys = [x1, x2, wings[0], wings[2]], [y1, y2, wings[1], wings[3]]
    parts = [*wings, F.least(*xs) - edge, F.least(*ys) - edge, F.greatest(*xs) + edge, F.greatest(*ys) + edge]
    names = ["wx1", "wy1", "wx2", "wy2", "x0", "y0", "x1", "y1"]
    return F.when(size >= 0.001, F.struct(*[p.alias(n) for p, n in zip(parts, names, strict=True)]))


def highlight_box(quads: Column) -> Column:
    """The bounding box of quadrilaterals given as one array of coordinates."""
    xs, ys = F.filter(quads, lambda v, i: i % 2 == 0), F.filter(quads, lambda v, i: i % 2 == 1)
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def ink_box(points: Column, line: float) -> Column:
    """The bounding box of a polyline of two points or more, with its pen; else null."""
    b, edge = highlight_box(points), line / 2.0 + 1.0
    return F.when(F.size(points) >= 4, F.struct((b.x0 - edge).alias("x0"), (b.y0 - edge).alias("y0"), (b.x1 + edge).alias("x1"), (b.y1 + edge).alias("y1")))
