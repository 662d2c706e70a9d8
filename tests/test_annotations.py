import math
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry
from quire.operators import annotations as A
from quire.operators import forms, objects


def greedy(text, size=9.0, width=200.0, most=20):
    """Word by word, by the rules."""
    lines, at = [], 0
    blank = A.word_width(" ", size)
    while len(lines) < most:
        while at < len(text) and text[at] == " ":
            at += 1
        if at >= len(text):
            break
        line, total = None, 0.0
        if text[at] in "\r\n":
            at += 2 if text[at : at + 2] in ("\r\n", "\n\r") else 1
            lines.append(("", 0.0))
            continue
        while at < len(text):
            if text[at] in "\r\n":
                at += 2 if text[at : at + 2] in ("\r\n", "\n\r") else 1
                break
            if text[at] == " ":
                at += 1
                continue
            end = at
            while end < len(text) and text[end] not in " \r\n":
                end += 1
            word = text[at:end][:127]
            w = A.word_width(word, size)
            if line is not None and (total + blank + w > width or len(line) + 1 + len(word) >= 128):
                break
            line, total = (word, w) if line is None else (f"{line} {word}", total + blank + w)
            at = end
        lines.append((line or "", total))
    if at < len(text) and lines and len(lines[-1][0]) + 3 < 128:
        lines[-1] = (lines[-1][0] + "...", lines[-1][1] + A.word_width("...", size))
    return lines or [("", 0.0)]


def test_wrap():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(["word ", "a", "longerword ", "\n", "\r\n", " ", "x" * 140, "mi "]) for _ in range(rng.randrange(40)))
        got, want = A.wrap(text), greedy(text)
        assert [x for x, _ in got] == [x for x, _ in want], repr(text)
        assert all(math.isclose(a, b) for (_, a), (_, b) in zip(got, want, strict=True))


def test_shapes():
    assert A.line_shape((0, 0), (0, 0), (1, 0, 0), 1) is None
    assert A.square_shape(5, 5, 5, 9, (1, 0, 0), 1) is None
    assert A.ink_shape([(0, 0)], (0, 0, 0), 1) is None
    look, bounds = A.circle_shape(0, 0, 10, 20, (1, 0, 0), 2)
    assert bounds == (-1, -1, 11, 21) and look.raw.count(b" c\n") == 4
    assert b"10.00 15.52 7.76 20.00 5.00 20.00 c" in look.raw
    look, bounds = A.highlight([[0, 10, 20, 10, 0, 0, 20, 0], [5, 30, 6, 30, 5, 20, 6, 20]], (1, 1, 0), 0.4)
    assert bounds == (0, 0, 20, 30) and look.raw.count(b"f\n") == 2 and b"20.00 10.00 l\n20.00 0.00 l\n0.00 0.00 l" in look.raw
    assert A.ink_shape([(0, 0), (3, 4)], (0, 0, 0), 2)[1] == (-2, -2, 5, 6)
    assert A.tip(0, 0, "") is None and A.tip(0, 0, "x" * 301) is None
    look, bounds = A.tip(10, 20, "a (note)")
    assert bounds[:2] == (10, 20) and b"(a \\(note\\)) Tj" in look.raw


def test_columns_agree_with_shapes(spark):
    row = spark.range(1).select(
        forms.arrow(F.lit(1.0), F.lit(2.0), F.lit(30.0), F.lit(9.0), 2.0).alias("a"),
        forms.square_appearance(F.lit(1.0), F.lit(2.0), F.lit(5.0), F.lit(9.0), (1, 0, 0), 2.0).alias("s"),
        forms.highlight_box(F.array(*[F.lit(float(v)) for v in (0, 10, 20, 10, 0, 0, 20, 0)])).alias("h"),
        forms.ink_box(F.array(*[F.lit(float(v)) for v in (0, 0, 3, 4)]), 2.0).alias("i"),
        forms.text_appearance(F.lit("a(b"), F.lit(100.0), F.lit(20.0), F.lit("Helv"), forms.font_size(F.lit(0.0), F.lit(20.0))).alias("t"),
        F.struct(*forms.parse_da(F.lit("0 g /Helv -9.5 Tf"))).alias("d"),
        forms.on_state(F.array(F.lit("Off"), F.lit("Yes"))).alias("on"),
        forms.visible(F.lit(34)).alias("v"),
    ).first()
    assert (row.a.x0, row.a.y0, row.a.x1, row.a.y1) == pytest.approx(A.line_shape((1, 2), (30, 9), (0, 0, 0), 2)[1])
    assert row.s.encode() == A.square_shape(1, 2, 5, 9, (1, 0, 0), 2)[0].raw
    assert tuple(row.h) == (0, 0, 20, 10) and tuple(row.i) == (-2, -2, 5, 6)
    assert row.t == "/Tx BMC\nq\n1 1 98.00 18.00 re\nW n\nBT\n/Helv 12.00 Tf\n0 g\n2 4.00 Td\n(a\\(b) Tj\nET\nQ\nEMC"
    assert tuple(row.d) == ("Helv", -9.5) and row.on == "Yes" and not row.v


def test_rotation(spark):
    df = spark.createDataFrame([(x,) for x in (-90, 44, 45, 315, 720, 134, -46)], "r int")
    assert [r[0] for r in df.select(geometry.normal_rotation(F.col("r"))).collect()] == [270, 0, 90, 0, 0, 90, 270]


def test_objects(spark):
    nodes = spark.createDataFrame([("a", None, None), ("b", "a", "x"), ("c", "b", None), ("d", "e", None), ("e", "d", None), ("f", "zz", None)], "n string, p string, v string")
    got = {r.n: (r.v, r.owner) for r in objects.inherit(nodes, "n", "p", "v", levels=5).collect()}
    assert got == {"a": (None, None), "b": ("x", "b"), "c": ("x", "b"), "d": (None, None), "e": (None, None), "f": (None, None)}
    df = spark.range(1).select(objects.dict_set(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), "a", F.lit(9)).alias("m"), objects.remove_at(F.array(*[F.lit(i) for i in range(4)]), 2).alias("r"))
    row = df.first()
    assert row.m == {"a": 9, "b": 2} and row.r == [0, 1, 3]
