"""Numeric kernels over the columns of lineitem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, geometry, numeric
from ..session import table

KEYS = ["l_orderkey", "l_linenumber"]
#: Components from 0 to 1 made of discount, tax, quantity, and of the price's remainder.
_UNIT = {
    "u": "least(1.0D, l_discount * 10.0D)",
    "v": "least(1.0D, l_tax * 12.5D)",
    "w": "l_quantity / 50.0D",
    "z": "(cast(l_partkey % 101 as double)) / 100.0D",
}
_SQL_UNIT = "least(1.0::DOUBLE, l_discount * 10.0::DOUBLE) AS u, least(1.0::DOUBLE, l_tax * 12.5::DOUBLE) AS v, l_quantity / 50.0::DOUBLE AS w, (l_partkey % 101)::DOUBLE / 100.0::DOUBLE AS z"
_FROM = f"SELECT l_orderkey, l_linenumber, {_SQL_UNIT} FROM lineitem"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*KEYS, *[F.expr(e).alias(n) for n, e in _UNIT.items()])


def _query(make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = {n: F.col(n) for n in "uvwz"}
        out: dict[str, Column] = make(**c)
        return _rows(spark, sf_dir).select(*KEYS, *[v.alias(n) for n, v in out.items()])

    return run


def _bytes(rgb) -> dict[str, Column]:
    return {n: color.byte(v) for n, v in zip("rgb", rgb, strict=True)}


def _six(v: Column) -> Column:
    return F.round(v, 6)


def _matrices(u, v, w, z):
    return geometry.matrix(u, v, -v, u, w * 100.0, z * 50.0), geometry.matrix(F.lit(2.0), z, w, F.lit(-1.0), u, v)


def _concat(u, v, w, z):
    m = geometry.concat(*_matrices(u, v, w, z))
    return {n: _six(m[n]) for n in geometry.FIELDS}


def _invert(u, v, w, z):
    m, n = _matrices(u, v, w, z)
    back = geometry.invert(n)
    p = geometry.transform(n, w * 10.0, z * 10.0)
    q = geometry.transform(back, p.x, p.y)
    return {"x": _six(q.x), "y": _six(q.y)}


def _rotate(u, v, w, z):
    turn = (F.floor(z * 100.0).cast("int") % 4) * 90
    p = geometry.topdown(u * 600.0, v * 700.0, F.lit(612.0), F.lit(792.0), turn, 10.0, 20.0)
    q = geometry.native(p.x, p.y, F.lit(612.0), F.lit(792.0), turn, 10.0, 20.0)
    return {"x": _six(p.x), "y": _six(p.y), "back_x": _six(q.x), "back_y": _six(q.y)}


def _norm(u, v, w, z):
    return {"rotation": geometry.normal_rotation(F.floor(z * 100.0).cast("int") * 17 - 850)}


_STOPS = [0, 40, 200, 255, 90]


def _kernels() -> dict:
    out = {
        "k_matrix_concat": _concat,
        "k_matrix_invert": _invert,
        "k_rotate_topdown": _rotate,
        "k_rotation_norm": _norm,
        "k_cmyk_rgb": lambda u, v, w, z: _bytes(color.cmyk_to_rgb(u, v, w, z)),
        "k_calgray": lambda u, v, w, z: _bytes(color.calgray_to_rgb(w, (0.9505, 1.0, 1.089), 2.2)),
        "k_calrgb": lambda u, v, w, z: _bytes(color.calrgb_to_rgb(u, v, w, (0.9505, 1.0, 1.089), 1.8, ((0.4497, 0.3163, 0.1845), (0.2446, 0.672, 0.0833), (0.0252, 0.1412, 0.9227)))),
        "k_lab_rgb": lambda u, v, w, z: _bytes(color.lab_to_rgb(w * 100.0, u * 200.0 - 100.0, v * 200.0 - 100.0, (0.9642, 1.0, 0.8249))),
        "k_fn_exp": lambda u, v, w, z: {"y": _six(numeric.exponential(w * 1.5 - 0.2, 0.1, 0.9, 2.5))},
        "k_fn_sampled": lambda u, v, w, z: {"y": _six(numeric.sampled(w * 1.5 - 0.2, F.array(*[F.lit(x) for x in _STOPS]), 5, 8, decode=(-1.0, 1.0)))},
        "k_fn_stitch": lambda u, v, w, z: {
            "y": _six(numeric.stitched(w, [0.25, 0.6], [(0.0, 1.0), (1.0, 0.0), (0.0, 1.0)], [lambda t: numeric.exponential(t, 0.0, 1.0, 1.0), lambda t: numeric.exponential(t, 0.2, 0.8, 2.0), lambda t: numeric.exponential(t, 1.0, 0.0, 3.0)]))
        },
        "k_shading_axial": lambda u, v, w, z: {"t": _six(numeric.axial(w * 100.0, z * 100.0, (20.0, 10.0, 70.0, 90.0), (True, False)))},
        "k_shading_radial": lambda u, v, w, z: {"t": _six(numeric.radial(w * 100.0, z * 100.0, (40.0, 50.0, 10.0, 60.0, 55.0, 40.0), (False, True)))},
    }
    for mode in color.BLEND:
        out[f"k_blend_{mode}"] = lambda u, v, w, z, f=color.BLEND[mode]: {"blended": color.byte(f(w, z)), "other": color.byte(f(u, v))}
    def composite(u, v, w, z):
        back, source = (u, w, z), (v, z, u)
        rgb, alpha = color.composite(back, v, source, tuple(color.BLEND["multiply"](b, s) for b, s in zip(back, source, strict=True)), w)
        return {**_bytes(rgb), "alpha": color.byte(alpha)}

    out["k_composite"] = composite
    out["k_luminosity_mask"] = lambda u, v, w, z: {"mask": color.byte(color.luminance(u, v, w))}
    return out


def _hsl(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = color.with_hsl_blend(_rows(spark, sf_dir), mode, ("u", "w", "z"), ("v", "z", "u"), ("r", "g", "b"))
        return rows.select(*KEYS, *[color.byte(F.col(n)).alias(n) for n in "rgb"])

    return run


HSL_MODES = ("hue", "saturation", "color", "luminosity")
QUERIES = {n: _query(f) for n, f in _kernels().items()} | {f"k_blend_hsl_{m}": _hsl(m) for m in HSL_MODES}

_D = "::DOUBLE"


def _byte(e: str) -> str:
    return f"CAST(floor(greatest(0.0{_D}, least(1.0{_D}, {e})) * 255.0{_D} + 0.5{_D}) AS INTEGER)"


def _sql(columns: dict[str, str], source: str = _FROM) -> str:
    return f"SELECT l_orderkey, l_linenumber, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM ({source})"


def _f(x: float) -> str:
    return f"({x!r}{_D})"


def _rows3(m, v: tuple[str, str, str]) -> list[str]:
    return [" + ".join(f"{_f(c)} * {x}" for c, x in zip(row, v, strict=True)) for row in m]


def _xyz_sql(x: str, y: str, z: str, white: tuple, source: str) -> str:
    """XYZ columns under a white point, to bytes."""
    own = [sum(a * b for a, b in zip(row, white, strict=True)) for row in color.BRADFORD]
    day = [sum(a * b for a, b in zip(row, color.D65, strict=True)) for row in color.BRADFORD]
    cone = [f"({e}) * {_f(d / s)}" for e, s, d in zip(_rows3(color.BRADFORD, ("xx", "yy", "zz")), own, day, strict=True)]
    a = f"SELECT *, {x} AS xx, {y} AS yy, {z} AS zz FROM ({source})"
    b = f"SELECT *, {cone[0]} AS c0, {cone[1]} AS c1, {cone[2]} AS c2 FROM ({a})"
    d = _rows3(color.BRADFORD_BACK, ("c0", "c1", "c2"))
    c = f"SELECT *, {d[0]} AS d0, {d[1]} AS d1, {d[2]} AS d2 FROM ({b})"
    lin = _rows3(color.XYZ_TO_RGB, ("d0", "d1", "d2"))
    e = f"SELECT *, {lin[0]} AS lr, {lin[1]} AS lg, {lin[2]} AS lb FROM ({c})"
    curve = lambda v: f"CASE WHEN {v} <= 0.0031308{_D} THEN 12.92{_D} * {v} ELSE 1.055{_D} * pow({v}, {_f(1 / 2.4)}) - 0.055{_D} END"
    return _sql({"r": _byte(curve("lr")), "g": _byte(curve("lg")), "b": _byte(curve("lb"))}, e)


def _blend_sql(mode: str, b: str, s: str) -> str:
    hard = lambda t: f"CASE WHEN {t} <= 0.5 THEN 2.0{_D} * {b} * {s} ELSE 1.0{_D} - 2.0{_D} * (1.0{_D} - {b}) * (1.0{_D} - {s}) END"
    return {
        "normal": s,
        "multiply": f"{b} * {s}",
        "screen": f"{b} + {s} - {b} * {s}",
        "overlay": hard(b),
        "darken": f"least({b}, {s})",
        "lighten": f"greatest({b}, {s})",
        "color_dodge": f"CASE WHEN {s} >= 1 THEN 1.0{_D} ELSE least(1.0{_D}, {b} / (1.0{_D} - {s})) END",
        "color_burn": f"CASE WHEN {s} <= 0 THEN 0.0{_D} ELSE greatest(0.0{_D}, 1.0{_D} - (1.0{_D} - {b}) / {s}) END",
        "hard_light": hard(s),
        "soft_light": f"CASE WHEN {s} <= 0.5 THEN {b} - (1.0{_D} - 2.0{_D} * {s}) * {b} * (1.0{_D} - {b}) ELSE {b} + (2.0{_D} * {s} - 1.0{_D}) * ((CASE WHEN {b} <= 0.25 THEN ((16.0{_D} * {b} - 12.0{_D}) * {b} + 4.0{_D}) * {b} ELSE sqrt({b}) END) - {b}) END",
        "difference": f"abs({b} - {s})",
        "exclusion": f"{b} + {s} - 2.0{_D} * {b} * {s}",
    }[mode]


def _hsl_cte(prefix: str, r: str, g: str, b: str) -> str:
    return f"""greatest({r}, {g}, {b}) AS {prefix}hi, least({r}, {g}, {b}) AS {prefix}lo"""


def _hsl_parts(p: str, r: str, g: str, b: str) -> str:
    d = f"({p}hi - {p}lo)"
    hue = f"CASE WHEN {p}hi = {r} THEN ({g} - {b}) / {d} + CASE WHEN {g} < {b} THEN 6.0{_D} ELSE 0.0{_D} END WHEN {p}hi = {g} THEN ({b} - {r}) / {d} + 2.0{_D} ELSE ({r} - {g}) / {d} + 4.0{_D} END"
    light = f"(({p}hi + {p}lo) * 0.5{_D})"
    return f"CASE WHEN {d} = 0 THEN 0.0{_D} ELSE ({hue}) / 6.0{_D} END AS {p}h, CASE WHEN {d} = 0 THEN 0.0{_D} ELSE {d} / (1.0{_D} - abs(2.0{_D} * {light} - 1.0{_D})) END AS {p}s, {light} AS {p}l"


def _hsl_sql(mode: str) -> str:
    a = f"SELECT *, {_hsl_cte('b', 'u', 'w', 'z')}, {_hsl_cte('s', 'v', 'z', 'u')} FROM ({_FROM})"
    b = f"SELECT *, {_hsl_parts('b', 'u', 'w', 'z')}, {_hsl_parts('s', 'v', 'z', 'u')} FROM ({a})"
    if mode == "saturation":
        part = lambda v: f"CASE WHEN bhi - blo <= 0 THEN 0.0{_D} ELSE greatest(0.0{_D}, least(1.0{_D}, ({v} - blo) * (ss / (bhi - blo)))) END"
        c = f"SELECT *, {part('u')} AS p0, {part('w')} AS p1, {part('z')} AS p2 FROM ({b})"
        lum = lambda x, y, z: f"(0.3{_D} * {x} + 0.59{_D} * {y} + 0.11{_D} * {z})"
        shift = f"({lum('u', 'w', 'z')} - {lum('p0', 'p1', 'p2')})"
        return _sql({n: _byte(f"p{i} + {shift}") for i, n in enumerate("rgb")}, c)
    h, s, light = {"hue": ("sh", "bs", "bl"), "color": ("sh", "ss", "bl"), "luminosity": ("bh", "bs", "sl")}[mode]
    c = f"SELECT *, {h} AS h, {s} AS s, {light} AS l, CASE WHEN {light} < 0.5 THEN {light} * (1.0{_D} + {s}) ELSE {light} + {s} - {light} * {s} END AS q FROM ({b})"
    d = f"SELECT *, 2.0{_D} * l - q AS p, h + {_f(1 / 3)} AS t0, h AS t1, h - {_f(1 / 3)} AS t2 FROM ({c})"
    e = "SELECT *, " + ", ".join(f"CASE WHEN t{i} < 0 THEN t{i} + 1.0{_D} WHEN t{i} > 1 THEN t{i} - 1.0{_D} ELSE t{i} END AS k{i}" for i in range(3)) + f" FROM ({d})"
    part = lambda i: f"CASE WHEN s = 0 THEN l WHEN k{i} < {_f(1 / 6)} THEN p + (q - p) * 6.0{_D} * k{i} WHEN k{i} < 0.5 THEN q WHEN k{i} < {_f(2 / 3)} THEN p + (q - p) * ({_f(2 / 3)} - k{i}) * 6.0{_D} ELSE p END"
    return _sql({n: _byte(part(i)) for i, n in enumerate("rgb")}, e)


def _composite_sql() -> str:
    parts = {}
    for n, (b, s) in zip("rgb", (("u", "v"), ("w", "z"), ("z", "u")), strict=True):
        parts[n] = _byte(f"CASE WHEN w <= 0 THEN {b} ELSE ({b} * {s} * w * v + {s} * w * (1.0{_D} - v) + {b} * v * (1.0{_D} - w)) / (w + v * (1.0{_D} - w)) END")
    return _sql({**parts, "alpha": _byte(f"w + v * (1.0{_D} - w)")})


_M = {"a": "u", "b": "v", "c": "-v", "d": "u", "e": f"(w * 100.0{_D})", "f": f"(z * 50.0{_D})"}
_N = {"a": f"2.0{_D}", "b": "z", "c": "w", "d": f"(-1.0{_D})", "e": "u", "f": "v"}


def _times_sql(x: str, y: str) -> str:
    return f"({_M[x]} * {_N[y]})"


_TURN = "((CAST(floor(z * 100.0::DOUBLE) AS INTEGER) % 4) * 90)"
_TX, _TY = f"(u * 600.0{_D} - 10.0{_D})", f"(792.0{_D} - (v * 700.0{_D} - 20.0{_D}))"
_CX = f"(least(greatest(w * 1.5{_D} - 0.2{_D}, 0.0{_D}), 1.0{_D}))"

ORACLES = {
    "k_matrix_concat": _sql(
        {
            "a": f"round({_times_sql('a', 'a')} + {_times_sql('b', 'c')}, 6)",
            "b": f"round({_times_sql('a', 'b')} + {_times_sql('b', 'd')}, 6)",
            "c": f"round({_times_sql('c', 'a')} + {_times_sql('d', 'c')}, 6)",
            "d": f"round({_times_sql('c', 'b')} + {_times_sql('d', 'd')}, 6)",
            "e": f"round({_times_sql('e', 'a')} + {_times_sql('f', 'c')} + {_N['e']}, 6)",
            "f": f"round({_times_sql('e', 'b')} + {_times_sql('f', 'd')} + {_N['f']}, 6)",
        }
    ),
    "k_matrix_invert": _sql({"x": f"round(w * 10.0{_D}, 6)", "y": f"round(z * 10.0{_D}, 6)"}),
    "k_rotate_topdown": _sql(
        {
            "x": f"round(CASE {_TURN} WHEN 90 THEN 792.0{_D} - {_TY} WHEN 180 THEN 612.0{_D} - {_TX} WHEN 270 THEN {_TY} ELSE {_TX} END, 6)",
            "y": f"round(CASE {_TURN} WHEN 90 THEN {_TX} WHEN 180 THEN 792.0{_D} - {_TY} WHEN 270 THEN 612.0{_D} - {_TX} ELSE {_TY} END, 6)",
            "back_x": f"round(u * 600.0{_D}, 6)",
            "back_y": f"round(v * 700.0{_D}, 6)",
        }
    ),
    "k_rotation_norm": _sql({"rotation": f"CAST((floor(((((CAST(floor(z * 100.0{_D}) AS INTEGER) * 17 - 850) % 360) + 360) % 360 + 45) / 90.0) * 90) % 360 AS INTEGER)"}),
    "k_cmyk_rgb": _sql({n: _byte(f"1.0{_D} - least(1.0{_D}, {c} + z)") for n, c in zip("rgb", "uvw", strict=True)}),
    "k_calgray": _xyz_sql(f"{_f(0.9505)} * pow(w, 2.2{_D})", f"1.0{_D} * pow(w, 2.2{_D})", f"{_f(1.089)} * pow(w, 2.2{_D})", (0.9505, 1.0, 1.089), _FROM),
    "k_calrgb": _xyz_sql(
        *_rows3(((0.4497, 0.3163, 0.1845), (0.2446, 0.672, 0.0833), (0.0252, 0.1412, 0.9227)), (f"pow(u, 1.8{_D})", f"pow(v, 1.8{_D})", f"pow(w, 1.8{_D})")), (0.9505, 1.0, 1.089), _FROM
    ),
    "k_lab_rgb": _xyz_sql(
        *[f"{_f(n)} * (CASE WHEN {t} > {_f(6 / 29)} THEN {t} * {t} * {t} ELSE {_f(3 * (6 / 29) * (6 / 29))} * ({t} - {_f(4 / 29)}) END)" for n, t in ((0.9642, "fx"), (1.0, "fy"), (0.8249, "fz"))],
        (0.9642, 1.0, 0.8249),
        f"SELECT *, fy + (u * 200.0{_D} - 100.0{_D}) / 500.0{_D} AS fx, fy - (v * 200.0{_D} - 100.0{_D}) / 200.0{_D} AS fz FROM (SELECT *, (w * 100.0{_D} + 16.0{_D}) / 116.0{_D} AS fy FROM ({_FROM}))",
    ),
    "k_fn_exp": _sql({"y": f"round(0.1{_D} + pow({_CX}, 2.5{_D}) * {_f(0.9 - 0.1)}, 6)"}),
    "k_fn_sampled": _sql(
        {"y": f"round(-1.0{_D} + (s0 + (e - floor(e)) * (s1 - s0)) * 2.0{_D}, 6)"},
        f"SELECT *, [{', '.join(map(str, _STOPS))}][CAST(floor(e) AS INTEGER) + 1] / 255.0{_D} AS s0, [{', '.join(map(str, _STOPS))}][least(CAST(floor(e) AS INTEGER) + 2, 5)] / 255.0{_D} AS s1 FROM (SELECT *, {_CX} * 4.0{_D} AS e FROM ({_FROM}))",
    ),
    "k_fn_stitch": _sql(
        {
            "y": f"round(CASE WHEN w < 0.25 THEN w / 0.25{_D} WHEN w < 0.6 THEN 0.2{_D} + pow(1.0{_D} - (w - 0.25{_D}) / {_f(0.6 - 0.25)}, 2.0{_D}) * {_f(0.8 - 0.2)} ELSE 1.0{_D} - pow((least(w, 1.0{_D}) - 0.6{_D}) / {_f(1.0 - 0.6)}, 3.0{_D}) END, 6)"
        }
    ),
    "k_shading_axial": _sql({"t": "round(CASE WHEN s < 0 THEN 0.0::DOUBLE WHEN s > 1 THEN NULL ELSE s END, 6)"}, f"SELECT *, ((w * 100.0{_D} - 20.0{_D}) * 50.0{_D} + (z * 100.0{_D} - 10.0{_D}) * 80.0{_D}) / 8900.0{_D} AS s FROM ({_FROM})"),
    "k_shading_radial": _sql(
        {"t": "round(coalesce(CASE WHEN 10 + hi * 30 >= 0 AND hi >= 0 THEN least(hi, 1.0::DOUBLE) END, CASE WHEN 10 + lo * 30 >= 0 AND lo >= 0 THEN least(lo, 1.0::DOUBLE) END), 6)"},
        f"""SELECT *, greatest(k1, k2) AS hi, least(k1, k2) AS lo FROM (SELECT *, CASE WHEN disc >= 0 THEN (-b + sqrt(disc)) / (2.0{_D} * a) END AS k1, CASE WHEN disc >= 0 THEN (-b - sqrt(disc)) / (2.0{_D} * a) END AS k2 FROM (
SELECT *, b * b - 4.0{_D} * a * c AS disc FROM (SELECT *, -475.0{_D} AS a, -2.0{_D} * (px * 20.0{_D} + py * 5.0{_D} + 300.0{_D}) AS b, px * px + py * py - 100.0{_D} AS c FROM (
SELECT *, w * 100.0{_D} - 40.0{_D} AS px, z * 100.0{_D} - 50.0{_D} AS py FROM ({_FROM})))))""",
    ),
    **{f"k_blend_{m}": _sql({"blended": _byte(_blend_sql(m, "w", "z")), "other": _byte(_blend_sql(m, "u", "v"))}) for m in color.BLEND},
    **{f"k_blend_hsl_{m}": _hsl_sql(m) for m in HSL_MODES},
    "k_composite": _composite_sql(),
    "k_luminosity_mask": _sql({"mask": _byte(f"0.3{_D} * u + 0.59{_D} * v + 0.11{_D} * w")}),
}
