"""Text queries over documents laid out as glyphs, and over conversations as files of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import glyphs as G
from ..session import table

KEYS = ["doc_id"]

GLYPHS = """ch AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents),
ln AS (SELECT *, sum(CASE WHEN ch = chr(10) THEN 1 ELSE 0 END) OVER w AS ln, i - 1 - max(CASE WHEN ch = chr(10) THEN i ELSE 0 END) OVER w AS col
       FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS glyph_idx, ch,
             CAST(72 + 6 * col AS DOUBLE) AS x0, CAST(84 + 12 * ln AS DOUBLE) AS y0, 6.0::DOUBLE AS advance, 10.0::DOUBLE AS height
      FROM ln WHERE ch <> chr(10))"""
BOX = "min(x0) AS x0, min(y0 - height * 0.8::DOUBLE) AS y0, max(x0 + advance) AS x1, max(y0 + height * 0.2::DOUBLE) AS y1"
LINES = """SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY glyph_idx) AS line_no FROM (
  SELECT *, CASE WHEN y0 <> lag(y0) OVER (PARTITION BY doc_id ORDER BY glyph_idx) THEN 1 ELSE 0 END AS fresh FROM {})"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.layout(_documents(spark, sf_dir))


def _find(needle: str, case_sensitive: bool = True, top: int | None = None):
    return lambda spark, sf_dir: G.find(G.page_text(_documents(spark, sf_dir)), KEYS, needle, case_sensitive, top)


def _fold(sql: str, case_sensitive: bool) -> str:
    return sql if case_sensitive else f"translate({sql}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _match_cte(needle: str, case_sensitive: bool = True, source: str = "g", by: str = "doc_id") -> str:
    parts = [_fold("ch" if not k else f"lead(ch, {k}) OVER w", case_sensitive) + f" = {_fold(repr(c), case_sensitive)}" for k, c in enumerate(needle)]
    return f"""m AS (SELECT {by}, glyph_idx AS start_idx, glyph_idx + {len(needle) - 1} AS end_idx FROM (
  SELECT {by}, glyph_idx, {' AND '.join(parts)} AS hit FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY glyph_idx)) WHERE hit)"""


def t_find_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.Layout().find(_documents(spark, sf_dir), "ation", False)


def t_find_glyph_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same boxes by way of glyph rows, as for glyphs of any layout."""
    docs = _documents(spark, sf_dir)
    return G.boxes(G.find(G.page_text(docs), KEYS, "ation", False), G.layout(docs), KEYS)


def t_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.Layout().nearest(_documents(spark, sf_dir), 200.0, 301.0)


def t_rect_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.Layout().in_rect(_documents(spark, sf_dir), 300.0, 80.0, 100.0, 200.0)


def t_between_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.Layout().between_points(_documents(spark, sf_dir), (94.36, 92.0), (200.0, 150.0))


def t_get_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.Layout().text_in_rect(_documents(spark, sf_dir), 300.0, 80.0, 100.0, 200.0)


# the same by way of glyph rows, as for glyphs of any layout


def t_nearest_glyph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.nearest(_glyphs(spark, sf_dir), KEYS, 200.0, 301.0)


def t_rect_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.in_rect(_glyphs(spark, sf_dir), KEYS, 300.0, 80.0, 100.0, 200.0)


def t_between_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are dealt out, not their glyphs, which take many times their room
    docs = _documents(spark, sf_dir).select("doc_id", "text").where("doc_id is not null").repartition("doc_id")
    return G.between_points(G.layout(docs), KEYS, (94.36, 92.0), (200.0, 150.0))


def t_get_glyph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = t_rect_glyphs(spark, sf_dir).select("doc_id", "lo", "hi")
    return G.get_text(G.page_text(_documents(spark, sf_dir)), ranges, KEYS)


def t_glyph_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("glyph_text")
    return G.page_text(_documents(spark, sf_dir)).select("doc_id", F.length(text).cast("bigint").alias("n_glyphs"))


def t_invisible_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaces are glyphs too: how many, and the last one's place."""
    text = F.col("glyph_text")
    n = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    last = F.when(n > 0, F.length(text) - F.instr(F.reverse(text), " "))
    return G.page_text(_documents(spark, sf_dir)).where("glyph_text <> ''").select("doc_id", n.cast("bigint").alias("n_spaces"), last.alias("last_space"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations")
    return pages.select("conv_id", "turn", F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("")).alias("glyph_text"))


def _step(back: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        matches = G.find(_pages(spark, sf_dir), ["conv_id", "turn"], "the", False)
        return G.step(matches.select("conv_id", "turn", "start_idx"), ["conv_id"], ["turn"], back)

    return query


def t_multi_page_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.select_across(_pages(spark, sf_dir), "conv_id", "turn", (1, 5), (3, 10))


def t_page_at_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    height = (F.length("glyph_text") % 50 + 100).cast("double")
    return G.page_at_offset(_pages(spark, sf_dir), "conv_id", "turn", height, 260.0, 8.0)


QUERIES = {
    "t_find": _find("the"),
    "t_find_ci": _find("THE", False),
    "t_find_none": _find("elephantine"),
    "t_find_overlap": _find("ee"),
    "t_find_bbox": t_find_bbox,
    "t_find_glyph_boxes": t_find_glyph_boxes,
    "t_find_topk": _find("on", True, 128),
    "t_find_next_wrap": _step(False),
    "t_find_prev_wrap": _step(True),
    "t_nearest": t_nearest,
    "t_rect_ranges": t_rect_ranges,
    "t_between_points": t_between_points,
    "t_get_text": t_get_text,
    "t_nearest_glyph": t_nearest_glyph,
    "t_rect_glyphs": t_rect_glyphs,
    "t_between_glyphs": t_between_glyphs,
    "t_get_glyph_text": t_get_glyph_text,
    "t_glyph_count": t_glyph_count,
    "t_invisible_spaces": t_invisible_spaces,
    "t_multi_page_select": t_multi_page_select,
    "t_page_at_offset": t_page_at_offset,
}


def _plain(needle: str, case_sensitive: bool = True) -> str:
    return f"WITH {GLYPHS}, {_match_cte(needle, case_sensitive)} SELECT * FROM m"


_CONVERSATIONS = """p AS (SELECT conv_id, turn, replace(coalesce(text, ''), chr(10), '') AS t FROM conversations),
c AS (SELECT conv_id, turn, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) - 1 AS glyph_idx FROM p WHERE t <> '')"""


def _steps(fn: str, around: str) -> str:
    over = "(PARTITION BY conv_id ORDER BY turn, start_idx)"
    whole = "(PARTITION BY conv_id ORDER BY turn, start_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    to = ", ".join(f"coalesce({fn}({c}) OVER {over}, {around}({c}) OVER {whole}) AS to_{c}" for c in ("turn", "start_idx"))
    return f"WITH {_CONVERSATIONS}, {_match_cte('the', False, 'c', 'conv_id, turn')} SELECT conv_id, turn, start_idx, {to} FROM m"


_RECT = f"""r AS (SELECT doc_id, min(glyph_idx) AS lo, max(glyph_idx) AS hi, {BOX} FROM ({LINES.format('g')})
  WHERE x0 + advance >= 100 AND x0 <= 300 AND y0 + height * 0.2::DOUBLE >= 80 AND y0 - height * 0.8::DOUBLE <= 200 GROUP BY doc_id, line_no)"""
_NEAR = "(abs(y0 - {1}::DOUBLE) * 1e6::DOUBLE + abs(x0 + advance * 0.5::DOUBLE - {0}::DOUBLE))"


def _nearest(x: float, y: float) -> str:
    return f"(SELECT doc_id, glyph_idx AS n FROM (SELECT doc_id, glyph_idx, row_number() OVER (PARTITION BY doc_id ORDER BY {_NEAR.format(x, y)}, glyph_idx) AS k FROM g) WHERE k = 1)"


ORACLES = {
    "t_find": _plain("the"),
    "t_find_ci": _plain("THE", False),
    "t_find_none": _plain("elephantine"),
    "t_find_overlap": _plain("ee"),
    "t_find_bbox": f"WITH {GLYPHS}, {_match_cte('ation', False)} SELECT doc_id, start_idx, end_idx, {BOX} FROM m JOIN g USING (doc_id) WHERE glyph_idx BETWEEN start_idx AND end_idx GROUP BY ALL",
    "t_find_glyph_boxes": f"WITH {GLYPHS}, {_match_cte('ation', False)} SELECT doc_id, start_idx, end_idx, {BOX} FROM m JOIN g USING (doc_id) WHERE glyph_idx BETWEEN start_idx AND end_idx GROUP BY ALL",
    "t_find_topk": f"WITH {GLYPHS}, {_match_cte('on')} SELECT doc_id, start_idx, end_idx FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start_idx) <= 128",
    "t_find_next_wrap": _steps("lead", "first_value"),
    "t_find_prev_wrap": _steps("lag", "last_value"),
    "t_nearest": f"WITH {GLYPHS} SELECT doc_id, n AS glyph_idx FROM {_nearest(200.0, 301.0)}",
    "t_rect_ranges": f"WITH {GLYPHS}, {_RECT} SELECT * FROM r",
    "t_between_points": f"""WITH {GLYPHS}, e AS (SELECT a.doc_id, least(a.n, b.n) AS l, greatest(a.n, b.n) AS h FROM {_nearest(94.36, 92.0)} a JOIN {_nearest(200.0, 150.0)} b USING (doc_id)),
held AS (SELECT g.* FROM g JOIN e USING (doc_id) WHERE glyph_idx BETWEEN l AND h)
SELECT doc_id, min(glyph_idx) AS lo, max(glyph_idx) AS hi, {BOX} FROM ({LINES.format('held')}) GROUP BY doc_id, line_no""",
    "t_get_text": f"""WITH {GLYPHS}, {_RECT}
SELECT doc_id, string_agg(t, chr(10) ORDER BY lo) AS selected FROM (
  SELECT r.doc_id, lo, string_agg(ch, '' ORDER BY glyph_idx) AS t FROM r JOIN g USING (doc_id) WHERE glyph_idx BETWEEN lo AND hi GROUP BY r.doc_id, lo) GROUP BY doc_id""",
    "t_glyph_count": "SELECT doc_id, length(replace(text, chr(10), '')) AS n_glyphs FROM documents",
    "t_invisible_spaces": f"WITH {GLYPHS} SELECT doc_id, count(*) FILTER (ch = ' ') AS n_spaces, max(glyph_idx) FILTER (ch = ' ') AS last_space FROM g GROUP BY doc_id",
    "t_multi_page_select": f"""WITH {_CONVERSATIONS}, h AS (SELECT conv_id, turn, string_agg(ch, '' ORDER BY glyph_idx) AS t FROM c
  WHERE turn BETWEEN 1 AND 3 AND (turn <> 1 OR glyph_idx >= 5) AND (turn <> 3 OR glyph_idx <= 10) GROUP BY conv_id, turn)
SELECT conv_id, string_agg(t, chr(10) ORDER BY turn) AS selected FROM h GROUP BY conv_id""",
    "t_page_at_offset": """WITH p AS (SELECT conv_id, turn, CAST(length(replace(coalesce(text, ''), chr(10), '')) % 50 + 100 + 8 AS DOUBLE) AS h FROM conversations),
t AS (SELECT conv_id, turn, sum(h) OVER (PARTITION BY conv_id ORDER BY turn) - h AS top FROM p)
SELECT conv_id, coalesce(max(turn) FILTER (top <= 260), min(turn)) AS page FROM t GROUP BY conv_id""",
}
ORACLES |= {of: ORACLES[name] for of, name in (("t_nearest_glyph", "t_nearest"), ("t_rect_glyphs", "t_rect_ranges"), ("t_between_glyphs", "t_between_points"), ("t_get_glyph_text", "t_get_text"))}
