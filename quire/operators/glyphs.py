"""Text queries on glyph rows.

A glyph table has the page's key columns and glyph_idx, ch (one character), x0, y0 (baseline), advance,
height, in a space with y down. Lines are runs of consecutive glyphs with exactly the same y0.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ascii_fold, bind, fold_needle, match_starts, running_sums

#: Shares of a glyph's height above and below the baseline.
ASCENT, DESCENT = 0.80, 0.20


def layout(docs: DataFrame, key: str = "doc_id", text: str = "text", shape: Layout | None = None) -> DataFrame:
    """Glyphs of plain texts in a fixed-pitch layout; line feeds move down and are no glyphs."""
    shape = shape or Layout()
    zipped = bind(shape.page(text), lambda p: F.arrays_zip(p.lines.alias("line"), F.slice(p.starts, F.lit(1), F.size(p.lines)).alias("start")))
    rows = docs.select(key, F.posexplode(zipped).alias("ln", "z"))
    rows = rows.where(F.length("z.line") > 0).select(key, "ln", F.col("z.start").alias("start"), F.posexplode(F.split("z.line", "")).alias("col", "ch"))
    return rows.select(
        key,
        (F.col("start") + F.col("col")).alias("glyph_idx"),
        "ch",
        shape.x(F.col("col")).alias("x0"),
        shape.y(F.col("ln")).alias("y0"),
        F.lit(float(shape.advance)).alias("advance"),
        F.lit(float(shape.height)).alias("height"),
    )


@dataclass(frozen=True)
class Layout:
    """A fixed-pitch layout, as layout() makes it, held as the lines of each text.

    The places of glyphs follow from the lines, so the queries below make no glyph rows, shuffle nothing and take
    time in proportion to the text. They give the rows that the functions of the same names, further down, give for
    glyph rows. Null and empty texts, and empty lines, have no glyphs and no rows; repeated rows give repeated rows.
    """

    left: float = 72
    top: float = 84
    advance: float = 6
    leading: float = 12
    height: float = 10

    def page(self, text: str = "text") -> Column:
        """(lines, starts): starts has the index of the first glyph of each line, and after the last the number of glyphs."""
        lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
        return bind(lines, lambda x: F.struct(x.alias("lines"), running_sums(F.transform(x, lambda line: F.length(line))).alias("starts")))

    def x(self, col: Column) -> Column:
        return (self.left + self.advance * col).cast("double")

    def y(self, ln: Column) -> Column:
        return (self.top + self.leading * ln).cast("double")

    def _nearest(self, page: Column, x: float, y: float) -> Column:
        """The index of the nearest glyph; of a line, only the two around x can be it."""
        at = math.floor((x - self.left) / self.advance - 0.5)

        def best(line: Column, k: Column) -> Column:
            def candidate(col: int) -> Column:
                held = F.least(F.lit(max(col, 0)), F.length(line) - 1)
                score = F.abs(self.y(k) - y) * 1e6 + F.abs(self.x(held) + self.advance * 0.5 - x)
                return F.struct(score.alias("s"), (F.get(page.starts, k) + held).alias("i"))

            return F.when(line != "", F.array_min(F.array(candidate(at), candidate(at + 1))))

        return F.array_min(F.transform(page.lines, best))["i"]

    def _rect(self, page: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
        """(ln, a, b): the lines that touch a rectangle, and their first and last columns that do."""
        x0, x1, y0, y1 = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
        # the first column whose right edge is at x0 or beyond it, the last whose left edge is at x1 or before it
        low, high = max(math.ceil((x0 - self.left) / self.advance - 1), 0), math.floor((x1 - self.left) / self.advance)
        pieces = F.transform(page.lines, lambda line, k: F.struct(k.alias("ln"), F.lit(low).alias("a"), F.least(F.length(line) - 1, F.lit(high)).alias("b")))
        touches = lambda k: (self.y(k) + self.height * DESCENT >= y0) & (self.y(k) - self.height * ASCENT <= y1)
        return F.filter(pieces, lambda r: touches(r.ln) & (r.a <= r.b))

    def _between(self, page: Column, i: Column, j: Column) -> Column:
        """(ln, a, b): the lines from glyph i to glyph j, or from j to i, and the columns held."""

        def piece(line: Column, k: Column) -> Column:
            start = F.get(page.starts, k)
            low, high = F.greatest(F.least(i, j) - start, F.lit(0)), F.least(F.greatest(i, j) - start, F.length(line) - 1)
            return F.struct(k.alias("ln"), low.alias("a"), high.alias("b"))

        return F.filter(F.transform(page.lines, piece), lambda r: r.a <= r.b)

    def _ranges(self, page: Column, pieces: Column) -> Column:
        """(lo, hi, x0, y0, x1, y1) of each piece of a page."""

        def one(r: Column) -> Column:
            start = F.get(page.starts, r.ln)
            across = [self.x(r.a).alias("x0"), (self.y(r.ln) - self.height * ASCENT).alias("y0"), (self.x(r.b) + self.advance).alias("x1"), (self.y(r.ln) + self.height * DESCENT).alias("y1")]
            return F.struct((start + r.a).alias("lo"), (start + r.b).alias("hi"), *across)

        return F.transform(pieces, one)

    def nearest(self, docs: DataFrame, x: float, y: float, key: str = "doc_id", text: str = "text", name: str = "glyph_idx") -> DataFrame:
        filled = docs.where(F.replace(F.col(text), F.lit("\n"), F.lit("")) != "")
        return filled.select(key, bind(self.page(text), lambda p: self._nearest(p, x, y)).alias(name))

    def in_rect(self, docs: DataFrame, x0: float, y0: float, x1: float, y1: float, key: str = "doc_id", text: str = "text") -> DataFrame:
        return docs.select(key, F.inline(bind(self.page(text), lambda p: self._ranges(p, self._rect(p, x0, y0, x1, y1)))))

    def between_points(self, docs: DataFrame, a: tuple[float, float], b: tuple[float, float], key: str = "doc_id", text: str = "text") -> DataFrame:
        def rows(page: Column) -> Column:
            ends = F.struct(self._nearest(page, *a).alias("i"), self._nearest(page, *b).alias("j"))
            return bind(ends, lambda e: self._ranges(page, self._between(page, e.i, e.j)))

        return docs.select(key, F.inline(bind(self.page(text), rows)))

    def text_in_rect(self, docs: DataFrame, x0: float, y0: float, x1: float, y1: float, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, selected): the text of in_rect's ranges, as by get_text."""

        def selected(page: Column) -> Column:
            parts = F.transform(self._rect(page, x0, y0, x1, y1), lambda r: F.substring(F.get(page.lines, r.ln), r.a + 1, r.b - r.a + 1))
            return F.when(F.size(parts) > 0, F.array_join(parts, "\n"))

        return docs.select(key, bind(self.page(text), selected).alias("selected")).where("selected is not null")

    def find(self, docs: DataFrame, needle: str, case_sensitive: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Matches with boxes (key, start_idx, end_idx, x0, y0, x1, y1)."""
        size = len(needle[:256])

        def boxes(page: Column) -> Column:
            line_of = F.flatten(F.transform(page.lines, lambda line, k: F.array_repeat(k, F.length(line))))
            found = match_starts(F.array_join(page.lines, ""), needle, case_sensitive)
            return bind(line_of, lambda of: F.transform(found, lambda i: one(page, of, i)))

        def one(page: Column, of: Column, i: Column) -> Column:
            held = F.transform(F.sequence(i, i + (size - 1)), lambda g: F.struct(F.get(of, g).alias("ln"), (g - F.get(page.starts, F.get(of, g))).alias("col")))
            return bind(held, lambda h: box_of(i, F.transform(h, lambda c: c.ln), F.transform(h, lambda c: c.col)))

        def box_of(i: Column, ln: Column, col: Column) -> Column:
            return F.struct(
                i.alias("start_idx"),
                (i + (size - 1)).alias("end_idx"),
                self.x(F.array_min(col)).alias("x0"),
                (self.y(F.array_min(ln)) - self.height * ASCENT).alias("y0"),
                (self.x(F.array_max(col)) + self.advance).alias("x1"),
                (self.y(F.array_max(ln)) + self.height * DESCENT).alias("y1"),
            )

        # texts without a match are told by a search of bytes, before any array is made
        body = F.replace(F.col(text), F.lit("\n"), F.lit(""))
        wanted = F.contains(body if case_sensitive else ascii_fold(body), F.lit(fold_needle(needle, case_sensitive)))
        return docs.where(wanted).select(key, F.inline(bind(self.page(text), boxes)))


def page_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The glyphs of each page as one string; line feeds are not glyphs, so matches cross lines."""
    return docs.select(key, F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\n"), F.lit("")).alias("glyph_text"))


def text_of(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """The string of each page's glyphs, in order."""
    rows = F.array_sort(F.collect_list(F.struct("glyph_idx", "ch")))
    return glyphs.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r.ch), "").alias("glyph_text"))


def find(pages: DataFrame, keys: list[str], needle: str, case_sensitive: bool = True, top: int | None = None) -> DataFrame:
    """Matches (keys, start_idx, end_idx), both inclusive; overlapping ones count. top: the first of each page."""
    starts = match_starts(F.col("glyph_text"), needle, case_sensitive)
    starts = F.slice(starts, 1, top) if top else starts
    found = pages.select(*keys, F.explode(starts).alias("start_idx"))
    return found.withColumn("end_idx", F.col("start_idx") + (len(needle[:256]) - 1))


def box(prefix: str = "") -> list[Column]:
    """The bounding box of grouped glyphs."""
    return [
        F.min("x0").alias(f"{prefix}x0"),
        F.min(F.col("y0") - F.col("height") * ASCENT).alias(f"{prefix}y0"),
        F.max(F.col("x0") + F.col("advance")).alias(f"{prefix}x1"),
        F.max(F.col("y0") + F.col("height") * DESCENT).alias(f"{prefix}y1"),
    ]


def boxes(matches: DataFrame, glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """Matches with their bounding boxes. Each match names its glyphs, so the join is on equal keys."""
    named = matches.withColumn("glyph_idx", F.explode(F.sequence("start_idx", "end_idx")))
    met = named.join(glyphs, [*keys, "glyph_idx"])
    return met.groupBy(*keys, "start_idx", "end_idx").agg(*box())


def nearest(glyphs: DataFrame, keys: list[str], x: float, y: float, name: str = "glyph_idx") -> DataFrame:
    """The glyph of each page that is nearest: by line first, then by its middle; the first one on ties."""
    score = F.abs(F.col("y0") - y) * 1e6 + F.abs(F.col("x0") + F.col("advance") * 0.5 - x)
    return glyphs.groupBy(*keys).agg(F.min(F.struct(score.alias("s"), F.col("glyph_idx").alias("i")))["i"].alias(name))


def with_lines(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """Glyphs with line_no: it grows by one wherever y0 differs from that of the glyph before."""
    by = Window.partitionBy(*keys).orderBy("glyph_idx")
    new = F.coalesce((F.col("y0") != F.lag("y0").over(by)).cast("int"), F.lit(0))
    return glyphs.withColumn("_new", new).withColumn("line_no", F.sum("_new").over(by)).drop("_new")


def in_rect(glyphs: DataFrame, keys: list[str], x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """For each line, the range from the first to the last glyph that touches a rectangle, and the box of those
    that do (keys, lo, hi, x0, y0, x1, y1)."""
    x0, x1, y0, y1 = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
    touch = (
        (F.col("x0") + F.col("advance") >= x0)
        & (F.col("x0") <= x1)
        & (F.col("y0") + F.col("height") * DESCENT >= y0)
        & (F.col("y0") - F.col("height") * ASCENT <= y1)
    )
    rows = with_lines(glyphs, keys).where(touch)
    return rows.groupBy(*keys, "line_no").agg(F.min("glyph_idx").alias("lo"), F.max("glyph_idx").alias("hi"), *box()).drop("line_no")


def between_points(glyphs: DataFrame, keys: list[str], a: tuple[float, float], b: tuple[float, float]) -> DataFrame:
    """The glyphs from the nearest to one point to the nearest to another, as one range and box for each line.

    Glyph rows are never sorted, but on pages where a line comes back to the y0 of an earlier one: on all others a
    line is what has one y0. They are gone through for the least distances and for the glyphs at these, twice as the
    pages of either kind are found, and for the lines between; only rows of lines and pages are kept meanwhile. Glyphs that are dealt out by their keys
    already (or made from pages that are) are not shuffled.
    """

    def score(p: tuple[float, float]) -> Column:
        return F.abs(F.col("y0") - p[1]) * 1e6 + F.abs(F.col("x0") + F.col("advance") * 0.5 - p[0])

    def of_pages(pages: DataFrame) -> DataFrame:
        # by hash tables of the pages, as sorts for a join would go over all glyphs
        return glyphs.join(pages.hint("shuffle_hash"), keys)

    for key in keys:  # as by the joins, so that all three read the same
        glyphs = glyphs.where(F.col(key).isNotNull())
    lines = glyphs.groupBy(*keys, "y0").agg(F.min("glyph_idx").alias("_lo"), F.max("glyph_idx").alias("_hi"), F.min(score(a)).alias("_a"), F.min(score(b)).alias("_b"))
    above = Window.partitionBy(*keys).orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)
    mixed = F.coalesce(F.max("_hi").over(above) >= F.col("_lo"), F.lit(False)) | F.col("y0").isNull()
    pages = lines.withColumn("_mixed", mixed).groupBy(*keys).agg(F.min("_a").alias("_a"), F.min("_b").alias("_b"), F.max("_mixed").alias("_mixed"))
    at_a, at_b = score(a).eqNullSafe(F.col("_a")), score(b).eqNullSafe(F.col("_b"))
    at = [F.min(F.when(at_a, F.col("glyph_idx"))).alias("i"), F.min(F.when(at_b, F.col("glyph_idx"))).alias("j"), F.max("_mixed").alias("_mixed")]
    ends = of_pages(pages).where(at_a | at_b).groupBy(*keys).agg(*at).select(*keys, F.least("i", "j").alias("_lo"), F.greatest("i", "j").alias("_hi"), "_mixed")
    # dealt out by another hash, or else Spark would leave that out, and not know of no rows before it reads glyphs
    ends = ends.where("_lo is not null and _hi is not null").repartition(F.xxhash64(*keys))
    held = "glyph_idx between _lo and _hi"
    found = [F.min("glyph_idx").alias("lo"), F.max("glyph_idx").alias("hi"), *box("box_")]
    names = [*keys, "lo", "hi", *[F.col(f"box_{n}").alias(n) for n in ("x0", "y0", "x1", "y1")]]
    plain = of_pages(ends).where(held).groupBy(*keys, "y0").agg(*found, F.max("_mixed").alias("_mixed")).where("not _mixed").select(*names)
    # the ends of these pages are found beside the others'; if there are none, no glyph is read for the lines between
    back = of_pages(ends.where("_mixed")).where(held)
    return plain.unionByName(with_lines(back, keys).groupBy(*keys, "line_no").agg(*found).select(*names))


def get_text(pages: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The text of each page's ranges (lo, hi), in order of lo, with a line feed before each but the first.
    Ranges that are empty or reach beyond the page are left out."""
    met = ranges.join(pages, keys).where("lo >= 0 and lo <= hi and hi < length(glyph_text)")
    part = F.struct("lo", "hi", F.substring("glyph_text", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1).alias("t"))
    parts = F.array_sort(F.collect_list(part))
    return met.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda r: r.t), "\n").alias("selected"))


def step(matches: DataFrame, by: list[str], order: list[str], back: bool = False) -> DataFrame:
    """Each match with the one that a search goes to from it (next_start and the page's order columns),
    around the end of the document."""
    columns = [*order, "start_idx"]
    ordered = Window.partitionBy(*by).orderBy(*columns)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = matches
    for c in columns:
        to = F.lag(c).over(ordered) if back else F.lead(c).over(ordered)
        around = F.last(c).over(whole) if back else F.first(c).over(whole)
        out = out.withColumn(f"to_{c}", F.coalesce(to, around))
    return out


def select_across(pages: DataFrame, doc: str, page: str, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """The text of a selection from (page, glyph) to (page, glyph), whole pages between, for each document."""
    n = F.length("glyph_text")
    lo = F.when(F.col(page) == start[0], F.lit(start[1])).otherwise(F.lit(0))
    hi = F.when(F.col(page) == end[0], F.least(F.lit(end[1]), n - 1)).otherwise(n - 1)
    held = pages.where(F.col(page).between(start[0], end[0])).select(doc, page, F.substring("glyph_text", lo + 1, F.greatest(hi - lo + 1, F.lit(0))).alias("t")).where("length(t) > 0")
    rows = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), "t")))
    return held.groupBy(doc).agg(F.array_join(F.transform(rows, lambda r: r.t), "\n").alias("selected"))


def page_at_offset(pages: DataFrame, doc: str, page: str, height: Column, offset: float, gap: float = 0.0) -> DataFrame:
    """The last page of each document whose top is at or above an offset, pages being stacked in order."""
    tops = F.sum(height + gap).over(Window.partitionBy(doc).orderBy(page)) - (height + gap)
    found = pages.select(doc, page, tops.alias("top"))
    return found.groupBy(doc).agg(F.coalesce(F.max(F.when(F.col("top") <= offset, F.col(page))), F.min(page)).alias("page"))
