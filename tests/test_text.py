"""The golden cases of the text queries."""

import random

import pytest

from quire.functions.text import fixed, fold_needle, match_starts, running_sums
from quire.operators import glyphs as G
from quire.plans.text_queries import QUERIES
from quire.sources.content import page_glyphs
from quire.sources.document import Document
from quire.sources.fonts import standard_width
from quire.sources.writer import Builder
from quire.sources.syntax import Name, Ref, Stream
from pyspark.sql import functions as F

LINES = ["AAAA BBBB CCCC", "DDDD EEEE FFFF", "GGGG HHHH IIII"]


def helvetica(spark, lines, left=50.0, top=92.0, step=20.0, size=12.0):
    rows, i = [], 0
    for n, line in enumerate(lines):
        x = left
        for c in line:
            advance = standard_width("Helvetica", ord(c)) / 1000 * size
            rows.append((1, i, c, x, top + step * n, advance, size))
            x, i = x + advance, i + 1
    return spark.createDataFrame(rows, "page int, glyph_idx int, ch string, x0 double, y0 double, advance double, height double")


@pytest.fixture(scope="module")
def search(spark):
    return helvetica(spark, ["The quick brown fox jumps"])


def test_find(search):
    pages = G.text_of(search, ["page"])
    assert search.count() == 25
    assert [(r.start_idx + 1, r.end_idx + 1) for r in G.find(pages, ["page"], "quick").collect()] == [(5, 9)]
    assert G.find(pages, ["page"], "QUICK").count() == 0
    assert G.find(pages, ["page"], "QUICK", False).count() == 1
    assert G.find(pages, ["page"], "elephant").count() == 0
    assert G.find(pages, ["page"], "").count() == 0


def test_rect(search):
    got = G.in_rect(search, ["page"], 0, 80, 300, 100).collect()
    assert [(r.lo + 1, r.hi + 1) for r in got] == [(1, 25)]
    text = G.get_text(G.text_of(search, ["page"]), G.in_rect(search, ["page"], 0, 80, 300, 100), ["page"]).first()
    assert text.selected == "The quick brown fox jumps"
    assert G.in_rect(search, ["page"], 0, 500, 50, 550).count() == 0


def test_between_points(spark):
    rows = helvetica(spark, LINES)
    ranges = G.between_points(rows, ["page"], (94.36, 92.0), (100.34, 132.0))
    assert ranges.count() == 3
    assert G.get_text(G.text_of(rows, ["page"]), ranges, ["page"]).first().selected == "BBB CCCC\nDDDD EEEE FFFF\nGGGG HH"


def test_overlap_and_fold(spark):
    df = spark.createDataFrame([("aaaa",), ("ÉÉ éé",), ("",), (None,), ("x\U0001f600aa",)], "t string")
    found = lambda n, cs=True: [r[0] for r in df.select(match_starts(F.col("t"), n, cs)).collect()]
    assert found("aa") == [[0, 1, 2], [], [], [], [2]]
    assert found("éé", False)[1] == [3]
    assert fold_needle("ABÉ" * 200, False) == "abÉ" * 85 + "a"


def test_ranges_beyond_the_page(spark, search):
    pages = G.text_of(search, ["page"])
    ranges = spark.createDataFrame([(1, 0, 2), (1, 4, 99), (1, 5, 4), (1, -1, 2), (1, 4, 8)], "page int, lo int, hi int")
    assert G.get_text(pages, ranges, ["page"]).first().selected == "The\nquick"


def test_nearest_takes_the_first_of_ties(spark):
    rows = spark.createDataFrame([(1, i, "x", 10.0, 20.0, 6.0, 10.0) for i in (3, 1, 2)], G.layout(spark.createDataFrame([(1, "x")], "doc_id int, text string")).schema)
    assert G.nearest(rows, ["doc_id"], 13.0, 20.0).first().glyph_idx == 1


EDGES = [(1, None), (2, ""), (3, "\n\n"), (4, "\nab\n\nabab\n"), (5, "x\U0001f600a.b\na.b(" * 90), (5, "x\U0001f600a.b\na.b(" * 90), (None, "lone"), (7, "\n" * 5000 + "end\n" * 5000)]


def test_layouts_of_lines_and_of_glyphs_agree(spark):
    docs = spark.createDataFrame(EDGES, "doc_id int, text string").withColumn("lines", F.lit(1)).withColumn("starts", F.lit(2))
    own = docs.where("doc_id is not null").distinct()  # glyph rows tell pages by their key alone
    rows, shape = G.layout(own), G.Layout()
    same = lambda a, b: sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))
    assert same(shape.nearest(own, 81.0, 97.0), G.nearest(rows, ["doc_id"], 81.0, 97.0))
    for rect in ((75.0, 80.0, 90.0, 200.0), (0.0, 0.0, 10.0, 1e6), (78.0, 78.0, 84.0, 1e6)):
        assert same(shape.in_rect(own, *rect), G.in_rect(rows, ["doc_id"], *rect))
        assert same(shape.text_in_rect(own, *rect), G.get_text(G.page_text(own), G.in_rect(rows, ["doc_id"], *rect), ["doc_id"]))
    assert same(shape.between_points(own, (81.0, 97.0), (0.0, 300.0)), G.between_points(rows, ["doc_id"], (81.0, 97.0), (0.0, 300.0)))
    for needle in ("a.b", "ba", "b(", "END", "\U0001f600"):
        assert same(shape.find(own, needle, False), G.boxes(G.find(G.page_text(own), ["doc_id"], needle, False), rows, ["doc_id"]))
    assert shape.find(docs, "lone").first().start_idx == 0 and shape.find(docs, "(x").count() == 2 * 89
    assert [shape.nearest(docs, 0.0, 0.0).where(c).count() for c in ("doc_id is null", "doc_id = 5", "doc_id < 4")] == [1, 2, 0]


def test_running_sums(spark):
    sizes = (0, 1, 63, 64, 65, 128, 129, 5000)
    df = spark.createDataFrame([(list(range(n)),) for n in sizes], "v array<int>")
    assert [r[0] for r in df.select(running_sums(F.col("v"))).collect()] == [[sum(range(k)) for k in range(n + 1)] for n in sizes]


def test_positioned_text_operators():
    b = Builder()
    content = b'q 2 0 0 2 0 0 cm BT /F 10 Tf 5 Tc 3 Tw 50 Tz 10 TL 10 100 Td [(A) -500 (B)] TJ T* (c d) Tj 1 2 (e) " ET Q BT 7 Ts 3 Tr 1 0 0 1 5 5 Tm (z) Tj ET /X Do'
    font = b.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier")})
    form = b.add(Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "Matrix": [1, 0, 0, 1, 100, 0]}, b"BT /F 10 Tf (q) Tj ET"))
    pages = b.add({})
    page = b.add({"Type": Name("Page"), "Parent": pages, "Contents": b.add(Stream({}, content)), "MediaBox": [0, 0, 200, 300], "Resources": {"Font": {"F": font}, "XObject": {"X": form}}})
    b.objects[pages.num] = {"Type": Name("Pages"), "Kids": [page], "Count": 1}
    doc = Document(b.build(b.add({"Type": Name("Catalog"), "Pages": pages})))
    got = page_glyphs(doc, next(doc.pages()))
    assert "".join(chr(g.unicode) for g in got) == "ABc dezq"
    by = {chr(g.unicode): g for g in got}
    assert (by["A"].x0, by["A"].y0, by["A"].advance, by["A"].height) == (20.0, 100.0, 6.0, 20.0)
    assert by["B"].x0 == pytest.approx(20 + 2 * ((6 + 5) * 0.5 + 2.5))
    assert by["c"].y0 == 120.0 and by["d"].x0 == pytest.approx(20 + 2 * (11 * 0.5 + (11 + 3) * 0.5))
    assert by["e"].y0 == 140.0
    assert (by["z"].mode, by["z"].x0, by["z"].y0) == (3, 5.0, 288.0)
    assert by["q"].x0 == 100.0
    assert isinstance(Ref(1, 0), Ref)


def test_fixed_decimals_of_exact_values(spark):
    rng = random.Random(2)
    values = [0.0, 2.625, 2.675, 2.665, 0.005, 1.005, 0.125, 0.375, 9.995, 1e9 + 0.125, 999.9951, None]
    values += [rng.uniform(0, 10 ** rng.randrange(-2, 10)) for _ in range(300)] + [rng.randrange(10**6) / 1000 for _ in range(300)]
    values += [-v for v in values[1:11]]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 2, 3):
        got = [r[0] for r in df.select(fixed(F.col("x"), digits)).collect()]
        assert got == [None if v is None else f"{v:.{digits}f}" for v in values]


def between_by_hand(rows, a, b):
    """(page, lo, hi, x0, y0, x1, y1) of the lines between two points, from glyphs in order."""
    out = []
    for page in sorted({r[0] for r in rows}):
        own = sorted(r for r in rows if r[0] == page)
        i, j = sorted(min((abs(r[3] - y) * 1e6 + abs(r[2] + r[4] * 0.5 - x), r[1]) for r in own)[1] for x, y in (a, b))
        lines = []
        for r in (r for r in own if i <= r[1] <= j):
            if not lines or lines[-1][-1][3] != r[3]:
                lines.append([])
            lines[-1].append(r)
        out += [(page, k[0][1], k[-1][1], min(r[2] for r in k), min(r[3] - r[5] * 0.8 for r in k), max(r[2] + r[4] for r in k), max(r[3] + r[5] * 0.2 for r in k)) for k in lines]
    return out


def test_between_points_on_lines_that_come_back(spark):
    """Lines of one y0 that follow others, columns, ties and gaps in the indices: as by going through the glyphs."""
    rnd, rows = random.Random(3), []
    for page in range(60):
        index, y = 0, 0.0
        for _ in range(rnd.randint(1, 60)):
            index += rnd.choice([1, 1, 3])
            y = y if rnd.random() < 0.7 else y + 10 if page % 2 else rnd.choice([0.0, -0.0, 10.0, 20.0])
            rows.append((page, index, float(rnd.choice([5, 10, 20, 35])), y, rnd.choice([4.0, 6.0]), rnd.choice([8.0, 12.0])))
    rnd.shuffle(rows)
    glyphs = spark.createDataFrame(rows, "page int, glyph_idx int, x0 double, y0 double, advance double, height double")
    for a, b in (((12.0, 3.0), (23.0, 18.0)), ((99.0, 99.0), (0.0, 0.0)), ((13.0, 10.0), (13.0, 10.0))):
        got = sorted(tuple(r) for r in G.between_points(glyphs, ["page"], a, b).collect())
        assert got == sorted(between_by_hand(rows, a, b))
    assert not G.between_points(glyphs.where("page < 0"), ["page"], (1.0, 1.0), (2.0, 2.0)).collect()


def test_between_glyphs_neither_sorts_nor_shuffles_them(spark):
    """Joins and aggregates by hash tables, one shuffle of texts; sorted and shuffled glyphs took over 7 times the input."""
    q = QUERIES["t_between_glyphs"](spark, "/root/testdata/sf0.001")
    assert len(q.collect()) == len(QUERIES["t_between_points"](spark, "/root/testdata/sf0.001").collect())
    plan = q._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan and "glyph_idx ASC" not in plan
    assert plan.count("Generate posexplode(split") == 3 and plan.count("ReusedExchange") == 2
