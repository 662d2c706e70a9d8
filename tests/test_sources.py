"""Bytes to tables: layouts, filters, ciphers, damage."""

import base64
import random
import zlib

import pytest

from quire.operators import annotations as A
from quire.sources import crypt, filters, reader
from quire.sources.content import operations, page_glyphs
from quire.sources.document import Document, Fault
from quire.sources.fonts import parse_to_unicode, standard_width
from quire.sources.syntax import Name, Reader, Ref, Stream, serialise
from quire.sources.writer import Builder, incremental_update, text_pdf

TEXT = "Hello (world) \\ two  spaces\nline2 éü ñ\n" + "\n".join(f"row {i} " + "x" * (i * 7 % 250) for i in range(120))
VARIANTS = """classic classic_flate classic_a85_flate xref_stream xref_stream_predictor objstm incremental_1 incremental_3 contents_array
nested_pages inherited_attrs rotate_90 rotate_180 rotate_270 cropbox type0_tounicode rc4_40 rc4_128 aesv2""".split()


@pytest.mark.parametrize("variant", VARIANTS)
def test_round_trip(variant):
    doc = Document(text_pdf(TEXT, variant))
    glyphs = [g for p in doc.pages() for g in page_glyphs(doc, p)]
    assert "".join(chr(g.unicode) for g in glyphs) == TEXT.replace("\n", "")
    first = {"rotate_90": (708, 72), "rotate_180": (540, 708), "rotate_270": (84, 540), "cropbox": (36, 48)}.get(variant, (72, 84))
    assert (glyphs[0].x0, glyphs[0].y0, glyphs[0].advance, glyphs[0].height) == (*first, 6.0, 10.0)
    assert doc.declared_pages() == sum(1 for _ in doc.pages()) == 3


def test_syntax():
    data = b"<< /A#20b 1 /C [1 0 R -2.5 (a\\(b\\)\\101\\\n) <4> true null foo] % note\n /D << /E /F >> /G .5 >>"
    v = Reader(data).value()
    assert v == {"A b": 1, "C": [Ref(1, 0), -2.5, b"a(b)A", b"@", True, None, None], "D": {"E": "F"}, "G": 0.5}
    again = Reader(serialise(v)).value()
    assert again == v and isinstance(again["D"]["E"], Name)


@pytest.mark.parametrize("seed", range(20))
def test_serialised_values_are_read_back(seed):
    rng = random.Random(seed)

    def value(depth):
        kind = rng.randrange(9 if depth < 4 else 7)
        if kind == 0:
            return rng.randrange(-(10**6), 10**6)
        if kind == 1:
            return round(rng.uniform(-1000, 1000), 3)
        if kind == 2:
            return bytes(rng.randrange(256) for _ in range(rng.randrange(20)))
        if kind == 3:
            return Name("".join(chr(rng.randrange(33, 256)) for _ in range(rng.randrange(1, 9))))
        if kind == 4:
            return rng.random() < 0.5
        if kind == 5:
            return Ref(rng.randrange(1, 99), 0)
        if kind == 6:
            return None
        if kind == 7:
            return [value(depth + 1) for _ in range(rng.randrange(5))]
        return {f"K{i}": value(depth + 1) for i in range(rng.randrange(5))}

    v = value(0)
    if not isinstance(v, Ref):
        assert Reader(serialise(v)).value() == v


def test_filters():
    raw = bytes(range(256)) * 3 + b"\0\0\0\0ab"
    assert filters.ascii85(base64.a85encode(raw) + b"~>junk") == raw
    assert filters.ascii85(b"z!!\n") == bytes(5)
    coded = zlib.compress(raw)
    assert filters.flate(coded) == filters.flate(coded[:-4] + b"bad!") == filters.flate(coded[2:-4]) == raw
    with pytest.raises(filters.FilterFault):
        filters.flate(b"\x78\x9c\xff\xff\xff")
    rows = [bytes(random.Random(i).randrange(256) for _ in range(12)) for i in range(9)]
    for kind in range(5):
        out, before = b"", bytes(12)
        for r in rows:
            coded = bytearray()
            for i, v in enumerate(r):
                a, b, c = (r[i - 3] if i > 2 else 0), before[i], (before[i - 3] if i > 2 else 0)
                p = a + b - c
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                coded.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
            out += bytes([kind]) + bytes(coded)
            before = r
        assert filters.predictor(out, 4, 3, 8) == b"".join(rows)


def test_ciphers():
    # published vectors
    key, block = bytes.fromhex("000102030405060708090a0b0c0d0e0f"), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypt.aes_encrypt(key, bytes(16), block).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    long = bytes(range(32))
    assert crypt.aes_encrypt(long, bytes(16), block).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert crypt.aes_decrypt(long, key, crypt.aes_encrypt(long, key, block * 3)) == block * 3
    assert crypt.aes_decrypt(key, bytes(16), b"") == crypt.aes_encrypt(key, bytes(16), b"") == b""
    assert crypt.aes_decrypt(key, bytes(16), bytes.fromhex("69c4e0d86a7b0430d8cdb78070b4c55a") + b"cut") == block
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    for revision in (5, 6):
        file_key, salts = bytes(range(32)), b"validate" + b"key salt"
        user = crypt.hash_v5(salts[:8], revision) + salts
        wrapped = crypt.aes_encrypt(crypt.hash_v5(salts[8:], revision), bytes(16), file_key)
        c = crypt.Crypt({"V": 5, "R": revision, "U": user, "UE": wrapped}, b"")
        assert (c.method, c.key) == ("aes256", file_key)
        assert c.decrypt(1, 0, key + crypt.aes_encrypt(file_key, key, b"text" + b"\x0c" * 12)) == b"text"
        assert c.decrypt(1, 0, b"short") == b"" and c.decrypt(1, 0, bytes(40)) == bytes(24)
    assert crypt.Crypt({"Filter": Name("Other"), "V": 5}, b"").method is None


def test_damaged_files_give_a_status(spark):
    good = text_pdf(TEXT, "objstm")
    rng, cases = random.Random(5), {"empty": b"", "cut": good[: len(good) // 2], "nostart": good.replace(b"startxref", b"startxxxx"), "zero": bytes(500)}
    for i in range(120):
        broken = bytearray(text_pdf("some text", rng.choice(["classic", "objstm", "xref_stream", "aesv2"])))
        for _ in range(rng.randrange(1, 30)):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        cases[f"fuzz{i}"] = bytes(broken)
    df = spark.createDataFrame([*cases.items(), ("none", None), ("good", good)], "path string, content binary")
    status = {r.file_id: r.status for r in reader.view(df, "files").collect()}
    assert len(status) == len(cases) + 2 and status["good"] == "OK" and status["none"] == status["cut"] == "BADARG"
    for name in reader.SCHEMAS:
        reader.view(df, name).collect()


def test_cycles_and_generations():
    data = text_pdf("a text")
    start = int(data[data.rfind(b"startxref") + 9 :].split()[0])
    looped = data.replace(b"trailer\n<<", b"trailer\n<</Prev %d " % start)
    doc = Document(looped)
    assert "".join(chr(g.unicode) for p in doc.pages() for g in page_glyphs(doc, p)) == "a text"
    doc = Document(data)
    assert doc.get(Ref(1, 7)) is None and doc.get(Ref(1, 0)) is not None and doc.get(Ref(99, 0)) is None
    b = Builder()
    a, c = b.add({}), b.add({})
    b.objects[a.num], b.objects[c.num] = {"Type": Name("Pages"), "Kids": [c, a]}, {"Type": Name("Pages"), "Kids": [a]}
    assert list(Document(b.build(b.add({"Type": Name("Catalog"), "Pages": a}))).pages()) == []


def test_freed_objects_stay_hidden():
    data = text_pdf("a text")
    doc = Document(data)
    page = next(doc.pages())
    start = int(data[data.rfind(b"startxref") + 9 :].split()[0])
    trailer = serialise({**doc.trailer, "Prev": start})
    freed = data + b"xref\n%d 1\n0000000000 00001 f \ntrailer\n" % page.num + trailer + b"\nstartxref\n%d\n%%%%EOF" % len(data)
    assert list(Document(freed).pages()) == []


def test_hybrid_section_prefers_its_stream_to_a_free_entry():
    b = Builder()
    pages = b.add({})
    hidden = b.add({"Type": Name("Page"), "Parent": pages, "MediaBox": [0, 0, 10, 20]})
    b.objects[pages.num] = {"Type": Name("Pages"), "Kids": [hidden], "Count": 1}
    data = b.build(b.add({"Type": Name("Catalog"), "Pages": pages}))
    start, entry = int(data[data.rfind(b"startxref") + 9 :].split()[0]), Document(data).table[hidden.num]
    row = b"%010d 00000 n" % entry.offset
    stream_at = len(data)
    v = Stream({"Type": Name("XRef"), "W": [1, 4, 1], "Index": [hidden.num, 1], "Size": 9}, b"\x01" + entry.offset.to_bytes(4, "big") + b"\0")
    data = data.replace(row, b"0000000000 00000 f").replace(b"trailer\n<<", b"trailer\n<</XRefStm %010d " % (stream_at + 21))
    data += b"9 0 obj\n" + serialise(v) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % start
    at = data.index(b"9 0 obj\n")
    data = data.replace(b"/XRefStm %010d" % (stream_at + 21), b"/XRefStm %010d" % at)
    assert [p.media.y1 for p in Document(data).pages()] == [20.0]


def test_incremental_updates():
    data = text_pdf(TEXT, "classic_flate", [{"FT": Name("Tx"), "T": b"n", "V": b"old", "Rect": [10, 20, 110, 40]}, {"FT": Name("Btn"), "T": b"c", "AP": {"N": {"Off": None, "Yes": None}}}])
    rows = reader.rows_of("form_fields", "f", data)
    assert [(r[3], r[4], r[5], r[6]) for r in rows] == [("text", "n", b"old", None), ("checkbox", "c", b"Off", "Yes")]
    ref = Ref(rows[0][8], 0)
    doc = Document(data)
    widget, look = A.text_value(doc, doc.get(ref), ref, "new (x)")
    assert b"(new \\(x\\)) Tj" in look.raw and b"/Helv 12.00 Tf" in look.raw
    out = incremental_update(data, [(ref.num, 0, {}), (ref.num, 0, widget)])
    assert out.startswith(data) and reader.rows_of("form_fields", "f", out)[0][5] == b"new (x)"
    with pytest.raises(Fault, match="ENCRYPTED"):
        incremental_update(text_pdf("x", "aesv2"), [(1, 0, {})])
    with pytest.raises(Fault):
        incremental_update(data, [])


def test_fields_inherit_from_their_parents():
    b = Builder()
    parent = b.add({"FT": Name("Tx"), "T": b"whole", "V": b"v", "Ff": 1})
    pages = b.add({})
    kid = b.add({"Subtype": Name("Widget"), "Parent": parent, "Rect": [5, 6, 1, 2]})
    page = b.add({"Type": Name("Page"), "Annots": [kid], "MediaBox": [0, 0, 100, 200]})
    b.objects[pages.num] = {"Type": Name("Pages"), "Kids": [page], "Count": 1}
    row = reader.rows_of("form_fields", "f", b.build(b.add({"Type": Name("Catalog"), "Pages": pages})))[0]
    assert row[3:10] == ("text", "whole", b"v", None, True, parent.num, 0) and row[10:] == (1.0, 194.0, 5.0, 198.0)


def test_to_unicode():
    cmap = b"1 beginbfchar <41> <0042> <42> <D83DDE00> endbfchar 2 beginbfrange <50> <52> <0061> <60> <61> [<0078> <0079>] endbfrange"
    assert parse_to_unicode(cmap) == {0x41: 0x42, 0x42: 0x1F600, 0x50: 0x61, 0x51: 0x62, 0x52: 0x63, 0x60: 0x78, 0x61: 0x79}
    assert standard_width("ABCDEF+Helvetica-Bold", 65) == 722 and standard_width("Arial,Italic", 65) == 667
    assert standard_width("TimesNewRomanPS-BoldMT", 65) == 722 and standard_width("Courier-Bold", 65) == 600 and standard_width("Other", 65) is None


def test_operations():
    got = list(operations(b"q 1 0 0 1 5 6 cm BI /W 2 /H 1 ID \x00EI\xff EI (a) Tj [1 (b)] TJ Q"))
    assert [op for op, _ in got] == ["q", "cm", "BI", "Tj", "TJ", "Q"]
    assert got[2][1] == [{"W": 2, "H": 1}, b"\x00EI\xff"]


def test_streamed_files(spark, tmp_path):
    from quire.streaming.files import stream_files, stream_find

    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"f{i}.pdf").write_bytes(text_pdf(f"needle {i} and a needle", "objstm"))
    found = stream_find(stream_files(spark, str(folder)), "needle")
    query = found.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.start_idx for r in spark.table("found").collect()) == [0, 0, 0, 15, 15, 15]


def test_files_as_views(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(text_pdf("page one\nsays this", "xref_stream"))
    reader.register_views(reader.read_files(spark, str(tmp_path)), ["glyphs", "pages"], "v_")
    row = spark.sql("SELECT count(*) AS n, max(width_pt) AS w FROM v_glyphs JOIN v_pages USING (file_id, page_index)").first()
    assert (row.n, row.w) == (17, 612.0)


def test_a_damaged_page_has_a_status_and_the_others_their_rows(spark, monkeypatch):
    text = "\n".join(f"line {i} of it" for i in range(130))
    data = bytearray(text_pdf(text, "classic_flate"))
    doc = Document(bytes(data))
    stream = doc.get(list(doc.pages())[1].dict["Contents"])
    data[stream.offset : stream.offset + len(stream.raw)] = b"\xff" * len(stream.raw)
    df = spark.createDataFrame([("a", bytes(data)), ("b", text_pdf(text, "classic_flate"))], "path string, content binary")
    for name in ("pages", "page_strings", "pictures"):
        got = {(r.file_id, r.page_index): r.status for r in reader.view(df, name).collect()}
        assert got == {(f, i): "SYNTAX" if (f, i) == ("a", 1) else "OK" for f in "ab" for i in range(3)}
    texts = {(r.file_id, r.page_index): r.glyph_text for r in reader.view(df, "page_strings").collect()}
    assert texts["a", 1] == "" and all(texts["a", i] == texts["b", i] != "" for i in (0, 2))
    assert {r.page_index for r in reader.view(df, "glyphs").where("file_id = 'a'").select("page_index").distinct().collect()} == {0, 2}
    monkeypatch.setattr(filters, "LIMIT", 100)
    assert [r[-1] for r in reader.rows_of("pages", "a", bytes(data))] == ["LIMIT", "SYNTAX", "LIMIT"]
    assert filters.flate(zlib.compress(b"x" * 100)) == b"x" * 100
