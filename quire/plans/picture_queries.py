"""Pages as pictures and images as samples, compared pixel by pixel; rows of files that are small but whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forms, objects
from ..session import prepare, table
from ..sources import reader
from ..sources.codecs import run_codes
from ..sources.document import Document
from ..sources.syntax import Name, Ref, Stream
from ..sources.writer import Builder, incremental_update, text_pdf
from .document_queries import bytes_of

WIDTH, HEIGHT = 20, 12


def _page(content: bytes, resources: dict | None = None, parts: Callable[[Builder], dict] | None = None) -> bytes:
    """A file of one page. parts: adds objects of its own and gives the resources that name them."""
    b = Builder()
    pages = b.add({})
    held = parts(b) if parts else resources or {}
    page = {"Type": Name("Page"), "Parent": pages, "MediaBox": [0, 0, WIDTH, HEIGHT], "Contents": b.add(Stream({}, content)), "Resources": held}
    b.objects[pages.num] = {"Type": Name("Pages"), "Kids": [b.add(page)], "Count": 1}
    return b.build(b.add({"Type": Name("Catalog"), "Pages": pages}))


def _group(b: Builder, content: bytes, resources: dict | None = None, **more) -> Ref:
    return b.add(Stream({"Subtype": Name("Form"), "BBox": [0, 0, WIDTH, HEIGHT], "Group": {"S": Name("Transparency"), **more}, "Resources": resources or {}}, content))


def _fill(k: int) -> bytes:
    """A rectangle, whose place, size and colour follow from a key."""
    colour = b" ".join(b"%.6f" % (v % 256 / 255) for v in (7 * k, 13 * k, 29 * k))
    return _page(colour + b" rg %d %d %d %d re f" % (k % 7, k % 5, 3 + k % 6, 2 + k % 4))


def _soft(k: int) -> bytes:
    """Black under a mask of one luminosity on the right half, and of none on the left."""

    def parts(b: Builder) -> dict:
        mask = _group(b, b"%.6f g 10 0 10 12 re f" % (k % 256 / 255))
        return {"ExtGState": {"M": {"SMask": {"S": Name("Luminosity"), "G": mask}}}}

    return _page(b"/M gs 0 g 0 0 20 12 re f", parts=parts)


def _knockout(k: int) -> bytes:
    """Two greys at half opacity in a knockout group: the second replaces the first where both are."""

    def parts(b: Builder) -> dict:
        content = b"/H gs %.6f g 0 0 10 12 re f %.6f g 5 0 15 12 re f" % (k % 256 / 255, 7 * k % 256 / 255)
        return {"XObject": {"F": _group(b, content, {"ExtGState": {"H": {"ca": 0.5}}}, K=True)}}

    return _page(b"/F Do", parts=parts)


def _reduced(k: int) -> bytes:
    """Two greys in turn, drawn at half their size: each pixel is the mean of four samples."""
    samples = (bytes([k % 256, 7 * k % 256]) * WIDTH + bytes([7 * k % 256, k % 256]) * WIDTH) * HEIGHT
    image = Stream({"Subtype": Name("Image"), "Width": 2 * WIDTH, "Height": 2 * HEIGHT, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8}, samples)
    return _page(b"20 0 0 12 0 0 cm /I Do", parts=lambda b: {"XObject": {"I": b.add(image)}})


def _packed(bits: str) -> bytes:
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def _jpeg(k: int) -> bytes:
    """A page with a baseline JPEG file of two blocks, each of one grey.

    Its codes: twelve of four bits for the sizes of differences, one of one bit for the end of a block."""
    marker = lambda code, body: bytes([255, code]) + (len(body) + 2).to_bytes(2, "big") + body
    bits, before = "", 0
    for v in (k % 256, 7 * k % 256):
        difference = 8 * (v - 128) - before
        before += difference
        size = abs(difference).bit_length()
        bits += f"{size:04b}" + (f"{difference if difference > 0 else difference + (1 << size) - 1:0{size}b}" if size else "") + "0"
    data = b"\xff\xd8" + marker(0xDB, bytes([0]) + bytes([1]) * 64) + marker(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    data += marker(0xC4, bytes([0x00, 0, 0, 0, 12, *bytes(12), *range(12)])) + marker(0xC4, bytes([0x10, 1, *bytes(15), 0]))
    data += marker(0xDA, bytes([1, 1, 0, 0, 63, 0])) + _packed(bits).replace(b"\xff", b"\xff\0") + b"\xff\xd9"
    image = Stream({"Subtype": Name("Image"), "Width": 16, "Height": 8, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8, "Filter": Name("DCTDecode")}, data)
    return _page(b"", parts=lambda b: {"XObject": {"I": b.add(image)}})


def _fax(k: int) -> bytes:
    """A page with a group 4 image of four equal rows, 32 wide, with one black run."""
    white, black = ({n: code for code, n in run_codes(b).items()} for b in (False, True))
    bits = "001" + white[1 + k % 10] + black[1 + k % 13] + "1" + "111" * 3 + "000000000001" * 2
    image = Stream({"Subtype": Name("Image"), "Width": 32, "Height": 4, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 1, "Filter": Name("CCITTFaxDecode"), "DecodeParms": {"K": -1, "Columns": 32, "Rows": 4}}, _packed(bits))
    return _page(b"", parts=lambda b: {"XObject": {"I": b.add(image)}})


def _customers(spark: SparkSession, sf_dir: str, make: Callable[..., bytes], *columns: str) -> DataFrame:
    prepare(spark)
    rows = table(spark, sf_dir, "customer").withColumn("key", F.col("c_custkey"))
    rows = rows.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    return bytes_of(rows, make, "c_custkey", *(columns or ["key"]))


def _key(rows: DataFrame) -> Column:
    return F.col("file_id").cast("bigint").alias("c_custkey")


def _drawn(make: Callable[[int], bytes]):
    """Digests of the pictures of all customers' pages."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = reader.view(_customers(spark, sf_dir, make), "pictures")
        return rows.select(_key(rows), "width", "height", F.md5("ppm").alias("digest"), "status")

    return query


def _decoded(make: Callable[[int], bytes]):
    """Digests of the samples of all customers' images."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = reader.view(_customers(spark, sf_dir, make), "images")
        return rows.select(_key(rows), "width", "height", F.md5("rgb").alias("digest"), "status")

    return query


def r_glyph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every glyph of a line of text a customer, with its place, as rows."""
    rows = reader.view(_customers(spark, sf_dir, lambda t: text_pdf(t, "objstm"), "c_name"), "glyphs")
    places = [F.round(c, 6).alias(c) for c in ("x0", "y0", "advance", "height", "rotation_deg")]
    return rows.select(_key(rows), "page_index", "glyph_idx", "unicode", "raw_code", "ch", *places, "render_mode", "is_space")


def r_aes256_r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose key comes from the hash of many rounds."""
    prepare(spark)
    files = bytes_of(table(spark, sf_dir, "nation"), lambda t: text_pdf(t, "aesv3_r6"), "n_nationkey", "n_name")
    rows = reader.view(files, "page_strings")
    return rows.select(F.col("file_id").cast("int").alias("n_nationkey"), F.col("glyph_text").alias("n_name"), "status")


def _linearised(name: str) -> bytes:
    """A file with a live linearisation dictionary, object 1, after an edit."""
    b = Builder()
    b.add({"Linearized": 1, "L": 1000})
    pages = b.add({"Type": Name("Pages"), "Kids": [], "Count": 0})
    note = b.add({"Title": b"old"})
    data = b.build(b.add({"Type": Name("Catalog"), "Pages": pages}))
    return incremental_update(data, [(note.num, 0, {"Title": Name(name)})])


def o_linearised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After an edit the dictionary that no longer holds is empty, and the edited object is the new one."""
    files = _customers(spark, sf_dir, _linearised, "c_mktsegment")
    rows = reader.view(files, "objects").where("obj_num in (1, 3)")
    return rows.select(_key(rows), "obj_num", F.get_json_object("value_json", "$.Linearized").alias("linearised"), (F.col("value_json") == "{}").alias("empty"))


def _kids(name: str, value: str) -> bytes:
    """A field whose type, name, value and flags are its parent's."""
    b = Builder()
    parent = b.add({"FT": Name("Tx"), "T": name.encode(), "V": value.encode(), "Ff": 1})
    pages = b.add({})
    kid = b.add({"Subtype": Name("Widget"), "Parent": parent, "Rect": [5, 6, 1, 2]})
    page = b.add({"Type": Name("Page"), "Parent": pages, "Annots": [kid], "MediaBox": [0, 0, 100, 200]})
    b.objects[pages.num] = {"Type": Name("Pages"), "Kids": [page], "Count": 1}
    return b.build(b.add({"Type": Name("Catalog"), "Pages": pages}))


def f_inherited_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reader.view(_customers(spark, sf_dir, _kids, "c_name", "c_mktsegment"), "form_fields")
    return rows.select(_key(rows), "type", "name", F.decode("value", "ISO-8859-1").alias("value"), "read_only", "x0", "y0", "x1", "y1")


def _twice_edited(name: str, segment: str) -> bytes:
    """A text whose file was saved again with another one of its objects."""
    data = text_pdf(name, "classic")
    doc = Document(data)
    page = next(doc.pages())
    return incremental_update(data, [(page.num, 0, {**page.dict, "Rotate": 90 if segment < "F" else 180})])


def r_edited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reader.view(_customers(spark, sf_dir, _twice_edited, "c_name", "c_mktsegment"), "pages")
    return rows.select(_key(rows), "rotate", "width_pt", "height_pt", "status")


# columns


def f_text_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content streams of text fields: the size is the appearance string's, or follows from the height."""
    rows, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    font, size = forms.parse_da(F.when(key % 4 == 0, "0 g").otherwise(F.concat(F.lit("0 g /F"), key % 3, F.lit(" "), key % 3 * 4, F.lit(" Tf"))))
    height = (key % 30).cast("double")
    look = forms.text_appearance(F.concat("c_name", F.lit(" (a\\b)")), (key % 50).cast("double"), height, font, forms.font_size(size, height))
    return rows.select("c_custkey", look.alias("look"))


def f_on_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    off = F.lit("Off")
    names = F.when(F.col("o_orderkey") % 3 == 0, F.array(off)).when(F.col("o_orderkey") % 3 == 1, F.array(off, "o_orderpriority", "o_orderstatus")).otherwise(F.array("o_orderstatus", off))
    kind = F.when(F.col("o_orderkey") % 2 == 0, "Btn").when(F.col("o_orderkey") % 5 == 0, "Ch").otherwise("Tx")
    return rows.select("o_orderkey", forms.on_state(names).alias("on_state"), forms.field_type(kind, F.when(F.col("o_orderkey") % 8 == 0, 0x8000).otherwise(1)).alias("type"))


def a_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, x = table(spark, sf_dir, "lineitem"), (F.col("l_partkey") % 40).cast("double")
    look = forms.square_appearance(F.lit(10.0), F.lit(5.0), x, x + 1.5, (1.0, 0.5, 0.0), 2.0)
    return rows.select("l_orderkey", "l_linenumber", look.alias("look"))


def a_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 30).cast("double")
    points = F.when(F.col("l_orderkey") % 4 == 0, F.array(x, y)).otherwise(F.array(x, y, F.lit(20.0), F.lit(15.0), y, x))
    box = forms.ink_box(points, 3.0)
    return rows.select("l_orderkey", "l_linenumber", *[box[n].alias(n) for n in ("x0", "y0", "x1", "y1")])


def o_dict_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionaries with a key replaced, or added, and arrays without their second element."""
    rows = table(spark, sf_dir, "orders")
    held = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("S"), "o_orderstatus", F.lit("P"), "o_orderpriority")).otherwise(F.create_map(F.lit("P"), "o_orderpriority"))
    changed, left = objects.dict_set(held, "S", F.lit("new")), objects.remove_at(F.array("o_orderstatus", "o_orderpriority", F.lit("c")), 1)
    return rows.select("o_orderkey", changed["S"].alias("s"), changed["P"].alias("p"), F.size(changed).alias("n"), F.array_join(left, ",").alias("items"))


QUERIES = (
    {"p_fill_pixels": _drawn(_fill), "p_soft_mask": _drawn(_soft), "p_knockout": _drawn(_knockout), "p_reduced_image": _drawn(_reduced), "c_dct": _decoded(_jpeg), "c_fax": _decoded(_fax)}
    | {f.__name__: f for f in (r_glyph_rows, r_aes256_r6, r_edited_pages, o_linearised, f_inherited_fields, f_text_appearance, f_on_state, a_square, a_ink, o_dict_set)}
)

_HEAD = "'50360a32302031320a3235350a'"  # P6, 20 12 and 255, with line ends
_GREY = "repeat(printf('%02x', {}), 3)"
_TWO = f"{_GREY.format('c_custkey % 256')} AS a, {_GREY.format('7 * c_custkey % 256')} AS b"
_SEEN = "20 AS width, 12 AS height, md5(unhex({})) AS digest, 'OK' AS status"
_OVER_WHITE = "CAST(floor((({}) % 256 * 128 + 255 * 127) / 255.0 + 0.5) AS INTEGER)"

ORACLES = {
    "p_fill_pixels": f"""WITH k AS (SELECT c_custkey, c_custkey % 7 AS x, c_custkey % 5 AS y, 3 + c_custkey % 6 AS w, 2 + c_custkey % 4 AS h,
  printf('%02x%02x%02x', 7 * c_custkey % 256, 13 * c_custkey % 256, 29 * c_custkey % 256) AS c, repeat('ffffff', 20) AS blank FROM customer)
SELECT c_custkey, {_SEEN.format(_HEAD + " || repeat(blank, 12 - y - h) || repeat(repeat('ffffff', x) || repeat(c, w) || repeat('ffffff', 20 - x - w), h) || repeat(blank, y)")} FROM k""",
    "p_soft_mask": f"WITH k AS (SELECT c_custkey, {_GREY.format('255 - c_custkey % 256')} AS a FROM customer) SELECT c_custkey, {_SEEN.format(_HEAD + " || repeat(repeat('ffffff', 10) || repeat(a, 10), 12)")} FROM k",
    "p_knockout": f"""WITH k AS (SELECT c_custkey, {_GREY.format(_OVER_WHITE.format('c_custkey'))} AS a, {_GREY.format(_OVER_WHITE.format('7 * c_custkey'))} AS b FROM customer)
SELECT c_custkey, {_SEEN.format(_HEAD + " || repeat(repeat(a, 5) || repeat(b, 15), 12)")} FROM k""",
    "p_reduced_image": f"""WITH k AS (SELECT c_custkey, {_GREY.format('(c_custkey % 256 + 7 * c_custkey % 256) // 2')} AS a FROM customer)
SELECT c_custkey, {_SEEN.format(_HEAD + " || repeat(a, 240)")} FROM k""",
    "c_dct": f"WITH k AS (SELECT c_custkey, {_TWO} FROM customer) SELECT c_custkey, 16 AS width, 8 AS height, md5(unhex(repeat(repeat(a, 8) || repeat(b, 8), 8))) AS digest, 'OK' AS status FROM k",
    "c_fax": """SELECT c_custkey, 32 AS width, 4 AS height, md5(unhex(repeat(repeat('ffffff', 1 + c_custkey % 10) || repeat('000000', 1 + c_custkey % 13) || repeat('ffffff', 30 - c_custkey % 10 - c_custkey % 13), 4))) AS digest,
'OK' AS status FROM customer""",
    "r_glyph_rows": """WITH g AS (SELECT c_custkey, unnest(string_split(c_name, '')) AS ch, generate_subscripts(string_split(c_name, ''), 1) - 1 AS i FROM customer)
SELECT c_custkey, 0 AS page_index, CAST(i AS INTEGER) AS glyph_idx, unicode(ch) AS unicode, unicode(ch) AS raw_code, ch, (72 + 6 * i)::DOUBLE AS x0, 84.0::DOUBLE AS y0, 6.0::DOUBLE AS advance,
10.0::DOUBLE AS height, 0.0::DOUBLE AS rotation_deg, 0 AS render_mode, ch = ' ' AS is_space FROM g""",
    "r_aes256_r6": "SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name, 'OK' AS status FROM nation",
    "r_edited_pages": """SELECT c_custkey, CASE WHEN c_mktsegment < 'F' THEN 90 ELSE 180 END AS rotate, CASE WHEN c_mktsegment < 'F' THEN 792.0 ELSE 612.0 END::DOUBLE AS width_pt,
CASE WHEN c_mktsegment < 'F' THEN 612.0 ELSE 792.0 END::DOUBLE AS height_pt, 'OK' AS status FROM customer""",
    "o_linearised": "SELECT c_custkey, CAST(n AS BIGINT) AS obj_num, CAST(NULL AS VARCHAR) AS linearised, n = 1 AS empty FROM customer, (VALUES (1), (3)) AS v(n)",
    "f_inherited_fields": "SELECT c_custkey, 'text' AS type, c_name AS name, c_mktsegment AS value, true AS read_only, 1.0::DOUBLE AS x0, 194.0::DOUBLE AS y0, 5.0::DOUBLE AS x1, 198.0::DOUBLE AS y1 FROM customer",
    "f_text_appearance": r"""WITH k AS (SELECT c_custkey, c_name, c_custkey % 4 = 0 AS bare, greatest(1, c_custkey % 50)::DOUBLE AS w, (c_custkey % 30)::DOUBLE AS raw, c_custkey % 3 * 4 AS da FROM customer),
s AS (SELECT *, greatest(1.0, raw) AS h, CASE WHEN bare OR da = 0 THEN greatest(4.0, least(12.0, raw * 0.65)) ELSE da END::DOUBLE AS size FROM k)
SELECT c_custkey, printf('/Tx BMC' || chr(10) || 'q' || chr(10) || '1 1 %.2f %.2f re' || chr(10) || 'W n' || chr(10) || 'BT' || chr(10) || '/%s %.2f Tf' || chr(10) || '0 g' || chr(10) || '2 %.2f Td' || chr(10) || '(%s) Tj' || chr(10) || 'ET' || chr(10) || 'Q' || chr(10) || 'EMC',
  CASE WHEN w > 2 THEN w - 2 ELSE w END, CASE WHEN h > 2 THEN h - 2 ELSE h END, CASE WHEN bare THEN 'Helv' ELSE 'F' || (c_custkey % 3) END, size, greatest(1.0, (h - size) / 2)::DOUBLE, c_name || ' \(a\\b\)') AS look FROM s""",
    "f_on_state": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN o_orderpriority ELSE o_orderstatus END AS on_state,
CASE WHEN o_orderkey % 8 = 0 THEN 'other' WHEN o_orderkey % 2 = 0 THEN 'checkbox' WHEN o_orderkey % 5 = 0 THEN 'other' ELSE 'text' END AS type FROM orders""",
    "a_square": """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 40 > 10 AND l_partkey % 40 + 1.5 > 5 THEN '2.000 w' || chr(10) || '1.000 0.500 0.000 RG' || chr(10)
  || printf('10.00 5.00 %.2f %.2f re', (l_partkey % 40 - 10)::DOUBLE, (l_partkey % 40 - 3.5)::DOUBLE) || chr(10) || 'S' || chr(10) END AS look FROM lineitem""",
    "a_ink": """WITH k AS (SELECT l_orderkey, l_linenumber, l_orderkey % 4 <> 0 AS line, (l_partkey % 40)::DOUBLE AS x, (l_suppkey % 30)::DOUBLE AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN line THEN least(x, 20, y) - 2.5 END AS x0, CASE WHEN line THEN least(y, 15, x) - 2.5 END AS y0,
CASE WHEN line THEN greatest(x, 20, y) + 2.5 END AS x1, CASE WHEN line THEN greatest(y, 15, x) + 2.5 END AS y1 FROM k""",
    "o_dict_set": "SELECT o_orderkey, 'new' AS s, o_orderpriority AS p, 2 AS n, o_orderstatus || ',c' AS items FROM orders",
}
