"""Files as tables, object graphs, forms, annotations, codecs and ciphers.

The test tables hold no files, so files are made of their rows, inside the queries, and read back.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape_literal
from ..operators import annotations as A
from ..operators import forms, objects
from ..session import prepare, table
from ..sources import crypt, filters, reader
from ..sources.document import Document
from ..sources.syntax import Name, Ref
from ..sources.writer import incremental_update, text_pdf


def bytes_of(rows: DataFrame, make: Callable[..., bytes], *columns: str, out: str = "content") -> DataFrame:
    """(first column, out): bytes made in Python of each row's other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([make(*x) for x in zip(*held, strict=True)], pa.binary())], ["path", out])

    rows = rows.select(F.col(columns[0]).cast("string").alias("path"), *columns[1:])
    return rows.mapInArrow(run, f"path string, {out} binary")


def text_files(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # making and reading files takes far longer than moving their text, so the work is spread first
    docs = docs.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return bytes_of(docs, lambda t: text_pdf(t, variant), "doc_id", "text")


def _summary(variant: str):
    """What the glyphs of a variant's pages add up to; full rows would only repeat the layout."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = reader.view(text_files(spark, sf_dir, variant), "glyphs")
        sums = [F.count("*").alias("n"), F.sum("unicode").alias("codes"), F.sum(F.col("glyph_idx") * F.col("unicode") % 1009).alias("ordered")]
        boxes = [F.round(F.sum("x0"), 3).alias("x"), F.round(F.sum("y0"), 3).alias("y"), F.round(F.sum("advance"), 3).alias("advance")]
        return rows.groupBy(F.col("file_id").cast("bigint").alias("doc_id"), "page_index").agg(*sums, *boxes)

    return query


def r_pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a page leaves the parser; a document's pages are joined in order."""
    rows = reader.page_strings(text_files(spark, sf_dir, "classic_flate"))
    pages = F.array_sort(F.collect_list(F.struct("page_index", "glyph_text")))
    text = F.array_join(F.transform(pages, lambda r: r.glyph_text), "")
    texts = rows.groupBy(F.col("file_id").cast("bigint").alias("doc_id")).agg(text.alias("text")).where("text <> ''")
    return texts.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def _damaged(text: str) -> bytes:
    """A text's file, in which the content of the last page cannot be decoded."""
    data = bytearray(text_pdf(text, "classic_flate"))
    doc = Document(bytes(data))
    last = list(doc.pages())[-1]
    contents = doc.get(last.dict["Contents"])
    stream = doc.get(contents[0]) if isinstance(contents, list) else contents
    data[stream.offset : stream.offset + len(stream.raw)] = b"\xff" * len(stream.raw)
    return bytes(data)


def r_page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose last page is damaged: it has a status and no text, and the other pages keep theirs."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    rows = reader.view(bytes_of(docs, _damaged, "doc_id", "text"), "page_strings")
    return rows.select(F.col("file_id").cast("bigint").alias("doc_id"), "page_index", F.length("glyph_text").cast("bigint").alias("n"), F.md5("glyph_text").alias("digest"), "status")


def r_pdf_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import glyphs as G

    keys = ["file_id", "page_index"]
    pages = G.text_of(reader.view(text_files(spark, sf_dir, "objstm"), "glyphs"), keys)
    found = G.find(pages, keys, "THE ", False)
    return found.groupBy(F.col("file_id").cast("bigint").alias("doc_id"), "page_index").agg(F.count("*").alias("n"), F.sum("start_idx").alias("starts"))


def r_pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reader.view(text_files(spark, sf_dir, "rotate_90"), "pages")
    return rows.groupBy(F.col("file_id").cast("bigint").alias("doc_id")).agg(F.count("*").alias("n_pages"), F.max("width_pt").alias("width"), F.max("height_pt").alias("height"))


def r_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the files is cut off: they get a status, and no task fails."""
    files = text_files(spark, sf_dir, "classic_flate")
    broken = F.col("path").cast("bigint") % 3 == 0
    files = files.withColumn("content", F.when(broken, F.substring("content", 1, 200)).otherwise(F.col("content")))
    return reader.view(files, "files").select(F.col("file_id").cast("bigint").alias("doc_id"), "pages_declared", "status")


def r_content_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of each page's operations, in order, as a digest."""
    rows = reader.view(text_files(spark, sf_dir, "contents_array"), "content_ops")
    names = F.array_sort(F.collect_list(F.struct("seq", "opname")))
    line = F.array_join(F.transform(names, lambda r: r.opname), " ")
    return rows.groupBy(F.col("file_id").cast("bigint").alias("doc_id"), "page_index").agg(F.count("*").alias("n"), F.md5(line).alias("digest"))


def p_render_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form pages of all customers as pictures: all are painted, and their sizes leave the workers."""
    rows = reader.view(_customer_files(spark, sf_dir), "picture_sizes")
    return rows.select(F.col("file_id").cast("bigint").alias("c_custkey"), "page_index", "width", "height", "bytes", "status")


# codecs and ciphers


def _round_trip(make: Callable[[bytes], bytes]):
    """What a codec gives back for each text, as a digest."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        docs = docs.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
        back = bytes_of(docs, lambda t: make(t.encode()), "doc_id", "text")
        return back.select(F.col("path").cast("bigint").alias("doc_id"), F.md5("content").alias("digest"))

    return query


def c_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def c_sha2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


def c_aes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the built-in cipher locks, a vector and then padded blocks as in files, is opened by that of files."""
    prepare(spark)
    key, text = F.unhex(F.md5(F.col("doc_id").cast("string").cast("binary"))), F.coalesce("text", F.lit("")).cast("binary")
    locked = table(spark, sf_dir, "documents").select("doc_id", key.alias("key"), F.aes_encrypt(text, key, F.lit("CBC"), F.lit("PKCS")).alias("locked"))
    locked = locked.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")

    def opened(key: bytes, locked: bytes) -> bytes:
        out = crypt.aes_decrypt(key, locked[:16], locked[16:])
        return out[: -out[-1]]

    back = bytes_of(locked, opened, "doc_id", "key", "locked")
    return back.select(F.col("path").cast("bigint").alias("doc_id"), F.md5("content").alias("digest"))


def k_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(escape_literal(F.col("text"))).alias("digest"))


def k_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a note's text; greedy, so row by row."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = bytes_of(docs, lambda t: "\n".join(x for x, _ in A.wrap(t)).encode(), "doc_id", "text")
    return lines.select(F.col("path").cast("bigint").alias("doc_id"), F.decode("content", "UTF-8").alias("lines"))


# object graphs


def o_revision_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of object entries, the latest event being the newest section."""
    log = table(spark, sf_dir, "events").select("user_id", (-F.col("event_id")).alias("section_rank"), F.when(F.col("event_type") == "error", "free").otherwise("offset").alias("kind"), "event_id", "value")
    return objects.merge_revisions(log, ["user_id"]).select("user_id", "event_id", "value")


def o_free_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", (-F.col("event_id")).alias("section_rank"), F.when(F.col("event_type") == "error", "free").otherwise("offset").alias("kind"), "event_id")
    kept = objects.merge_revisions(log, ["user_id"], keep_free=True)
    return kept.groupBy("kind").agg(F.count("*").alias("n"))


def o_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", (-F.floor(F.col("event_id") / 1000)).cast("int").alias("section_rank"), F.when(F.col("event_type") == "error", "free").otherwise("offset").alias("kind"), "event_type", "event_id")
    one = lambda rows: rows.groupBy("user_id", "section_rank").agg(F.max_by(F.struct("kind", "event_id"), "event_id").alias("x")).select("user_id", "section_rank", "x.*")
    return objects.merge_hybrid(one(log.where("event_type <> 'view'")), one(log.where("event_type = 'view'")), ["user_id"]).select("user_id", "section_rank", "event_id")


def o_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under nations under regions; some levels have a value of their own."""
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.when(F.col("r_regionkey") != 2, F.col("r_name")).alias("value"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).alias("value"))
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).alias("value"))
    return objects.inherit(region.unionByName(nation).unionByName(customer), "node", "parent", "value")


def o_deref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders refer to customers; a fourth names another generation and stays unresolved."""
    edges = table(spark, sf_dir, "orders").select(F.lit("f").alias("file_id"), F.col("o_orderkey").alias("src_num"), F.col("o_custkey").alias("dst_num"), F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0).alias("dst_gen"))
    target = table(spark, sf_dir, "customer").select(F.lit("f").alias("file_id"), F.col("c_custkey").alias("obj_num"), F.lit(0).alias("gen"), F.col("c_name").alias("value"))
    return objects.resolve(edges, target).select("src_num", "dst_num", "dst_value")


def o_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as edits of customers: the last one counts, and lies over the base value."""
    edits = objects.latest_edits(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], "o_orderkey", "o_orderpriority")
    base = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("value"))
    return objects.overlay(base, edits.withColumnRenamed("o_orderpriority", "value"), ["c_custkey"], "value")


# forms and annotations


def _widget(name: str, value: str, key: int) -> dict:
    return {"FT": Name("Tx"), "T": name.encode(), "V": value.encode(), "Rect": [10, 20 + key % 100, 110, 40 + key % 100], "DA": b"/Helv 9 Tf 0 g"}


def _customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_custkey").alias("key"))
    rows = rows.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    return bytes_of(rows, lambda n, s, k: text_pdf("form", "classic", [_widget(n, s, k)]), "c_custkey", "c_name", "c_mktsegment", "key")


def _fields(files: DataFrame) -> DataFrame:
    rows = reader.view(files, "form_fields")
    return rows.select(F.col("file_id").cast("bigint").alias("c_custkey"), "type", "name", F.decode("value", "ISO-8859-1").alias("value"), "x0", "y0", "x1", "y1")


def f_list_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(_customer_files(spark, sf_dir))


def _set_value(data: bytes) -> bytes:
    """The file with the reversed value in its first field, and an appearance for it."""
    doc = Document(data)
    page = next(doc.pages())
    ref = doc.get(page.dict["Annots"])[0]
    widget, top = doc.get(ref), max(doc.table) + 1
    changed, look = A.text_value(doc, widget, ref, widget["V"].decode("latin-1")[::-1])
    return incremental_update(data, [(top, 0, look), (ref.num, ref.gen, {**changed, "AP": {"N": Ref(top, 0)}})])


def f_set_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(bytes_of(_customer_files(spark, sf_dir), _set_value, "path", "content")).select("c_custkey", "name", "value")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rectangles on the pages of their customers."""
    key = F.col("o_orderkey")
    x, y = (key % 37 * 10).cast("double"), (key % 53 * 10).cast("double")
    return table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderkey").alias("annot_idx"), F.when(key % 5 == 0, "FreeText").otherwise("Square").alias("subtype"), "o_orderpriority", x.alias("x0"), y.alias("y0"), (x + 90).alias("x1"), (y + 70).alias("y1")
    )


def f_hit_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.first_hit(_boxes(spark, sf_dir), ["o_custkey"], "annot_idx", 200.0, 250.0)


def a_add_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = forms.delete_first(_boxes(spark, sf_dir), ["o_custkey"], "annot_idx", 200.0, 250.0, F.col("subtype") == "Square")
    return left.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("annot_idx").alias("ids"))


def a_get_tip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir)
    hit = forms.first_hit(rows, ["o_custkey"], "annot_idx", 200.0, 250.0, F.col("subtype") == "FreeText")
    return hit.join(rows.select("o_custkey", "annot_idx", "o_orderpriority"), ["o_custkey", "annot_idx"])


def _highlight(data: bytes, key: int) -> bytes:
    """The file with a highlight of one quadrilateral, and a note."""
    doc = Document(data)
    page, top = next(doc.pages()), max(doc.table) + 1
    x, y = 72.0 + key % 40, 600.0 - key % 70
    quad = [x, y + 10, x + 50, y + 10, x, y, x + 50, y]
    shape, note = A.highlight([quad], (1.0, 1.0, 0.0), 0.5), A.tip(x, y, f"note {key}")
    marks = [A.new_annotation("Highlight", shape, (1.0, 1.0, 0.0), Ref(top, 0), quads=[quad]), A.new_annotation("FreeText", note, (0, 0, 0), Ref(top + 1, 0), f"note {key}")]
    changed = {**page.dict, "Annots": [*(doc.get(page.dict.get("Annots")) or []), Ref(top + 2, 0), Ref(top + 3, 0)]}
    return incremental_update(data, [(top, 0, shape[0]), (top + 1, 0, note[0]), (top + 2, 0, marks[0]), (top + 3, 0, marks[1]), (page.num, 0, changed)])


def a_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _customer_files(spark, sf_dir).withColumn("key", F.col("path").cast("bigint"))
    rows = reader.view(bytes_of(files, _highlight, "path", "content", "key"), "annotations").where("subtype <> 'Widget'")
    return rows.select(F.col("file_id").cast("bigint").alias("c_custkey"), "annot_idx", "subtype", F.round("x0", 3).alias("x0"), F.round("y0", 3).alias("y0"), F.decode("contents", "ISO-8859-1").alias("contents"))


def a_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_partkey") % 90).cast("double").alias("z"))
    a = forms.arrow(F.lit(10.0), F.lit(20.0), F.col("l_quantity"), F.col("z"), 2.0)
    return rows.select("l_orderkey", "l_linenumber", *[F.round(a[n], 6).alias(n) for n in ("x0", "y0", "x1", "y1")])


_ROUND_TRIPS = {
    "c_ascii85": lambda b: filters.ascii85(base64.a85encode(b) + b"~>"),
    "c_asciihex": lambda b: filters.ascii_hex(b.hex().encode() + b">"),
    "c_flate": lambda b: filters.flate(zlib.compress(b)),
    "c_rc4_roundtrip": lambda b: crypt.rc4(b"key" + b[:4], crypt.rc4(b"key" + b[:4], b)),
}
_VARIANTS = {"r_pdf_glyphs": "classic", "r_xref_stream": "xref_stream_predictor", "r_objstm": "objstm", "r_incremental": "incremental_2", "r_nested": "nested_pages", "r_inherited": "inherited_attrs", "r_type0": "type0_tounicode", "r_aes256": "aesv3", "r_a85": "classic_a85_flate", "r_rc4": "rc4_128", "r_aes": "aesv2"}

QUERIES = (
    {n: _summary(v) for n, v in _VARIANTS.items()}
    | {n: _round_trip(f) for n, f in _ROUND_TRIPS.items()}
    | {
        f.__name__: f
        for f in (r_pdf_text, r_page_status, r_pdf_find, r_pdf_pages, r_files, p_render_ppm, r_content_ops, c_md5, c_sha2, c_aes_roundtrip, k_escape, k_wrap, o_revision_merge, o_free_mask, o_hybrid, o_inherit, o_deref, o_edits)
    }
    | {f.__name__: f for f in (f_list_fields, f_set_value, f_hit_test, a_add_delete, a_get_tip, a_highlight, a_arrow)}
)

_PAGES = """ch AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents),
ln AS (SELECT *, sum(CASE WHEN ch = chr(10) THEN 1 ELSE 0 END) OVER w AS ln, i - 1 - max(CASE WHEN ch = chr(10) THEN i ELSE 0 END) OVER w AS col
       FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, CAST(ln // 50 AS INTEGER) AS page_index, row_number() OVER (PARTITION BY doc_id, ln // 50 ORDER BY i) - 1 AS glyph_idx, ch,
             unicode(ch) AS u, 72 + 6 * col AS x0, 84 + 12 * (ln % 50) AS y0 FROM ln WHERE ch <> chr(10))"""
_SUMMARY = f"""WITH {_PAGES} SELECT doc_id, page_index, count(*) AS n, CAST(sum(u) AS BIGINT) AS codes, CAST(sum(glyph_idx * u % 1009) AS BIGINT) AS ordered,
CAST(sum(x0) AS DOUBLE) AS x, CAST(sum(y0) AS DOUBLE) AS y, CAST(6 * count(*) AS DOUBLE) AS advance FROM g GROUP BY doc_id, page_index"""
_LINES = "length(text) - length(replace(text, chr(10), '')) + 1"
_DIGEST = "SELECT doc_id, md5(text) AS digest FROM documents"
_BOXES = """b AS (SELECT o_custkey, o_orderkey AS annot_idx, CASE WHEN o_orderkey % 5 = 0 THEN 'FreeText' ELSE 'Square' END AS subtype, o_orderpriority,
o_orderkey % 37 * 10 AS x0, o_orderkey % 53 * 10 AS y0 FROM orders)"""
_HIT = "200 BETWEEN x0 AND x0 + 90 AND 250 BETWEEN y0 AND y0 + 70"

ORACLES = (
    {n: _SUMMARY for n in _VARIANTS}
    | {n: _DIGEST for n in [*_ROUND_TRIPS, "c_md5", "c_aes_roundtrip"]}
    | {
        "c_sha2": "SELECT doc_id, sha256(text) AS digest FROM documents",
        "r_pdf_text": "SELECT doc_id, md5(replace(text, chr(10), '')) AS digest FROM documents WHERE replace(text, chr(10), '') <> ''",
        "r_pdf_find": f"""WITH {_PAGES}, m AS (SELECT doc_id, page_index, glyph_idx, translate(ch, 'THE', 'the') = 't' AND translate(lead(ch, 1) OVER w, 'THE', 'the') = 'h' AND translate(lead(ch, 2) OVER w, 'THE', 'the') = 'e' AND lead(ch, 3) OVER w = ' ' AS hit
FROM g WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY glyph_idx))
SELECT doc_id, page_index, count(*) AS n, CAST(sum(glyph_idx) AS BIGINT) AS starts FROM m WHERE hit GROUP BY doc_id, page_index""",
        "r_page_status": f"""WITH p AS (SELECT doc_id, text, CAST(ceil(({_LINES}) / 50.0) AS INTEGER) AS pages FROM documents),
q AS (SELECT doc_id, pages, string_split(text, chr(10)) AS ls, unnest(generate_series(0, pages - 1)) AS i FROM p),
r AS (SELECT doc_id, CAST(i AS INTEGER) AS page_index, i = pages - 1 AS bad, array_to_string(list_slice(ls, 50 * i + 1, 50 * i + 50), '') AS t FROM q)
SELECT doc_id, page_index, CAST(CASE WHEN bad THEN 0 ELSE length(t) END AS BIGINT) AS n, md5(CASE WHEN bad THEN '' ELSE t END) AS digest,
       CASE WHEN bad THEN 'SYNTAX' ELSE 'OK' END AS status FROM r""",
        "r_pdf_pages": f"SELECT doc_id, CAST(ceil(({_LINES}) / 50.0) AS BIGINT) AS n_pages, 792.0::DOUBLE AS width, 612.0::DOUBLE AS height FROM documents",
        "r_files": f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE CAST(ceil(({_LINES}) / 50.0) AS INTEGER) END AS pages_declared, CASE WHEN doc_id % 3 = 0 THEN 'BADARG' ELSE 'OK' END AS status FROM documents",
        "r_content_ops": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
p AS (SELECT doc_id, CAST(i // 50 AS INTEGER) AS page_index, i, CASE WHEN i % 50 = 0 THEN '' ELSE ' T*' END || repeat(' Tj', CAST(ceil(length(line) / 200.0) AS INTEGER)) AS ops FROM l),
q AS (SELECT doc_id, page_index, 'BT Tf TL Td' || string_agg(ops, '' ORDER BY i) || ' ET' AS ops FROM p GROUP BY doc_id, page_index)
SELECT doc_id, page_index, length(ops) - length(replace(ops, ' ', '')) + 1 AS n, md5(ops) AS digest FROM q""",
        "p_render_ppm": "SELECT c_custkey, 0 AS page_index, 612 AS width, 792 AS height, CAST(612 * 792 * 3 + 15 AS BIGINT) AS bytes, 'OK' AS status FROM customer",
        "k_escape": "SELECT doc_id, md5(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '(', chr(92) || '('), ')', chr(92) || ')')) AS digest FROM documents",
        "o_revision_merge": "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'error'",
        "o_free_mask": "SELECT CASE WHEN event_type = 'error' THEN 'free' ELSE 'offset' END AS kind, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 GROUP BY 1",
        "o_hybrid": """WITH l AS (SELECT user_id, -(event_id // 1000) AS section_rank, event_type = 'view' AS s, event_type = 'error' AS free, event_id FROM events),
x AS (SELECT user_id, section_rank, s, max_by(free, event_id) AS free, max(event_id) AS event_id FROM l GROUP BY user_id, section_rank, s),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY section_rank, CASE WHEN free THEN 2 ELSE 0 END, s) AS k FROM x)
SELECT user_id, CAST(section_rank AS INTEGER) AS section_rank, event_id FROM p WHERE k = 1 AND NOT free""",
        "o_inherit": """WITH n AS (SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN r_regionkey <> 2 THEN r_name END AS v,
  CASE WHEN n_nationkey % 3 = 0 THEN 'n' || n_nationkey WHEN r_regionkey <> 2 THEN 'r' || r_regionkey END AS o FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'r' || r_regionkey AS node, CASE WHEN r_regionkey <> 2 THEN r_name END AS value, CASE WHEN r_regionkey <> 2 THEN 'r' || r_regionkey END AS owner FROM region
UNION ALL SELECT 'n' || n_nationkey, v, o FROM n
UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE v END, CASE WHEN c_custkey % 5 = 0 THEN 'c' || c_custkey ELSE o END FROM customer JOIN n ON c_nationkey = n_nationkey""",
        "o_deref": "SELECT o_orderkey AS src_num, o_custkey AS dst_num, CASE WHEN o_orderkey % 4 <> 0 THEN c_name END AS dst_value FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
        "o_edits": "SELECT c_custkey, coalesce(v, c_mktsegment) AS value FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey",
        "f_list_fields": "SELECT c_custkey, 'text' AS type, c_name AS name, c_mktsegment AS value, 10.0::DOUBLE AS x0, (752 - c_custkey % 100)::DOUBLE AS y0, 110.0::DOUBLE AS x1, (772 - c_custkey % 100)::DOUBLE AS y1 FROM customer",
        "f_set_value": "SELECT c_custkey, c_name AS name, reverse(c_mktsegment) AS value FROM customer",
        "f_hit_test": f"WITH {_BOXES} SELECT o_custkey, min(annot_idx) AS annot_idx FROM b WHERE {_HIT} GROUP BY o_custkey",
        "a_add_delete": f"WITH {_BOXES}, h AS (SELECT min(annot_idx) AS annot_idx FROM b WHERE {_HIT} AND subtype = 'Square' GROUP BY o_custkey) SELECT o_custkey, count(*) AS n, CAST(sum(annot_idx) AS BIGINT) AS ids FROM b ANTI JOIN h USING (annot_idx) GROUP BY o_custkey",
        "a_get_tip": f"WITH {_BOXES} SELECT o_custkey, min(annot_idx) AS annot_idx, min_by(o_orderpriority, annot_idx) AS o_orderpriority FROM b WHERE {_HIT} AND subtype = 'FreeText' GROUP BY o_custkey",
        "a_highlight": """SELECT c_custkey, 1 AS annot_idx, 'Highlight' AS subtype, (72 + c_custkey % 40)::DOUBLE AS x0, (600 - c_custkey % 70)::DOUBLE AS y0, CAST(NULL AS VARCHAR) AS contents FROM customer
UNION ALL SELECT c_custkey, 2, 'FreeText', (72 + c_custkey % 40)::DOUBLE, (600 - c_custkey % 70)::DOUBLE, 'note ' || c_custkey FROM customer""",
        "a_arrow": """WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, (l_partkey % 90)::DOUBLE AS y FROM lineitem),
b AS (SELECT *, sqrt((x - 10) * (x - 10) + (y - 20) * (y - 20)) AS d FROM a), c AS (SELECT *, CASE WHEN d >= 0.001 THEN (x - 10) / d END AS ux, CASE WHEN d >= 0.001 THEN (y - 20) / d END AS uy FROM b),
w AS (SELECT *, x - 10 * ux - 4 * uy AS wx1, y - 10 * uy + 4 * ux AS wy1, x - 10 * ux + 4 * uy AS wx2, y - 10 * uy - 4 * ux AS wy2 FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN ux IS NOT NULL THEN round(least(10, x, wx1, wx2) - 2, 6) END AS x0, CASE WHEN ux IS NOT NULL THEN round(least(20, y, wy1, wy2) - 2, 6) END AS y0,
CASE WHEN ux IS NOT NULL THEN round(greatest(10, x, wx1, wx2) + 2, 6) END AS x1, CASE WHEN ux IS NOT NULL THEN round(greatest(20, y, wy1, wy2) + 2, 6) END AS y1 FROM w""",
    }
)
