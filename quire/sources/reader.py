"""Files as tables: one pass over the bytes of each file gives the rows of the tables asked for.

Bad input gives rows with a status, never a failed task. A page whose content cannot be decoded, or is shown
with a fault, says so in `pages`, `page_strings` or `pictures`; the other pages of the file keep their rows.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from itertools import chain as joined
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.annotations import field_row
from .content import operations, page_glyphs
from .document import Document, Fault, box, num
from .filters import FilterFault, chain, status_of
from .fonts import Font
from .images import decode_image
from .raster import Bitmap
from .render import rendered
from .syntax import Name, Ref, Stream, SyntaxFault, plain

SCHEMAS = {
    "files": "file_id string, length bigint, n_xref bigint, pages_declared int, encrypted boolean, crypt_method string, status string",
    "xref": "file_id string, obj_num bigint, gen bigint, kind string, offset bigint, objstm_num bigint, objstm_index bigint, section_rank int",
    "objects": "file_id string, obj_num bigint, gen bigint, type string, value_json string, stream_offset bigint, stream_length bigint, filters array<string>, status string",
    "edges": "file_id string, src_num bigint, key_path string, pos int, dst_num bigint, dst_gen bigint",
    "pages": "file_id string, page_index int, obj_num bigint, media struct<x0:double,y0:double,x1:double,y1:double>, crop struct<x0:double,y0:double,x1:double,y1:double>, rotate int, width_pt double, height_pt double, status string",
    "content_ops": "file_id string, page_index int, seq bigint, opname string, args_json string",
    "glyphs": "file_id string, page_index int, glyph_idx int, unicode int, raw_code int, ch string, x0 double, y0 double, advance double, height double, rotation_deg double, render_mode int, is_space boolean",
    "page_strings": "file_id string, page_index int, glyph_text string, status string",
    "fonts": "file_id string, font_num bigint, base_font string, subtype string, is_cid boolean, is_bold boolean, is_italic boolean, is_serif boolean, embedded string",
    "form_fields": "file_id string, page_index int, field_idx int, type string, name string, value binary, on_state string, read_only boolean, obj_num bigint, obj_gen bigint, x0 double, y0 double, x1 double, y1 double",
    "annotations": "file_id string, page_index int, annot_idx int, subtype string, flags int, x0 double, y0 double, x1 double, y1 double, quadpoints array<double>, contents binary, color array<double>, obj_num bigint",
    "images": "file_id string, obj_num bigint, width int, height int, bpc int, cs string, filters array<string>, rgb binary, alpha binary, status string",
    "pictures": "file_id string, page_index int, width int, height int, ppm binary, status string",
    "picture_sizes": "file_id string, page_index int, width int, height int, bytes bigint, status string",
}


def _files(doc: Document, size: int) -> Iterator[tuple]:
    method = doc.crypt.method if doc.crypt else None
    status = "UNSUPPORTED" if doc.crypt and not method else "OK"
    yield size, len(doc.table), doc.declared_pages(), doc.crypt is not None, method, status


def _kind(v) -> str:
    for kind, name in ((Stream, "stream"), (dict, "dict"), (list, "array"), (Name, "name"), (bytes, "string"), (Ref, "ref"), (bool, "bool"), (int, "int"), (float, "real")):
        if isinstance(v, kind) and not (kind is list and isinstance(v, Ref)):
            return name
    return "null"


def _objects(doc: Document) -> Iterator[tuple]:
    for n in sorted(doc.table):
        entry = doc.table[n]
        if entry.kind == "free":
            continue
        v = doc.object(n)
        stream = isinstance(v, Stream)
        names = [f for f, _ in chain(v.dict, doc.get)] if stream else []
        yield n, entry.gen, _kind(v), json.dumps(plain(v)), v.offset if stream else None, len(v.raw) if stream else None, names, "OK" if v is not None else "NULL"


def _edges(doc: Document) -> Iterator[tuple]:
    def walk(v, path: str, pos: int):
        if isinstance(v, Ref):
            yield path, pos, v.num, v.gen
        elif isinstance(v, list):
            for i, x in enumerate(v):
                yield from walk(x, path, i)
        elif isinstance(v, dict):
            for k, x in v.items():
                yield from walk(x, f"{path}.{k}" if path else k, 0)

    for n in sorted(doc.table):
        v = doc.object(n)
        for path, pos, a, b in walk(v.dict if isinstance(v, Stream) else v, "", 0):
            yield n, path, pos, a, b


_FAULTS = (Fault, SyntaxFault, FilterFault, RecursionError, ValueError, TypeError, AttributeError, KeyError, IndexError, OverflowError, ZeroDivisionError, EOFError, struct.error)


def _pages(doc: Document) -> Iterator[tuple]:
    for p in doc.pages():
        yield p.index, p.num, vars(p.media), vars(p.crop), p.rotate, *p.size, doc.content_and_status(p)[1]


def _content(doc: Document) -> Iterator[tuple]:
    for p in doc.pages():
        for i, (op, args) in enumerate(operations(doc.content(p))):
            yield p.index, i, op, json.dumps([plain(x) for x in args])


def _shown(doc: Document) -> Iterator[tuple]:
    """(page, glyphs, status) of each page; a page that cannot be shown has no glyphs."""
    for p in doc.pages():
        try:
            yield p, page_glyphs(doc, p), doc.content_and_status(p)[1]
        except _FAULTS as e:
            yield p, [], status_of(e)


def _character(c: int) -> str:
    return chr(c) if 0 <= c < 0x110000 and not 0xD800 <= c < 0xE000 else "\ufffd"


def _glyphs(doc: Document) -> Iterator[tuple]:
    for p, shown, _ in _shown(doc):
        for i, g in enumerate(shown):
            yield p.index, i, g.unicode, g.code, _character(g.unicode), g.x0, g.y0, g.advance, g.height, g.rotation, g.mode, g.unicode == 32


def _strings(doc: Document) -> Iterator[tuple]:
    for p, shown, status in _shown(doc):
        yield p.index, "".join(_character(g.unicode) for g in shown), status


def _fonts(doc: Document) -> Iterator[tuple]:
    for n in sorted(doc.table):
        v = doc.object(n)
        if isinstance(v, dict) and v.get("Type") == "Font" and v.get("Subtype") not in ("CIDFontType0", "CIDFontType2"):
            f = Font(doc, v)
            yield n, f.base, f.subtype, f.is_cid, f.bold, f.italic, f.serif, f.embedded


def _annots(doc: Document) -> Iterator[tuple]:
    for p in doc.pages():
        rows = doc.get(p.dict.get("Annots"))
        for i, ref in enumerate(rows if isinstance(rows, list) else []):
            v = doc.get(ref)
            if isinstance(v, dict):
                yield p, i, ref if isinstance(ref, Ref) else Ref(0, 0), v


def _fields(doc: Document) -> Iterator[tuple]:
    place: dict[int, int] = {}
    for p, _, ref, v in _annots(doc):
        if v.get("Subtype") == "Widget":
            at = place.get(p.index, 0)
            place[p.index] = at + 1
            yield (p.index, at, *field_row(doc, p, ref, v))


def _annotations(doc: Document) -> Iterator[tuple]:
    numbers = lambda v: [num(doc.get(x)) for x in v] if isinstance(v := doc.get(v), list) else None
    for p, i, ref, v in _annots(doc):
        r = box([doc.get(x) for x in doc.get(v.get("Rect")) or []])
        rect = (r.x0, r.y0, r.x1, r.y1) if r else (0.0, 0.0, 0.0, 0.0)
        contents = doc.get(v.get("Contents"))
        yield p.index, i, str(doc.get(v.get("Subtype")) or ""), int(num(doc.get(v.get("F")))), *rect, numbers(v.get("QuadPoints")), contents if isinstance(contents, bytes) else None, numbers(v.get("C")), ref.num


def _images(doc: Document) -> Iterator[tuple]:
    for n in sorted(doc.table):
        v = doc.object(n)
        if not isinstance(v, Stream) or v.dict.get("Subtype") != "Image":
            continue
        d, names = v.dict, [f for f, _ in chain(v.dict, doc.get)]
        space = doc.get(d.get("ColorSpace"))
        space = doc.get(space[0]) if isinstance(space, list) and space else space
        width, height, rgb, alpha, status = int(num(doc.get(d.get("Width")))), int(num(doc.get(d.get("Height")))), None, None, "OK"
        try:
            width, height, colours, opacity = decode_image(doc, v)
            rgb, alpha = colours.tobytes(), opacity.tobytes() if opacity is not None else None
        except FilterFault as e:
            status = status_of(e)
        except (ValueError, IndexError, KeyError, TypeError, EOFError, struct.error):
            status = "SYNTAX"
        yield n, width, height, int(num(doc.get(d.get("BitsPerComponent")), 1)), str(space or ""), names, rgb, alpha, status


#: A bitmap of the last page rendered, for the next one; larger ones are not kept.
_SPARE: list[Bitmap] = []
SPARE_PIXELS = 4_000_000


def _rendered(doc: Document, of: Callable[[Bitmap], bytes | int]) -> Iterator[tuple]:
    """Every page is painted in full; of says what is told of its picture."""
    for p in doc.pages():
        try:
            bitmap, status = rendered(doc, p, spare=_SPARE.pop() if _SPARE else None)
            height, width = bitmap.opacity.shape
            row = p.index, width, height, of(bitmap), status
            if not _SPARE and width * height <= SPARE_PIXELS:
                _SPARE.append(bitmap)
        except (FilterFault, ValueError, IndexError, KeyError, TypeError, ZeroDivisionError, OverflowError):
            row = p.index, 0, 0, None, "SYNTAX"
        yield row


def _pictures(doc: Document) -> Iterator[tuple]:
    return _rendered(doc, Bitmap.ppm)


def _picture_sizes(doc: Document) -> Iterator[tuple]:
    """pictures' rows with the sizes of the files in place of these, which do not leave the worker."""
    return _rendered(doc, lambda bitmap: sum(memoryview(x).nbytes for x in bitmap.ppm_parts()))


_TABLES: dict[str, Callable[[Document], Iterator[tuple]]] = {
    "xref": lambda doc: ((e.num, e.gen, e.kind, e.offset if e.offset >= 0 else None, e.stream if e.stream >= 0 else None, e.index if e.index >= 0 else None, e.rank) for e in doc.entries),
    "objects": _objects,
    "edges": _edges,
    "pages": _pages,
    "content_ops": _content,
    "glyphs": _glyphs,
    "page_strings": _strings,
    "fonts": _fonts,
    "form_fields": _fields,
    "annotations": _annotations,
    "images": _images,
    "pictures": _pictures,
    "picture_sizes": _picture_sizes,
}

#: Tables of small rows, few to a file: their batches have rows of many files.
_SMALL = ("files", "pages", "picture_sizes")


def each_row(name: str, file_id: str, data: bytes) -> Iterator[tuple]:
    """The rows of a table for one file, one by one; a file that cannot be opened has rows only in `files`."""
    try:
        doc = Document(data)
        for r in _files(doc, len(data)) if name == "files" else _TABLES[name](doc):
            yield (file_id, *r)
    except _FAULTS as e:
        if name == "files":
            yield file_id, len(data), 0, 0, False, None, str(e) if isinstance(e, Fault) else "SYNTAX"


def rows_of(name: str, file_id: str, data: bytes) -> list[tuple]:
    return list(each_row(name, file_id, data))


def view(files: DataFrame, name: str, file_col: str = "path", content_col: str = "content") -> DataFrame:
    """One of the tables of SCHEMAS for files given as rows (identifier, bytes). A null content is an empty file."""
    schema = SCHEMAS[name]
    arrow: list[pa.Schema] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not arrow:
            arrow.append(to_arrow_schema(shape))
        for batch in batches:
            files = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            of_each = (each_row(name, file_id, bytes(data or b"")) for file_id, data in files)
            for rows in [joined.from_iterable(of_each)] if name in _SMALL else of_each:
                while part := list(islice(rows, 10_000)):
                    columns = [pa.array([r[i] for r in part], f.type) for i, f in enumerate(arrow[0])]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow[0])

    rows = files.select(F.col(file_col).cast("string").alias("file_id"), F.col(content_col).cast("binary").alias("content"))
    shape = StructType.fromDDL(schema)
    return rows.mapInArrow(run, schema)


def page_strings(files: DataFrame) -> DataFrame:
    """(file_id, page_index, glyph_text): each page's glyphs as one string, for searches that need no boxes."""
    return view(files, "page_strings").drop("status")


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, content) of the files under a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def register_views(files: DataFrame, names: list[str] | None = None, prefix: str = "") -> None:
    """The tables as temporary views, for SQL over files."""
    for name in names or list(SCHEMAS):
        view(files, name).createOrReplaceTempView(f"{prefix}{name}")
