"""Writing: incremental updates of existing files, and small files made of texts."""

from __future__ import annotations

import base64
import hashlib
import zlib
from typing import Any

from .crypt import PAD, aes_encrypt, hash_v5, rc4
from .document import Document, Fault
from .syntax import Name, Ref, Stream, serialise


def incremental_update(data: bytes, edits: list[tuple[int, int, Any]]) -> bytes:
    """The file with objects (number, generation, value) added or replaced by an appended section.

    The last edit of a number counts, at the place of its first. Raises Fault for encrypted files and for
    no edits. A live linearisation dictionary is replaced by an empty one, since it no longer holds.
    """
    doc = Document(data)
    if doc.trailer.get("Encrypt") is not None:
        raise Fault("ENCRYPTED")
    last: dict[int, tuple[int, Any]] = {}
    for n, g, v in edits:
        last[n] = (g, v)
    if not last:
        raise Fault("BADARG")
    for n, e in doc.table.items():
        if e.kind == "offset" and n not in last and isinstance(v := doc.object(n), dict) and "Linearized" in v:
            last[n] = (e.gen, {})
    out, places = bytearray(data if data.endswith(b"\n") else data + b"\n"), {}
    for n, (g, v) in last.items():
        places[n] = (len(out), g)
        out += b"%d %d obj\n" % (n, g) + serialise(v) + b"\nendobj\n"
    start = len(out)
    out += b"xref\n"
    numbers = sorted(places)
    for i, n in enumerate(numbers):
        if not i or numbers[i - 1] != n - 1:
            run = next((j for j in range(i, len(numbers)) if j + 1 == len(numbers) or numbers[j + 1] != numbers[j] + 1))
            out += b"%d %d\n" % (n, run - i + 1)
        out += b"%010d %05d n \n" % places[n]
    size = max([doc.trailer.get("Size", 0), *(n + 1 for n in numbers)])
    trailer = {k: v for k, v in doc.trailer.items() if k in ("Root", "Info", "ID")} | {"Size": size, "Prev": _start(data)}
    out += b"trailer\n" + serialise(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % start
    return bytes(out)


def _start(data: bytes) -> int:
    at = data.rfind(b"startxref")
    return int(data[at + 9 :].split()[0])


class Builder:
    """Objects collected into a new file."""

    def __init__(self) -> None:
        self.objects: dict[int, Any] = {}

    def add(self, v: Any) -> Ref:
        n = max(self.objects, default=0) + 1
        self.objects[n] = v
        return Ref(n, 0)

    def build(self, root: Ref, layout: str = "table", trailer: dict | None = None, encrypt=None) -> bytes:
        """layout: table, stream (cross-reference stream), predictor (with row filters), or objstm
        (objects in an object stream). encrypt: a function of (number, bytes) for streams."""
        out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
        packed = [n for n, v in self.objects.items() if layout == "objstm" and not isinstance(v, Stream)]
        top = max(self.objects) + 1
        for n, v in self.objects.items():
            if n in packed:
                continue
            if encrypt and isinstance(v, Stream):
                v = Stream(v.dict, encrypt(n, v.raw))
            places[n] = (1, len(out), 0)
            out += b"%d 0 obj\n" % n + serialise(v) + b"\nendobj\n"
        if packed:
            bodies = [serialise(self.objects[n]) for n in packed]
            head, at = b"", 0
            for n, body in zip(packed, bodies, strict=True):
                head += b"%d %d " % (n, at)
                at += len(body) + 1
            holder, top = top, top + 1
            places[holder] = (1, len(out), 0)
            raw = zlib.compress(head + b" ".join(bodies))
            out += b"%d 0 obj\n" % holder + serialise(Stream({"Type": Name("ObjStm"), "N": len(packed), "First": len(head), "Filter": Name("FlateDecode")}, raw)) + b"\nendobj\n"
            for i, n in enumerate(packed):
                places[n] = (2, holder, i)
        start, more = len(out), {"Root": root, **(trailer or {})}
        if layout == "table":
            out += b"xref\n0 %d\n0000000000 65535 f \n" % top
            out += b"".join(b"%010d 00000 n \n" % places[n][1] if n in places else b"0000000000 00000 f \n" for n in range(1, top))
            out += b"trailer\n" + serialise({"Size": top, **more})
        else:
            places[top] = (1, start, 0)
            rows = [b"\0" * 6 + b"\xff"] + [bytes([places[n][0]]) + places[n][1].to_bytes(4, "big") + places[n][2].to_bytes(2, "big") if n in places else b"\0" * 7 for n in range(1, top + 1)]
            parms: dict = {}
            if layout == "predictor":  # each row minus the one before
                before, coded = bytes(7), []
                for r in rows:
                    coded.append(b"\x02" + bytes((a - b) & 255 for a, b in zip(r, before, strict=True)))
                    before = r
                rows, parms = coded, {"DecodeParms": {"Predictor": 12, "Columns": 7}}
            v = Stream({"Type": Name("XRef"), "Size": top + 1, "W": [1, 4, 2], "Filter": Name("FlateDecode"), **parms, **more}, zlib.compress(b"".join(rows)))
            out += b"%d 0 obj\n" % top + serialise(v) + b"\nendobj"
        return bytes(out + b"\nstartxref\n%d\n%%%%EOF\n" % start)


LINES_PER_PAGE = 50


def text_pdf(text: str, variant: str = "classic", widgets: list[dict] | None = None) -> bytes:
    """A file that shows a Latin-1 text in Courier 10, 50 lines a page; see FIXTURES for the variants."""
    b = Builder()
    font = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier"), "FirstChar": 0, "LastChar": 255, "Widths": [600] * 256, "Encoding": Name("WinAnsiEncoding")}
    encode = lambda s: s.encode("latin-1")
    if variant == "type0_tounicode":
        inner = b.add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("Courier"), "DW": 600})
        body = "".join(f"<{c + 256:04X}> <{c:04X}>\n" for c in range(128)) + "endbfchar\n1 beginbfrange\n<0180> <01FF> <0080>\n"
        cmap = b.add(Stream({"Filter": Name("FlateDecode")}, zlib.compress(f"128 beginbfchar\n{body}endbfrange\n".encode())))
        font = {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Courier"), "Encoding": Name("Identity-H"), "DescendantFonts": [inner], "ToUnicode": cmap}
        encode = lambda s: b"".join((ord(c) + 256).to_bytes(2, "big") for c in s)
    fonts = b.add(font)
    lines = text.split("\n")
    pages, kids = b.add({}), []
    resources = {"Font": {"F1": fonts}}
    box = [0, 0, 612, 792]
    for at in range(0, len(lines), LINES_PER_PAGE):
        body = [b"BT /F1 10 Tf 12 TL 72 708 Td"]
        for i, line in enumerate(lines[at : at + LINES_PER_PAGE]):
            if i:
                body.append(b"T*")
            body += [serialise(encode(line[j : j + 200])) + b" Tj" for j in range(0, len(line), 200)]
        raw = b"\n".join([*body, b"ET"])
        cut = raw.find(b"\n", len(raw) // 2)
        parts = [raw[:cut], raw[cut:]] if variant == "contents_array" and cut > 0 else [raw]
        refs = []
        for part in parts:
            filters: list[Name] = []
            if variant != "classic" or len(raw) > 1 << 16:
                part, filters = zlib.compress(part), [Name("FlateDecode")]
            if variant == "classic_a85_flate":
                part, filters = base64.a85encode(part) + b"~>", [Name("ASCII85Decode"), *filters]
            refs.append(b.add(Stream({"Filter": filters if len(filters) != 1 else filters[0]} if filters else {}, part)))
        page: dict = {"Type": Name("Page"), "Parent": pages, "Contents": refs if len(refs) > 1 else refs[0]}
        if variant != "inherited_attrs":
            page |= {"MediaBox": box, "Resources": resources}
        if variant.startswith("rotate_"):
            page["Rotate"] = int(variant[7:])
        if variant == "cropbox":
            page["CropBox"] = [36, 36, 576, 756]
        if widgets and not kids:
            page["Annots"] = [b.add({"Type": Name("Annot"), "Subtype": Name("Widget"), **w}) for w in widgets]
        kids.append(b.add(page))
    count = len(kids)
    if variant == "nested_pages" and count > 1:
        half = b.add({"Type": Name("Pages"), "Parent": pages, "Kids": kids[:-1], "Count": count - 1})
        kids = [half, kids[-1]]
    tree: dict = {"Type": Name("Pages"), "Kids": kids, "Count": count}
    if variant == "inherited_attrs":
        tree |= {"MediaBox": box, "Resources": resources}
    b.objects[pages.num] = tree
    root = b.add({"Type": Name("Catalog"), "Pages": pages})
    layout = {"xref_stream": "stream", "xref_stream_predictor": "predictor", "objstm": "objstm"}.get(variant, "table")
    if variant in ("rc4_40", "rc4_128", "aesv2"):
        return _encrypted(b, root, variant)
    if variant in ("aesv3", "aesv3_r6"):
        return _encrypted_v5(b, root, 6 if variant == "aesv3_r6" else 5)
    data = b.build(root, layout)
    if variant.startswith("incremental_"):
        doc = Document(data)
        for k in range(int(variant[12:])):  # the last revision restores what the first ones replace
            final = k + 1 == int(variant[12:])
            data = incremental_update(data, [(pages.num, 0, tree if final else {**tree, "Kids": []}), (root.num, 0, doc.object(root.num))])
    return data


def _encrypted(b: Builder, root: Ref, variant: str) -> bytes:
    """Encrypted for the empty user password; the owner's entry is arbitrary."""
    first, owner = hashlib.md5(variant.encode()).digest(), hashlib.sha256(variant.encode()).digest()
    v, r, size = {"rc4_40": (1, 2, 5), "rc4_128": (2, 3, 16), "aesv2": (4, 4, 16)}[variant]
    digest = hashlib.md5(PAD + owner + (0xFFFFFFFC).to_bytes(4, "little") + first).digest()
    for _ in range(50 if r >= 3 else 0):
        digest = hashlib.md5(digest[:size]).digest()
    key = digest[:size]
    entry: dict = {"Filter": Name("Standard"), "V": v, "R": r, "Length": 8 * size, "P": -4, "O": owner, "U": bytes(32)}
    if v == 4:
        entry |= {"CF": {"StdCF": {"CFM": Name("AESV2"), "Length": 16}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}

    def lock(n: int, raw: bytes) -> bytes:
        own = hashlib.md5(key + n.to_bytes(4, "little")[:3] + bytes(2) + (b"sAlT" if v == 4 else b"")).digest()[: min(16, size + 5)]
        if v != 4:
            return rc4(own, raw)
        iv, pad = hashlib.md5(b"%d" % n).digest(), 16 - len(raw) % 16
        return iv + aes_encrypt(own, iv, raw + bytes([pad]) * pad)

    return b.build(root, "table", {"Encrypt": entry, "ID": [first, first]}, lock)


def _encrypted_v5(b: Builder, root: Ref, revision: int) -> bytes:
    """Encrypted by AES of 256 bits for the empty user password."""
    key, salts = hashlib.sha256(b"key %d" % revision).digest(), b"validate" + b"key salt"
    user = hash_v5(salts[:8], revision) + salts
    wrapped = aes_encrypt(hash_v5(salts[8:], revision), bytes(16), key)
    entry = {"Filter": Name("Standard"), "V": 5, "R": revision, "Length": 256, "P": -4, "O": bytes(48), "U": user, "OE": bytes(32), "UE": wrapped}
    entry |= {"CF": {"StdCF": {"CFM": Name("AESV3"), "Length": 32}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}

    def lock(n: int, raw: bytes) -> bytes:
        iv, pad = hashlib.md5(b"%d" % n).digest(), 16 - len(raw) % 16
        return iv + aes_encrypt(key, iv, raw + bytes([pad]) * pad)

    return b.build(root, "table", {"Encrypt": entry, "ID": [salts, salts]}, lock)
