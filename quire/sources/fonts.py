"""Fonts as code tables: widths and Unicode values."""

from __future__ import annotations

import re
from typing import Any

from .document import Document, num
from .filters import FilterFault
from .outlines import Compact, FontFault, TrueType
from .syntax import Name, Stream

# Advance widths of codes 32 to 126 in thousandths of the em, of the standard metrics.
_HELVETICA = """278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556
278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667
944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500
278 556 500 722 500 500 500 334 260 334 584"""
_HELVETICA_BOLD = """278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556
333 333 584 584 584 611 975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667
944 667 667 611 333 278 333 584 556 333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556
333 611 556 778 556 556 500 389 280 389 584"""
_TIMES = """250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500
278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722
944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389
278 500 500 722 500 500 444 480 200 480 541"""
_TIMES_BOLD = """250 333 555 500 500 1000 833 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500
333 333 570 570 570 500 930 722 667 722 722 667 611 778 778 389 500 778 667 944 722 778 611 778 722 556 667 722 722
1000 722 722 667 333 278 333 581 500 333 500 556 444 556 444 333 500 556 278 333 556 278 833 556 500 556 556 444 389
333 556 500 722 500 500 444 394 220 394 520"""
_TIMES_ITALIC = """250 333 420 500 500 833 778 214 333 333 500 675 250 333 250 278 500 500 500 500 500 500 500 500 500 500
333 333 675 675 675 500 920 611 611 667 722 611 611 722 722 333 444 667 556 833 667 722 611 722 611 500 556 722 611
833 611 556 556 389 278 389 422 500 333 500 500 444 500 444 278 500 500 278 278 444 278 722 500 500 500 500 389 389
278 500 444 667 444 444 389 400 275 400 541"""
_TIMES_BOLD_ITALIC = """250 389 555 500 500 833 778 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500
333 333 570 570 570 500 832 667 667 667 722 667 667 722 778 389 500 667 611 889 722 722 611 722 667 556 611 722 667
889 667 611 611 333 278 333 570 500 333 500 500 444 500 444 333 500 556 278 278 500 278 778 556 500 500 500 389 389
278 556 444 667 500 444 389 348 220 348 570"""
_METRICS = {k: [int(x) for x in v.split()] for k, v in {"h": _HELVETICA, "hb": _HELVETICA_BOLD, "t": _TIMES, "tb": _TIMES_BOLD, "ti": _TIMES_ITALIC, "tbi": _TIMES_BOLD_ITALIC}.items()}
#: Names of the standard fonts and their usual substitutes.
_FAMILIES = {"Helvetica": "h", "Arial": "h", "Times": "t", "TimesNewRoman": "t", "TimesNewRomanPS": "t", "TimesNewRomanPSMT": "t"}
#: Glyph names that subset fonts use for their own codes.
GLYPH_NAMES = {
    "ff": 0xFB00, "fi": 0xFB01, "fl": 0xFB02, "ffi": 0xFB03, "ffl": 0xFB04, "lslash": 0x142, "Lslash": 0x141, "dotlessi": 0x131,
    "germandbls": 0xDF, "emdash": 0x2014, "endash": 0x2013, "quoteleft": 0x2018, "quoteright": 0x2019, "quotedblleft": 0x201C,
    "quotedblright": 0x201D, "bullet": 0x2022, "ellipsis": 0x2026, "trademark": 0x2122, "copyright": 0xA9, "registered": 0xAE,
    "minus": 0x2212, "multiply": 0xD7, "divide": 0xF7,
}


def standard_width(font: str, code: int) -> int | None:
    """A code's width in one of the standard fonts; None for other fonts and codes."""
    font = re.sub(r"^[A-Z]{6}\+", "", font)
    if font.startswith("Courier"):
        return 600 if 32 <= code <= 126 else None
    m = re.fullmatch(r"(Helvetica|Arial|Times|TimesNewRomanPSMT|TimesNewRomanPS|TimesNewRoman)(?:[-,](Roman|Bold|Italic|Oblique|BoldItalic|BoldOblique)(?:MT)?)?", font)
    if not m or not 32 <= code <= 126:
        return None
    family, style = _FAMILIES[m[1]], m[2] or ""
    table = family + ("b" if "Bold" in style else "") + ("i" if family == "t" and "Italic" in style else "")
    return _METRICS[table][code - 32]


def cp1252(code: int) -> int:
    """What a code of 0x80 to 0x9F stands for."""
    try:
        return ord(bytes([code]).decode("cp1252"))
    except UnicodeDecodeError:
        return code


def parse_to_unicode(data: bytes) -> dict[int, int]:
    """Code to Unicode of a character map: single codes, ranges, and ranges with a list."""
    out: dict[int, int] = {}

    def scalar(raw: bytes) -> int:
        raw = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", raw).decode().ljust(2, "0"))
        if len(raw) >= 4:
            text = raw[:4].decode("utf-16-be", "replace")
            return ord(text[0]) if text else 0
        return int.from_bytes(raw, "big")

    for kind, body in re.findall(rb"beginbf(char|range)(.*?)endbf", data, re.S):
        if kind == b"char":
            for a, b in re.findall(rb"<([^>]*)>\s*<([^>]*)>", body):
                out[int(a, 16)] = scalar(b)
        else:
            for a, b, single, many in re.findall(rb"<([^>]*)>\s*<([^>]*)>\s*(?:<([^>]*)>|\[([^\]]*)\])", body):
                low, high = int(a, 16), int(b, 16)
                if not 0 <= high - low < 65536:
                    continue
                if single:
                    out.update((c, scalar(single) + c - low) for c in range(low, high + 1))
                else:
                    out.update(zip(range(low, high + 1), (scalar(x) for x in re.findall(rb"<([^>]*)>", many)), strict=False))
    return {c: u for c, u in out.items() if u}


class Font:
    """Widths and Unicode of a font's codes."""

    def __init__(self, doc: Document, d: dict):
        get = doc.get
        self.base = str(get(d.get("BaseFont")) or "")
        self.subtype = str(get(d.get("Subtype")) or "")
        self.bold = "bold" in self.base.lower()
        self.italic = any(x in self.base.lower() for x in ("italic", "oblique"))
        self.is_cid = self.subtype == "Type0"
        self.step = 2 if self.is_cid and "OneByteIdentityH" not in self.base else 1
        self.widths: dict[int, float] = {}
        self.default, self.replaced = 500.0, set()
        descendants = get(d.get("DescendantFonts"))
        inner = get(descendants[0]) if isinstance(descendants, list) and descendants else None
        descriptor = get(d.get("FontDescriptor")) or (get(inner.get("FontDescriptor")) if isinstance(inner, dict) else None)
        descriptor = descriptor if isinstance(descriptor, dict) else {}
        self.serif = bool(int(num(get(descriptor.get("Flags")))) & 2)
        self.embedded = next((k for k in ("FontFile", "FontFile2", "FontFile3") if descriptor.get(k) is not None), None)
        if self.is_cid:
            self.default = 1000.0
            if isinstance(inner, dict):
                self.default = num(get(inner.get("DW")), 1000.0)
                self._cid_widths(get, get(inner.get("W")))
        else:
            missing = num(get(d.get("MissingWidth")), 0.0)
            self.default = missing if missing > 0 else 500.0
            widths, first = get(d.get("Widths")), int(num(get(d.get("FirstChar"))))
            if isinstance(widths, list):
                self.widths = {first + i: w for i, x in enumerate(widths) if 0 <= first + i < 256 and (w := float(x) if type(x) is int else num(get(x), -1.0)) >= 0}
            else:
                self.widths = {c: float(w) for c in range(32, 127) if (w := standard_width(self.base, c)) is not None}
            encoding = get(d.get("Encoding"))
            differences = get(encoding.get("Differences")) if isinstance(encoding, dict) else None
            at = 0
            for x in differences if isinstance(differences, list) else []:
                x = get(x)
                if isinstance(x, Name):
                    self.replaced.add(at)
                    at += 1
                else:
                    at = int(num(x))
        self.program: TrueType | Compact | None = None
        try:
            if descriptor.get("FontFile2") is not None:
                self.program = TrueType(doc.stream_bytes(descriptor["FontFile2"]))
                names = self.program.names
                self.base = names.get(1, self.base)
                self.bold = "bold" in names.get(2, "").lower() if 2 in names else self.bold
                self.italic = any(x in names.get(2, "").lower() for x in ("italic", "oblique")) if 2 in names else self.italic
            elif descriptor.get("FontFile3") is not None:
                self.program = Compact(doc.stream_bytes(descriptor["FontFile3"]))
        except (FilterFault, FontFault):
            pass
        glyphs = get(inner.get("CIDToGIDMap")) if isinstance(inner, dict) else None
        try:
            raw = doc.stream_bytes(glyphs) if isinstance(glyphs, Stream) else b""
        except FilterFault:
            raw = b""
        self.cid_glyphs = {i // 2: int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw) - 1, 2)}
        try:
            self.unicode = parse_to_unicode(doc.stream_bytes(d["ToUnicode"])) if d.get("ToUnicode") is not None else {}
        except (FilterFault, ValueError):
            self.unicode = {}
        if isinstance(self.program, Compact) and not self.is_cid:
            for code in range(256):
                name = self.program.name_of(code)
                if code not in self.unicode and name in GLYPH_NAMES:
                    self.unicode[code] = GLYPH_NAMES[name]
                if self.widths.get(code) == 0 and (glyph := self.program.glyph_of(code)):
                    try:
                        self.widths[code] = self.program.advance(glyph) * 1000 or 0.0
                    except FontFault:
                        continue

    def outline(self, code: int) -> tuple[list, float]:
        """(contours, natural width) of a code's glyph in the embedded program; none if it has none."""
        if self.program is None:
            return [], 0.0
        if isinstance(self.program, Compact):
            glyph = self.program.glyph_of(code)
        elif self.is_cid:
            glyph = self.cid_glyphs.get(code, code)
        else:
            glyph = self.program.glyph_of(self.to_unicode(code), code)
        if not glyph:
            return [], 0.0
        try:
            return self.program.outline(glyph), self.program.advance(glyph)
        except FontFault:
            return [], 0.0

    def _cid_widths(self, get: Any, rows: Any) -> None:
        rows, i = rows if isinstance(rows, list) else [], 0
        while i + 1 < len(rows):
            first, then = int(num(get(rows[i]), -1.0)), get(rows[i + 1])
            if first < 0:
                return
            if isinstance(then, list):
                self.widths.update((first + j, num(get(w), -1.0)) for j, w in enumerate(then))
                i += 2
            elif i + 2 < len(rows):
                width = num(get(rows[i + 2]), -1.0)
                if 0 <= int(num(then, -1.0)) - first < 65536:
                    self.widths.update((c, width) for c in range(first, int(num(then)) + 1))
                i += 3
            else:
                return
        self.widths = {c: w for c, w in self.widths.items() if 0 <= c < 65536 and w >= 0}

    def width(self, code: int) -> float:
        return self.widths.get(code, self.default)

    def to_unicode(self, code: int) -> int:
        if code in self.unicode:
            return self.unicode[code]
        if self.is_cid:
            return code
        if code in self.replaced:
            return 0xFFFD
        return cp1252(code) if 0x80 <= code <= 0x9F else code
