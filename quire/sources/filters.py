"""Stream codecs: bytes to bytes. Unknown or failing ones raise FilterFault."""

from __future__ import annotations

import zlib

import numpy as np

from .syntax import Name


class FilterFault(ValueError):
    pass


#: A stream that decodes to more bytes is a fault (status LIMIT), as a guard against bombs.
LIMIT = 200 << 20


def status_of(fault: Exception) -> str:
    """The status that rows give for a stream that cannot be decoded."""
    return "UNSUPPORTED" if "unsupported" in str(fault) else "LIMIT" if "limit" in str(fault) else "SYNTAX"


def ascii85(data: bytes) -> bytes:
    """Up to ~; z is four zero bytes between groups; other characters out of range are skipped."""
    out, group = bytearray(), []
    for c in data.split(b"~", 1)[0]:
        if c == 0x7A and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += _word85(group)
                group = []
    if group:
        out += _word85(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _word85(group: list[int]) -> bytes:
    value = 0
    for d in group:
        value = value * 85 + d
    return (value & 0xFFFFFFFF).to_bytes(4, "big")


def flate(data: bytes) -> bytes:
    """Deflate with or without its header; the check sum is not verified."""
    for skip in ((2, 0) if len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0 else (0,)):
        inflater = zlib.decompressobj(-15)
        try:
            out = inflater.decompress(data[skip:], LIMIT)
        except zlib.error:
            continue
        if inflater.unconsumed_tail:
            raise FilterFault("over the limit")
        return out
    raise FilterFault("bad deflate data")


def ascii_hex(data: bytes) -> bytes:
    from .syntax import hex_bytes

    return hex_bytes(data.split(b">", 1)[0])


def predictor(data: bytes, columns: int, colors: int = 1, bits: int = 8) -> bytes:
    """Undo the row filters of the PNG predictors."""
    unit = max(1, colors * bits // 8)
    width = (columns * colors * bits + 7) // 8
    out, before = bytearray(), np.zeros(width, np.uint8)
    for at in range(0, len(data), width + 1):
        kind, row = data[at], np.frombuffer(data[at + 1 : at + 1 + width].ljust(width, b"\0"), np.uint8)
        if kind == 2:
            row = row + before
        elif kind in (1, 3, 4):
            cur = bytearray(width)
            for i in range(width):
                a = cur[i - unit] if i >= unit else 0
                b, c = int(before[i]), int(before[i - unit]) if i >= unit else 0
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                cur[i] = (int(row[i]) + guess) & 255
            row = np.frombuffer(bytes(cur), np.uint8)
        before = row
        out += row.tobytes()
    return bytes(out)


_CODECS = {"FlateDecode": flate, "Fl": flate, "ASCII85Decode": ascii85, "A85": ascii85, "ASCIIHexDecode": ascii_hex, "AHx": ascii_hex}
#: Codecs whose result is an image.
IMAGE_CODECS = frozenset("DCTDecode DCT CCITTFaxDecode CCF JPXDecode JBIG2Decode".split())


def chain(dictionary: dict, get=lambda v: v) -> list[tuple[str, dict]]:
    """The filters of a stream with their parameters, in order. get resolves references."""
    names = get(dictionary.get("Filter", dictionary.get("F")))
    parms = get(dictionary.get("DecodeParms", dictionary.get("DP")))
    names = names if isinstance(names, list) else [names] if isinstance(names, Name) else []
    parms = parms if isinstance(parms, list) else [parms]
    out = []
    for i, n in enumerate(names):
        p = get(parms[i]) if i < len(parms) else None
        out.append((str(get(n)), p if isinstance(p, dict) else {}))
    return out


def decode(data: bytes, filters: list[tuple[str, dict]], get=lambda v: v) -> bytes:
    for name, parms in filters:
        if name not in _CODECS:
            raise FilterFault(f"unsupported filter {name}")
        data = _CODECS[name](data)
        kind = get(parms.get("Predictor", 1)) or 1
        if kind >= 10:
            data = predictor(data, get(parms.get("Columns", 1)) or 1, get(parms.get("Colors", 1)) or 1, get(parms.get("BitsPerComponent", 8)) or 8)
    return data
