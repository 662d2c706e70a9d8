"""Image objects to RGB samples, and their masks to alpha."""

from __future__ import annotations

from typing import Any

import numpy as np

from .codecs import ccitt_g4, dct, jbig2
from .document import Document, num
from .filters import IMAGE_CODECS, FilterFault, chain, decode
from .syntax import Stream

#: Images of more pixels are refused.
MAX_PIXELS = 170_000_000
_COMPONENTS = {"DeviceGray": 1, "G": 1, "CalGray": 1, "DeviceRGB": 3, "RGB": 3, "CalRGB": 3, "Lab": 3, "DeviceCMYK": 4, "CMYK": 4, "Indexed": 1, "I": 1}


def space_of(doc: Document, v: Any) -> tuple[str, int, Any]:
    """(name, components, the array it came from) of a colour space; unknown ones count as RGB."""
    v = doc.get(v)
    if isinstance(v, list) and v:
        name = str(doc.get(v[0]) or "")
        if name == "ICCBased":
            profile = doc.get(v[1]) if len(v) > 1 else None
            n = int(num(doc.get(profile.dict.get("N")), 3)) if isinstance(profile, Stream) else 3
            return {1: "DeviceGray", 4: "DeviceCMYK"}.get(n, "DeviceRGB"), n if n in (1, 4) else 3, v
        return name, _COMPONENTS.get(name, 3), v
    name = str(v or "DeviceGray")
    return name, _COMPONENTS.get(name, 3), None


def to_rgb(doc: Document, space: tuple[str, int, Any], samples: np.ndarray) -> np.ndarray:
    """height x width x components from 0 to 1 (indices for Indexed) as RGB from 0 to 1."""
    name, n, array = space
    if name in ("Indexed", "I") and array and len(array) >= 4:
        base = space_of(doc, array[1])
        table = doc.get(array[3])
        raw = doc.stream_bytes(table) if isinstance(table, Stream) else table if isinstance(table, bytes) else b""
        top = min(255, int(num(doc.get(array[2]))))
        raw = raw[: (top + 1) * base[1]].ljust((top + 1) * base[1], b"\0")
        colours = to_rgb(doc, base, np.frombuffer(raw, np.uint8).reshape(1, top + 1, base[1]) / 255.0)[0]
        return colours[np.clip(samples[..., 0].astype(int), 0, top)]
    if n == 1:
        return np.repeat(samples[..., :1], 3, 2)
    if n == 4:
        return 1.0 - np.minimum(1.0, samples[..., :3] + samples[..., 3:4])
    return samples[..., :3]


def _samples(data: bytes, width: int, height: int, n: int, bits: int) -> np.ndarray:
    """Packed rows as raw integers; missing data are zeros."""
    row = (width * n * bits + 7) // 8
    raw = np.frombuffer(data[: row * height].ljust(row * height, b"\0"), np.uint8).reshape(height, row)
    if bits == 8:
        return raw[:, : width * n].reshape(height, width, n)
    if bits == 16:
        return raw[:, 0 : 2 * width * n : 2].reshape(height, width, n)
    single = np.unpackbits(raw, axis=1)[:, : width * n * bits].reshape(height, width, n, bits)
    return (single * (1 << np.arange(bits - 1, -1, -1))).sum(3)


def decode_image(doc: Document, v: Stream) -> tuple[int, int, np.ndarray, np.ndarray | None]:
    """(width, height, RGB, alpha or None), as bytes from 0 to 255. A stencil mask is black with alpha."""
    d, get = v.dict, doc.get
    pick = lambda *names: next((get(d[x]) for x in names if d.get(x) is not None), None)
    width, height = int(num(pick("Width", "W"))), int(num(pick("Height", "H")))
    if width <= 0 or height <= 0 or width * height > MAX_PIXELS:
        raise FilterFault("bad size")
    stencil, bits = pick("ImageMask", "IM") is True, int(num(pick("BitsPerComponent", "BPC"), 8))
    space = space_of(doc, d.get("ColorSpace", d.get("CS")))
    filters = chain(d, get)
    last = filters[-1] if filters and filters[-1][0] in IMAGE_CODECS else None
    data = decode(v.raw, filters[:-1] if last else filters, get)
    if stencil:
        bits, space = 1, ("DeviceGray", 1, None)
    if last:
        kind, parms = last
        if kind in ("DCTDecode", "DCT"):
            image = dct(data)
            height, width, n = image.shape
            if n != space[1]:
                space = {1: ("DeviceGray", 1, None), 3: ("DeviceRGB", 3, None), 4: ("DeviceCMYK", 4, None)}[n]
            raw, bits = image, 8
        elif kind in ("CCITTFaxDecode", "CCF"):
            if num(get(parms.get("K")), 0) >= 0:
                raise FilterFault("unsupported fax mode")
            columns = int(num(get(parms.get("Columns")), 1728))
            rows = int(num(get(parms.get("Rows")), 0)) or height
            packed = ccitt_g4(data, columns, rows, get(parms.get("BlackIs1")) is True, get(parms.get("EncodedByteAlign")) is True)
            raw, bits = _samples(packed, columns, height, 1, 1)[:, :width], 1
        elif kind == "JBIG2Decode":
            shared = get(parms.get("JBIG2Globals"))
            w, h, packed = jbig2(data, doc.stream_bytes(shared) if shared is not None else b"")
            raw, bits = 1 - _samples(packed, w, h, 1, 1), 1  # black is 1 there, and 0 here
            height, width = raw.shape[:2]
        else:
            raise FilterFault(f"unsupported filter {kind}")
    else:
        raw = _samples(data, width, height, space[1], bits)
    indexed = space[0] in ("Indexed", "I")
    top = 255.0 if bits in (8, 16) else float((1 << bits) - 1)
    samples = raw.astype(np.float64) if indexed else raw / top
    turn = pick("Decode", "D")
    if isinstance(turn, list) and not indexed and len(turn) >= 2 * samples.shape[2]:
        for i in range(samples.shape[2]):
            low, high = num(get(turn[2 * i])), num(get(turn[2 * i + 1]))
            samples[..., i] = low + samples[..., i] * (high - low)
    if stencil:
        alpha = np.rint((1.0 - samples[..., 0]) * 255).astype(np.uint8)
        return width, height, np.zeros((height, width, 3), np.uint8), alpha
    rgb = np.floor(np.clip(to_rgb(doc, space, samples), 0, 1) * 255 + 0.5).astype(np.uint8)
    alpha = None
    for key in ("SMask", "Mask"):
        mask = get(d.get(key))
        if isinstance(mask, Stream):
            w, h, grey, own = decode_image(doc, Stream({k: x for k, x in mask.dict.items() if k not in ("SMask", "Mask")}, mask.raw))
            alpha = 255 - own if own is not None else grey[..., 0]
            rows, cols = np.arange(height) * h // height, np.arange(width) * w // width
            alpha = np.ascontiguousarray(alpha[rows][:, cols])
            break
    return width, height, rgb, alpha
