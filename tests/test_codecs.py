"""Codecs against encoders written here, and published vectors."""

import struct

import numpy as np
import pytest

from quire.sources import codecs as C
from quire.sources.filters import FilterFault


def test_run_codes_are_prefix_free():
    for black in (False, True):
        words = sorted([*C.run_codes(black), "000000000001"])
        assert len(words) == 105
        assert not any(b.startswith(a) for a, b in zip(words, words[1:], strict=False))


def encode_g4(image):
    """Every mode by the rules of the standard, one row after another."""
    modes = {v: k for k, v in C._MODES.items()}
    words = [{v: k for k, v in C.run_codes(b).items()} for b in (False, True)]

    def run(n, black):
        out = ""
        while n >= 2624:
            out, n = out + words[black][2560], n - 2560
        if n >= 64:
            out, n = out + words[black][n // 64 * 64], n % 64
        return out + words[black][n]

    def edges(row):
        return [x for x in range(len(row)) if row[x] != (row[x - 1] if x else 0)]

    bits, width = "", image.shape[1]
    before = np.zeros(width, int)
    for row in image:
        a0, color = -1, 0
        while a0 < width:
            a1 = next((x for x in edges(row) if x > a0 and row[x] != color), width) if a0 >= 0 else next((x for x in edges(row) if row[x] != color), width)
            b1 = next((x for x in edges(before) if x > a0 and before[x] != color), width)
            b2 = next((x for x in edges(before) if x > b1), width)
            if b2 < a1:
                bits, a0 = bits + modes["pass"], b2
            elif abs(a1 - b1) <= 3:
                bits, a0, color = bits + modes[a1 - b1], a1, 1 - color
            else:
                a2 = next((x for x in edges(row) if x > a1), width)
                bits, a0 = bits + modes["horizontal"] + run(a1 - max(a0, 0), bool(color)) + run(a2 - a1, not color), a2
        before = row
    bits += "000000000001" * 2
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


@pytest.mark.parametrize("seed", range(12))
def test_group_4(seed):
    rng = np.random.RandomState(seed)
    width = [1, 7, 40, 200, 3000, 64][seed % 6]
    image = (rng.rand(20, width) < (0.005 if width > 1000 else [0.1, 0.5, 0.02][seed % 3])).astype(int)
    image[3:6] = image[3]
    image[8] = 0
    image[9] = 1
    want = np.packbits(image.astype(np.uint8), axis=1).tobytes()
    assert C.ccitt_g4(encode_g4(image), width, 20, True) == want
    assert C.ccitt_g4(encode_g4(image), width, 0, True) == want
    inverted = np.frombuffer(C.ccitt_g4(encode_g4(image), width, 20), np.uint8).reshape(20, -1)
    assert (np.unpackbits(inverted, axis=1)[:, :width] == 1 - image).all()


#: A published test sequence of the arithmetic coder.
CODED = bytes.fromhex("84C73BFCE1A1430402200000410DBB86F4317FFF88FF37471ADB6ADFFFAC")
PLAIN = bytes.fromhex("00020051000000C00352872AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF")


def test_arithmetic_decoder():
    decoder, context = C.Arithmetic(CODED), [0, 0]
    bits = [decoder.bit(context) for _ in range(256)]
    assert np.packbits(bits).tobytes() == PLAIN


class Encoder:
    """The arithmetic encoder that belongs to the decoder."""

    def __init__(self):
        self.a, self.c, self.ct, self.out = 0x8000, 0, 12, bytearray([0])

    def put(self, context, bit):
        qe, more, less, switch = C._STATES[context[0]]
        self.a -= qe
        if bit == context[1]:
            if not self.a & 0x8000:
                if self.a < qe:
                    self.a = qe
                else:
                    self.c += qe
                context[0] = more
                self.renorm()
            else:
                self.c += qe
        else:
            if self.a < qe:
                self.c += qe
            else:
                self.a = qe
            if switch:
                context[1] = 1 - context[1]
            context[0] = less
            self.renorm()

    def renorm(self):
        while True:
            self.a <<= 1
            self.c <<= 1
            self.ct -= 1
            if not self.ct:
                self.byte()
            if self.a & 0x8000:
                return

    def byte(self):
        if self.out[-1] == 0xFF:
            self.emit(20, 7)
        elif self.c < 0x8000000:
            self.emit(19, 8)
        else:
            self.out[-1] += 1
            if self.out[-1] == 0xFF:
                self.c &= 0x7FFFFFF
                self.emit(20, 7)
            else:
                self.emit(19, 8)

    def emit(self, shift, count):
        self.out.append(self.c >> shift & 0xFF)
        self.c &= (1 << shift) - 1
        self.ct = count

    def finish(self):
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.ct
            self.byte()
        return bytes(self.out[1:])


@pytest.mark.parametrize("template", range(4))
@pytest.mark.parametrize("typical", [False, True])
def test_generic_regions(template, typical):
    rng = np.random.RandomState(template)
    image = (rng.rand(24, 37) < 0.3).astype(int)
    image[5:8] = image[5]
    at = [(3, -1), (-3, -1), (2, -2), (-2, -2)] if template == 0 else [(3, -1) if template == 1 else (2, -1)]
    order = iter(C._ADAPTIVE[template])
    pixels = [p if p else at[next(order)] for p in C._TEMPLATES[template]]
    encoder, contexts, same = Encoder(), {}, 0
    get = lambda x, y: int(image[y, x]) if 0 <= x < 37 and y >= 0 else 0
    for y in range(24):
        if typical:
            now = int(y > 0 and (image[y] == image[y - 1]).all() or y == 0 and not image[0].any())
            encoder.put(contexts.setdefault("t", [0, 0]), now ^ same)
            same = now
            if now:
                continue
        for x in range(37):
            c = 0
            for dx, dy in pixels:
                c = c << 1 | get(x + dx, y + dy)
            encoder.put(contexts.setdefault(c, [0, 0]), int(image[y, x]))
    coded = encoder.finish()
    assert (C.generic_region(coded, 37, 24, template, typical, at) == image).all()
    body = struct.pack(">IIIIBB", 37, 24, 0, 0, 0, template << 1 | typical << 3) + b"".join(struct.pack(">bb", *p) for p in at) + coded
    page = struct.pack(">IIIIBH", 40, 30, 0, 0, 0, 0)
    stream = b"".join(struct.pack(">IBBBI", i, kind, 0, 1, len(b)) + b for i, (kind, b) in enumerate([(48, page), (38, body), (49, b"")]))
    width, height, rows = C.jbig2(stream)
    got = np.unpackbits(np.frombuffer(rows, np.uint8).reshape(height, -1), axis=1)[:, :width]
    assert (width, height) == (40, 30) and (got[:24, :37] == image).all() and not got[24:].any()
    with pytest.raises(FilterFault):
        C.jbig2(stream.replace(struct.pack(">IBBB", 1, 38, 0, 1), struct.pack(">IBBB", 1, 4, 0, 1)))


def encode_jpeg(image, progressive, sampling=1, interval=0, quality=2):
    """A small encoder: every symbol has an eight-bit code; progressive files refine in two steps."""
    height, width, n = image.shape
    order, m = C.zigzag(), C._basis()
    if n == 3:
        r, g, b = (image[..., i].astype(float) for i in range(3))
        planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    else:
        planes = [image[..., i].astype(float) for i in range(n)]
    unit = 8 * sampling
    wide, tall = -(-width // unit) * unit, -(-height // unit) * unit
    parts = []
    for i, p in enumerate(planes):
        p = np.pad(p, ((0, tall - height), (0, wide - width)), "edge")
        s = 1 if i == 0 else sampling
        p = p.reshape(tall // s, s, wide // s, s).mean((1, 3))
        blocks = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3) - 128
        coef = np.rint(np.einsum("ux,rcxy,vy->rcuv", m, blocks, m) / quality).astype(int)
        parts.append((coef.reshape(*coef.shape[:2], 64), sampling if i == 0 else 1))
    symbols = list(range(256))
    table = bytes([0] * 7 + [255] + [1] + [0] * 7)  # 255 codes of eight bits, one of nine
    code = {s: (format(i, "08b") if i < 255 else "111111110") for i, s in enumerate(symbols)}
    out = bytearray(b"\xff\xd8")
    seg = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    out += seg(0xDB, bytes([0] + [quality] * 64))
    out += seg(0xC2 if progressive else 0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, (0x11 * s), 0]) for i, (_, s) in enumerate(parts)))
    for kind in (0, 0x10):
        out += seg(0xC4, bytes([kind]) + table + bytes(symbols))
    if interval:
        out += seg(0xDD, struct.pack(">H", interval))
    size = lambda v: int(abs(v)).bit_length()
    value = lambda v: "" if v == 0 else format(v if v > 0 else v + (1 << size(v)) - 1, f"0{size(v)}b")

    def scan(chosen, first, last, high, low, body):
        head = bytes([len(chosen)]) + b"".join(bytes([i + 1, 0]) for i in chosen) + bytes([first, last, high << 4 | low])
        raw, marks = bytearray(), 0
        units = []
        if len(chosen) == 1:
            c, s = parts[chosen[0]]
            top = max(p[1] for p in parts)
            rows, cols = -(-(-(-height * s // top)) // 8), -(-(-(-width * s // top)) // 8)
            units = [[(chosen[0], y, x)] for y in range(rows) for x in range(cols)]
        else:
            units = [[(i, my * parts[i][1] + v, mx * parts[i][1] + h) for i in chosen for v in range(parts[i][1]) for h in range(parts[i][1])] for my in range(tall // unit) for mx in range(wide // unit)]
        bits, before = "", dict.fromkeys(chosen, 0)

        def flush(bits):
            bits += "1" * (-len(bits) % 8)
            return b"".join(b"\xff\0" if bits[j : j + 8] == "11111111" else bytes([int(bits[j : j + 8], 2)]) for j in range(0, len(bits), 8))

        for k, group in enumerate(units):
            if interval and k and k % interval == 0:
                raw += flush(bits) + bytes([0xFF, 0xD0 + marks % 8])
                marks, bits, before = marks + 1, "", dict.fromkeys(chosen, 0)
            for i, y, x in group:
                bits += body(i, parts[i][0][y, x], before)
        return seg(0xDA, head) + bytes(raw) + flush(bits)

    def dc(low):
        def put(i, block, before):
            v = int(block[0]) >> low
            d, before[i] = v - before[i], v
            return code[size(d)] + value(d)

        return put

    def ac(first, last, low):
        def put(i, block, before):
            bits, run = "", 0
            for k in range(first, last + 1):
                v = int(block[order[k]])
                v = (abs(v) >> low) * (1 if v > 0 else -1)
                if not v:
                    run += 1
                    continue
                while run > 15:
                    bits, run = bits + code[0xF0], run - 16
                bits += code[run << 4 | size(v)] + value(v)
                run = 0
            return bits + (code[0] if run else "")

        return put

    def refine(first, last, low):
        def put(i, block, before):
            bits, run, late = "", 0, ""
            values = [int(block[order[k]]) for k in range(first, last + 1)]
            newest = max((j for j, v in enumerate(values) if abs(v) >> low == 1), default=-1)
            for j, v in enumerate(values):
                size_now = abs(v) >> low
                if size_now > 1:
                    late += str(size_now & 1)
                elif size_now == 1:
                    bits += code[run << 4 | 1] + ("1" if v > 0 else "0") + late
                    run, late = 0, ""
                else:
                    run += 1
                    if run == 16 and j < newest:
                        bits += code[0xF0] + late
                        run, late = 0, ""
            return bits + (code[0] + late if run or late else "")

        return put

    every = list(range(n))
    if not progressive:
        out += scan(every, 0, 63, 0, 0, lambda i, b, before: dc(0)(i, b, before) + ac(1, 63, 0)(i, b, before))
    else:
        out += scan(every, 0, 0, 0, 1, dc(1))
        for i in every:
            out += scan([i], 1, 5, 0, 1, ac(1, 5, 1)) + scan([i], 6, 63, 0, 1, ac(6, 63, 1))
        out += scan(every, 0, 0, 1, 0, lambda i, b, before: str(int(b[0]) & 1))
        for i in every:
            out += scan([i], 1, 63, 1, 0, refine(1, 63, 0))
    return bytes(out + b"\xff\xd9")


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize(("n", "sampling", "interval"), [(1, 1, 0), (3, 1, 0), (3, 2, 3), (4, 1, 2)])
def test_jpeg(progressive, n, sampling, interval):
    y, x = np.mgrid[0:37, 0:45]
    image = np.stack([(128 + 90 * np.sin(x / 9 + i) * np.cos(y / (7 + i))).clip(0, 255) for i in range(n)], 2).astype(np.uint8)
    got = C.dct(encode_jpeg(image, progressive, sampling, interval))
    assert got.shape == image.shape
    assert np.abs(got.astype(int) - image).mean() < (2.5 if sampling == 1 else 6)
    assert (got == C.dct(encode_jpeg(image, not progressive, sampling, interval))).all()


def test_broken_jpeg():
    with pytest.raises(FilterFault):
        C.dct(b"not one")
    with pytest.raises(FilterFault):
        C.dct(b"\xff\xd8\xff\xd9\0\0\0\0")
