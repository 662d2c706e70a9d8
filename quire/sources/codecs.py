"""Image codecs: CCITT group 4, JBIG2 generic regions, baseline and progressive JPEG."""

from __future__ import annotations

import struct
from functools import cache

import numpy as np

from .filters import FilterFault

# Run codes of white and black pixels (0 to 63, then 64 to 1728 by 64), and of both (1792 on).
_WHITE = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011
0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010
00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101
00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010
01011011 01001010 01001011 00110010 00110011 00110100 11011 10010 010111 0110111 00110110 00110111 01100100 01100101
01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001
011011010 011011011 010011000 010011001 010011010 011000 010011011"""
_BLACK = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000
0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000
000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010
000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011
000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100
000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010
000001100110 000001100111 0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101
0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011
0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101
0000001011010 0000001011011 0000001100100 0000001100101"""
_LONG = """00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111
000000011100 000000011101 000000011110 000000011111"""
#: Codes of the two-dimensional modes.
_MODES = {"0001": "pass", "001": "horizontal", "1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3}


@cache
def run_codes(black: bool) -> dict[str, int]:
    """Code to run length."""
    codes = (_BLACK if black else _WHITE).split()
    lengths = [*range(64), *range(64, 1729, 64)]
    return dict(zip(codes, lengths, strict=True)) | dict(zip(_LONG.split(), range(1792, 2561, 64), strict=True))


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.size = data, 0, 8 * len(data)

    def bit(self) -> int:
        if self.at >= self.size:
            raise EOFError
        b = self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
        self.at += 1
        return b

    def code(self, table: dict):
        word = ""
        while len(word) < 14:
            word += "1" if self.bit() else "0"
            if word in table:
                return table[word]
        raise EOFError


def ccitt_g4(data: bytes, columns: int = 1728, rows: int = 0, black_is_1: bool = False, align: bool = False) -> bytes:
    """Rows of packed bits; 0 is black unless black_is_1. Stops at the end code or where the data do."""
    bits, lines, before = _Bits(data), [], [columns, columns]

    def run(black: bool) -> int:
        total = 0
        while True:
            n = bits.code(run_codes(black))
            total += n
            if n < 64:
                return total

    try:
        while not rows or len(lines) < rows:
            if align:
                bits.at = (bits.at + 7) // 8 * 8
            line, a0, black, i = [], -1, False, 0
            while a0 < columns:
                i = max(0, i - 2)  # changes of the row before, to the other colour, beyond a0
                while i < len(before) and (before[i] <= a0 or i % 2 != black):
                    i += 1
                b1 = before[i] if i < len(before) else columns
                mode = bits.code(_MODES)
                if mode == "pass":
                    a0 = before[i + 1] if i + 1 < len(before) else columns
                elif mode == "horizontal":
                    first, second = run(black), run(not black)
                    a1 = min(columns, max(a0, 0) + first)
                    a0 = min(columns, a1 + second)
                    line += [a1, a0]
                else:
                    a0 = max(0, min(columns, b1 + mode))
                    line.append(a0)
                    black = not black
            lines.append(line)
            before = [*line, columns, columns]
    except EOFError:
        pass
    out = np.zeros((len(lines), columns), np.uint8)
    for y, line in enumerate(lines):
        for a, b in zip(line[::2], [*line[1::2], columns], strict=False):
            out[y, a:b] = 1
    if rows and len(lines) < rows:
        out = np.vstack([out, np.zeros((rows - len(lines), columns), np.uint8)])
    return np.packbits(out if black_is_1 else 1 - out, axis=1).tobytes()


# Probability states of the adaptive arithmetic decoder (estimate, next if more likely, next if less
# likely, whether the sense switches).
_STATES = [
    tuple(int(x, 16 if i == 0 else 10) for i, x in enumerate(row.split(",")))
    for row in """5601,1,1,1 3401,2,6,0 1801,3,9,0 0AC1,4,12,0 0521,5,29,0 0221,38,33,0 5601,7,6,1 5401,8,14,0 4801,9,14,0 3801,10,14,0
3001,11,17,0 2401,12,18,0 1C01,13,20,0 1601,29,21,0 5601,15,14,1 5401,16,14,0 5101,17,15,0 4801,18,16,0 3801,19,17,0 3401,20,18,0
3001,21,19,0 2801,22,19,0 2401,23,20,0 2201,24,21,0 1C01,25,22,0 1801,26,23,0 1601,27,24,0 1401,28,25,0 1201,29,26,0 1101,30,27,0
0AC1,31,28,0 09C1,32,29,0 08A1,33,30,0 0521,34,31,0 0441,35,32,0 02A1,36,33,0 0221,37,34,0 0141,38,35,0 0111,39,36,0 0085,40,37,0
0049,41,38,0 0025,42,39,0 0015,43,40,0 0009,44,41,0 0005,45,42,0 0001,45,43,0 5601,46,46,0""".split()
]


class Arithmetic:
    """Adaptive binary arithmetic decoding. A context is a list [state, more likely bit]."""

    def __init__(self, data: bytes):
        self.data, self.at, self.count = data, 0, 0
        self.code = self._byte(0) << 16
        self._next()
        self.code <<= 7
        self.count -= 7
        self.span = 0x8000

    def _byte(self, i: int) -> int:
        return self.data[i] if i < len(self.data) else 0xFF

    def _next(self) -> None:
        if self._byte(self.at) == 0xFF:
            if self._byte(self.at + 1) > 0x8F:
                self.code += 0xFF00
                self.count = 8
            else:
                self.at += 1
                self.code += self._byte(self.at) << 9
                self.count = 7
        else:
            self.at += 1
            self.code += self._byte(self.at) << 8
            self.count = 8

    def bit(self, context: list[int]) -> int:
        estimate, more, less, switch = _STATES[context[0]]
        self.span -= estimate
        if (self.code >> 16) < estimate:
            likely = self.span < estimate
            self.span = estimate
        else:
            self.code -= estimate << 16
            if self.span & 0x8000:
                return context[1]
            likely = self.span >= estimate
        if likely:
            out, context[0] = context[1], more
        else:
            out = 1 - context[1]
            if switch:
                context[1] = out
            context[0] = less
        while not self.span & 0x8000:
            if not self.count:
                self._next()
            self.span <<= 1
            self.code = self.code << 1 & 0xFFFFFFFF
            self.count -= 1
        return out


#: Pixels of the templates around the current one, (dx, dy), most significant first; None is an
#: adaptive pixel.
_TEMPLATES = [
    [None, (-1, -2), (0, -2), (1, -2), None, None, (-2, -1), (-1, -1), (0, -1), (1, -1), (2, -1), None, (-4, 0), (-3, 0), (-2, 0), (-1, 0)],
    [(-1, -2), (0, -2), (1, -2), (2, -2), (-2, -1), (-1, -1), (0, -1), (1, -1), (2, -1), None, (-3, 0), (-2, 0), (-1, 0)],
    [(-1, -2), (0, -2), (1, -2), (-2, -1), (-1, -1), (0, -1), (1, -1), None, (-2, 0), (-1, 0)],
    [(-3, -1), (-2, -1), (-1, -1), (0, -1), (1, -1), None, (-4, 0), (-3, 0), (-2, 0), (-1, 0)],
]
#: Which adaptive pixel stands at each place of template 0, and the contexts of repeated rows.
_ADAPTIVE = [[3, 1, 2, 0], [0], [0], [0]]
_REPEATED = [0x9B25, 0x0795, 0x00E5, 0x0195]


def generic_region(data: bytes, width: int, height: int, template: int, typical: bool, adaptive: list[tuple[int, int]]) -> np.ndarray:
    """An arithmetically coded region as rows of 0 and 1 (black)."""
    order = iter(_ADAPTIVE[template])
    pixels = [p if p else adaptive[next(order)] for p in _TEMPLATES[template]]
    decoder, contexts = Arithmetic(data), {}
    edge = 130
    # rows above and columns around count as white
    rows = [bytearray(width + 2 * edge) for _ in range(130)]
    same = 0
    for _ in range(height):
        row = bytearray(width + 2 * edge)
        rows.append(row)
        if typical:
            same ^= decoder.bit(contexts.setdefault(-_REPEATED[template] - 1, [0, 0]))
            if same:
                row[:] = rows[-2]
                continue
        taps = [(rows[-1 + dy], dx) for dx, dy in pixels]
        for x in range(edge, edge + width):
            c = 0
            for held, dx in taps:
                c = c << 1 | held[x + dx]
            state = contexts.get(c)
            if state is None:
                state = contexts[c] = [0, 0]
            row[x] = decoder.bit(state)
    return np.array([list(r[edge : edge + width]) for r in rows[130:]], np.uint8).reshape(height, width)


def jbig2(data: bytes, shared: bytes = b"") -> tuple[int, int, bytes]:
    """(width, height, packed rows, 1 is black) of a page made of generic regions; other segments are faults."""
    page: np.ndarray | None = None
    for stream in (shared, data):
        at = 0
        while at + 11 <= len(stream):
            number, flags = struct.unpack_from(">IB", stream, at)
            kind, at = flags & 63, at + 5
            refer = stream[at] >> 5
            if refer == 7:
                refer = struct.unpack_from(">I", stream, at)[0] & 0x1FFFFFFF
                at += 4 + (refer + 8) // 8
            else:
                at += 1
            at += refer * (1 if number <= 256 else 2 if number <= 65536 else 4) + (4 if flags & 64 else 1)
            size = struct.unpack_from(">I", stream, at)[0]
            at += 4
            body = stream[at : at + size] if size != 0xFFFFFFFF else stream[at:]
            at += len(body)
            if kind == 48:
                width, height, _, _, look = struct.unpack_from(">IIIIB", body)
                if width * (height if height != 0xFFFFFFFF else 1) > 500 << 20:
                    raise FilterFault("image too large")
                page = np.full((height if height != 0xFFFFFFFF else 0, width), look >> 2 & 1, np.uint8)
            elif kind in (36, 38, 39):
                w, h, x, y, join, how = struct.unpack_from(">IIIIBB", body)
                if how & 1 or page is None:
                    raise FilterFault("unsupported region")
                template = how >> 1 & 3
                n = 4 if template == 0 else 1
                places = [struct.unpack_from(">bb", body, 18 + 2 * i) for i in range(n)]
                region = generic_region(body[18 + 2 * n :], w, h, template, bool(how & 8), places)
                if page.shape[0] < y + h:
                    page = np.vstack([page, np.zeros((y + h - page.shape[0], page.shape[1]), np.uint8)])
                part = page[y : y + h, x : x + w]
                region = region[: part.shape[0], : part.shape[1]]
                part[:] = {0: part | region, 1: part & region, 2: part ^ region, 3: 1 - (part ^ region)}.get(join & 7, region)
            elif kind not in (49, 50, 51, 52, 62):
                raise FilterFault(f"unsupported segment {kind}")
    if page is None:
        raise FilterFault("no page")
    return page.shape[1], page.shape[0], np.packbits(page, axis=1).tobytes()


@cache
def zigzag() -> list[int]:
    """The order of the 64 coefficients: along the diagonals, in turns up and down."""
    return sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))


class _Scan:
    """Entropy-coded data of one scan."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.held, self.n = data, at, 0, 0

    def bits(self, n: int) -> int:
        while self.n < n:
            b = self.data[self.at] if self.at < len(self.data) else 0
            if b == 0xFF:
                if self.at + 1 < len(self.data) and self.data[self.at + 1] == 0:
                    self.at += 2
                else:
                    b = 0  # a marker: zeros follow
            else:
                self.at += 1
            self.held, self.n = (self.held << 8 | b) & 0xFFFFFFFF, self.n + 8
        self.n -= n
        return self.held >> self.n & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bits(1)
            v = table.get((n, code))
            if v is not None:
                return v
        raise FilterFault("bad code")

    def signed(self, n: int) -> int:
        if not n:
            return 0
        v = self.bits(n)
        return v if v >> (n - 1) else v - (1 << n) + 1

    def restart(self) -> None:
        self.n = 0
        while self.at + 1 < len(self.data) and not (self.data[self.at] == 0xFF and 0xD0 <= self.data[self.at + 1] <= 0xD7):
            self.at += 1
        self.at += 2


def dct(data: bytes) -> np.ndarray:
    """A JPEG file as height x width x components, 0 to 255, colours as its markers say (RGB or CMYK)."""
    if data[:2] != b"\xff\xd8":
        raise FilterFault("not a JPEG file")
    at, quant, huffman, parts, interval, adobe, progressive = 2, {}, {}, [], 0, None, False
    width = height = 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker == 0xFF or marker == 0 or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = struct.unpack_from(">64H" if wide else ">64B", body, 1)
                quant[body[0] & 15] = np.array(values, np.int32)
                body = body[1 + (128 if wide else 64) :]
        elif marker == 0xC4:
            while body:
                counts, code, k, table = body[1:17], 0, 17, {}
                for n, count in enumerate(counts, 1):
                    for _ in range(count):
                        table[n, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                huffman[body[0]] = table
                body = body[k:]
        elif marker in (0xC0, 0xC1, 0xC2):
            progressive = marker == 0xC2
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not width or not height or width * height > 100 << 20:
                raise FilterFault("unsupported frame")
            parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(n)]
            hmax, vmax = max(p["h"] for p in parts), max(p["v"] for p in parts)
            mx, my = -(-width // (8 * hmax)), -(-height // (8 * vmax))
            for p in parts:
                p["rows"], p["cols"] = my * p["v"], mx * p["h"]
                p["own"] = (-(-(-(-height * p["v"] // vmax)) // 8), -(-(-(-width * p["h"] // hmax)) // 8))
                p["coef"] = np.zeros((p["rows"], p["cols"], 64), np.int32)
        elif 0xC3 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise FilterFault("unsupported frame")
        elif marker == 0xDD:
            interval = struct.unpack_from(">H", body)[0]
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif marker == 0xDA:
            if not parts:
                raise FilterFault("no frame")
            n = body[0]
            chosen = []
            for i in range(n):
                p = next((p for p in parts if p["id"] == body[1 + 2 * i]), None)
                if p is None:
                    raise FilterFault("bad scan")
                chosen.append((p, huffman.get(body[2 + 2 * i] >> 4), huffman.get(0x10 | body[2 + 2 * i] & 15)))
            first, last, step = body[1 + 2 * n : 4 + 2 * n]
            at = _scan(data, at, chosen, progressive, first, last, step >> 4, step & 15, interval, (mx, my))
    if not parts:
        raise FilterFault("no frame")
    planes = [_plane(p, quant.get(p["q"]), (hmax, vmax), (width, height)) for p in parts]
    image = np.stack(planes, 2)
    if len(parts) == 3 and adobe != 0:
        y, cb, cr = image[..., 0], image[..., 1] - 128.0, image[..., 2] - 128.0
        image = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
    if len(parts) == 4:
        if adobe == 2:
            y, cb, cr = image[..., 0], image[..., 1] - 128.0, image[..., 2] - 128.0
            image[..., 0], image[..., 1], image[..., 2] = y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb
        if adobe is not None:
            image = 255.0 - image
    return np.clip(np.rint(image), 0, 255).astype(np.uint8)


def _scan(data, at, chosen, progressive, first, last, high, low, interval, mcus) -> int:
    scan, order = _Scan(data, at), zigzag()
    if len(chosen) == 1:
        rows, cols = chosen[0][0]["own"]
        units = [[(0, r, c)] for r in range(rows) for c in range(cols)]
    else:
        units = [[(i, my * p["v"] + v, mx * p["h"] + h) for i, (p, _, _) in enumerate(chosen) for v in range(p["v"]) for h in range(p["h"])] for my in range(mcus[1]) for mx in range(mcus[0])]
    before, skip = [0] * len(chosen), 0
    for count, unit in enumerate(units):
        if interval and count and count % interval == 0:
            scan.restart()
            before, skip = [0] * len(chosen), 0
        for i, r, c in unit:
            p, dc, ac = chosen[i]
            block = p["coef"][r, c]
            if not progressive:
                before[i] += scan.signed(scan.symbol(dc))
                block[0] = before[i]
                k = 1
                while k < 64:
                    s = scan.symbol(ac)
                    run, n = s >> 4, s & 15
                    if not n:
                        if run < 15:
                            break
                        k += 16
                        continue
                    k += run
                    if k > 63:
                        break
                    block[order[k]] = scan.signed(n)
                    k += 1
            elif first == 0:
                if high == 0:
                    before[i] += scan.signed(scan.symbol(dc))
                    block[0] = before[i] << low
                elif scan.bits(1):
                    block[0] |= 1 << low
            elif high == 0:
                skip = _first(scan, block, ac, order, first, last, low, skip)
            else:
                skip = _refine(scan, block, ac, order, first, last, 1 << low, skip)
    return scan.at


def _first(scan, block, ac, order, k, last, low, skip) -> int:
    if skip:
        return skip - 1
    while k <= last:
        s = scan.symbol(ac)
        run, n = s >> 4, s & 15
        if n:
            k += run
            if k > 63:
                break
            block[order[k]] = scan.signed(n) * (1 << low)
            k += 1
        elif run < 15:
            return (1 << run) - 1 + (scan.bits(run) if run else 0)
        else:
            k += 16
    return 0


def _refine(scan, block, ac, order, k, last, unit, skip) -> int:
    def touch(z: int) -> None:
        if scan.bits(1) and not abs(int(block[z])) & unit:
            block[z] += unit if block[z] > 0 else -unit

    if not skip:
        while k <= last:
            s = scan.symbol(ac)
            run, n, value = s >> 4, s & 15, 0
            if n:
                value = unit if scan.bits(1) else -unit
            elif run < 15:
                skip = (1 << run) + (scan.bits(run) if run else 0)
                break
            while k <= last:
                z = order[k]
                if block[z]:
                    touch(z)
                elif run == 0:
                    if value:
                        block[z] = value
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
    if skip:
        for j in range(k, last + 1):
            if block[order[j]]:
                touch(order[j])
        return skip - 1
    return 0


@cache
def _basis() -> np.ndarray:
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    m = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    m[0] /= np.sqrt(2)
    return m


def _plane(p, quant, most, size) -> np.ndarray:
    """A component's samples at the size of the image."""
    if quant is None:
        raise FilterFault("no quantisation table")
    table = np.zeros(64, np.int32)
    table[zigzag()] = quant
    blocks = (p["coef"] * table).reshape(p["rows"], p["cols"], 8, 8).astype(np.float64)
    m = _basis()
    pixels = np.einsum("ux,rcuv,vy->rcxy", m, blocks, m) + 128.0
    plane = np.clip(np.rint(pixels), 0, 255).transpose(0, 2, 1, 3).reshape(p["rows"] * 8, p["cols"] * 8)
    plane = plane.repeat(most[1] // p["v"], 0).repeat(most[0] // p["h"], 1)
    return plane[: size[1], : size[0]]
