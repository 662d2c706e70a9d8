"""Benchmark decontamination by template windows.

Tokens are made canonical: a number is <number>, a fixed unit word or sign right after a number is <unit>,
a run of capitalised words inside a sentence is <name>; other words are lower case, and punctuation does
not count. The windows of `window` canonical tokens of all benchmark items are hash-joined with those of
all texts. Hits of one item on one diagonal (text position minus item position) are an alignment; its slots
are consistent if each value in the item stands for one value in the text and the other way round, so a
question whose numbers or names were exchanged throughout is still found, and a chance match of templates is
not. A window needs one literal word; an alignment counts if its windows cover `literals` literal words. Of an
alignment that does not count, the windows still do whose values are all equal. An item with fewer literal
words (its tokens are nearly all slots) is looked for by windows of its tokens as they are. A text is
contaminated by an item if counted windows are at least `cover` of the item's, or hold at least `run`
consecutive tokens.

The item side of the join is held in memory, in blocks of at most `bound` windows; a larger benchmark is
joined in several passes. Texts are never shuffled.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import slices, text_bytes
from ._tokens import LOWER, _DIGIT, _LETTER, grams, group_starts, hashes, mix, runs

_U = np.uint64
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3

#: Words and signs that are units where they follow a number.
UNITS = """% ‰ ° $ € £ ¥ mm cm dm m km in ft yd mi mg g kg t lb lbs oz ml cl l s sec min h hr hrs ms hz khz mhz ghz
w kw mw v a j kj mj cal kcal n pa kpa bar k c f mph kmh kph b kb mb gb tb percent meter meters metre metres
kilometer kilometers kilometre kilometres centimeter centimeters mile miles foot feet inch inches yard yards gram
grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres gallon gallons second seconds
minute minutes hour hours day days week weeks month months year years degree degrees dollar dollars euro euros
cent cents watt watts volt volts joule joules""".split()  # fmt: skip

_SIGNS = np.zeros(256, bool)
_SIGNS[[0x25, 0x24]] = True  # % and $; other signs are bytes over 127 and so letters here
_CLASSES = np.where(_DIGIT, 2, np.where(_LETTER, 1, np.where(_SIGNS, 3, 0))).astype(np.uint8)
_CODES = mix(np.array([11, 12, 13], _U))


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    buf = np.frombuffer(b" ".join(raw), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in raw]) - 1
    return np.sort(hashes(buf, ends - [len(w) for w in raw], ends, LOWER))


_UNIT_HASHES = _hash_words(UNITS)


def _tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document, class) of the words, numbers and signs."""
    classes = _CLASSES[buf]
    if len(buf) > 2:  # a point or comma between digits belongs to the number
        inner = ((buf[1:-1] == 46) | (buf[1:-1] == 44)) & (classes[:-2] == 2) & (classes[2:] == 2)
        classes[1:-1][inner] = 2
    starts, ends, doc = runs(classes, off, np.arange(256, dtype=np.uint8))
    return starts, ends, doc, classes[starts]


def exact(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, value) of all tokens as they are, in lower case."""
    starts, ends, doc, _ = _tokens(buf, off)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, _U)
    return doc, hashes(buf, starts, ends, LOWER)


def canonical(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, code, kind, value) of the canonical tokens; code is what windows hash, value the token itself."""
    starts, ends, doc, cls = _tokens(buf, off)
    if not len(starts):
        empty = np.empty(0, np.int64)
        return empty, empty.astype(_U), empty, empty.astype(_U)
    value = hashes(buf, starts, ends, LOWER)
    kind = np.where(cls == 2, NUMBER, LITERAL)
    at = np.minimum(np.searchsorted(_UNIT_HASHES, value), len(_UNIT_HASHES) - 1)
    same = np.concatenate([[False], doc[1:] == doc[:-1]])
    after_number = np.concatenate([[False], cls[:-1] == 2]) & same
    unit = (_UNIT_HASHES[at] == value) & after_number
    kind[unit] = UNIT
    lead = buf[starts]
    second = buf[np.minimum(starts + 1, len(buf) - 1)]
    capital = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    stops = np.cumsum(np.isin(buf, np.frombuffer(b".!?:\n\r\"|", np.uint8)))
    inside = np.zeros(len(starts), bool)
    inside[1:] = (stops[starts[1:]] == stops[ends[:-1] - 1]) & same[1:]
    name = capital & inside & (cls == 1) & (kind == LITERAL)
    kind[name] = NAME
    keep = (cls != 3) | unit
    follow = name & np.concatenate([[False], name[:-1]]) & same
    if name.any():  # a run of names is one
        heads = np.flatnonzero(~follow)
        joined = np.bitwise_xor.reduceat(mix(value), heads)
        value[heads[name[heads]]] = joined[name[heads]]
        keep &= ~follow
    doc, kind, value = doc[keep], kind[keep], value[keep]
    code = value.copy()
    slot = kind != LITERAL
    code[slot] = _CODES[kind[slot] - 1]
    return doc, code, kind, value


def _windows(doc: np.ndarray, code: np.ndarray, kind: np.ndarray, length: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the windows within one document that hold enough literal words."""
    g = grams(code, length, 31)
    n = len(g)
    if not n:
        return np.empty(0, np.int64), g
    plain = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    ok = (doc[:n] == doc[length - 1 : length - 1 + n]) & (plain[length : length + n] - plain[:n] >= literals)
    at = np.flatnonzero(ok)
    return at, g[at]


class Templates:
    """The windows of some items, and the items' canonical tokens."""

    def __init__(self, items: pa.Table, window: int, literals: int):
        self.ids = items["id"].to_numpy()
        buf, off = text_bytes(items["text"])
        doc, self.code, self.kind, self.value = canonical(buf, off)
        self.first = np.searchsorted(doc, np.arange(len(self.ids) + 1))
        self.total = np.zeros(len(self.ids), np.int64)
        words = np.bincount(doc[self.kind == LITERAL], minlength=len(self.ids))
        self.lengths = self._indexed(doc, self.code, self.kind, self.first, words >= literals, window, 1)
        doc, value = exact(buf, off)
        first = np.searchsorted(doc, np.arange(len(self.ids) + 1))
        self.plain = (words < literals) & (np.diff(first) >= literals)
        self.exact = self._indexed(doc, value, np.zeros(len(doc), np.int64), first, self.plain, window, 0) if self.plain.any() else {}
        bits = np.zeros(1 << 20, bool)
        for g, _, _ in [*self.lengths.values(), *self.exact.values()]:
            bits[(g >> _U(44)).astype(np.int64)] = True
        self.bits = bits

    def _indexed(self, doc: np.ndarray, code: np.ndarray, kind: np.ndarray, first: np.ndarray, wanted: np.ndarray, window: int, literals: int) -> dict:
        """For each length, the windows of the wanted items of that length: sorted hashes, items, places."""
        sizes, out = np.diff(first), {}
        for length in sorted({min(window, int(n)) for n in sizes[wanted]}):
            fit = wanted & (sizes >= window if length == window else sizes == length)
            at, g = _windows(doc, code, kind, length, literals)
            mine = fit[doc[at]] if len(at) else np.empty(0, bool)
            at, g = at[mine], g[mine]
            self.total += np.bincount(doc[at], minlength=len(self.ids))
            order = np.argsort(g, kind="stable")
            out[length] = (g[order], doc[at][order], (at - first[doc[at]])[order] if len(at) else at)
        return out


def _consistent(item_value: np.ndarray, text_value: np.ndarray, kind: np.ndarray, share: float = 0.9) -> bool:
    """Whether slots map one to one, but for a small share of them."""
    slot = np.flatnonzero(kind != LITERAL)
    if not len(slot):
        return True
    for a, b in ((item_value, text_value), (text_value, item_value)):
        seen: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for i in slot:
            seen[int(a[i])][int(b[i])] += 1
        if sum(max(x.values()) for x in seen.values()) < share * len(slot):
            return False
    return True


def _covered(windows: list) -> np.ndarray:
    return np.unique(np.concatenate([np.arange(p, p + n) for p, n in windows]))


def _hits(doc: np.ndarray, code: np.ndarray, kind: np.ndarray, first: np.ndarray, lengths: dict, bits: np.ndarray, literals: int) -> np.ndarray:
    """(document, item, diagonal, place in the item, length) of all windows that texts share with items."""
    out = [np.empty((0, 5), np.int64)]
    for length, (keys, item, place) in lengths.items():
        at, g = _windows(doc, code, kind, length, literals)
        maybe = bits[(g >> _U(44)).astype(np.int64)]
        at, g = at[maybe], g[maybe]
        low, high = np.searchsorted(keys, g, "left"), np.searchsorted(keys, g, "right")
        n = high - low
        text = np.repeat(at, n)
        known = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        d = doc[text]
        out.append(np.stack([d, item[known], text - first[d] - place[known], place[known], np.full(len(d), length)], 1))
    return np.concatenate(out)


def find_items(buf: np.ndarray, off: np.ndarray, known: Templates, literals: int, cover: float, run: int):
    """For each document, [(item id, share of its windows, longest run of tokens)] of the items found."""
    out: list[list[tuple[int, float, int]]] = []
    for i, j in slices(off):
        raw, own = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        doc, code, kind, value = canonical(raw, own)
        first = np.searchsorted(doc, np.arange(j - i + 1))
        hits = _hits(doc, code, kind, first, known.lengths, known.bits, 1)
        if known.exact:
            at, plain = exact(raw, own)
            hits = np.concatenate([hits, _hits(at, plain, np.zeros(len(at), np.int64), np.searchsorted(at, np.arange(j - i + 1)), known.exact, known.bits, 0)])
        hits = hits[np.lexsort(hits.T[::-1])]
        places: dict[tuple[int, int], set[int]] = defaultdict(set)
        best: dict[tuple[int, int], int] = defaultdict(int)
        heads = group_starts(hits[:, 0], hits[:, 1], hits[:, 2])
        for a, b in zip(heads, np.append(heads, len(hits))[1:], strict=True):  # one alignment
            d, item, diagonal = hits[a, :3].tolist()
            windows = hits[a:b, 3:].tolist()
            covered = _covered(windows)
            if not known.plain[item]:
                x, y = known.first[item] + covered, first[d] + diagonal + covered
                told = (known.kind[x] == LITERAL).sum() >= literals
                if not told or not _consistent(known.value[x], value[y], known.kind[x]):
                    equal = set(covered[known.value[x] == value[y]].tolist())
                    windows = [(p, n) for p, n in windows if equal.issuperset(range(p, p + n))]
                    if not windows:
                        continue
                    covered = _covered(windows)
            places[d, item].update(p for p, _ in windows)
            edge = np.flatnonzero(np.diff(covered) > 1)
            best[d, item] = max(best[d, item], int(np.diff(np.concatenate([[-1], edge, [len(covered) - 1]])).max()))
        found: list[list[tuple[int, float, int]]] = [[] for _ in range(j - i)]
        for (d, item), at in places.items():
            share = len(at) / max(1, int(known.total[item]))
            if share >= cover or best[d, item] >= run:
                found[d].append((int(known.ids[item]), share, best[d, item]))
        out += [sorted(x) for x in found]
    return out


_HITS = "array<struct<item_id:bigint,share:double,tokens:int>>"


def contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 8,
    literals: int = 4,
    cover: float = 0.5,
    run: int = 13,
    bound: int = 2_000_000,
    keep: bool = False,
) -> DataFrame:
    """One row for each row of df: `id`, `items` (item_id, share of its windows, tokens in the longest run).

    With keep, the rows of df that no item is found in, with df's columns, instead. Defined cases: null and
    empty texts hold no item; items without id or text, or with fewer than `literals` tokens, are not
    looked for (they are no evidence); an item shorter than `window` tokens is one window, as long as it is; repeated items are
    found once for each id; repeated rows give repeated rows; empty tables are fine on either side; columns
    of df may have any names.
    """
    spark = df.sparkSession
    items = benchmark.select(F.col(item_col).cast("bigint").alias("id"), F.col(item_text_col).cast("string").alias("text")).dropna().distinct()
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, math.ceil(size / bound))
    result: DataFrame | None = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else items
        shipped = spark.sparkContext.broadcast(Templates(part.toArrow().sort_by("id"), window, literals))  # at most `bound` words, on average

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                buf, off = text_bytes(batch.column(batch.num_columns - 1 if keep else 1))
                found = find_items(buf, off, shipped.value, literals, cover, run)
                if keep:
                    clean = pa.array([not x for x in found], pa.bool_())
                    rows = batch.filter(clean)
                    yield pa.RecordBatch.from_arrays(rows.columns[:-1], rows.schema.names[:-1])
                    continue
                flat = [y for x in found for y in x]
                cuts = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                a, s, n = (list(x) for x in zip(*flat, strict=True)) if flat else ([], [], [])
                hits = pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(s, pa.float64()), pa.array(n, pa.int32())], ["item_id", "share", "tokens"])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cuts), hits)], ["id", "items"])

        unused = "_text" + "_" * max(map(len, df.columns))
        text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(unused if keep else "_text")
        if keep:
            rows = (result if result is not None else df).select("*", text)
            result = rows.mapInArrow(search, df.schema)
        elif result is None:
            result = df.select(F.col(id_col).cast("bigint").alias("id"), text).mapInArrow(search, f"id bigint, items {_HITS}")
            if blocks > 1:
                result = df.select(F.col(id_col).cast("bigint").alias("id"), text, F.array().cast(_HITS).alias("items"))
                result = result.mapInArrow(_adding(search), f"id bigint, _text string, items {_HITS}")
        else:
            result = result.mapInArrow(_adding(search), f"id bigint, _text string, items {_HITS}")
    return result.select("id", "items") if not keep else result


def _adding(search):
    """search for rows that already have the items of earlier blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in search(iter([batch])):
                old, new = batch.column(2).to_pylist(), found.column(1).to_pylist()
                both = [sorted(a + b, key=lambda x: x["item_id"]) for a, b in zip(old, new, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, found.column(1).type)], ["id", "_text", "items"])

    return run
