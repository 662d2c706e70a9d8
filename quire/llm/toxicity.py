"""Toxic passages as maximal scoring segments.

Each token gets a log-odds score, toxic against clean, from document frequencies in labelled texts. Two
levels of Dirichlet priors smooth it: a word's prior is that of the words with the same first bytes, whose
prior is the overall rate; a share of the standard error is taken off, so that rare words need evidence. Other
tokens cost `drift`. One linear scan finds every maximal segment (no part of one has a negative score at
an end, and no two can be joined for a gain). Under chance the best segment of n tokens exceeds x with
probability 1 - exp(-K n exp(-lambda x)); lambda and K are fitted to clean texts, and the best sum of a
text's segments is turned into evidence by the distribution of such sums. A logistic curve of the
evidence's logarithm gives the score; it is fitted on a third of the sample that the odds do not use. A token
that repeats the one before it in its text costs drift, whatever it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import slices, text_bytes
from ._sample import labelled_sample
from ._tokens import LETTERS, LOWER, group_starts, hashes, runs

_U = np.uint64
#: Bytes of a token that its prior goes by.
STEM = 5


def _tokens(buf: np.ndarray, off: np.ndarray):
    """(document, word hash, stem hash, start, end) of all runs of letters and digits, lower case."""
    starts, ends, doc = runs(buf, off, LETTERS)
    fold = np.where(LETTERS == 1, LOWER, _U(0))
    return doc, hashes(buf, starts, ends, fold), hashes(buf, starts, ends, fold, STEM), starts, ends


def maximal_segments(place: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, as (first, last token, sum), where tokens not listed score -drift.

    `place` has the positions, ascending, of the tokens that have a score of their own.
    """
    if not len(place):
        return []
    gap = np.diff(place, prepend=-1) - 1
    after = np.cumsum(score - drift * gap)
    good = score > 0
    # first, last, sum before, sum after, nearest earlier one with a smaller sum before
    stack: list[tuple[int, int, float, float, int]] = []
    for p, x, y in zip(place[good].tolist(), (after - score)[good].tolist(), after[good].tolist(), strict=True):
        first = p
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= x:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= y:
                break
            first, x = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, p, x, y, j))
    return [(a, b, y - x) for a, b, x, y, _ in stack]


@dataclass
class ToxicityModel:
    """Scores of known words and stems (sorted hashes), and the fitted curves."""

    words: np.ndarray = field(default_factory=lambda: np.empty(0, _U))
    word_scores: np.ndarray = field(default_factory=lambda: np.empty(0))
    stems: np.ndarray = field(default_factory=lambda: np.empty(0, _U))
    stem_scores: np.ndarray = field(default_factory=lambda: np.empty(0))
    drift: float = 1.0
    rate: float = 1.0
    scale: float = 0.01
    slope: float = 1.0
    level: float = -4.0

    def own_scores(self, doc: np.ndarray, word: np.ndarray, stem: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of the tokens that do not simply cost drift."""
        score = np.full(len(word), -self.drift)
        for keys, values, h, filled in ((self.stems, self.stem_scores, stem, self.filled[0]), (self.words, self.word_scores, word, self.filled[1])):
            maybe = np.flatnonzero(filled[(h >> _U(44)).astype(np.int64)])
            if len(maybe):
                at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
                hit = keys[at] == h[maybe]
                score[maybe[hit]] = values[at[hit]]
        score[1:][(word[1:] == word[:-1]) & (doc[1:] == doc[:-1])] = -self.drift
        at = np.flatnonzero(score != -self.drift)
        return at, score[at]

    @cached_property
    def filled(self) -> list[np.ndarray]:
        """For stems and words, which of the first 20 bits of a hash occur."""
        out = [np.zeros(1 << 20, bool), np.zeros(1 << 20, bool)]
        for bits, keys in zip(out, (self.stems, self.words), strict=True):
            bits[(keys >> _U(44)).astype(np.int64)] = True
        return out

    def size(self, n: int) -> float:
        """ln(K n)."""
        return math.log(max(self.scale * max(n, 1), 1e-12))

    def evidence(self, sums: list[float], n: int) -> float:
        """Minus the logarithm of the chance of the best sum of segments in a text of n tokens."""
        best, total = 0.0, 0.0
        size = self.size(n)
        for r, s in enumerate(sorted(sums, reverse=True), 1):
            if self.rate * s <= size:  # chance alone gives as good a segment
                break
            total += self.rate * s - size
            if total > r:  # the tail's approximation holds
                best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2))
        return best

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(evidence) + self.level, -40, 40)))


def _documents(buf: np.ndarray, off: np.ndarray, model: ToxicityModel, own_scores: list | None = None):
    """For each document: (number of tokens, segments with byte spans); own_scores gets its tokens' scores."""
    for i, j in slices(off):
        own = off[i : j + 1] - off[i]
        doc, word, stem, starts, ends = _tokens(buf[off[i] : off[j]], own)
        at, score = model.own_scores(doc, word, stem)
        first = np.searchsorted(doc, np.arange(j - i + 1))
        cut = np.searchsorted(at, first)
        for d in range(j - i):
            a, b = first[d], first[d + 1]
            if own_scores is not None:
                own_scores.append((at[cut[d] : cut[d + 1]] - a, score[cut[d] : cut[d + 1]]))
            found = maximal_segments(at[cut[d] : cut[d + 1]] - a, score[cut[d] : cut[d + 1]], model.drift)
            yield int(b - a), [(int(starts[a + x] - own[d]), int(ends[a + y] - own[d]), s) for x, y, s in found]


def _frequencies(keys: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, toxic documents with it, clean documents with it)."""
    order = np.lexsort((doc, keys))
    keys, doc = keys[order], doc[order]
    once = group_starts(keys, doc)
    keys, bad = keys[once], toxic[doc[once]]
    first = group_starts(keys)
    if not len(first):
        return keys, np.empty(0), np.empty(0)
    return keys[first], np.add.reduceat(bad.astype(float), first), np.add.reduceat((~bad).astype(float), first)


def fit_toxicity(sample: pa.Table, label: str = "toxic", prior: float = 100.0, caution: float = 1.5, drift: float = 1.0) -> ToxicityModel:
    """A model of labelled texts. Without texts of both kinds, every text scores low alike."""
    model = ToxicityModel(drift=drift)
    toxic = sample[label].to_numpy().astype(bool)
    if not toxic.any() or toxic.all():
        return model
    buf, off = text_bytes(sample["text"])
    parts = [[], [], []]
    half = np.arange(len(toxic)) % 3 != 2
    for i, j in slices(off):
        doc, word, stem, _, _ = _tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        keep = half[doc + i]
        for x, y in zip(parts, (doc[keep] + i, word[keep], stem[keep]), strict=True):
            x.append(y)
    doc, word, stem = (np.concatenate(x) for x in parts)
    bad, good = toxic[half].sum(), (~toxic[half]).sum()

    def odds(t, c, pt, pc):
        value = np.log((t + prior * pt) / (bad + prior)) - np.log((c + prior * pc) / (good + prior))
        return value - caution * np.sqrt(1 / (t + prior * pt) + 1 / (c + prior * pc))

    stems, st, sc = _frequencies(stem, doc, toxic)
    rate = (st + sc + 0.5) / (bad + good + 1)
    model.stems, model.stem_scores = stems, odds(st, sc, rate, rate)
    words, wt, wc = _frequencies(word, doc, toxic)
    first = np.unique(word, return_index=True)[1]
    of = np.searchsorted(stems, stem[first])
    share = (wt + wc) / (st[of] + sc[of])
    model.words = words
    model.word_scores = odds(wt, wc, (st[of] + prior * rate[of]) / (bad + prior) * share, (sc[of] + prior * rate[of]) / (good + prior) * share)
    for keys, scores in (("words", "word_scores"), ("stems", "stem_scores")):
        kept = getattr(model, scores) > 0  # the others cost as much as an unknown token
        setattr(model, keys, getattr(model, keys)[kept])
        setattr(model, scores, getattr(model, scores)[kept])
    # what a clean word must not gain from its stem
    clean = (wc > 0) & np.isin(stem[first], model.stems)
    known = np.concatenate([words[clean & ~np.isin(words, model.words)], model.words])
    value = np.concatenate([np.full(len(known) - len(model.words), -drift), model.word_scores])
    order = np.argsort(known)
    model.words, model.word_scores = known[order], value[order]

    model.__dict__.pop("filled", None)
    rest = np.flatnonzero(~half)
    sub = sample["text"].combine_chunks() if isinstance(sample["text"], pa.ChunkedArray) else sample["text"]
    buf, off = text_bytes(sub.take(pa.array(rest)))
    seen, raw = [], []
    for n, found in _documents(buf, off, model, raw):
        seen.append((n, [s for _, _, s in found]))
    y = toxic[rest]
    best = np.array([max(s, default=0.0) for _, s in seen])
    length = np.array([max(n, 1) for n, _ in seen], float)
    calm = ~y & (best > 0)
    gains = np.concatenate([[drift], *[s for (_, s), bad in zip(raw, y, strict=True) if not bad]])
    model.rate = _decay(gains, float(length[~y].sum()) + 1, drift)
    if calm.any():  # lambda * best - log(K n) has the mean of the standard extreme-value distribution
        model.scale = math.exp(np.mean(model.rate * best[calm] - np.log(length[calm])) - 0.5772)
    e = np.array([model.evidence(s, int(n)) for n, s in seen])
    model.slope, model.level = _logistic(np.log1p(e), y.astype(float))
    return model


def _decay(scores: np.ndarray, n: float, drift: float) -> float:
    """The positive lambda at which exp(lambda * score) is 1 on average, over n tokens of which some score."""
    quiet = n - len(scores)
    mean = lambda x: (np.exp(np.minimum(x * scores, 600)).sum() + quiet * math.exp(-x * drift)) / n
    low, high = 1e-3, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and level of a logistic curve, by damped Newton steps."""
    scale = max(float(np.abs(x).max()), 1e-9)
    design = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + ridge * w
        curve = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(curve, grad)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def toxic_passages(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", alarm: float = 3.0) -> DataFrame:
    """One row for each row of df: `id`, `score` (0 to 1), `evidence`, `passages`.

    `passages` lists every maximal segment whose own evidence is at least `alarm`, as code point spans
    [start, end) with their scores. Defined cases: null and empty texts have no passage and the score of no
    evidence; repeated rows give repeated rows; an empty table gives an empty table.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample it was fitted on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            buf, off = text_bytes(batch.column("_text"))
            lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # code points before each byte
            evidence, spans, cuts = [], [], [0]
            for d, (n, found) in enumerate(_documents(buf, off, known)):
                evidence.append(known.evidence([s for _, _, s in found], n))
                least, base = (alarm + math.log(2) + known.size(n)) / known.rate, lead[off[d]]
                for a, b, s in found:
                    if s >= least:  # its evidence, as the only segment, is at least alarm
                        spans.append((int(lead[off[d] + a] - base), int(lead[off[d] + b] - base), s))
                cuts.append(len(spans))
            e = np.array(evidence, float)
            a, b, s = (list(x) for x in zip(*spans, strict=True)) if spans else ([], [], [])
            items = pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["start", "end", "score"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(known.score(e), pa.float64()), pa.array(e, pa.float64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), items)],
                ["id", "score", "evidence", "passages"],
            )

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, "id bigint, score double, evidence double, passages array<struct<start:bigint,end:bigint,score:double>>")


def fit_from_tables(docs: DataFrame, labels: DataFrame, rows: int = 12_000, only=None) -> ToxicityModel:
    """A model of about `rows` labelled documents."""
    return fit_toxicity(labelled_sample(docs, labels, ["toxic"], rows, only=only))
