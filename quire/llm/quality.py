"""Document quality: random-indexing word vectors, pooled, and a two-layer network.

Every token hashes to one of `buckets` words; a word has a sparse random index vector of `dims` entries.
Its context vector sums the index vectors of its neighbours in the sample (up to two tokens away), and its
word vector is the index vector plus a share of the normalised context. Runs of letters also have a shape
(lower case, capitalised, upper case, with digits), runs of other characters are tokens of their own. A
document is the mean of its tokens' vectors, and the mean product of neighbouring vectors, which tells
repetition. A network with one hidden layer gives a logit; its temperature is fitted on rows that the
network was not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import slices, text_bytes
from ._sample import labelled_sample
from ._tokens import EXACT, GOLDEN, LOWER, PARTS, _DIGIT, hashes, mix, runs

_U = np.uint64
_SLICE = 1 << 18
SHAPES = 6
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_SMALL = np.zeros(256, np.int64)
_SMALL[97:123] = 1


def index_vectors(n: int, dims: int, seed: int, active: int = 6) -> np.ndarray:
    """n sparse random vectors: `active` entries of plus or minus one, of length one."""
    draw = mix(np.arange(n * active, dtype=_U) * _U(GOLDEN) + _U(seed)).reshape(n, active)
    out = np.zeros((n, dims), np.float32)
    sign = np.where((draw >> _U(40)) & _U(1), 1.0, -1.0)
    np.add.at(out, (np.arange(n)[:, None], (draw % _U(dims)).astype(np.int64)), sign)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def _tokens(buf: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word bucket, shape) of all tokens."""
    starts, ends, doc = runs(buf, off, PARTS)
    if not len(starts):
        return doc, doc, doc
    fold = np.where(PARTS > 0, LOWER, _U(0))
    bucket = (hashes(buf, starts, ends, fold) % _U(buckets)).astype(np.int64)
    count = lambda x: np.add.reduceat(x[buf], starts)
    upper, small, digit = count(_UPPER), count(_SMALL), count(_DIGIT.astype(np.int64))
    shape = np.select([PARTS[buf[starts]] == 2, digit > 0, (upper > 1) & (small == 0), (upper == 1) & (small == 0), upper > 0], [5, 4, 3, 2, 1], 0)
    return doc, bucket, shape


@dataclass
class QualityModel:
    words: np.ndarray
    shapes: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None
    temperature: float
    base: float

    def features(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        dims = self.words.shape[1]
        out = np.zeros((len(off) - 1, 2 * dims + SHAPES + 1), np.float32)
        for i, j in slices(off, _SLICE):
            doc, bucket, shape = _tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i], len(self.words))
            if not len(doc):
                continue
            vec = self.words[bucket] + self.shapes[shape]
            n = np.bincount(doc, minlength=j - i)
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            has = n > 0
            rows = np.flatnonzero(has) + i
            total = n[has][:, None]
            out[rows, :dims] = np.add.reduceat(vec, first[has], axis=0) / total
            near = np.zeros_like(vec)
            near[:-1] = vec[:-1] * vec[1:]
            near[np.cumsum(n)[has] - 1] = 0  # the last token of a document has no follower
            out[rows, dims : 2 * dims] = np.add.reduceat(near, first[has], axis=0) / total
            kinds = np.zeros((len(doc), SHAPES), np.float32)
            kinds[np.arange(len(doc)), shape] = 1
            out[rows, 2 * dims : -1] = np.add.reduceat(kinds, first[has], axis=0) / total
            out[rows, -1] = np.log1p(n[has])
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(features), self.base)
        x = (features - self.centre) / self.spread
        a, b, c, d = self.layers
        logit = np.maximum(x @ a + b, 0) @ c + d
        return 1 / (1 + np.exp(-np.clip(logit / self.temperature, -40, 40)))


def _contexts(buf: np.ndarray, off: np.ndarray, index: np.ndarray, reach: int = 2) -> np.ndarray:
    """Sums of the index vectors of each word's neighbours."""
    buckets, dims = index.shape
    total = np.zeros((buckets, dims), np.float64)
    for i, j in slices(off, 1 << 20):
        doc, bucket, _ = _tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i], buckets)
        left, right = [], []
        for d in range(1, reach + 1):
            same = np.flatnonzero(doc[:-d] == doc[d:]) if len(doc) > d else np.empty(0, np.int64)
            left += [bucket[same], bucket[same + d]]
            right += [bucket[same + d], bucket[same]]
        pair, count = np.unique(np.concatenate(left) * buckets + np.concatenate(right), return_counts=True)
        own, other = pair // buckets, pair % buckets
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
        for s in range(0, len(heads), 4096):
            a, b = heads[s], heads[s + 4096] if s + 4096 < len(heads) else len(own)
            total[own[heads[s : s + 4096]]] += np.add.reduceat(index[other[a:b]] * count[a:b, None], heads[s : s + 4096] - a, axis=0)
    return total


def fit_quality(
    sample: pa.Table, label: str = "quality", dims: int = 48, buckets: int = 1 << 14, hidden: int = 32, epochs: int = 60, share: float = 0.5, seed: int = 5
) -> QualityModel:
    """A model of labelled texts. Without texts of both kinds, every text scores their common label (or 0.5)."""
    y = sample[label].to_numpy().astype(float)
    buf, off = text_bytes(sample["text"])
    index = index_vectors(buckets, dims, seed)
    context = _contexts(buf, off, index) if len(y) else np.zeros_like(index)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    words = (index + share * context).astype(np.float32)
    width = 2 * dims + SHAPES + 1
    model = QualityModel(words, index_vectors(SHAPES, dims, seed + 1), np.zeros(width), np.ones(width), None, 1.0, float(y.mean()) if len(y) else 0.5)
    if len(y) < 10 or y.min() == y.max():
        return model
    x = model.features(buf, off)
    model.centre, model.spread = x.mean(0), x.std(0) + 1e-4
    x = (x - model.centre) / model.spread
    held = np.arange(len(y)) % 5 == 4
    rng = np.random.RandomState(seed)
    a, b = rng.randn(width, hidden) * np.sqrt(2 / width), np.zeros(hidden)
    c, d = rng.randn(hidden) * np.sqrt(1 / hidden), np.zeros(1)
    weights = [a, b, c, d]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    rows, t = np.flatnonzero(~held), 0
    for _ in range(epochs):
        rng.shuffle(rows)
        for s in range(0, len(rows), 128):
            own = rows[s : s + 128]
            z = x[own] @ a + b
            h = np.maximum(z, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ c + d, -40, 40)))
            g = (p - y[own]) / len(own)
            back = np.outer(g, c) * (z > 0)
            grads = [x[own].T @ back + 1e-3 * a, back.sum(0), h.T @ g + 1e-3 * c, np.array([g.sum()])]
            t += 1
            for w, m, v, grad in zip(weights, first, second, grads, strict=True):
                m *= 0.9
                m += 0.1 * grad
                v *= 0.999
                v += 0.001 * grad * grad
                w -= 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.layers = (a.astype(np.float32), b.astype(np.float32), c.astype(np.float32), float(d[0]))
    logit = np.maximum(x[held] @ a + b, 0) @ c + d
    loss = lambda k: np.mean(np.logaddexp(0, logit / k) - y[held] * logit / k)
    model.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss)) if held.any() else 1.0
    return model


def document_quality(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: `id`, `score` (0 to 1).

    Defined cases: null and empty texts have features of zero, and are scored like other texts; repeated
    rows give repeated rows; an empty table gives an empty table; other columns are not looked at.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model)  # buckets x dims numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            buf, off = text_bytes(batch.column("_text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(known.score(known.features(buf, off)).astype(float), pa.float64())], ["id", "score"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, "id bigint, score double")


def fit_from_tables(docs: DataFrame, labels: DataFrame, rows: int = 8_000, only=None) -> QualityModel:
    """A model of about `rows` labelled documents."""
    return fit_quality(labelled_sample(docs, labels, ["quality"], rows, only=only))
