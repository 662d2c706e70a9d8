"""Mixing to target weights with soft membership.

A classifier fitted on labelled rows gives every document a posterior over domains. The unknowns are
nonnegative rates, one for each document: how many times its tokens are to be read. The expected tokens of
domain k are the sum of rate * tokens * posterior of k; the rates minimise the squared distance of these
totals from the targets, by projected gradients from rates of one. A gradient depends on a rate only through
the k residuals, so a rate is a fold over the residuals so far: each step is one aggregation over (tokens,
posterior), and neither rates nor posteriors are collected. Residuals are scaled by the inverse second
moments of the posteriors, which makes domains of very different sizes converge alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import slices, text_bytes
from ._sample import labelled_sample
from ._storage import staged
from ._tokens import LOWER, PARTS, _DIGIT, group_starts, hashes, runs

_U = np.uint64
_SMALL = np.zeros(256, np.int64)
_SMALL[97:123] = 1
_HIGH = np.zeros(256, np.int64)
_HIGH[65:91] = 1


def _features(buf: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of all distinct features, and the number of tokens of each document.

    Features are tokens in lower case, the shapes of all-capital words, and tokens that repeat.
    """
    starts, ends, doc = runs(buf, off, PARTS)
    n = np.bincount(doc, minlength=len(off) - 1)
    if not len(starts):
        return doc, doc, n
    h = hashes(buf, starts, ends, np.where(PARTS > 0, LOWER, _U(0)))
    key = (h % _U(buckets - 4)).astype(np.int64) + 4
    upper, low = np.add.reduceat(_HIGH[buf], starts), np.add.reduceat(_SMALL[buf], starts)
    loud = np.flatnonzero((upper > 1) & (low == 0))
    twice = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) + 1
    doc = np.concatenate([doc, doc[loud], doc[twice]])
    key = np.concatenate([key, np.zeros(len(loud), np.int64), np.ones(len(twice), np.int64)])
    both = np.unique(doc * buckets + key)
    return both // buckets, both % buckets, n


@dataclass
class DomainModel:
    domains: list[str]
    weights: np.ndarray  # buckets x domains
    bias: np.ndarray
    temperature: float = 1.0

    def posteriors(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(posterior of each domain, number of tokens) of each text; a text without tokens has the bias's."""
        logit = np.repeat(self.bias[None, :], len(off) - 1, 0)
        count = np.zeros(len(off) - 1, np.int64)
        for i, j in slices(off):
            doc, key, n = _features(buf[off[i] : off[j]], off[i : j + 1] - off[i], len(self.weights))
            count[i:j] = n
            first = group_starts(doc) if len(doc) else doc
            if len(first):
                logit[doc[first] + i] += np.add.reduceat(self.weights[key], first, axis=0)
        return _softmax(logit / self.temperature), count


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def fit_domains(sample: pa.Table, label: np.ndarray, domains: list[str], buckets: int = 1 << 16, epochs: int = 6, rate: float = 0.1, ridge: float = 1e-5) -> DomainModel:
    """Multinomial logistic regression on hashed token presence, by adaptive gradients.

    `label` has the domain's number of each row of the sample. Without rows all domains are alike.
    """
    k = len(domains)
    model = DomainModel(domains, np.zeros((buckets, k)), np.zeros(k))
    if not len(label):
        return model
    share = np.bincount(label, minlength=k) + 1.0
    model.bias = np.log(share / share.sum())
    buf, off = text_bytes(sample["text"])
    docs, keys = [], []
    for i, j in slices(off):
        doc, key, _ = _features(buf[off[i] : off[j]], off[i : j + 1] - off[i], buckets)
        docs.append(doc + i)
        keys.append(key)
    doc, key = np.concatenate(docs), np.concatenate(keys)
    cut = np.searchsorted(doc, np.arange(len(label) + 1))
    held = np.arange(len(label)) % 5 == 4
    rng, rows = np.random.RandomState(3), np.flatnonzero(~held)
    seen, seen_bias = np.full((buckets, k), 1e-3), np.full(k, 1e-3)
    for _ in range(epochs):
        rng.shuffle(rows)
        for s in range(0, len(rows), 64):
            own = rows[s : s + 64]
            size = cut[own + 1] - cut[own]
            at = np.repeat(cut[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            row = np.repeat(np.arange(len(own)), size)
            used, inverse = np.unique(key[at], return_inverse=True)
            logit = np.repeat(model.bias[None, :], len(own), 0)
            for x in range(k):
                logit[:, x] += np.bincount(row, model.weights[key[at], x], len(own))
            error = _softmax(logit)
            error[np.arange(len(own)), label[own]] -= 1
            grad = np.stack([np.bincount(inverse, error[row, x], len(used)) for x in range(k)], 1) / len(own) + ridge * model.weights[used]
            seen[used] += grad * grad
            model.weights[used] -= rate * grad / np.sqrt(seen[used])
            step = error.mean(0)
            seen_bias += step * step
            model.bias -= rate * step / np.sqrt(seen_bias)
    if held.any():
        rest = np.flatnonzero(held)
        logit = np.stack([model.bias + model.weights[key[cut[i] : cut[i + 1]]].sum(0) for i in rest])
        loss = lambda t: -np.mean(np.log(_softmax(logit / t)[np.arange(len(rest)), label[rest]] + 1e-12))
        model.temperature = float(min(np.geomspace(0.5, 8, 40), key=loss))
    return model


#: Domains of the labelled table, and the share of tokens that each is to have.
TARGETS = {"clean": 0.92, "low": 0.05, "toxic": 0.03}


def fit_from_tables(docs: DataFrame, labels: DataFrame, rows: int = 6_000) -> DomainModel:
    """Domains clean, low (quality 0) and toxic (quality 1, toxic 1) from about `rows` labelled documents."""
    sample = labelled_sample(docs, labels, ["quality", "toxic"], rows)
    quality, toxic = sample["quality"].to_numpy(), sample["toxic"].to_numpy()
    return fit_domains(sample, np.where(quality == 0, 1, np.where(toxic == 1, 2, 0)).astype(np.int64), list(TARGETS))


def domain_posteriors(df: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: `id`, `tokens`, `p` (posterior of each domain, in order)."""
    shipped = df.sparkSession.sparkContext.broadcast(model)  # buckets x domains numbers
    k = len(model.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, n = shipped.value.posteriors(*text_bytes(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k, dtype=np.int32)), pa.array(p.reshape(-1), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), lists], ["id", "tokens", "p"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id bigint, tokens bigint, p array<double>")


def _rate(steps: list[np.ndarray], k: int) -> Column:
    """The rate after these steps: each takes away the posterior's product with the step, down to zero."""
    if not steps:
        return F.lit(1.0)
    path = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    p = F.col("p")
    change = lambda s: sum((p[i] * s[i] for i in range(1, k)), p[0] * s[0])
    return F.aggregate(path, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - change(s)))


def fit_rates(members: DataFrame, targets: np.ndarray, tolerance: float = 1e-3, rounds: int = 40) -> tuple[list[np.ndarray], np.ndarray]:
    """(steps, totals): projected-gradient steps for (tokens, p) rows, and the domain totals they reach.

    Stops when each total is within `tolerance` of all target tokens of its target, or after so many rounds
    (targets that no nonnegative rates can reach are approached in the weighted least-squares sense, and a
    target of zero within about one in a hundred).
    """
    k = len(targets)
    tokens, p = F.col("tokens").cast("double"), F.col("p")
    moments = members.agg(F.sum(tokens), *[F.sum(tokens * p[i] * p[j]) for i in range(k) for j in range(k)]).first()
    size = float(moments[0] or 0.0)
    if not size:
        return [], np.zeros(k)
    spread = np.array([float(x) for x in moments[1:]]).reshape(k, k) / size
    inverse = np.linalg.inv(spread + 1e-6 * np.eye(k))
    steps: list[np.ndarray] = []
    totals = np.zeros(k)
    for _ in range(rounds + 1):
        rate = _rate(steps, k)
        totals = np.array([float(x or 0.0) for x in members.select(rate.alias("r"), "tokens", "p").agg(*[F.sum(F.col("r") * tokens * p[i]) for i in range(k)]).first()])
        gap = (totals - targets) / size
        if np.abs(gap).max() <= tolerance * targets.sum() / size or len(steps) == rounds:
            break
        steps.append(inverse @ gap)
    return steps, totals


def mixed(
    df: DataFrame,
    model: DomainModel,
    weights: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    budget: float | None = None,
    anchor: tuple[str, float] = ("clean", 1.05),
    seed: int = 11,
) -> DataFrame:
    """One row for each row of df: `id`, `tokens`, `p`, `rate`, `copies`.

    `weights` are the target shares of tokens by domain. `budget` is the tokens wanted as a share of those
    there are; by default as many that the anchor domain gets that multiple of the tokens it has, so that
    documents of a domain that is to stay have rates of about one or more. `copies` is the rate rounded down or up, up with the probability of its fraction, by a hash
    of the id. Defined cases: null and empty texts have no tokens and the posterior of no evidence; repeated
    rows are rows of their own with equal rates; a table without tokens keeps rates of one; an empty table
    gives an empty table. A null id draws like any other value.
    """
    members = staged(domain_posteriors(df, model, id_col, text_col), "domains")
    k = len(model.domains)
    have = [float(x or 0) for x in members.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * F.col("p")[i]) for i in range(k)]).first()]
    share = np.array([weights.get(d, 0.0) for d in model.domains])
    share = share / share.sum()
    at = model.domains.index(anchor[0])
    total = budget * have[0] if budget is not None else anchor[1] * have[1 + at] / share[at]
    steps, _ = fit_rates(members, share * total)
    draw = F.pmod(F.xxhash64(F.coalesce("id", F.lit(-1).cast("bigint")), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rate = _rate(steps, k)
    rows = members.withColumn("rate", rate)
    return rows.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))
