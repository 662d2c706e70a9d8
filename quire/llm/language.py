"""Language identification by Bayesian fusion of evidence.

Text: each language has a smoothed distribution of hashed letter trigrams, counted over a bounded sample of
texts of known language; a text's average log-likelihood counts as that of at most `weight` trigrams, since
neighbours are not independent. Host: the languages of a host's other documents, smoothed towards those of
its domain, and these towards those of the whole table. Markup: the declared language, weighed by how often
documents of each language declare it. Address: the suffix of the host, weighed in the same way. All three
are grouped sums of the text posteriors over all rows, each taken without the row's own share. Rows
without a host, declaration or suffix simply lack that evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import slices, text_bytes
from ._storage import looked_up, staged
from ._tokens import _LETTER, constants, mix

_U = np.uint64
_FOLD = np.where(_LETTER, np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)), 0).astype(np.uint8)
_BY = constants(3, 41)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages, log-probabilities
    weight: float

    def averages(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(average log-likelihoods by language, number of trigrams) of each text."""
        out = np.zeros((len(off) - 1, len(self.languages)))
        count = np.zeros(len(off) - 1, np.int64)
        for i, j in slices(off):
            key, doc = _trigrams(buf[off[i] : off[j]], off[i : j + 1] - off[i], len(self.table))
            if not len(key):
                continue
            n = np.bincount(doc, minlength=j - i)
            first = np.concatenate([[0], np.cumsum(n)[:-1]])[n > 0]
            rows = np.flatnonzero(n) + i
            out[rows] = np.add.reduceat(self.table[key], first, axis=0) / n[n > 0][:, None]
            count[i:j] = n
        return out, count


def _trigrams(buf: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of all byte trigrams with at least two letters, lower case, others as blanks."""
    if len(buf) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = _FOLD[buf]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    live = (c > 0).astype(np.uint8)
    ok = (doc[:-2] == doc[2:]) & (live[:-2] + live[1:-1] + live[2:] >= 2)
    at = np.flatnonzero(ok)
    wide = c.astype(_U)
    key = mix(wide[at] * _BY[0] + wide[at + 1] * _BY[1] + wide[at + 2] * _BY[2]) % _U(buckets)
    return key.astype(np.int64), doc[at]


def fit_languages(
    df: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", rows: int = 6_000, buckets: int = 1 << 15, weight: float = 60.0, least: int = 5
) -> LanguageModel:
    """A model of about `rows` texts of known language, chosen by a hash of their id.

    Languages with fewer than `least` sampled texts are left out, and so are rows without language or id.
    """
    known = df.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = known.where("id is not null and lang is not null")
    share = min(1.0, rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 30)) < int(share * (1 << 30))).select("lang", "text").toArrow()
    langs = sample["lang"].to_numpy(zero_copy_only=False) if sample.num_rows else np.empty(0, object)
    names = sorted(x for x in set(langs) if (langs == x).sum() >= least)
    counts = np.zeros((buckets, len(names)))
    buf, off = text_bytes(sample["text"])
    code = np.array([names.index(x) if x in names else -1 for x in langs], np.int64)
    for i, j in slices(off):
        key, doc = _trigrams(buf[off[i] : off[j]], off[i : j + 1] - off[i], buckets)
        of = code[doc + i]
        for x in range(len(names)):
            counts[:, x] += np.bincount(key[of == x], minlength=buckets)
    both = counts.sum(1, keepdims=True)
    back = (both + 0.5) / (both.sum() + 0.5 * buckets)
    table = np.log((counts + 200 * back) / (counts.sum(0) + 200)) if names else counts
    return LanguageModel(names, table, weight)


def identify_languages(
    df: DataFrame,
    model: LanguageModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    host: Column | None = None,
    declared: Column | None = None,
    sure: float = 0.5,
    smooth: float = 20.0,
) -> DataFrame:
    """One row for each row of df: `id`, `language`, `posterior`, `accepted`, `text_posterior`, `n_trigrams`.

    host and declared are columns of df; a host's domain is its last two labels and its suffix the last one
    (of a host with a dot), a declaration counts by its part before the first - or _. A row is rejected,
    with language null, if its text has no letters or no language has a posterior of at least `sure`.
    Rows are joined with the sums of their host by broadcast while hosts are few; beyond that, hosts with many
    rows still are, and rows without a host are not shuffled.
    Defined cases: null and empty texts are rejected; null hosts and declarations are no evidence; a model
    without languages rejects all; repeated rows give repeated rows; an empty table gives an empty table.
    """
    names, k = model.languages, len(model.languages)
    spark = df.sparkSession
    shipped = spark.sparkContext.broadcast(model)  # buckets x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            buf, off = text_bytes(batch.column(3))
            average, n = known.averages(buf, off)
            letters = np.concatenate([[0], np.cumsum(_LETTER[buf])])
            score = average * np.minimum(n, known.weight)[:, None]
            flat = pa.array(score.reshape(-1), pa.float64())
            like = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, max(k, 1), dtype=np.int32) if k else np.zeros(len(n) + 1, np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), like, pa.array(n, pa.int64()), pa.array(letters[off[1:]] > letters[off[:-1]])],
                ["id", "host", "declared", "like", "n_trigrams", "spoken"],
            )

    clean = lambda c: F.lower(F.trim(c.cast("string"))) if c is not None else F.lit(None).cast("string")
    rows = df.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.nullif(clean(host), F.lit("")).alias("host"),
        F.nullif(F.regexp_extract(clean(declared), "^([a-z]+)", 1), F.lit("")).alias("declared"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    scored = rows.mapInArrow(run, "id bigint, host string, declared string, like array<double>, n_trigrams bigint, spoken boolean")
    if not k:
        none = F.lit(None)
        return scored.select("id", none.cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"), F.lit(0.0).alias("text_posterior"), "n_trigrams")
    scored = staged(scored.withColumn("p", _softmax(F.col("like"), k)), "languages")
    named = F.col("host").contains(".")
    scored = scored.withColumn("domain", F.coalesce(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.col("host")))
    scored = scored.withColumn("suffix", F.when(named, F.regexp_extract("host", r"([^.]+)$", 1)))
    # a text without letters says nothing about its host
    spoken = scored.where("n_trigrams > 0")
    total = spoken.agg(*[F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)) for i in range(k)], F.count("*")).first()
    everywhere = [(total[i] + 1.0) / (total[k] + k) for i in range(k)]

    out = scored
    for level in ("host", "domain", "declared", "suffix"):
        sums = spoken.where(F.col(level).isNotNull()).groupBy(level)
        sums = sums.agg(F.array(*[F.sum(F.col("p")[i]) for i in range(k)]).alias(f"{level}_sum"), F.count("*").alias("_rows"))
        out = looked_up(out, sums, level, "_rows", int(total[k]))

    def rest(level: str, i: int) -> Column:
        own = F.when(F.col("n_trigrams") > 0, F.col("p")[i]).otherwise(0.0)
        return F.greatest(F.coalesce(F.col(f"{level}_sum")[i], F.lit(0.0)) - F.when(F.col(level).isNotNull(), own).otherwise(0.0), F.lit(0.0))

    def size(level: str) -> Column:
        return sum((rest(level, i) for i in range(1, k)), rest(level, 0))

    logs = []
    for i in range(k):
        domain = (rest("domain", i) + smooth * everywhere[i]) / (size("domain") + smooth)
        prior = (rest("host", i) + smooth * domain) / (size("host") + smooth)
        log = F.col("like")[i] + F.log(prior)
        for level in ("declared", "suffix"):  # how often language i goes with this value, against all languages
            often = (rest(level, i) + smooth * everywhere[i]) / F.lit(total[i] + smooth)
            usual = (size(level) + smooth) / F.lit(total[k] + smooth)
            log = log + F.when(F.col(f"{level}_sum").isNotNull(), F.log(often / usual)).otherwise(0.0)
        logs.append(log)
    out = out.withColumn("fused", F.array(*logs)).withColumn("post", _softmax(F.col("fused"), k))
    out = out.withColumn("best", F.array_max("post")).withColumn("at", F.array_position("post", F.col("best")).cast("int"))
    accepted = F.col("spoken") & (F.col("best") >= sure)
    return out.select(
        "id",
        F.when(accepted, F.array(*[F.lit(x) for x in names])[F.col("at") - 1]).alias("language"),
        F.col("best").alias("posterior"),
        accepted.alias("accepted"),
        F.array_max("p").alias("text_posterior"),
        "n_trigrams",
    )


def _softmax(logs: Column, k: int) -> Column:
    """Probabilities of an array of k logarithms."""
    top = F.array_max(logs)
    total = sum((F.exp(logs[i] - top) for i in range(1, k)), F.exp(logs[0] - top))
    return F.transform(logs, lambda x: F.exp(x - top) / total)
