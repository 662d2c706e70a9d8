import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import quality, toxicity
from quire.llm._arrow import text_bytes
from quire.llm._sample import labelled_sample


def labelled(n=600, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    out = []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(5, 80))
        toxic, good = int(rng.random() < 0.2), int(rng.random() > 0.3)
        for _ in range(3 * toxic):
            w[rng.randrange(len(w))] = rng.choice(["Vilezz", "grotzig", "mugrat"])
        if not good:
            w = [f"{x}%%%" for x in w] if i % 2 else [w[0]] * len(w)
        out.append((i, " ".join(w), good, toxic))
    return out


def brute_segments(scores):
    """Maximal segments by their definition: split at the best one, and go on left and right."""
    best, at = 0, None
    for a in range(len(scores)):
        total = 0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > best + 1e-12:
                best, at = total, (a, b)
    if at is None:
        return []
    a, b = at
    shift = lambda part, by: [(x + by, y + by, s) for x, y, s in part]
    return brute_segments(scores[:a]) + [(a, b, best)] + shift(brute_segments(scores[b + 1 :]), b + 1)


def test_maximal_segments():
    rng = np.random.RandomState(1)
    for _ in range(200):
        n = rng.randint(1, 25)
        own = rng.rand(n) < 0.5
        scores = np.where(own, rng.randint(-8, 9, n) + rng.rand(n), -1.5)
        got = toxicity.maximal_segments(np.flatnonzero(own), scores[own], 1.5)
        want = brute_segments(list(scores))
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_toxicity_held_out(make):
    rows = labelled()
    sample = pa.table({"id": [r[0] for r in rows[:400]], "text": [r[1] for r in rows[:400]], "toxic": [r[3] for r in rows[:400]]})
    model = toxicity.fit_toxicity(sample)
    test = [(r[0], r[1]) for r in rows[400:]] + [(900, None), (901, ""), (902, "clean " * 5000), (None, "mugrat grotzig vilezz")]
    got = {r.id: r for r in toxicity.toxic_passages(make(test), model).collect()}
    assert np.mean([(got[r[0]].score >= 0.5) == bool(r[3]) for r in rows[400:]]) > 0.97
    assert got[900].score == got[901].score < 0.5 and got[902].score < 0.5 and got[None].score > 0.5
    text = dict(test)
    for r in got.values():
        for p in r.passages:
            assert any(w in (text[r.id] or "")[p.start : p.end].lower() for w in ("vilezz", "grotzig", "mugrat"))


def test_quality_held_out(make):
    rows = labelled()
    sample = pa.table({"id": [r[0] for r in rows[:400]], "text": [r[1] for r in rows[:400]], "quality": [r[2] for r in rows[:400]]})
    model = quality.fit_quality(sample)
    got = {r.id: r.score for r in quality.document_quality(make([(r[0], r[1]) for r in rows[400:]] + [(900, None), (901, "")]), model).collect()}
    assert np.mean([(got[r[0]] >= 0.5) == bool(r[2]) for r in rows[400:]]) > 0.95
    assert 0 <= got[900] == got[901] <= 1


@pytest.mark.parametrize("labels", [[], [1, 1, 1]])
def test_without_both_labels(make, labels):
    ids = list(range(len(labels)))
    table = pa.table({"id": pa.array(ids, pa.int64()), "text": pa.array(["a b"] * len(ids), pa.string()), "toxic": pa.array(labels, pa.int32()), "quality": pa.array(labels, pa.int32())})
    df = make([(1, "some text"), (2, None)])
    assert all(0 <= r.score <= 1 for r in toxicity.toxic_passages(df, toxicity.fit_toxicity(table)).collect())
    assert all(0 <= r.score <= 1 for r in quality.document_quality(df, quality.fit_quality(table)).collect())


def test_empty_table(make):
    model = toxicity.ToxicityModel()
    assert toxicity.toxic_passages(make([]), model).collect() == []


def test_sample_bound_and_nulls(spark, make):
    docs = make([(i, f"t{i}") for i in range(2000)] + [(None, "t")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)] + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    table = labelled_sample(docs, labels, ["toxic"], 200)
    assert 120 < table.num_rows < 280
    whole = labelled_sample(docs, labels, ["toxic"], 10**6, only=F.col("_key") < 10)
    assert whole["id"].to_pylist() == list(range(10)) and whole["toxic"].to_pylist() == [i % 2 for i in range(10)]


def test_quality_against_a_loop_over_tokens(make):
    rows = labelled(120)
    model = quality.fit_quality(pa.table({"text": [r[1] for r in rows], "quality": [r[2] for r in rows]}))
    texts = [(i, t) for i, t, _, _ in rows[:25]] + [(900, None), (901, "One"), (902, "A1 %% b B c3")]
    found = {r.id: r.score for r in quality.document_quality(make(texts), model).collect()}
    for i, text in texts:
        vectors, shapes = [], []
        for token in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+|[^A-Za-z0-9\s\u0080-\U0010ffff]+", text or ""):
            raw = token.encode()
            _, bucket, _ = quality._tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), len(model.words))
            upper, lower = sum(x.isupper() for x in token), sum(x.islower() for x in token)
            kind = 5 if not token[0].isalnum() else 4 if any(x.isdigit() for x in token) else 3 if upper > 1 and not lower else 2 if upper and not lower else int(upper > 0)
            shapes.append(kind)
            vectors.append(model.words[bucket[0]] + model.shapes[kind])
        n = len(vectors)
        mean = sum(vectors) / n if n else np.zeros(48)
        near = sum(a * b for a, b in zip(vectors, vectors[1:], strict=False)) / n if n else np.zeros(48)
        share = [shapes.count(k) / n if n else 0.0 for k in range(6)]
        x = (np.concatenate([mean, near + np.zeros(48), share, [np.log1p(n)]]) - model.centre) / model.spread
        a, b, c, d = model.layers
        assert abs(1 / (1 + np.exp(-(np.maximum(x @ a + b, 0) @ c + d) / model.temperature)) - found[i]) < 1e-3, text


def test_toxicity_against_segments_of_each_text_alone(make):
    rows = labelled(300)
    model = toxicity.fit_toxicity(pa.table({"text": [r[1] for r in rows], "toxic": [r[3] for r in rows]}))
    texts = [(i, t) for i, t, _, _ in rows[:40]] + [(900, None), (901, "mugrat"), (902, "mugrat"), (903, "mugrat mugrat grotzig"), (901, "mugrat")]
    found = toxicity.toxic_passages(make(texts).coalesce(1), model).collect()
    of = dict(texts)
    for r in found:
        buf, off = text_bytes(pa.array([of[r.id]], pa.string()))
        doc, word, stem, _, _ = toxicity._tokens(buf, off)
        scores = [-model.drift] * len(word)
        for at, s in zip(*(x.tolist() for x in model.own_scores(doc, word, stem)), strict=True):
            scores[at] = s
        assert all(scores[i] == -model.drift for i in range(1, len(word)) if word[i] == word[i - 1])
        evidence = model.evidence([s for _, _, s in brute_segments(scores)], len(word))
        assert abs(evidence - r.evidence) < 1e-6 and abs(model.score(np.array([evidence]))[0] - r.score) < 1e-9
    assert len({r.score for r in found if r.id in (901, 902)}) == 1


def test_quality_of_an_empty_table(make):
    model = quality.fit_quality(pa.table({"text": ["a", "b"], "quality": [0, 1]}))
    assert quality.document_quality(make([]), model).collect() == []


def test_sample_is_bounded_in_bytes(spark, make):
    docs = make([(i, "x" * 100) for i in range(200)])
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, toxic int")
    assert labelled_sample(docs, labels, ["toxic"], 10**6, size=5000).num_rows == 50
