import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.llm import mixing


def weights(p, n):
    size = n.sum()
    return np.linalg.inv((p * n[:, None]).T @ p / size + 1e-6 * np.eye(p.shape[1]))


def brute_rates(p, n, target, rounds=4000):
    """Short projected gradients in numpy, from rates of one."""
    r, size, w = np.ones(len(n)), n.sum(), weights(p, n)
    for _ in range(rounds):
        gap = ((p * (n * r)[:, None]).sum(0) - target) / size
        r = np.maximum(0, r - 0.2 * p @ (w @ gap))
    return r


def members(spark, p, n):
    return spark.createDataFrame([(i, int(n[i]), [float(x) for x in p[i]]) for i in range(len(n))], "id long, tokens long, p array<double>")


def test_totals_match_targets(spark):
    rng = np.random.RandomState(1)
    p = rng.dirichlet([0.2, 0.1, 0.05], 500)
    n = rng.randint(0, 400, 500)
    for share in ([0.2, 0.3, 0.5], [0.6, 0.4, 0.0], [0.9, 0.05, 0.05]):
        target = np.array(share) * n.sum()
        steps, totals = mixing.fit_rates(members(spark, p, n), target)
        got = np.ones(500)
        for s in steps:
            got = np.maximum(0, got - p @ s)
        assert np.allclose((p * (n * got)[:, None]).sum(0), totals)
        # a target of zero is approached, not reached: every posterior is positive
        assert np.abs(totals - target).max() <= (0.001 if min(share) else 0.01) * target.sum()
        assert np.abs((p * (n * brute_rates(p, n, target))[:, None]).sum(0) - target).max() <= (0.001 if min(share) else 0.01) * target.sum()


def test_no_tokens(spark):
    assert mixing.fit_rates(members(spark, np.ones((2, 1)), [0, 0]), np.array([0.0]))[0] == []


def test_mixed(spark, make):
    rng = np.random.RandomState(2)
    texts = [(i, " ".join(rng.choice(["good", "fine", "nice"] if i % 3 else ["bad", "poor", "ugly"], 30))) for i in range(300)]
    label = np.array([int(i % 3 == 0) for i, _ in texts])
    model = mixing.fit_domains(pa.table({"text": [t for _, t in texts]}), label, ["clean", "low"])
    df = make(texts + [(900, None), (901, ""), (5, texts[5][1]), (None, "good nice")])
    rows = mixing.mixed(df, model, {"clean": 0.8, "low": 0.2}, budget=1.0).collect()
    total = sum(r.tokens * r.rate * np.array(r.p) for r in rows)
    assert np.allclose(total / total.sum(), [0.8, 0.2], atol=0.005)
    assert all(int(r.rate) <= r.copies <= int(r.rate) + 1 for r in rows)
    assert {r.tokens for r in rows if r.id in (900, 901)} == {0}
    assert len({r.rate for r in rows if r.id == 5}) == 1
    assert mixing.mixed(make([]), model, {"clean": 1.0}).collect() == []
    assert [r.rate for r in mixing.mixed(make([(1, None)]), model, {"clean": 1.0}).collect()] == [1.0]


def test_without_labels(spark, make):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = mixing.fit_from_tables(make([(1, "a b c")]), labels)
    row = mixing.domain_posteriors(make([(1, "a b c")]), model).select(F.col("p")).first()
    assert np.allclose(row.p, 1 / 3)
