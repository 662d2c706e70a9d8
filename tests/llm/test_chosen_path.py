import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from quire.llm import chosen_path
from quire.llm.chosen_path import near_classes
from quire.llm.components import connected


def brute(texts, k=5, num=4, den=5):
    sets = []
    for _, t in texts:
        w = [x for x in (t or "").replace(" ", "\u0001").split()]
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    nodes = defaultdict(list)
    for (i, _), s in zip(texts, sets, strict=True):
        nodes[s].append(i)
    keys = list(nodes)
    near = {a: [b for b in keys if a != b and a and b and den * len(a & b) >= num * len(a | b)] for a in keys}
    rep = {s: min((i for i in ids if i is not None), default=None) for s, ids in nodes.items()}
    out = []
    for (i, _), s in zip(texts, sets, strict=True):
        seen, queue = {s}, [s]
        while queue:
            for b in near[queue.pop()]:
                if b not in seen:
                    seen.add(b)
                    queue.append(b)
        out.append((str(i), str(min((rep[x] for x in seen if rep[x] is not None), default=None)), len(near[s])))
    return sorted(out)


def got(df, **kw):
    return sorted((str(r.id), str(r.class_id), r.n_links) for r in near_classes(df, **kw).collect())


def test_brute_force(make, corpus):
    assert got(make(corpus)) == brute(corpus)


def test_splitting_and_blocks(make):
    base = [f"w{i}" for i in range(120)]
    common = " ".join(f"c{i}" for i in range(9))
    texts = []
    for i in range(70):  # one large group of near copies, and texts that share a line
        own = list(base)
        own[(7 * i) % 120] = f"n{i}"
        texts.append((i, " ".join(own)))
        texts.append((1000 + i, f"{common} " + " ".join(f"z{i}_{j}" for j in range(3 + i % 4))))
    want = brute(texts)
    assert got(make(texts), bucket=8, reach=4, block=16, depth=3) == want
    assert got(make(texts), bucket=16, reach=8, block=1000) == want


@pytest.fixture(scope="module")
def pairs_in_a_large_group():
    """900 pairs of similarity 0.81 among 1,800 texts put together from the same few passages, and what brute force says."""
    rng = random.Random(1)
    texts, drawn = [], {}
    while len(drawn) < 900:
        drawn[tuple(rng.choices((0, 1), (65, 35))[0] for _ in range(20))] = None
    for i, passages in enumerate(drawn):
        a = [f"s{k}v{v}w{j}" for k, v in enumerate(passages) for j in range(10)]
        b = list(a)
        b[25::50] = [f"q{i}"] * 4
        texts += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    words = [t.split() for _, t in texts]
    sets = [{tuple(w[s : s + 5]) for s in range(len(w) - 4)} for w in words]
    column = {g: c for c, g in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(column)), np.float32)
    for row, x in enumerate(sets):
        held[row, [column[g] for g in x]] = 1
    both = (held @ held.T).astype(int)
    size = both.diagonal()
    near = 5 * both >= 4 * (size[:, None] + size[None, :] - both)
    reach = near.copy()
    while (more := (reach.astype(np.float32) @ reach > 0)).sum() > reach.sum():
        reach = more
    return texts, sorted((str(i), str(reach[i].argmax()), int(near[i].sum() - 1)) for i in range(len(texts)))


def test_all_pairs_of_a_large_group(make, pairs_in_a_large_group):
    texts, want = pairs_in_a_large_group
    assert got(make(texts)) == want


def test_buckets_over_the_bound_at_full_depth(make, pairs_in_a_large_group):
    texts, want = pairs_in_a_large_group
    found = set(got(make(texts), bucket=40, reach=8))
    assert len(found & set(want)) >= 0.998 * len(want)


def test_texts_of_one_template(make):
    """Texts of similarity about 0.65, none linked, and some near copies among them: small components, all links."""
    rng = random.Random(3)
    base, texts = [f"t{i}" for i in range(400)], []
    for i in range(300):
        own = list(base)
        for at in rng.sample(range(0, 400, 5), 9):
            own[at] = f"x{i}y{at}"
        texts.append((i, " ".join(own)))
        if i % 25 == 0:
            own[3] = f"n{i}"
            texts.append((1000 + i, " ".join(own)))
    want = brute(texts)
    assert sum(n for _, _, n in want) == 24
    sizes = []
    refined = chosen_path._refined

    def counting(*args):
        out = refined(*args)
        sizes.extend(max(Counter(r.root for r in x.select("root").collect()).values()) for x in (args[0], out))
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(chosen_path, "_refined", counting)
        assert got(make(texts), block=40) == want
    assert sizes[0] > 300 and sizes[1] <= 40


def test_one_row_of_each_class(make):
    texts = [(1, "a text of some words that is here twice"), (None, "a text of some words that is here twice"), (None, "a text of some words that is here twice")]
    texts += [(1, "other"), (5, "third one"), (5, "other"), (None, None)]
    rows = near_classes(make(texts)).collect()
    assert sorted(str(r.id) for r in rows if r.row == r.class_row) == ["1", "1", "5", "None"]


def test_many_bytes_are_checked_in_blocks(make, corpus):
    assert got(make(corpus), bytes=2000) == brute(corpus)


def test_empty_table(make):
    assert near_classes(make([])).collect() == []


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(30)], [(0, i) for i in range(1, 50)] + [(60, 61), (61, 62), (3, 60)], [(5, 4), (4, 5), (5, 4), (9, 9)]])
def test_components(spark, links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = sorted((x, find(x)) for x in parent)
    df = spark.createDataFrame(links, "a long, b long")
    assert sorted(tuple(r) for r in connected(df).collect()) == want
