import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, _id long, id string, block int"


def rows_of(texts, lang="en"):
    return [(i, t, lang, f"src{(i or 0) % 3}", len(t or ""), "x", 7, "y", 1) for i, t in texts]


@pytest.fixture(scope="session")
def make(spark):
    """A table of (doc_id, text) with columns whose names clash with those that operators use inside."""
    return lambda texts, lang="en": spark.createDataFrame(rows_of(texts, lang), SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """Small texts with copies, near copies, shared passages, short, empty and null texts, ties and a long one."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage, out = text(40), []
    for i in range(60):
        own = text(rng.randint(1, 120))
        if i % 5 == 0:
            own = f"{own}\n{passage} {text(7)}"
        out.append((i, own))
    near = out[3][1].split() * 3 + text(60).split()
    for j in range(6):
        changed = list(near)
        changed[10 + 9 * j] = f"new{j}"
        out.append((100 + j, " ".join(changed)))
    out += [(200, out[0][1]), (201, out[0][1]), (5, out[5][1]), (300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "two words")]
    out += [(400, text(9000)), (None, out[7][1]), (None, None), (500, "Ünïcödé " * 30), (501, "x y \U0001f600 z " * 9)]
    return out
