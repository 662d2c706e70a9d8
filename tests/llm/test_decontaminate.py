import random
from collections import Counter

import pyarrow as pa
import pytest

from quire.llm import decontaminate
from quire.llm._arrow import text_bytes
from quire.llm.decontaminate import contaminated

ITEMS = [
    (1, "Anna Smith bought 12 apples for 3.50 $ and then sold 12 apples for 7 dollars at the market in Paris yesterday"),
    (2, "the quick brown fox jumps over the lazy dog while the small cat looks on from behind the old garden wall"),
    (3, "five short literal words here"),
    (4, None),
    (None, "no id for this item although it has many words to be found in texts"),
    (5, "tiny one"),
]
CASES = [
    (1, "Intro text here. Then Bob Jones bought 99 apples for 8.25 $ and then sold 99 apples for 4 dollars at the market in Rome yesterday. End", [1]),
    (2, "So Bob Jones bought 99 apples for 8.25 $ and then sold 55 apples for 8.25 dollars at the market in Rome, Bob said 99 times", []),
    (3, "It is said, THE QUICK brown fox jumps over the lazy dog; while the small cat looks on (from behind the old garden wall).", [2]),
    (4, "over the lazy dog while the small cat looks on and that is all of it", []),
    (5, "the quick brown fox jumps over the lazy dog while the small cat sleeps", [2]),
    (6, "nothing of the kind", []),
    (7, "He wrote five short literal words here again", [3]),
    (8, None, []),
    (9, "", []),
    (10, "tiny one", []),
    (11, ITEMS[0][1] + "\n" + ITEMS[1][1] + " filler" * 3000, [1, 2]),
    (None, ITEMS[1][1], [2]),
    (11, "repeated id", []),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS + ITEMS[:1], "item_id long, text string")


@pytest.mark.parametrize("bound", [10**6, 9])
def test_cases(make, items, bound):
    got = contaminated(make([c[:2] for c in CASES]), items, bound=bound).collect()
    assert sorted((str(r.id), [x.item_id for x in r["items"]]) for r in got) == sorted((str(c[0]), c[2]) for c in CASES)


@pytest.mark.parametrize("bound", [10**6, 9])
def test_keep(make, items, bound):
    df = make([c[:2] for c in CASES])
    got = contaminated(df, items, bound=bound, keep=True)
    assert got.schema == df.schema
    assert sorted((str(r.doc_id), r.text) for r in got.collect() if r.text) == sorted((str(c[0]), c[1]) for c in CASES if not c[2] and c[1])
    assert {r._text for r in got.collect()} == {"x"}


def test_empty_tables(make, items):
    assert contaminated(make([]), items).collect() == []
    assert [list(r["items"]) for r in contaminated(make([(1, "a")]), items.limit(0)).collect()] == [[]]


def test_verbatim_parts_and_items_of_slots(spark, make):
    words = " ".join(f"w{chr(97 + i)}" for i in range(26))
    others = words.replace("w", "v")
    items = [(1, f"{words} with 3 pears and 5 plums"), (2, f"take 3 {others} add 3"), (3, "Compute 12 + 7, 8 + 9, 14 + 3, 5 + 61"), (4, "7 kg 9 m 4 s")]
    texts = [
        (1, f"so {words} with 4 pears and 4 plums", [1]),
        (2, f"so take 3 {others} add 7", [2]),
        (3, "Do this. Compute 12 + 7, 8 + 9, 14 + 3, 5 + 61 now", [3]),
        (4, "Do this. Compute 12 + 6, 8 + 1, 13 + 3, 5 + 62 now", []),
        (5, "lift 7 kg 9 m 4 s long", [4]),
        (6, "lift 7 kg 9 m 5 s long", []),
    ]
    df = make([x[:2] for x in texts])
    got = contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.id, [x.item_id for x in r["items"]]) for r in got) == [(x[0], x[2]) for x in texts]


def test_items_of_numbers_and_names(spark, make):
    items = [
        (1, "Compute 12 + 45 * 7 - 3 and 88 / 4 + 19 = 41"),
        (2, "Paris 3, Rome 14, Oslo 15, Bern 92, Lima 65, Cairo 35"),
        (3, "A train leaves at 3 15 7 21 and 4 66 2 9 meets one at 5 45 8 13 going 6 7 8 9 where"),
    ]
    texts = [
        (1, f"Some text first. {items[0][1]} And some after it.", [1]),
        (2, f"They list {items[1][1]} there", [2]),
        (3, f"Again: {items[2][1]} do they meet", [3]),
        (4, "A train leaves at 4 16 8 22 and 5 67 3 10 meets one at 6 46 9 14 going 7 8 9 10 where", [3]),  # 1 more everywhere
        (5, "A train leaves at 1 1 1 1 and 1 1 1 1 meets one at 1 1 1 1 going 1 1 1 1 where", []),
        (6, "Compute 1 + 2 and 3", []),
        (7, "3 14 15 92 65 35 and 12 45 7 3 88 4 19 41", []),
    ]
    got = contaminated(make([x[:2] for x in texts]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.id, [x.item_id for x in r["items"]]) for r in got) == [(x[0], x[2]) for x in texts]


def brute(text, items, window=8, literals=4, cover=0.5, run=13):
    """The items found in a text, by comparing each place of it with each place of each item."""
    tokens = lambda t: [x.tolist() for x in decontaminate.canonical(*text_bytes(pa.array([t])))[1:]]
    plain = lambda t: decontaminate.exact(*text_bytes(pa.array([t])))[1].tolist()
    code, kind, value = tokens(text)
    out = []
    for i, item in items:
        icode, ikind, ivalue = tokens(item)
        bare = ikind.count(0) < literals
        if bare:
            mine, own = plain(item), plain(text)
        else:
            mine, own = icode, code
        n = min(window, len(mine))
        if len(mine) < literals:
            continue
        starts = [p for p in range(len(mine) - n + 1) if bare or 0 in ikind[p : p + n]]
        places, longest = set(), 0
        for diagonal in range(-len(mine), len(own)):
            hit = [p for p in starts if p + diagonal >= 0 and mine[p : p + n] == own[p + diagonal : p + diagonal + n]]
            covered = sorted({q for p in hit for q in range(p, p + n)})
            if hit and not bare:
                slots = [(ivalue[q], value[q + diagonal]) for q in covered if ikind[q]]
                for pairs in (slots, [(y, x) for x, y in slots]):
                    agree = sum(max(Counter(y for z, y in pairs if z == x).values()) for x in {x for x, _ in pairs})
                    if agree < 0.9 * len(slots) or sum(ikind[q] == 0 for q in covered) < literals:
                        hit = [p for p in hit if ivalue[p : p + n] == value[p + diagonal : p + diagonal + n]]
                        break
                covered = sorted({q for p in hit for q in range(p, p + n)})
            places |= set(hit)
            for q in covered:
                length = 0
                while q + length in covered:
                    length += 1
                longest = max(longest, length)
        if places and (len(places) >= cover * len(starts) or longest >= run):
            out.append(i)
    return out


def test_against_brute_force(spark, make):
    rng = random.Random(8)
    words = ["stone", "river", "Anna", "7", "12", "kg", "%", "the", "of", "find", "3.5", "Paris", "sum"]
    items = [(n, " ".join(rng.choices(words, k=rng.randint(3, 30)))) for n in range(40)]
    texts = []
    for n in range(160):
        own = items[n % 40][1].split()
        cut = own[rng.randint(0, 4) : len(own) - rng.randint(0, 4)] if n % 3 else own
        changed = [str(int(float(x)) + n % 4) if x[0].isdigit() else "Bob" if x == "Anna" and n % 5 else x for x in cut]
        texts.append((n, " ".join(rng.choices(words, k=rng.randint(0, 12)) + changed + rng.choices(words, k=rng.randint(0, 12)))))
    texts += [(200, ""), (201, " ".join(x for _, x in items))]
    got = contaminated(make(texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {i: brute(t, items) for i, t in texts}
    assert {r.id: [x.item_id for x in r["items"]] for r in got} == want
    assert 40 < sum(map(bool, want.values())) < 162
