import random
import re

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from quire.llm import _storage, language
from quire.llm._arrow import text_bytes

PARTS = {"aa": ["the", "tion", "ing", "wh"], "bb": ["sch", "ung", "keit", "ei"], "cc": ["eau", "oux", "ment", "qu"]}


def sentences(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(PARTS))
        out.append((i, " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(4, 40))), lang))
    return out


def test_held_out_accuracy(spark):
    rows = sentences(400)
    df = spark.createDataFrame([(i, t, x, f"s{i % 4}") for i, t, x in rows], "doc_id long, text string, lang string, source string")
    model = language.fit_languages(df.where("doc_id < 200"))
    assert model.languages == sorted(PARTS)
    got = {r.id: r for r in language.identify_languages(df.where("doc_id >= 200"), model, host=F.col("source")).collect()}
    assert sum(got[i].language == x for i, _, x in rows[200:]) >= 198


def test_host_and_markup_decide_short_texts(spark):
    rows = [(i, t, "bb", "a.host.bb", "bb-BB") for i, t, x in sentences(300) if x == "bb"]
    rows += [(i, t, "aa", "b.host.aa", "aa") for i, t, x in sentences(300) if x == "aa"]
    schema = "doc_id long, text string, lang string, host string, declared string"
    model = language.fit_languages(spark.createDataFrame(rows, schema))
    rows += [(900, "xy", None, "a.host.bb", "bb"), (901, "xy", None, "b.host.aa", None), (902, None, None, "b.host.aa", "aa"), (903, "", None, None, None), (904, "12 34", None, "a.host.bb", "bb"), (None, "the tion", None, None, None)]
    found = language.identify_languages(spark.createDataFrame(rows, schema), model, host=F.col("host"), declared=F.col("declared"), sure=0.6)
    got = {r.id: r for r in found.collect()}
    assert got[900].language == "bb" and got[901].language == "aa"
    assert [got[i].accepted for i in (902, 903, 904)] == [False] * 3 and got[902].language is None
    assert got[None].language == "aa"


def test_no_languages_and_empty_tables(spark, make):
    model = language.fit_languages(make([]))
    assert model.languages == []
    assert [r.accepted for r in language.identify_languages(make([(1, "text")]), model).collect()] == [False]
    some = language.fit_languages(make([(i, f"word{i} text") for i in range(9)]))
    assert some.languages == ["en"]
    assert language.identify_languages(make([]), some, host=F.col("source")).collect() == []
    assert [r.language for r in language.identify_languages(make([(1, "text"), (1, "text")]), some).collect()] == ["en", "en"]


def test_against_a_loop_over_rows(spark):
    rows = [(i, t if i % 9 else t[:4], x, f"h{i % 3}.site{i % 2}.{x[0]}a" if i % 4 else None, x if i % 5 == 0 else None) for i, t, x in sentences(60)]
    rows += [(100, None, "aa", "h1.site1.aa", "bb"), (101, "", "aa", None, None), (102, "12", "bb", "h1.site1.aa", None), (3, "the tion", "aa", "one", "cc-x"), (None, "sch ei", "bb", "one", "??")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string, declared string")
    model = language.fit_languages(df)
    k, smooth = 3, 20.0
    seen = []
    for i, t, _, host, declared in rows:
        average, n = model.averages(*text_bytes(pa.array([t], pa.string())))
        like = average[0] * min(int(n[0]), model.weight)
        p = np.exp(like - like.max()) / np.exp(like - like.max()).sum()
        labels = host.split(".") if host else []
        levels = {"host": host, "domain": ".".join(labels[-2:]) or None, "suffix": labels[-1] if len(labels) > 1 else None}
        levels["declared"] = re.match("[a-z]*", declared or "")[0] or None
        seen.append((i, t, like, p, int(n[0]), levels))
    total = sum(p for _, _, _, p, n, _ in seen if n)
    count = sum(1 for x in seen if x[4])
    everywhere = (total + 1) / (count + k)
    want = {}
    for me, (i, t, like, p, n, levels) in enumerate(seen):
        rest = lambda level, me=me, levels=levels: sum((x[3] for j, x in enumerate(seen) if j != me and x[4] and levels[level] and x[5][level] == levels[level]), np.zeros(k))
        domain = (rest("domain") + smooth * everywhere) / (rest("domain").sum() + smooth)
        log = like + np.log((rest("host") + smooth * domain) / (rest("host").sum() + smooth))
        for level in ("declared", "suffix"):
            if levels[level] and any(x[4] and x[5][level] == levels[level] for x in seen):
                log += np.log((rest(level) + smooth * everywhere) / (total + smooth)) - np.log((rest(level).sum() + smooth) / (count + smooth))
        post = np.exp(log - log.max()) / np.exp(log - log.max()).sum()
        spoken = any(c.isalpha() for c in t or "")
        want[i, t] = (model.languages[int(post.argmax())] if spoken and post.max() >= 0.5 else None, post.max())
    found = language.identify_languages(df, model, host=F.col("host"), declared=F.col("declared")).collect()
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1])
    assert len(found) == len(rows)
    for r in found:
        assert any(r.language == want[r.id, t][0] and abs(r.posterior - want[r.id, t][1]) < 1e-6 for t in texts[r.id]), r


def test_many_hosts_are_looked_up_by_shuffles(spark, monkeypatch):
    rows = [(i, t, x, f"h{i if i % 3 else 0}.org" if i % 7 else None) for i, t, x in sentences(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    model = language.fit_languages(df)
    want = sorted(map(tuple, language.identify_languages(df, model, host=F.col("host")).collect()))
    monkeypatch.setattr(_storage.looked_up, "__defaults__", (10,))
    got = sorted(map(tuple, language.identify_languages(df, model, host=F.col("host")).collect()))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want])
