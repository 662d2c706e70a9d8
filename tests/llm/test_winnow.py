import hashlib

from pyspark.sql import functions as F

from quire.llm import winnow

KEY = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")


def test_edits_and_order(make, corpus):
    rows = sorted(corpus, key=KEY)
    want = []
    for n, (i, t) in enumerate(rows):
        t, follow = t or "", rows[(n + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest()))
    out = winnow.edited_fingerprints(make(corpus))
    got = out.select("id", "n_chars", F.sha2("edited", 256).alias("e"), "near_edited", "near_next").collect()
    assert sorted((str(r.id), r.n_chars, r.e) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def brute(hashes, window):
    """Chosen positions: rightmost least hash of each window."""
    out = []
    for s in range(max(1, len(hashes) - window + 1)) if hashes else ():
        part = hashes[s : s + window]
        at = s + max(j for j, x in enumerate(part) if x == min(part))
        if at not in out:
            out.append(at)
    return out


def test_windows(make, corpus):
    for k, window in ((3, 4), (2, 8), (1, 1), (4, 2)):
        df = winnow.with_fingerprint(make(corpus).select("text"), "text", "f", k, window)
        df = df.select("text", F.transform("f", winnow.place_of).alias("at"), F.transform("f", winnow.hash_of).alias("h"))
        full = winnow.with_fingerprint(df, "text", "g", k, 1).select("at", "h", F.transform("g", winnow.hash_of).alias("all"))
        for r in full.collect():
            assert list(r["at"]) == brute(list(r["all"]), window)
            assert [r["all"][i] for i in r["at"]] == list(r["h"])


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_likeness_against_brute_force(make, corpus):
    chinese = "".join(chr(0x4E00 + (7 * i * i + 3 * i) % 5000) for i in range(500))
    rows = sorted([(i, t) for i, t in corpus if i is not None and (i, t) != (5, corpus[5][1])] + [(600, chinese), (601, chinese[:400] + "x y z")], key=KEY)
    out = winnow.edited_fingerprints(make(rows))
    by = dict(rows)
    ids = [i for i, _ in rows]
    texts = {r.id: (by[r.id] or "", r.edited, by[ids[(ids.index(r.id) + 1) % len(ids)]] or "", r.near_edited, r.near_next) for r in out.collect()}
    flat = make([(n, t) for n, t in enumerate({x for v in texts.values() for x in v[:3]})]).select("text")
    grams = {r.text: [winnowed for winnowed in r.h] for r in winnow.with_fingerprint(flat, "text", "g", 3, 1).select("text", F.transform("g", winnow.hash_of).alias("h")).collect()}
    kept = {t: {h[i] for i in brute(list(h), 2)} for t, h in grams.items()}
    for text, edited, follow, near_edited, near_next in texts.values():
        assert abs(dice(kept[text], kept[edited]) - near_edited) < 1e-9
        assert abs(dice(kept[text], kept[follow]) - near_next) < 1e-9
    assert 0.3 < texts[600][3] < 0.8 and texts[600][4] > 0.7


def test_equal_texts_and_match_guarantee(spark):
    shared = " ".join(f"s{i}" for i in range(6))  # k + window - 1 words
    a = " ".join(f"a{i}" for i in range(200)) + f" {shared} " + " ".join(f"b{i}" for i in range(150))
    b = " ".join(f"c{i}" for i in range(90)) + f" {shared} " + " ".join(f"d{i}" for i in range(310))
    df = spark.createDataFrame([(1, a), (2, b), (3, a.replace(" ", "\n"))], "doc_id int, text string")
    rows = {r.doc_id: r for r in winnow.with_fingerprint(df, "text", "f").select("doc_id", "f", F.transform("f", winnow.hash_of).alias("h")).collect()}
    assert set(rows[1].h) & set(rows[2].h)
    assert rows[1].f == rows[3].f


def test_likeness_and_single_row(make):
    df = make([(9, "a lone text of some words to be put together")])
    r = winnow.edited_fingerprints(df).first()
    assert r.near_next == 1.0 and 0 < r.near_edited < 1
    r = winnow.edited_fingerprints(make([(1, None), (2, "")])).collect()
    assert [x.near_edited for x in r] == [1.0, 1.0] and [x.near_next for x in r] == [1.0, 1.0]
    assert winnow.edited_fingerprints(make([])).collect() == []


def test_one_rule_for_all_lengths(make):
    words = [f"w{i}" for i in range(120)]
    for n in (3, 10, 64, 65, 66, 100):
        rows = winnow.edited_fingerprints(make([(1, " ".join(words[:n])), (2, " ".join(words[: n + 1]))])).collect()
        assert all(r.near_next >= 1 - 2.5 / max(1, n - 2) for r in rows), n


def test_main_path_is_native(make, corpus):
    plan = winnow.edited_fingerprints(make(corpus))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
