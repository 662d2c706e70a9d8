import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import shards
from quire.llm._order import row_key


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 255, 1000, 65537])
def test_permutation(n):
    x = shards.feistel(np.arange(n), n, 7)
    assert sorted(x.tolist()) == list(range(n))
    assert (shards.feistel(x, n, 7, inverse=True) == np.arange(n)).all()
    if n > 200:
        assert (x != shards.feistel(np.arange(n), n, 8)).mean() > 0.9
        assert np.abs(np.corrcoef(np.arange(n), x)[0, 1]) < 0.25


def brute(corpus, order, length, key):
    """(slot, id, sequence, tokens) of all sequences, from the documents in order."""
    enc, end, out = shards.encoder(shards.VOCABULARY), 50256, []
    for i, t in order:
        ids = [*enc.encode(t or "", allowed_special=set(), disallowed_special=()), end]
        out += [(i, s // length, ids[s : s + length] + [end] * (length - len(ids[s : s + length]))) for s in range(0, len(ids), length)]
    slots = shards.feistel(np.arange(len(out)), len(out), key)
    return sorted((int(s), -1 if i is None else i, n, tuple(x)) for s, (i, n, x) in zip(slots, out, strict=True))


def taken(rows):
    return sorted((r.slot, -1 if r.doc_id is None else r.doc_id, r.sequence, tuple(np.frombuffer(r.tokens, np.uint16).tolist())) for r in rows)


def test_against_brute_force_under_any_partitioning(spark, make, corpus):
    df = make(corpus)
    keyed = df.select(F.col("doc_id").alias("id"), "text").withColumn("h", row_key("id", "text"))
    order = [(r.id, r.text) for r in sorted(keyed.collect(), key=lambda r: (r.h, r.id is not None, r.id or 0))]
    want = brute(corpus, order, 32, 9)
    for rows in (df.coalesce(1), df.repartition(5), df.orderBy(F.desc("text")).repartition(13)):
        found = shards.training_order(rows, length=32, shard=16, key=9).collect()
        assert taken(found) == want
        assert all(r.shard == r.slot // 16 and r.place == r.slot % 16 and r.n_tokens >= 1 for r in found)


def test_texts_round_trip(make, corpus):
    enc, texts = shards.encoder(shards.VOCABULARY), []
    rows = sorted(shards.training_order(make(corpus), length=32, shard=16).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.sequence))
    unique = [i for i in {i for i, _ in corpus} if i is not None and sum(i == j for j, _ in corpus) == 1]
    for i, group in itertools.groupby(rows, key=lambda r: r.doc_id):
        if i in unique:
            ids = np.concatenate([np.frombuffer(r.tokens, np.uint16)[: r.n_tokens] for r in group])
            assert ids[-1] == 50256 and 50256 not in ids[:-1]
            texts.append((i, enc.decode(ids[:-1].tolist())))
    assert sorted(texts) == sorted((i, t or "") for i, t in corpus if i in unique)


def test_files_are_read_by_slot_and_gone_on_with(spark, make, corpus, tmp_path):
    df, folder = make(corpus), str(tmp_path / "out")
    layout = shards.write_shards(df, folder, length=32, shard=16, passes=3)
    want = taken(shards.read_slots(spark, folder).collect())
    assert [x[0] for x in want] == list(range(layout.records))
    for first, n in ((0, 5), (13, 40), (layout.records - 3, 10), (layout.records, 1)):
        assert taken(shards.read_slots(spark, folder, first, n).collect()) == want[first : first + n]
    files = sorted((tmp_path / "out").glob("pass=*/shard=*/part-*"))
    stride = layout.record().itemsize
    assert len(files) == layout.files and sum(f.stat().st_size for f in files) == stride * layout.records
    (tmp_path / "out" / "pass=1" / "_SUCCESS").unlink()  # as if the job had stopped there
    files[0].touch()
    kept = files[0].stat().st_mtime_ns
    assert shards.write_shards(df, folder, length=32, shard=16, passes=3) == layout
    assert files[0].stat().st_mtime_ns == kept and taken(shards.read_slots(spark, folder).collect()) == want
    with pytest.raises(ValueError):
        shards.write_shards(df.limit(3), folder, length=32, shard=16, passes=3)
    cut = next((tmp_path / "out").glob("pass=*/shard=1/part-*"))
    cut.write_bytes(b"cut off")
    cut.with_name(f".{cut.name}.crc").unlink()
    with pytest.raises(Exception, match="does not hold"):
        shards.read_slots(spark, folder).collect()


def test_empty_table(spark, make, tmp_path):
    assert shards.training_order(make([])).collect() == []
    assert shards.write_shards(make([]), str(tmp_path / "x")).records == 0
    assert shards.read_slots(spark, str(tmp_path / "x"), 0, 3).collect() == []


def test_long_runs_are_cut_where_the_pattern_cuts(monkeypatch):
    enc, real = shards.encoder(shards.VOCABULARY), shards.encoder(shards.VOCABULARY).encode_to_numpy
    texts = [a + run + b for a in ("", "x", "x. ", " ") for run in (" " * 3000, "\n" * 2500, "\t　 " * 900) for b in ("", "y", " 7", "!", "'s")]
    want = [real(t, disallowed_special=()).tolist() for t in texts]

    def narrow(text, **options):
        if len(text) > 2048 and not text.strip():
            raise ValueError("no room")
        if shards._BLANKS.search(text):
            raise ValueError("no room")
        return real(text, **options)

    monkeypatch.setattr(enc, "encode_to_numpy", narrow)
    assert [shards.encoded(enc, t).tolist() for t in texts] == want


def test_a_million_blanks(make):
    text = "before" + " " * 1_000_000 + "after" + "\n" * 1_000_000
    rows = sorted(shards.training_order(make([(1, text), (2, "plain")])).where("doc_id = 1").collect(), key=lambda r: r.sequence)
    ids = np.concatenate([np.frombuffer(r.tokens, np.uint16)[: r.n_tokens] for r in rows])
    assert shards.encoder(shards.VOCABULARY).decode(ids[:-1].tolist()) == text
