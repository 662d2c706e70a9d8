import corpus_pipeline
from quire.llm.decontaminate import contaminated
from quire.session import table
from test_chosen_path import brute

SF = "/root/testdata/sf0.001"


def test_stages_on_a_table(spark):
    docs = table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = [(r.doc_id, r.text) for r in out.collect()]
        before = [(r.doc_id, r.text) for r in docs.collect()]
        assert set(rows) <= set(before)
        if name == "near_duplicates":
            assert sorted(i for i, _ in rows) == sorted({int(c) for _, c, _ in brute(before)})
        if name == "decontamination":
            hits = {r.id for r in contaminated(docs, table(spark, SF, "benchmark")).collect() if r["items"]}
            assert {i for i, _ in before} - {i for i, _ in rows} == hits
        kept[name] = len(rows)
        docs = out
    assert kept["language_id"] >= 0.97 * table(spark, SF, "documents").count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r.slot for r in last) == list(range(len(last)))
    assert {r.doc_id for r in last} == {r.doc_id for r in docs.collect()}


WORDS = "one two three four five six seven eight nine ten".split()


def documents(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], schema)


def kept(df):
    return sorted((str(r.doc_id), str(r.text)) for r in df.collect())


def test_null_and_repeated_ids_keep_one_row_of_each_class(spark):
    text, other = " ".join(WORDS), "other text"
    rows = [(1, text), (None, text), (None, text), (1, other), (5, "third"), (5, other), (2, "third"), (7, "x"), (7, "x"), (None, None)]
    out = corpus_pipeline.keep_one_of_each_class(spark, documents(spark, rows), SF)
    assert kept(out) == sorted([("1", text), ("1", other), ("2", "third"), ("7", "x"), ("None", "None")])


def test_language_verdicts_go_by_row(spark):
    known = [(i, f"{' '.join(WORDS)} {i}") for i in range(20)]
    odd = [(None, "12 34"), (3, "---"), (None, f"{' '.join(WORDS)} of it"), (4, None), (4, "")]
    out = corpus_pipeline.keep_known_languages(spark, documents(spark, known + odd), SF)
    assert kept(out) == sorted((str(i), t) for i, t in [*known, odd[2]])


def test_rates_go_by_row(spark, monkeypatch):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(labels, "doc_id", "left_semi")
    texts = [r.text for r in docs.limit(60).collect()]
    rows = documents(spark, [(None if i % 3 else 7, t) for i, t in enumerate(texts)] + [(7, None)])
    found = {}

    def noted(df, model, targets, id_col):
        out = mixed(df, model, targets, id_col=id_col)
        found.update({(r.doc_id, r.text): r.copies for r in out.join(df, out["id"] == df[id_col]).collect()})
        return out

    mixed = corpus_pipeline.mixing.mixed
    monkeypatch.setattr(corpus_pipeline.mixing, "mixed", noted)
    out = corpus_pipeline.mix_to_weights(spark, rows, SF)
    assert kept(out) == sorted((str(r.doc_id), str(r.text)) for r in rows.collect() for _ in range(found[r.doc_id, r.text]))
    assert out.columns == rows.columns and len(set(found.values())) > 1


def test_empty_table(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []
