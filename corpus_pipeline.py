"""A corpus pipeline of five of the operators; each stage is written as Parquet and read again by the next.

Stages decide on rows, not on ids: a row's verdict is found again by a key of its values (_keyed), so null and
repeated ids are rows like any others, and equal rows share their verdict. Keys have 64 bits; that two different
rows share one, and a clean row goes with a rejected one, is to be expected once in 2^64 pairs of such rows.
An empty table passes through all stages; the last one then has no slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chosen_path, decontaminate, language, mixing, shards
from quire.llm._order import row_key
from quire.llm._storage import small, staged
from quire.session import lean_workers, prepare, table

#: Some stages have no SQL form (a trained classifier, fitted rates, a tokenizer); tests use brute force.
ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those that language ID rejects go: texts that are null, or
    without letters, or in no language that is more likely than not."""
    _set_up(spark)
    keyed, key = _keyed(docs, *docs.columns)
    found = language.identify_languages(keyed, language.fit_languages(docs), id_col=key, host=F.col("source"))
    # written first, for a filter on the posterior would be evaluated below the projections that make it
    found = staged(found.select("id", "accepted"), "accepted")
    return _without(keyed, key, found.where(~F.col("accepted")).select("id"))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id (null last), of each class of near copies; of equal rows, one. Null and empty
    texts are a class of their own."""
    _set_up(spark)
    classes = staged(chosen_path.near_classes(docs).select("row", (F.col("row") == F.col("class_row")).alias("first")), "classes")
    keyed, key = _keyed(docs, "doc_id", "text")
    left = _without(keyed, key, classes.where(~F.col("first")).select(F.col("row").alias("id")))
    twice = staged(classes.where("first").groupBy("row").count().where("count > 1").select(F.col("row").alias("id")), "twice")
    if not twice.limit(1).count():
        return left
    keyed, key = _keyed(left, "doc_id", "text")
    again = keyed.join(small(twice), F.col(key) == twice["id"], "left_semi").dropDuplicates([key]).drop(key)
    return _without(keyed, key, twice).unionByName(again)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    _set_up(spark)
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), keep=True)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, whole copies by a hash of its values. A row without tokens has the
    rate of a row without evidence."""
    _set_up(spark)
    model = mixing.fit_from_tables(docs, table(spark, sf_dir, "labels"))
    keyed, key = _keyed(docs, *docs.columns)
    rates = mixing.mixed(keyed, model, mixing.TARGETS, id_col=key).groupBy("id").agg(F.max("copies").alias("copies"))
    rates = staged(rates, "copies")
    rows = keyed.join(small(rates), F.col(key) == rates["id"]).where("copies > 0")
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def materialise_training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences at their slots, read back from the shards that were written."""
    _set_up(spark)
    return shards.training_order(docs)


def _set_up(spark: SparkSession) -> None:
    prepare(spark)
    lean_workers(spark)


def _keyed(docs: DataFrame, *columns: str) -> tuple[DataFrame, str]:
    """docs with a key of these columns' values, and the name of that column, which docs does not have."""
    name = "_key" + "_" * max(map(len, docs.columns))
    return docs.withColumn(name, row_key(*columns)), name


def _without(keyed: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    ids = ids.distinct()
    return keyed.join(small(ids), F.col(key) == ids["id"], "left_anti").drop(key)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", keep_one_of_each_class),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_to_weights),
    ("training_order", materialise_training_order),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, for the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
