"""Queries of this subpackage: one for each operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, table
from . import chosen_path, decontaminate, language, mincut, mixing, quality, repeats, shards, toxicity, winnow


def _rest(key: str, by: int) -> Column:
    """crc32 of an id's text, modulo a number; null for a null id."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(by))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = mixing.fit_from_tables(docs, table(spark, sf_dir, "labels"))
    rows = mixing.mixed(docs, model, mixing.TARGETS)
    shares = [F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)]
    return rows.select(F.col("id").alias("doc_id"), "tokens", *shares, "rate", "copies")


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return shards.training_order(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no address and no markup: their source takes the place of the host."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    found = language.identify_languages(docs, language.fit_languages(docs), host=F.col("source"))
    return found.withColumnRenamed("id", "doc_id")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where all its evidence is there: pages with hosts and declared languages."""
    prepare(spark)
    pages = table(spark, sf_dir, "pages")
    body = F.regexp_replace("html", r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    pages = pages.withColumn("body", body).withColumn("declared", F.regexp_extract("html", r'(?i)<html[^>]*\blang="?([a-zA-Z-]+)', 1))
    pages = pages.withColumn("host", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1))
    model = language.fit_languages(table(spark, sf_dir, "documents"))
    found = language.identify_languages(pages, model, "page_id", "body", host=F.col("host"), declared=F.col("declared"))
    return found.withColumnRenamed("id", "page_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_from_tables(docs, table(spark, sf_dir, "labels"), only=_rest("_key", 5) != 0)
    rows = toxicity.toxic_passages(docs, model).withColumnRenamed("id", "doc_id")
    held = F.coalesce(_rest("doc_id", 5) == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "passages")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        F.col("id").alias("doc_id"),
        (F.size("items") > 0).alias("contaminated"),
        F.transform("items", lambda x: x.item_id).alias("item_ids"),
        F.array_max(F.transform("items", lambda x: x.share)).alias("share"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_from_tables(docs, table(spark, sf_dir, "labels"), only=_rest("_key", 3) != 1)
    rows = quality.document_quality(docs, model).withColumnRenamed("id", "doc_id")
    held = F.coalesce(_rest("doc_id", 3) == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = repeats.repeated_passages(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, x: total + x.end - x.start)
    return rows.select(F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnow.edited_fingerprints(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        winnow.digest(F.col("fingerprint")).alias("fingerprint"),
        winnow.digest(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = mincut.extracted(table(spark, sf_dir, "pages"))
    return rows.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op10_near_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return chosen_path.near_classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_training_order,
        op3_language_id,
        op4_toxicity,
        op5_decontaminate,
        op6_quality,
        op7_repeated_passages,
        op8_fingerprints,
        op9_main_text,
        op10_near_classes,
        language_of_pages,
        pipeline,
    )
}

_WORDS = r"w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)"

ORACLES = {
    "op7_repeated_passages": f"""
WITH {_WORDS},
win AS (SELECT doc_id, s, array_to_string(list_slice(ws, s, s + 12), ' ') AS g
        FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS s FROM w WHERE len(ws) >= 13)),
lowest AS (SELECT g, min(doc_id) AS lo FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, s + k AS i
         FROM (SELECT win.doc_id, s, unnest(generate_series(0, 12)) AS k FROM win JOIN lowest USING (g) WHERE lo < win.doc_id)),
one AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT one.doc_id, string_agg(word, ' ' ORDER BY one.i) AS t, count(*) AS n
         FROM one LEFT JOIN gone ON one.doc_id = gone.doc_id AND one.i = gone.i WHERE gone.i IS NULL GROUP BY one.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
    "op10_near_classes": f"""
WITH RECURSIVE {_WORDS},
sh AS (SELECT DISTINCT doc_id, g FROM (
         SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
           ELSE list_transform(generate_series(1, len(ws) - 4), lambda s: array_to_string(list_slice(ws, s, s + 4), ' ')) END) AS g FROM w)),
node AS (SELECT w.doc_id, coalesce(f, '') AS f, coalesce(n, 0) AS n
         FROM w LEFT JOIN (SELECT doc_id, string_agg(g, chr(10) ORDER BY g) AS f, count(*) AS n FROM sh GROUP BY doc_id) x ON w.doc_id = x.doc_id),
rep AS (SELECT f, min(doc_id) AS r, any_value(n) AS n FROM node GROUP BY f),
own AS (SELECT r, n, g FROM rep JOIN sh ON sh.doc_id = rep.r),
pair AS (SELECT a.r AS x, b.r AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
         FROM own a JOIN own b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
link AS (SELECT x, y FROM pair WHERE 5 * c >= 4 * (nx + ny - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT r AS x, r AS y FROM rep UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x),
class AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n_links FROM edge GROUP BY x)
SELECT node.doc_id, class.class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM node JOIN rep USING (f) JOIN class ON class.x = rep.r LEFT JOIN degree ON degree.x = rep.r""",
}
