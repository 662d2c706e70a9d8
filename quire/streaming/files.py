"""Files as a stream: new files of a folder are parsed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import glyphs as G
from ..sources import reader


def stream_files(spark: SparkSession, path: str, glob: str = "*.pdf", per_batch: int = 1000) -> DataFrame:
    """(path, modificationTime, content) of new files, at most so many in a batch."""
    source = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("maxFilesPerTrigger", str(per_batch))
    return source.schema("path string, modificationTime timestamp, length bigint, content binary").load(path).select("path", "modificationTime", "content")


def stream_view(files: DataFrame, name: str) -> DataFrame:
    """One of the reader's tables for streamed files. Parsing keeps no state between batches."""
    return reader.view(files, name)


def stream_find(files: DataFrame, needle: str, case_sensitive: bool = True) -> DataFrame:
    """(file_id, page_index, start_idx, end_idx) of a text in streamed files. A page's glyphs come from one
    row of the parser, so a page is one string without an aggregation over the stream."""
    pages = reader.page_strings(files)
    return G.find(pages, ["file_id", "page_index"], needle, case_sensitive)


def files_per_window(files: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files and bytes by modification time, for files at most so late."""
    rows = files.withWatermark("modificationTime", late)
    return rows.groupBy(F.window("modificationTime", window)).agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("bytes"))
