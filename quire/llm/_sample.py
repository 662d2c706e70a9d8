"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._storage import staged

_SPACE = 1 << 30


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    columns: list[str],
    rows: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    only: Column | None = None,
    seed: int = 17,
    size: int = 1 << 28,
) -> pa.Table:
    """About `rows` labelled texts (all, if there are fewer), as (id, text, *columns), chosen by a hash of their
    id; of these, the first by that hash that together have at most `size` bytes.

    Repeated labels of an id count once, with the greatest value; rows without an id or with a null label
    are left out; repeated documents stay. `only` is a condition on the labels' id column.
    """
    known = labels.select(F.col(id_col).cast("bigint").alias("_key"), *[F.col(c).cast("int").alias(c) for c in columns])
    if only is not None:
        known = known.where(only)
    known = known.dropna().groupBy("_key").agg(*[F.max(c).alias(c) for c in columns])
    draw = F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(_SPACE))
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.where(draw < int(share * _SPACE))
    texts = docs.select(F.col(id_col).cast("bigint").alias("_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = staged(texts.join(F.broadcast(chosen), "_key"), "sample")  # as many as `rows` says
    sizes = sorted(found.select(draw.alias("d"), F.octet_length("text").alias("n")).collect())  # a number for each
    total, last = 0, _SPACE
    for d, n in sizes:
        total += n
        if total > size:
            last = d
            break
    return found.where(draw < last).select(F.col("_key").alias("id"), "text", *columns).toArrow().sort_by("id")
