"""Object-graph operators: revisions, references, inheritance, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_revisions(entries: DataFrame, keys: list[str], rank: str = "section_rank", keep_free: bool = False) -> DataFrame:
    """The entry of the newest section (least rank) for each object. A free entry hides older ones and is then
    dropped. One aggregation, combined before its shuffle."""
    rest = [c for c in entries.columns if c not in keys and c != rank]
    newest = entries.groupBy(*keys).agg(F.min_by(F.struct(rank, *rest), F.col(rank)).alias("e")).select(*keys, "e.*")
    return newest if keep_free else newest.where("kind <> 'free'")


def merge_hybrid(table: DataFrame, stream: DataFrame, keys: list[str], rank: str = "section_rank") -> DataFrame:
    """Entries of hybrid sections: within a section, one of its stream comes after one of its table, but
    before one that the table says is free. Then the newest section's entry."""
    both = table.withColumn("late", F.when(F.col("kind") == "free", 2).otherwise(0)).unionByName(stream.withColumn("late", F.lit(1)))
    rest = [c for c in table.columns if c not in keys and c != rank]
    found = both.groupBy(*keys).agg(F.min_by(F.struct(rank, *rest), F.struct(rank, "late")).alias("e")).select(*keys, "e.*")
    return found.where("kind <> 'free'")


def resolve(edges: DataFrame, objects: DataFrame, file: str = "file_id") -> DataFrame:
    """References with the objects they name: number and generation must be equal; others get nulls."""
    target = objects.select(F.col(file), F.col("obj_num").alias("dst_num"), F.col("gen").alias("dst_gen"), *[F.col(c).alias(f"dst_{c}") for c in objects.columns if c not in (file, "obj_num", "gen")])
    return edges.join(target, [file, "dst_num", "dst_gen"], "left")


def inherit(nodes: DataFrame, key: str, parent: str, value: str, owner: str = "owner", levels: int = 32) -> DataFrame:
    """Each node's value, its own or else that of its nearest ancestor, and who owns it (key, value, owner).

    One join a level, of the nodes that still lack a value; stops when none does, after `levels` levels, or
    on a cycle. A node whose ancestors have none gets null.
    """
    done = nodes.where(F.col(value).isNotNull()).select(key, F.col(value), F.col(key).alias(owner))
    todo = nodes.where(F.col(value).isNull()).select(F.col(key), F.col(parent).alias("_up"))
    up = nodes.select(F.col(key).alias("_up"), F.col(value).alias("_value"), F.col(parent).alias("_next"))
    for _ in range(levels):
        if not todo.limit(1).count():
            break
        met = todo.join(up, "_up", "left")
        done = done.unionByName(met.where("_value is not null").select(key, F.col("_value").alias(value), F.col("_up").alias(owner)))
        lost = met.where("_value is null and _next is null").select(key, F.col("_value").alias(value), F.lit(None).cast(done.schema[owner].dataType).alias(owner))
        done = done.unionByName(lost)
        todo = met.where("_value is null and _next is not null").select(key, F.col("_next").alias("_up"))
    return done.unionByName(todo.select(key, F.lit(None).cast(done.schema[value].dataType).alias(value), F.lit(None).cast(done.schema[owner].dataType).alias(owner)))


def latest_edits(edits: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The edit log's last value of each object, at the place of its first edit."""
    return edits.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.min(order).alias("first_edit"))


def overlay(base: DataFrame, edits: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Base rows with edited values put over them."""
    new = edits.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_edited"))
    return base.join(new, keys, "left").withColumn(value, F.when(F.col("_edited"), F.col("_new")).otherwise(F.col(value))).drop("_new", "_edited")


def dict_set(entries: Column, key: str, value: Column) -> Column:
    """A map with a key replaced or added."""
    return F.map_concat(F.map_filter(entries, lambda k, _: k != key), F.create_map(F.lit(key), value))


def remove_at(items: Column, index: int) -> Column:
    """An array without the element at a 0-based index."""
    return F.filter(items, lambda x, i: i != index)
