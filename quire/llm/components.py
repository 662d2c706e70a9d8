"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._storage import looked_up, staged


def connected(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, root): each node that a link names, and the least node of its component.

    Links may repeat and point either way; a link from a node to itself names that node. Null ends are
    ignored; no links give no rows. Each round is written to the shared folder. Neighbours are combined before
    each shuffle, and a node with a large share of the links is looked up without one (looked_up), so no task
    holds all links of a hub. Raises if the links have not settled after so many rounds.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    known = staged(links, "links")
    alone = known.where("a = b")
    known = known.where("a <> b")
    mark = None
    for _ in range(rounds):
        now = known.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == mark or not now[0]:
            pairs = known.select("a", "b").unionByName(known.select(F.col("b").alias("a"), "b")).unionByName(alone)
            return pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        mark = now
        larger = staged(_large_star(known, now[0]), "links")
        known = staged(_small_star(larger, larger.count()), "links")
    raise RuntimeError("components did not settle")


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """The larger neighbours of each node are linked to its least neighbour."""
    ends = F.array(F.struct(F.col("a").alias("n"), F.col("b").alias("v")), F.struct(F.col("b").alias("n"), F.col("a").alias("v")))
    near = links.select(F.explode(ends).alias("x")).select("x.n", "x.v")
    least = staged(near.groupBy("n").agg(F.min("v").alias("m"), F.count("*").alias("weight")), "least")
    met = looked_up(near.where("v > n"), least, "n", "weight", 2 * total)
    return met.select(F.col("v").alias("a"), F.least("n", "m").alias("b")).distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """The smaller neighbours of each node, and the node, are linked to the least of them."""
    least = staged(links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("weight")), "least")
    met = looked_up(links, least, "a", "weight", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return met.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
