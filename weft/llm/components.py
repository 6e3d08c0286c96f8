"""Connected components of a link table by alternating large and small stars; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import drop_written, written

ROUNDS = 40


def _least(edges: DataFrame) -> DataFrame:
    """Smallest neighbour or self of every node; pre-aggregated before its shuffle, so a hub is no burden."""
    return edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))


def _mark(edges: DataFrame) -> tuple:
    """Count and checksums of a set of edges: two sets that agree in them are taken for equal."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in the links (a, b): root is the smallest id of its component."""
    edges = written(links.select("a", "b").where("a != b").distinct(), "links")
    before = _mark(edges)
    for _ in range(ROUNDS):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        small = large.join(_least(large), "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        after = written(small, "links")
        drop_written(edges)
        edges, last = after, before
        before = _mark(edges)
        if before == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
