"""Bounded graph traversal as a chain of joins.

Each hop is one join of what was reached last with the edges, and one minimum per (seed, node), which is summed before its
shuffle. A hop carries all reached nodes on, so the plan has one leaf per hop and no action; the edges' exchange is the
same in every hop and is reused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.schema import EDGE_KINDS, check_kinds


def oriented(edges: DataFrame, outbound: bool, kinds=()) -> DataFrame:
    """(tail, head) of the edges of the kinds (all if none are given)."""
    kinds = check_kinds(kinds, EDGE_KINDS)
    kept = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    tail, head = ("source", "target") if outbound else ("target", "source")
    return kept.select(F.col(tail).alias("tail"), F.col(head).alias("head"))


def distances(seeds: DataFrame, edges: DataFrame, depth: int, outbound: bool = True, kinds=()) -> DataFrame:
    """(seed, node, distance) of all nodes within depth hops of the seeds (seed, node)."""
    links = oriented(edges, outbound, kinds)  # repeated edges meet in each hop's minimum
    reached = seeds.select("seed", "node", F.lit(0).alias("distance")).distinct()
    for hop in range(depth):
        step = reached.join(links, (F.col("node") == F.col("tail")) & (F.col("distance") == hop), "left")
        both = F.array(F.struct(F.col("node"), F.col("distance")), F.struct(F.col("head").alias("node"), F.lit(hop + 1).alias("distance")))
        step = step.select("seed", F.explode(both).alias("to")).select("seed", "to.node", "to.distance").where("node is not null")
        reached = step.groupBy("seed", "node").agg(F.min("distance").alias("distance"))
    return reached


def seeds_of(spark, ids: list[str]) -> DataFrame:
    """Every id as a seed of its own."""
    return spark.createDataFrame([(i, i) for i in ids], "seed string, node string")


def reached_entities(found: DataFrame, entities: DataFrame) -> DataFrame:
    """The entities among the nodes, with their distance from the nearest seed; nodes without an entity are left out."""
    nearest = found.groupBy("node").agg(F.min("distance").alias("distance"))
    return entities.join(nearest, entities.id == nearest.node).drop("node")


def passed_edges(found: DataFrame, edges: DataFrame, depth: int, outbound: bool = True, kinds=()) -> DataFrame:
    """The edges that leave a node nearer than depth, whatever they lead to."""
    kinds = check_kinds(kinds, EDGE_KINDS)
    kept = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    inner = found.where(F.col("distance") < depth).select(F.col("node").alias("tail")).distinct()
    return kept.join(inner, F.col("source" if outbound else "target") == F.col("tail"), "left_semi")


def traverse(entities: DataFrame, edges: DataFrame, starts: DataFrame, depth: int, outbound: bool = True, kinds=()) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) around the starts (column id), as one traversal from all of them."""
    seeds = starts.select(F.lit("").alias("seed"), F.col("id").alias("node"))
    found = distances(seeds, edges, depth, outbound, kinds)
    return reached_entities(found, entities), passed_edges(found, edges, depth, outbound, kinds)


def starts_by_name(entities: DataFrame, name: str) -> DataFrame:
    """Entities with that qualified name, or if there are none, with that name."""
    exact = entities.where(F.col("qualified_name") == name).select("id", F.lit(0).alias("way"))
    loose = entities.where(F.col("name") == name).select("id", F.lit(1).alias("way"))
    both = exact.union(loose)
    best = both.agg(F.min("way").alias("best"))
    return both.join(F.broadcast(best), F.col("way") == F.col("best")).select("id").distinct()  # best is one row


def trace(entities: DataFrame, edges: DataFrame, name: str, depth: int, kinds, outbound: bool, to_kind: str | None = None, min_confidence: float = 0.0, limit: int | None = None, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """Traversal from a name: reached entities of to_kind, edges of at least min_confidence, each ordered and paged."""
    reached, passed = traverse(entities, edges, starts_by_name(entities, name), depth, outbound, kinds)
    if to_kind is not None:
        reached = reached.where(F.col("kind") == to_kind)
    passed = passed.where(F.col("confidence") >= min_confidence)
    if limit is None:
        return reached, passed
    return reached.orderBy("qualified_name", "id").offset(offset).limit(limit), passed.orderBy("source", "target", "kind").offset(offset).limit(limit)


def adjacent(edges: DataFrame, node: Column | str, outbound: bool = True) -> DataFrame:
    return edges.where(F.col("source" if outbound else "target") == node)
