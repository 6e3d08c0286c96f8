"""Keyed changes to tables, as relations; weft.sources.warehouse writes their results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE_KEY = ["source", "target", "kind"]


def last_wins(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key by seq. An aggregate, so rows are combined before they are shuffled."""
    held = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct("seq", *[c for c in held if c != "seq"])).alias("_last"))
    return best.select(*[F.col(k) if k in keys else F.col(f"_last.{k}").alias(k) for k in rows.columns])


def upsert(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the batch's rows put in place of those of the same key."""
    fresh = last_wins(batch, keys)
    return table.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def remove_entities(entities: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the entities (id) and the edges at them."""
    gone = ids.select("id").distinct()
    kept = edges
    for end in ("source", "target"):
        kept = kept.join(gone.withColumnRenamed("id", end), end, "left_anti").select(*edges.columns)
    return entities.join(gone, "id", "left_anti"), kept


def delete_files(entities: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without what the files (file) gave."""
    return remove_entities(entities.join(files, "file", "left_anti"), edges, entities.join(files, "file", "left_semi"))


def delete_subtree(entities: DataFrame, edges: DataFrame, file_id: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without a file, what it contains, and the edges at them."""
    spark = entities.sparkSession
    inside = edges.where((F.col("source") == file_id) & (F.col("kind") == "contains")).select(F.col("target").alias("id"))
    return remove_entities(entities, edges, inside.union(spark.createDataFrame([(file_id,)], "id string")))


def visible_edges(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Resolved edges, and the facts that none of them overrides."""
    return resolved.unionByName(facts.join(resolved.select(*EDGE_KEY), EDGE_KEY, "left_anti").select(*facts.columns))


def replace_resolved(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """The edge table (with resolved 0 or 1) after its resolved part was exchanged."""
    return visible_edges(edges.where("resolved = 0"), resolved.withColumn("resolved", F.lit(1)).select(*edges.columns))


def scan_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """(path, status) of two snapshots (path, hash)."""
    both = new.select("path", F.col("hash").alias("new_hash")).join(old.select("path", F.col("hash").alias("old_hash")), "path", "full_outer")
    status = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("new_hash") != F.col("old_hash"), "changed").otherwise("unchanged")
    return both.select("path", status.alias("status"))


def scan_summary(diff: DataFrame) -> DataFrame:
    count = lambda *s: F.count_if(F.col("status").isin(*s)).cast("long")
    return diff.agg(
        count("added", "changed", "unchanged").alias("files_indexed"), count("added", "changed").alias("files_extracted"), count("added").alias("added"),
        count("changed").alias("changed"), count("deleted").alias("deleted"), count("unchanged").alias("unchanged"),
    )
