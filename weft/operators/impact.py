"""What a change reaches, and the hand-off document around one entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft import schema
from weft.functions import exprs
from weft.operators.search import exact_name
from weft.operators.traverse import distances


def default_depth(operation: str) -> int:
    if operation not in schema.CHANGE_OPERATIONS:
        raise ValueError(f"unknown operation: {operation}")
    return schema.DEFAULT_DEPTHS.get(operation, 1)


EVIDENCE_LIST = f"array<{schema.EVIDENCE}>"


def evidence_of(df: DataFrame) -> Column:
    """The rows' evidence; tables without any have none."""
    return F.coalesce("evidence", F.array().cast(EVIDENCE_LIST)) if "evidence" in df.columns else F.array().cast(EVIDENCE_LIST)


def anchor_of(evidence: Column) -> Column:
    """Where the first evidence stands, as JSON, or that it needs a review."""
    first = F.get(evidence, F.lit(0))
    return exprs.anchor(first["file"], first["start_line"], first["end_line"])


def candidates(entities: DataFrame, name: str, limit: int = schema.DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """The page of entities of that name: most visible plane first, then by qualified name and id."""
    found = exact_name(entities, name, schema.SEARCH_CAP)
    return found.orderBy(F.desc(exprs.plane_rank("kind")), "qualified_name", "id").offset(offset).limit(min(limit, schema.MAX_LIMIT))


def neighbourhood(page: DataFrame, entities: DataFrame, edges: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(seed, node) and (seed, confidence) of all edges passed: both directions at once, each seed by itself, with the bridge.

    The bridge: a frontend field's file, the smallest of those that reach it, goes on to what the file contains and matches.
    """
    seeds = page.select(F.col("id").alias("seed"), F.col("id").alias("node"))
    inbound, outbound = distances(seeds, edges, depth, False), distances(seeds, edges, depth, True)
    fields = page.where("kind = 'frontend_field'").select(F.col("id").alias("seed"))
    files = inbound.join(fields, "seed", "left_semi").join(entities.where("kind = 'file'").select(F.col("id").alias("node")), "node").groupBy("seed").agg(F.min("node").alias("node"))
    bridge = distances(files, edges, 2, True, schema.BRIDGE_KINDS)

    def passed(found: DataFrame, hops: int, key: str, kinds=()) -> DataFrame:
        kept = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
        return found.where(F.col("distance") < hops).join(kept, F.col("node") == F.col(key)).select("seed", "source", "target", "kind", "confidence", evidence_of(kept).alias("evidence"))

    nodes = inbound.union(outbound).union(bridge).select("seed", "node").distinct()
    used = passed(inbound, depth, "target").union(passed(outbound, depth, "source")).union(passed(bridge, 2, "source", schema.BRIDGE_KINDS))
    return nodes, used


def impact(entities: DataFrame, edges: DataFrame, name: str, operation: str, depth: int | None = None, limit: int = schema.DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """One finding for each candidate on the page: the ids on its path, the least confidence, plane, severity, evidence.

    Evidence is the candidate's own, then that of the edges passed, each once, in the order of file and line.
    """
    depth = default_depth(operation) if depth is None else schema.clamp_depth(depth)
    page = candidates(entities, name, limit, offset)
    nodes, used = neighbourhood(page, entities, edges, depth)
    path = nodes.join(entities.select(F.col("id").alias("node")), "node", "left_semi").groupBy("seed").agg(F.array_sort(F.collect_set("node")).alias("path"))
    least = used.groupBy("seed").agg(F.least(F.lit(1.0), F.min("confidence")).alias("confidence"), F.count("*").alias("edges_passed"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("passed"))
    found = page.join(path, page.id == path.seed, "left").drop("seed").join(least, page.id == least.seed, "left").drop("seed")
    return found.select(
        "id", "kind", "name", "qualified_name", exprs.plane("kind").alias("plane"), F.lit("review_required").alias("severity"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("path", F.array("id")).alias("path"), F.coalesce("edges_passed", F.lit(0)).alias("edges_passed"),
        F.concat(evidence_of(page), F.coalesce("passed", F.array().cast(EVIDENCE_LIST))).alias("evidence"),
    )


def open_questions(total: int, shown: int, kinds: list[str], indexed: bool = True) -> list[str]:
    out = []
    if not indexed:
        out.append("The index is empty; run a scan first.")
    if total >= schema.SEARCH_CAP:
        out.append("More entities share the name than are ranked; narrow the name.")
    if not shown:
        out.append("Nothing of that name is indexed.")
    if "frontend_field" in kinds and "field" not in kinds:
        out.append("A frontend field has no resolved backend field; its source may be external or dynamic.")
    return out


def relay(entities: DataFrame, edges: DataFrame, target_id: str, outbound: bool, depth: int = 1) -> DataFrame:
    """Edges around one entity for a hand-off document, with what stands at their other end."""
    spark = entities.sparkSession
    seeds = spark.createDataFrame([("", target_id)], "seed string, node string")
    found = distances(seeds, edges, schema.clamp_depth(depth, 1), outbound, schema.RELAY_KINDS)
    tail, head = ("source", "target") if outbound else ("target", "source")
    inner = found.where(F.col("distance") < depth).select("node")
    kept = edges.where(F.col("kind").isin(*schema.RELAY_KINDS)).join(inner, F.col(tail) == F.col("node"), "left_semi")
    peers = entities.select(F.col("id").alias(head), F.col("kind").alias("peer_kind"), F.col("qualified_name").alias("peer"), F.col("name").alias("peer_name"))
    joined = kept.join(peers, head, "left")
    return joined.select(
        "source", "target", "kind", exprs.relay_edge_type("kind", "peer_kind").alias("edge_type"), F.when(F.col("peer_kind").isNull(), "custom:needs-review").otherwise(exprs.relay_layer("peer_kind")).alias("layer"),
        F.coalesce("peer", F.lit("")).alias("peer"), F.coalesce("peer_name", F.lit("")).alias("peer_name"), "confidence", exprs.tentative("classification", "confidence").alias("tentative"),
        anchor_of(evidence_of(kept)).alias("anchor"), evidence_of(kept).alias("evidence"), (F.size(evidence_of(kept)) == 0).alias("needs_review"),
    )


def homonyms(entities: DataFrame, target_id: str, limit: int = 100) -> DataFrame:
    name = entities.where(F.col("id") == target_id).select("name")
    return entities.join(name, "name", "left_semi").where(F.col("id") != target_id).orderBy("id").limit(limit)
