"""A scan: snapshot diff, extraction of what changed, resolution of everything, and one commit."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import files as extraction
from weft.operators import resolve, search, store
from weft.sources import discover as discovery
from weft.sources.config import Config
from weft.sources.warehouse import Warehouse, facts_of

#: Rises when extraction changes, so that all files count as changed once.
FORMAT = "f1:"


@dataclass
class Summary:
    files_indexed: int = 0
    files_extracted: int = 0
    added: int = 0
    changed: int = 0
    deleted: int = 0
    unchanged: int = 0
    failed: int = 0
    entities: int = 0
    edges: int = 0
    ambiguous: int = 0

    def as_dict(self) -> dict:
        return asdict(self)


def meta(path: str, kind: str = "string"):
    return F.get_json_object("metadata", f"$.{path}").cast(kind)


def parsed(path: str, kind: str):
    return F.from_json(F.get_json_object("metadata", f"$.{path}"), kind)


def resolved(entities: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, notes) of all rules over stored entities and fact edges."""
    of = lambda *kinds: entities.where(F.col("kind").isin(*kinds))
    link = lambda kind: facts.where(F.col("kind") == kind).select("source", "target")
    types = of("class", "interface").select("id", "kind", "name", "file", meta("superclass").alias("superclass"), F.explode_outer(F.coalesce(parsed("implements", "array<string>"), F.array(F.lit(None).cast("string")))).alias("implements_name"))
    single = types.drop("implements_name").distinct()
    methods = of("method").join(link("declares"), F.col("id") == F.col("target")).select("id", F.col("source").alias("owner_id"), "name", "file", "seq", "metadata").distinct()
    owned = methods.join(single.select(F.col("id").alias("owner_id"), F.col("name").alias("owner_name"), F.col("kind").alias("owner_kind")), "owner_id")
    injected = of("class", "interface").select(F.col("id").alias("owner_id"), F.explode(parsed("injected_fields", "array<struct<name:string,type:string>>")).alias("f")).select("owner_id", F.col("f.name").alias("field_name"), F.col("f.type").alias("type_name"))
    beans = link("injects").join(of("spring_bean").select(F.col("id").alias("target"), F.col("name").alias("type_name")), "target").select(F.col("source").alias("owner_id"), "type_name")
    invokes = methods.select(F.col("id").alias("caller_id"), F.posexplode(parsed("invokes", "array<struct<name:string,line:int,receiver_kind:string,receiver:string>>")).alias("pos", "i")).select("caller_id", "pos", F.col("i.name").alias("callee_name"), "i.receiver_kind", "i.receiver")
    mappers = of("mapper").select("id", "name", "file", meta("entity_type").alias("entity_type"))
    bindings = link("depends_on").join(of("class").select(F.col("id").alias("source"), "seq"), "source").join(of("table").select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("class_id"), F.col("target").alias("table"), "seq")
    tables = resolve.class_table(single, bindings)
    statements = of("xml_statement").select(F.col("id").alias("statement_id"), "name", meta("namespace").alias("namespace")).where("namespace is not null")
    clients = of("http_client_call").select("id", meta("method").alias("method"), meta("path").alias("path"))
    endpoints = of("http_endpoint").select("id", meta("method").alias("method"), meta("path").alias("path"))
    fields = of("frontend_field", "api_field", "field", "sql_field", "column").select("id", "kind", "name", meta("origin").alias("origin"))
    advice = of("method").select("id", meta("pointcut").alias("pointcut")).where("pointcut is not null")
    found = resolve.merged([
        resolve.mapped_from(fields), resolve.mapper_table(mappers, tables), resolve.binds_statement(owned.where("owner_kind = 'interface'"), statements), resolve.calls(single, methods, injected, invokes, beans),
        resolve.implements(types), resolve.superclass(single), resolve.interface_dispatch(types, methods), resolve.mapper_method_table(owned, mappers, tables),
        resolve.http_matches(clients, endpoints), resolve.tests(single), resolve.intercepts(advice, methods.select("id", "name")),
    ])
    holders = [
        (types.where("implements_name is not null").select(F.col("id").alias("holder"), F.col("implements_name").alias("name")), "implements"),
        (single.where("superclass is not null").select(F.col("id").alias("holder"), F.col("superclass").alias("name")), "superclass"),
        (mappers.select(F.col("id").alias("holder"), F.col("entity_type").alias("name")), "mapper_table"),
        (single.where(F.col("name").endswith("Test") & (F.col("name") != "Test")).select(F.col("id").alias("holder"), F.regexp_replace("name", "Test$", "").alias("name")), "test_convention"),
        (owned.join(invokes.select(F.col("caller_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("holder"), F.col("owner_name").alias("name")), "call_resolution"),
    ]
    return found, resolve.union_all([resolve.notes(rows, single, kind) for rows, kind in holders])


def embedded(entities: DataFrame, edges: DataFrame, before: DataFrame) -> DataFrame:
    """Vectors of all entities, those of unchanged texts taken over."""
    from weft.functions import exprs

    names = edges.where("kind = 'annotated'").join(entities.select(F.col("id").alias("target"), "name"), "target").groupBy(F.col("source").alias("id")).agg(F.collect_set("name").alias("annotations"))
    texts = entities.join(names, "id", "left").select("id", exprs.embed_text("kind", "qualified_name", "name", F.col("annotations")).alias("text"))
    fresh = search.changed_embeddings(texts, before).select("id", search.hashed_embedding(F.col("text")).alias("embedding"), F.lit(64).alias("dim"), "text_hash")
    kept = before.join(texts.select("id", F.sha2("text", 256).alias("text_hash")), ["id", "text_hash"], "left_semi")
    return kept.select(*fresh.columns).unionByName(fresh)


def scan_files(spark: SparkSession, found: DataFrame, warehouse: Warehouse, config: Config | None = None) -> Summary:
    """Bring the warehouse up to date with a file table (path, kind, hash, content)."""
    config = config or Config()
    found = found.withColumn("hash", F.concat(F.lit(FORMAT), "hash")).persist()  # the tree is read once
    diff = store.scan_diff(found, warehouse.table("file_state").select("path", "hash")).persist()
    counts = store.scan_summary(diff).first().asDict()
    changed = diff.where("status in ('added', 'changed')").select("path")
    extracted = extraction.extract(found.join(changed, "path", "left_semi"), config.extraction()).persist()
    fine, failed = extracted.where("failed is null"), extracted.where("failed is not null").select("path")
    stale = diff.where("status in ('deleted', 'changed')").select(F.col("path").alias("file"))
    keep = lambda name: warehouse.table(name).join(stale, "file", "left_anti")
    entities = store.upsert(keep("entity").select(*warehouse.table("entity").columns), extraction.entities_of(fine), ["id"])
    edges = store.upsert(keep("edge").select(*warehouse.table("edge").columns), extraction.edges_of(fine), store.EDGE_KEY)
    state = found.join(failed, "path", "left_anti").select("path", "hash", F.unix_timestamp().alias("indexed_at"))
    entities, edges = entities.persist(), edges.persist()
    facts = facts_of(edges)
    links, notes = resolved(entities, facts)
    notes = notes.persist()
    warehouse.replace(
        entity=resolve.with_ambiguity(entities, notes), edge=edges, file=found, file_state=state, note=notes, resolved=resolve.with_evidence(links, entities),
        embedding=embedded(entities, facts, warehouse.embeddings()),
    )
    summary = Summary(**counts, failed=failed.count(), entities=warehouse.entities().count(), edges=warehouse.edges().count(), ambiguous=warehouse.table("note").count())
    for held in (notes, edges, entities, extracted, diff, found):
        held.unpersist()
    return summary


def scan(spark: SparkSession, root: str, warehouse: Warehouse, config: Config | None = None) -> Summary:
    return scan_files(spark, discovery.discover(spark, root, config), warehouse, config)
