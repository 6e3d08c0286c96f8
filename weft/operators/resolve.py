"""Cross-file relationships: one function for each rule, from plain relations to edges.

A name that several types share is ambiguous; rules that go by name then give no edge, and notes() says so. Every edge
has source, target, kind, classification, confidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import exprs

FULL, HALF_SURE, CALL, INJECTED, SUFFIX, EXACT, BOUND = 1.0, 0.7, 0.7, 0.5, 0.6, 0.95, 0.9
WILDCARD = 0.6
#: Key of an entity's metadata that holds its unresolved names; always the last one.
AMBIGUOUS = "ambiguous_resolution"


def edges(rows: DataFrame, source: Column | str, target: Column | str, kind: str, classification: str, confidence) -> DataFrame:
    """The rows as edges, each (source, target) once."""
    confidence = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return rows.select(exprs.col(source).alias("source"), exprs.col(target).alias("target"), F.lit(kind).alias("kind"), F.lit(classification).alias("classification"), confidence.alias("confidence")).distinct()


def owners(types: DataFrame) -> DataFrame:
    """(name, owners, id): how many types have the name, and the one if it is one."""
    return types.groupBy("name").agg(F.count("*").alias("owners"), F.min("id").alias("id"))


def unique_types(types: DataFrame) -> DataFrame:
    return owners(types).where("owners = 1").select("name", "id")


def notes(holders: DataFrame, types: DataFrame, kind: str) -> DataFrame:
    """For (holder, name) whose name is ambiguous: the sorted files of the candidates. The first of equal notes stays."""
    files = types.groupBy("name").agg(F.count("*").alias("owners"), F.array_sort(F.collect_set("file")).alias("candidates")).where("owners > 1").drop("owners")
    return holders.join(files, "name").select("holder", F.lit(kind).alias("kind"), "name", "candidates").dropDuplicates(["holder", "kind", "name"])


def mapped_from(fields: DataFrame) -> DataFrame:
    """Consecutive members of one name, in semantic order (frontend, api, field, sql, column); joins and filters are not fields."""
    order = Window.partitionBy("name").orderBy(exprs.semantic_rank("kind"), "id")
    kept = fields.where(F.coalesce("origin", F.lit("")) != "where_join")
    linked = kept.withColumn("next", F.lead("id").over(order)).where("next is not null")
    return edges(linked, "id", "next", "mapped_from", "resolved", BOUND)


def class_table(types: DataFrame, bindings: DataFrame) -> DataFrame:
    """(name, table): the table of each unambiguous class by its bindings (class_id, table, seq); the last one counts."""
    bound = bindings.groupBy("class_id").agg(F.max_by("table", F.struct("seq", "table")).alias("table"))
    return unique_types(types.where("kind = 'class'")).join(bound, F.col("id") == F.col("class_id")).select("name", "table")


def mapper_table(mappers: DataFrame, tables: DataFrame) -> DataFrame:
    """mappers (id, entity_type) to the table of their entity type."""
    return edges(mappers.drop("name").join(tables, F.col("entity_type") == F.col("name")), "id", "table", "depends_on", "resolved", BOUND)


def binds_statement(methods: DataFrame, statements: DataFrame) -> DataFrame:
    """Interface methods (id, name, file) to statements (statement_id, name, namespace) of their file's namespace and name.

    The file ends with the namespace as a path; that is asked of rows that already agree in name and file name.
    """
    wanted = statements.withColumn("suffix", F.concat(F.replace("namespace", F.lit("."), F.lit("/")), F.lit(".java")))
    wanted = wanted.withColumn("base", F.substring_index("suffix", "/", -1)).select("statement_id", F.col("name"), "suffix", "base")
    exact = methods.withColumn("base", F.substring_index("file", "/", -1)).join(wanted.where(F.contains("suffix", F.lit("/"))), ["name", "base"]).where(F.col("file").endswith(F.col("suffix")))
    bare = methods.join(wanted.where(~F.contains("suffix", F.lit("/"))).drop("base"), "name").where(F.col("file").endswith(F.col("suffix")))
    return edges(exact.select("id", "statement_id").union(bare.select("id", "statement_id")), "id", "statement_id", "binds_to_statement", "resolved", BOUND)


def method_targets(types: DataFrame, methods: DataFrame) -> DataFrame:
    """(type_name, method_name, target): the method that a name stands for in an unambiguous type; of overloads the last."""
    last = methods.groupBy("owner_id", F.col("name").alias("method_name")).agg(F.max_by("id", F.struct("seq", "id")).alias("target"))
    once = unique_types(types).select(F.col("name").alias("type_name"), F.col("id").alias("owner_id"))
    return once.join(last, "owner_id").select("type_name", "method_name", "target")


def calls(types: DataFrame, methods: DataFrame, injected: DataFrame, invokes: DataFrame, beans: DataFrame | None = None) -> DataFrame:
    """Cross-file calls: by the type of an injected field, by a named type, or by what the owner has injected at all.

    invokes (caller_id, pos, callee_name, receiver_kind, receiver), injected (owner_id, field_name, type_name); beans
    (owner_id, type_name) are the injected types, by default those of the fields. Of several ways the first counts.
    """
    targets = method_targets(types, methods)
    hit = lambda df, way, confidence: df.select("caller_id", "pos", "target", F.lit(way).alias("way"), F.lit(confidence).alias("confidence"))
    known = types.select(F.col("id").alias("owner_id"), "name").join(owners(types).where("owners = 1").select("name"), "name", "left_semi").select("owner_id")
    sure = invokes.join(methods.select(F.col("id").alias("caller_id"), "owner_id"), "caller_id").join(known, "owner_id", "left_semi").withColumnRenamed("callee_name", "method_name")
    field = injected.groupBy("owner_id", F.col("field_name").alias("receiver")).agg(F.max("type_name").alias("type_name"))
    by_field = hit(sure.where(F.col("receiver_kind").isin("field", "name")).join(field, ["owner_id", "receiver"]).join(targets, ["type_name", "method_name"]), 0, CALL)
    named = invokes.where("receiver_kind = 'name'").select("caller_id", "pos", F.col("receiver").alias("type_name"), F.col("callee_name").alias("method_name"))
    by_type = hit(named.join(targets, ["type_name", "method_name"]), 1, CALL)
    beans = (injected if beans is None else beans).select("owner_id", "type_name").distinct()
    any_bean = sure.join(beans, "owner_id").join(targets, ["type_name", "method_name"]).groupBy("caller_id", "pos").agg(F.count("*").alias("hits"), F.min("target").alias("target"))
    any_bean = hit(any_bean.where("hits = 1"), 2, INJECTED)
    every = by_field.union(by_type).union(any_bean).where("target != caller_id")
    best = every.groupBy("caller_id", "pos").agg(F.min(F.struct("way", "target", "confidence")).alias("best"))
    by_edge = best.groupBy("caller_id", F.col("best.target").alias("target")).agg(F.max_by("best.confidence", "pos").alias("confidence"))
    return edges(by_edge, "caller_id", "target", "calls", "inferred", F.col("confidence"))


def implements(types: DataFrame) -> DataFrame:
    """Classes (id, implements_name) with the unambiguous interface they name, both ways."""
    interfaces = unique_types(types.where("kind = 'interface'")).select(F.col("name").alias("implements_name"), F.col("id").alias("interface_id"))
    found = types.where("kind = 'class'").join(interfaces, "implements_name")
    return edges(found, "id", "interface_id", "depends_on", "fact", FULL).union(edges(found, "interface_id", "id", "implements", "fact", FULL))


def superclass(types: DataFrame) -> DataFrame:
    above = unique_types(types.where("kind = 'class'")).select(F.col("name").alias("superclass"), F.col("id").alias("super_id"))
    return edges(types.where("kind = 'class'").join(above, "superclass").where("super_id != id"), "super_id", "id", "superclass_of", "fact", FULL)


def interface_dispatch(types: DataFrame, methods: DataFrame) -> DataFrame:
    """A method of an interface to the method of that name in the one unambiguous class that implements it."""
    implementing = implements(types).where("kind = 'implements'").select(F.col("source").alias("interface_id"), F.col("target").alias("class_id"))
    once = unique_types(types.where("kind = 'class'")).select(F.col("id").alias("class_id"))
    above = methods.select(F.col("id").alias("from_id"), F.col("owner_id").alias("interface_id"), "name")
    last = methods.groupBy(F.col("owner_id").alias("class_id"), "name").agg(F.max_by("id", F.struct("seq", "id")).alias("to_id"))
    found = implementing.join(once, "class_id", "left_semi").join(above, "interface_id").join(last, ["class_id", "name"])
    single = found.groupBy("from_id").agg(F.count_distinct("class_id").alias("n"), F.min("to_id").alias("to_id")).where("n = 1 and from_id != to_id")
    return edges(single, "from_id", "to_id", "calls", "inferred", HALF_SURE)


def mapper_method_table(methods: DataFrame, mappers: DataFrame, tables: DataFrame) -> DataFrame:
    """Methods (id, owner_name, file) of a mapper's interface, in the mapper's file, to the table of its entity type."""
    found = methods.drop("name").join(mappers.select(F.col("name").alias("owner_name"), "file", "entity_type"), ["owner_name", "file"]).join(tables, F.col("entity_type") == F.col("name"))
    return edges(found, "id", "table", "reads_table", "inferred", HALF_SURE)


def http_matches(clients: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Client calls to endpoints: the path equal, or the endpoint's segments the last of the call with one to three before.

    The endpoints' side is what the call's own suffixes are joined with, so this is a hash join. An endpoint without a verb
    takes any, at less confidence.
    """
    parts = exprs.segments("path")
    call = clients.select(F.col("id").alias("call_id"), F.col("method").alias("call_method"), "path", parts.alias("segs"))
    suffix = F.transform(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda j: j < F.size("segs")), lambda j: F.struct(j.alias("more"), F.array_join(F.slice("segs", j + 1, F.size("segs") - j), "/").alias("key")))
    exact = call.select("call_id", "call_method", F.lit(0).alias("more"), F.col("path").alias("key"))
    aligned = call.select("call_id", "call_method", F.explode(suffix).alias("s")).select("call_id", "call_method", "s.more", "s.key")
    end = endpoints.select(F.col("id").alias("endpoint_id"), F.coalesce("method", F.lit("")).alias("endpoint_method"), "path", F.array_join(parts, "/").alias("joined"))
    same = exact.join(end.withColumnRenamed("path", "key"), "key")
    tail = aligned.join(end.where("joined != ''").withColumnRenamed("joined", "key"), "key")
    both = same.select("call_id", "endpoint_id", "call_method", "endpoint_method", "more").union(tail.select("call_id", "endpoint_id", "call_method", "endpoint_method", "more"))
    both = both.where("endpoint_method = '' or endpoint_method = call_method")
    base = F.when(F.col("more") == 0, EXACT).otherwise(SUFFIX)
    wild = F.col("endpoint_method") == ""
    kind = F.when((F.col("more") == 0) & ~wild, "resolved").otherwise("inferred")
    best = both.withColumns({"confidence": base * F.when(wild, WILDCARD).otherwise(1.0), "classification": kind}).groupBy("call_id", "endpoint_id").agg(F.max(F.struct("confidence", "classification")).alias("b"))
    return best.select(F.col("call_id").alias("source"), F.col("endpoint_id").alias("target"), F.lit("matches_endpoint").alias("kind"), "b.classification", "b.confidence")


def tests(types: DataFrame) -> DataFrame:
    """Classes named XTest to the unambiguous class X."""
    subject = unique_types(types.where("kind = 'class'")).select(F.col("name").alias("subject"), F.col("id").alias("subject_id"))
    testing = types.where("kind = 'class'").where(F.col("name").endswith("Test") & (F.col("name") != "Test")).withColumn("subject", F.regexp_replace("name", "Test$", ""))
    return edges(testing.join(subject, "subject"), "id", "subject_id", "tests", "inferred", HALF_SURE)


def intercepts(advice: DataFrame, methods: DataFrame) -> DataFrame:
    """Advice (id, pointcut) to the only method whose name is the pointcut's last part."""
    single = methods.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("method_id")).where("n = 1")
    found = advice.withColumn("name", F.substring_index("pointcut", ".", -1)).join(single, "name").where("method_id != id")
    return edges(found, "id", "method_id", "intercepts", "inferred", INJECTED)


def same_file_calls(methods: DataFrame, invokes: DataFrame) -> DataFrame:
    """Calls inside one file where the caller's and the callee's names are unique in it."""
    unique = methods.groupBy("file", "name").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    caller = unique.select("file", F.col("name").alias("caller_name"), F.col("id").alias("caller_id"))
    callee = unique.select("file", F.col("name").alias("callee_name"), F.col("id").alias("callee_id"))
    found = invokes.join(caller, ["file", "caller_name"]).join(callee, ["file", "callee_name"]).where("caller_id != callee_id")
    return edges(found, "caller_id", "callee_id", "calls", "inferred", HALF_SURE)


def with_evidence(found: DataFrame, entities: DataFrame) -> DataFrame:
    """The edges with their evidence: the rule, and where the entity stands that the edge leaves."""
    first = F.get("evidence", F.lit(0))
    places = entities.select(F.col("id").alias("source"), F.coalesce(first["file"], F.col("file")).alias("_file"), first["start_line"].alias("_start"), first["end_line"].alias("_end"), first["snippet"].alias("_snippet"))
    made = F.struct(
        F.col("_file").alias("file"), F.coalesce("_start", F.lit(0)).cast("int").alias("start_line"), F.coalesce("_end", "_start", F.lit(0)).cast("int").alias("end_line"), "classification",
        F.col("confidence").cast("float").alias("confidence"), F.concat(F.lit("resolved across files: "), "kind").alias("reason"), F.col("_snippet").alias("snippet"),
    )
    return found.join(places, "source", "left").withColumn("evidence", F.array(made)).select(*found.columns, "evidence")


def ambiguity(notes: DataFrame) -> DataFrame:
    """(id, ambiguous): what could not be resolved for each holder, as a JSON list."""
    listed = F.array_sort(F.collect_list(F.struct("kind", "name", "candidates")))
    return notes.groupBy(F.col("holder").alias("id")).agg(F.to_json(listed).alias("ambiguous"))


def with_ambiguity(entities: DataFrame, notes: DataFrame) -> DataFrame:
    """The entities whose metadata say under AMBIGUOUS what could not be resolved; what an earlier scan said goes."""
    bare = F.regexp_replace(F.coalesce("metadata", F.lit("{}")), f',?"{AMBIGUOUS}":\\[.*\\]\\}}$', "}")
    head = F.regexp_replace(bare, r"\}\s*$", "")
    added = F.concat(head, F.when(head.rlike(r"\{\s*$"), "").otherwise(","), F.lit(f'"{AMBIGUOUS}":'), F.col("ambiguous"), F.lit("}"))
    found = entities.join(ambiguity(notes), "id", "left")
    return found.withColumn("metadata", F.when(F.col("ambiguous").isNull(), F.when(F.col("metadata").isNotNull(), bare)).otherwise(added)).select(*entities.columns)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def merged(parts: list[DataFrame]) -> DataFrame:
    """All rules' edges, one for each (source, target, kind): the surest."""
    every = union_all(parts)
    best = every.groupBy("source", "target", "kind").agg(F.max(F.struct("confidence", "classification")).alias("b"))
    return best.select("source", "target", "kind", "b.classification", "b.confidence")
