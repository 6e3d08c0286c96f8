"""Queries over the projected graph and the synthesised sources, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import schema
from weft.functions import exprs
from weft.operators import extract, files, impact, resolve, search, sql_text, store, traverse
from weft.plans.views import load, with_views
from weft.sources import config as settings
from weft.sources import discover

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
PG = ("pg_entity", "pg_edge")


def query(name: str, views: tuple[str, ...], sql: str | None, recursive: str = ""):
    """Register f(*frames of the views) under a name, with its checking SQL over the same views."""

    def add(f):
        _queries[name] = lambda spark, sf_dir: f(*load(spark, sf_dir, *views))
        _queries[name].__name__ = name
        if sql is not None:
            _oracles[name] = with_views(views, sql, recursive)
        return f

    return add


def quoted(kinds) -> str:
    return ", ".join(f"'{k}'" for k in kinds)


def ranked(column: str, order, otherwise: int) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {i}" for i, k in enumerate(order)) + f" ELSE {otherwise} END"


def grouped(column: str, table: dict, otherwise) -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {column} IN ({quoted(kinds)}) THEN {text(v)}" for v, kinds in table.items()) + f" ELSE {text(otherwise)} END"


# counts and views
query("counts", PG, "SELECT (SELECT count(*) FROM pg_entity) AS entity_count, (SELECT count(*) FROM pg_edge) AS edge_count")(search.counts)
query("counts_by_kind", PG, "SELECT kind, count(*) AS n FROM pg_entity GROUP BY kind")(lambda e, _: search.counts_by_kind(e))
for _view, _kinds in (("api", schema.API_VIEW_KINDS), ("data", schema.DATA_VIEW_KINDS)):
    query(f"system_view_{_view}", ("pg_entity",), f"SELECT kind, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS plane_total FROM pg_entity WHERE kind IN ({quoted(_kinds)}) GROUP BY kind")(
        lambda e, v=_view: search.system_view(e, v)
    )
query("system_view_all", ("pg_entity",), "SELECT kind, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS plane_total FROM pg_entity GROUP BY kind")(lambda e: search.system_view(e, "repositories"))
query("list_repositories", ("documents",), "SELECT source AS repository, count(*) AS n FROM documents GROUP BY source")(lambda d: search.list_repositories(d.select(F.col("source").alias("repository"))))
query("any_entities", ("pg_entity",), "SELECT count(*) > 0 AS found FROM pg_entity")(lambda e: e.limit(1).agg((F.count("*") > 0).alias("found")))

# search
COLUMNS = ("id", "kind", "name", "qualified_name")


def search_sql(words: list[str], limit: int, offset: int = 0, kinds=()) -> str:
    text = " ".join(words) if len(words) > 1 else words[0]
    match = " OR ".join(f"contains(lower({c}), '{w.lower()}')" for w in words for c in ("name", "qualified_name"))
    kept = f" AND kind IN ({quoted(kinds)})" if kinds else ""
    return f"SELECT {', '.join(COLUMNS)}, CAST(1.0 AS DOUBLE) AS score FROM pg_entity WHERE ({match}){kept} ORDER BY CASE WHEN lower(name) = '{text.lower()}' THEN 0 ELSE 1 END, {ranked('kind', schema.SEARCH_PRIORITY, 9)}, name, id LIMIT {limit} OFFSET {offset}"


for _name, _words, _limit, _offset, _some in (
    ("search_single", ["nation_1"], 50, 0, ()), ("search_multiword", ["nation_2", "widget"], 50, 0, ()), ("search_short", ["bo"], 50, 0, ()), ("search_wildcard_chars", ["r_1"], 50, 0, ()),
    ("search_page2", ["order"], 20, 40, ()), ("search_kind_filter", ["a"], 30, 0, ("class", "package")), ("find_endpoint", ["e"], 50, 0, schema.ENDPOINT_KINDS),
):
    query(_name, ("pg_entity",), search_sql(_words, _limit, _offset, _some))(lambda e, w=_words, n=_limit, o=_offset, k=_some: search.search(e, " ".join(w), n, o, k).select(*COLUMNS, "score"))
query("exact_name", ("pg_entity",), "SELECT id, kind, name, qualified_name FROM pg_entity WHERE name = 'NATION_3'")(lambda e: search.exact_name(e, "NATION_3").select(*COLUMNS))
query("get_entity", ("pg_entity",), "SELECT id, kind, name, qualified_name FROM pg_entity WHERE id = 'c:7'")(lambda e: e.where("id = 'c:7'").select(*COLUMNS))
query("search_trigram", ("pg_entity",), "SELECT id, kind, name, qualified_name FROM pg_entity WHERE contains(lower(name), 'widg') OR contains(lower(qualified_name), 'widg')")(
    lambda e: search.search_by_index(e, search.trigram_index(e), "widg").select(*COLUMNS)
)

# traversal


def walk_sql(starts: str, depth: int, outbound: bool, kinds=()) -> str:
    tail, head = ("source", "target") if outbound else ("target", "source")
    kept = f" AND e.kind IN ({quoted(kinds)})" if kinds else ""
    return f"walk AS ({starts} UNION SELECT walk.seed, e.{head}, walk.d + 1 FROM walk JOIN pg_edge e ON e.{tail} = walk.node WHERE walk.d < {depth}{kept}), dist AS (SELECT seed, node, min(d) AS d FROM walk GROUP BY seed, node)"


def one(start: str) -> str:
    return f"SELECT '' AS seed, '{start}' AS node, 0 AS d"


NODES = "SELECT p.id, p.kind, CAST(min(dist.d) AS BIGINT) AS distance FROM dist JOIN pg_entity p ON p.id = dist.node GROUP BY p.id, p.kind"
EDGE_COLUMNS = ("source", "target", "kind")


def edges_sql(depth: int, outbound: bool, kinds=(), least: float = 0.0) -> str:
    kept = f" AND kind IN ({quoted(kinds)})" if kinds else ""
    return f"SELECT source, target, kind FROM pg_edge WHERE {'source' if outbound else 'target'} IN (SELECT node FROM dist WHERE d < {depth}){kept} AND confidence >= {least}"


def reached(e: DataFrame) -> DataFrame:
    return e.select("id", "kind", F.col("distance").cast("long").alias("distance"))


def from_one(start: str, depth: int, outbound: bool, kinds=()):
    return lambda e, g: traverse.traverse(e, g, e.sparkSession.createDataFrame([(start,)], "id string"), depth, outbound, kinds)


for _name, _start, _depth, _out, _some in (
    ("traverse_out_d1", "n:3", 1, True, ()), ("traverse_out_d2", "n:3", 2, True, ()), ("traverse_out_d3", "n:3", 3, True, ()), ("traverse_in_d2", "p:5", 2, False, ()),
    ("traverse_kinds", "c:1", 3, True, ("calls", "binds_to_statement")), ("traverse_cycle", "c:1", 6, True, ("calls",)), ("traverse_depth0", "c:1", 0, True, ()),
):
    query(_name, PG, NODES, walk_sql(one(_start), _depth, _out, _some))(lambda e, g, f=from_one(_start, _depth, _out, _some): reached(f(e, g)[0]))
query("traverse_edges", PG, edges_sql(3, True), walk_sql(one("n:3"), 3, True))(lambda e, g: from_one("n:3", 3, True)(e, g)[1].select(*EDGE_COLUMNS))
query("adjacent", PG, "SELECT source, target, kind FROM pg_edge WHERE source = 'c:1'")(lambda e, g: traverse.adjacent(g, "c:1").select(*EDGE_COLUMNS))


def named(name: str) -> str:
    return f"SELECT '' AS seed, id AS node, 0 AS d FROM pg_entity WHERE qualified_name = '{name}' OR (name = '{name}' AND NOT EXISTS (SELECT 1 FROM pg_entity q WHERE q.qualified_name = '{name}'))"


for _name, _of, _depth, _some, _out, _to in (
    ("trace_callers", "Customer#000000008", 2, schema.TRACE_KINDS, False, None), ("trace_callees", "NATION_3", 2, schema.TRACE_KINDS, True, None),
    ("trace_table_access_read", "order_7", 2, (*schema.TABLE_ACCESS_KINDS, "reads_table"), False, None), ("trace_table_access_write", "order_7", 2, (*schema.TABLE_ACCESS_KINDS, "writes_table"), False, None),
    ("trace_table_access_both", "order_7", 2, (*schema.TABLE_ACCESS_KINDS, "reads_table", "writes_table"), False, None), ("trace_full_path", "NATION_3", 4, schema.FULL_PATH_KINDS, True, "table"),
):
    query(_name, PG, NODES + (f" HAVING p.kind = '{_to}'" if _to else ""), walk_sql(named(_of), _depth, _out, _some))(
        lambda e, g, n=_of, d=_depth, k=_some, o=_out, t=_to: reached(traverse.trace(e, g, n, d, k, o, t)[0])
    )
_homonym = "SELECT '' AS seed, id AS node, 0 AS d FROM pg_entity WHERE name = (SELECT min(name) FROM pg_entity WHERE kind = 'table')"
query("trace_homonym", PG, NODES, walk_sql(_homonym, 2, False, schema.FULL_PATH_KINDS))(
    lambda e, g: reached(traverse.traverse(e, g, e.join(e.where("kind = 'table'").agg(F.min("name").alias("name")), "name", "left_semi"), 2, False, schema.FULL_PATH_KINDS)[0])
)
query("trace_min_confidence", PG, edges_sql(3, True, schema.FULL_PATH_KINDS, 0.8), walk_sql(named("NATION_3"), 3, True, schema.FULL_PATH_KINDS))(
    lambda e, g: traverse.trace(e, g, "NATION_3", 3, schema.FULL_PATH_KINDS, True, min_confidence=0.8)[1].select(*EDGE_COLUMNS)
)
query("trace_page", PG, f"SELECT id, kind, distance FROM (SELECT p.id, p.kind, p.qualified_name, CAST(min(dist.d) AS BIGINT) AS distance FROM dist JOIN pg_entity p ON p.id = dist.node GROUP BY ALL) ORDER BY qualified_name, id LIMIT 25 OFFSET 10", walk_sql(named("NATION_3"), 3, True, schema.FULL_PATH_KINDS))(
    lambda e, g: reached(traverse.trace(e, g, "NATION_3", 3, schema.FULL_PATH_KINDS, True, limit=25, offset=10)[0])
)
query("edge_view_tentative", ("pg_edge",), "SELECT source, target, kind, confidence, CASE WHEN classification = 'fact' THEN false WHEN classification = 'resolved' THEN confidence < 0.8 ELSE true END AS tentative FROM pg_edge")(
    lambda g: g.select("source", "target", "kind", "confidence", exprs.tentative("classification", "confidence").alias("tentative"))
)

# impact
_part = "(SELECT min(name) FROM pg_entity WHERE kind IN ('field', 'table'))"


def impact_sql(depth: int, limit: int = 100, offset: int = 0) -> tuple[str, str]:
    page = f"page AS MATERIALIZED (SELECT * FROM (SELECT * FROM pg_entity WHERE name = {_part} ORDER BY id LIMIT {schema.SEARCH_CAP}) ORDER BY {grouped('kind', schema.PLANE_RANKS, 0)} DESC, qualified_name, id LIMIT {limit} OFFSET {offset})"
    walks = []
    for way, (tail, head) in (("o", ("source", "target")), ("i", ("target", "source"))):
        walks.append(f"w{way} AS (SELECT id AS seed, id AS node, 0 AS d FROM page UNION SELECT w{way}.seed, e.{head}, w{way}.d + 1 FROM w{way} JOIN pg_edge e ON e.{tail} = w{way}.node WHERE w{way}.d < {depth}), d{way} AS (SELECT seed, node, min(d) AS d FROM w{way} GROUP BY seed, node)")
    used = f"used AS (SELECT seed, confidence FROM do JOIN pg_edge ON source = node WHERE d < {depth} UNION ALL SELECT seed, confidence FROM di JOIN pg_edge ON target = node WHERE d < {depth})".replace(" do ", " do_ ")
    nodes = "nodes AS (SELECT seed, node FROM do_ UNION SELECT seed, node FROM di)"
    recursive = ", ".join([page, *walks]).replace("do AS (", "do_ AS (") + ", " + nodes + ", " + used
    body = f"""SELECT p.id, p.kind, {grouped('p.kind', schema.PLANES, 'code')} AS plane, 'review_required' AS severity,
        coalesce((SELECT round(least(1.0, min(confidence)), 4) FROM used WHERE seed = p.id), 1.0) AS confidence, (SELECT count(*) FROM used WHERE seed = p.id) AS edges_passed,
        (SELECT string_agg(node, ',' ORDER BY node) FROM nodes JOIN pg_entity ON pg_entity.id = node WHERE seed = p.id) AS path FROM page p"""
    return body, recursive


def impact_rows(operation: str, limit: int = 100, offset: int = 0):
    def run(e: DataFrame, g: DataFrame) -> DataFrame:
        name = e.where("kind in ('field', 'table')").agg(F.min("name")).first()[0]
        found = impact.impact(e, g, name, operation, None, limit, offset)
        return found.select("id", "kind", "plane", "severity", F.round("confidence", 4).alias("confidence"), F.col("edges_passed").cast("long").alias("edges_passed"), F.array_join("path", ",").alias("path"))

    return run


for _name, _operation, _limit, _offset in (("impact_rename", "rename", 100, 0), ("impact_remove", "remove", 100, 0), ("impact_page", "remove", 2, 1)):
    _body, _walk = impact_sql(impact.default_depth(_operation), _limit, _offset)
    query(_name, PG, _body, _walk)(impact_rows(_operation, _limit, _offset))

query("impact_bridge", ("syn_page_entity", "syn_page_edge"), """SELECT p.id, p.kind, 'frontend' AS plane, 'review_required' AS severity, CAST(0.6 AS DOUBLE) AS confidence, (SELECT count(*) FROM syn_page_edge e WHERE e.source = f.source) + 2 AS edges_passed,
 (SELECT string_agg(node, ',' ORDER BY node) FROM (SELECT f.source AS node UNION SELECT a.target FROM syn_page_edge a WHERE a.source = f.source UNION SELECT b.target FROM syn_page_edge a JOIN syn_page_edge b ON b.source = a.target WHERE a.source = f.source)) AS path
 FROM (SELECT * FROM syn_page_entity WHERE name = 'name3' ORDER BY qualified_name, id LIMIT 100) p JOIN syn_page_edge f ON f.target = p.id""")(
    lambda e, g: impact.impact(e, g, "name3", "remove").select("id", "kind", "plane", "severity", F.round("confidence", 4).alias("confidence"), F.col("edges_passed").cast("long").alias("edges_passed"), F.array_join("path", ",").alias("path"))
)

# relay
_layer = f"CASE WHEN t.kind IS NULL THEN 'custom:needs-review' ELSE {grouped('t.kind', schema.RELAY_LAYERS, 'infra')} END"
_type = """CASE WHEN e.kind IN ('reads_table', 'reads_column', 'binds_to_statement') THEN 'db_read' WHEN e.kind IN ('writes_table', 'writes_column') THEN 'db_write'
 WHEN e.kind IN ('matches_endpoint', 'sends_http_request') OR (e.kind = 'exposes' AND t.kind = 'http_endpoint') THEN 'http_out' WHEN e.kind = 'mapped_from' THEN 'field_propagate' WHEN e.kind = 'calls' THEN 'call'
 WHEN e.kind = 'declares' THEN 'declares' WHEN e.kind = 'exposes' AND t.kind = 'spring_bean' THEN 'exposes' WHEN e.kind = 'injects' THEN 'inject'
 WHEN e.kind = 'depends_on' AND t.kind IN ('table', 'column', 'database') THEN 'db_read' ELSE 'custom:needs-review' END"""
for _name, _start, _out in (("relay_outbound", "c:1", True), ("relay_inbound", "p:5", False)):
    _tail, _head = ("source", "target") if _out else ("target", "source")
    query(_name, PG, f"SELECT e.source, e.target, {_type} AS edge_type, {_layer} AS layer, coalesce(t.qualified_name, '') AS peer FROM pg_edge e LEFT JOIN pg_entity t ON t.id = e.{_head} WHERE e.kind IN ({quoted(schema.RELAY_KINDS)}) AND e.{_tail} IN (SELECT node FROM dist WHERE d < 2)", walk_sql(one(_start), 2, _out, schema.RELAY_KINDS))(
        lambda e, g, s=_start, o=_out: impact.relay(e, g, s, o, 2).select("source", "target", "edge_type", "layer", "peer")
    )
query("relay_homonyms", ("pg_entity",), "SELECT id, kind FROM pg_entity WHERE name = (SELECT name FROM pg_entity WHERE id = 'p:5') AND id <> 'p:5' ORDER BY id LIMIT 100")(lambda e: impact.homonyms(e, "p:5").select("id", "kind"))

# resolution
TYPES, METHODS = "syn_type", "syn_method"
_uniq = "uniq AS (SELECT name, min(id) AS id FROM syn_type GROUP BY name HAVING count(*) = 1)"
_uclass = "uclass AS (SELECT name, min(id) AS id FROM syn_type WHERE kind = 'class' GROUP BY name HAVING count(*) = 1)"
_uiface = "uiface AS (SELECT name, min(id) AS id FROM syn_type WHERE kind = 'interface' GROUP BY name HAVING count(*) = 1)"
OUT = ("source", "target", "kind", "confidence")


def with_more(views: tuple[str, ...], body: str, *more: str) -> dict:
    return {"views": views, "sql": body, "recursive": ", ".join(more)}


def out(df: DataFrame) -> DataFrame:
    return df.select("source", "target", "kind", F.round("confidence", 4).alias("confidence"))


query("superclass_edges", (TYPES,), "SELECT DISTINCT u.id AS source, t.id AS target, 'superclass_of' AS kind, CAST(1.0 AS DOUBLE) AS confidence FROM syn_type t JOIN uclass u ON t.superclass = u.name WHERE t.kind = 'class' AND u.id <> t.id", _uclass)(lambda t: out(resolve.superclass(t)))
query("implements_edges", (TYPES,), "SELECT t.id AS source, u.id AS target, 'depends_on' AS kind, CAST(1.0 AS DOUBLE) AS confidence FROM syn_type t JOIN uiface u ON t.implements_name = u.name WHERE t.kind = 'class' UNION ALL SELECT u.id, t.id, 'implements', CAST(1.0 AS DOUBLE) FROM syn_type t JOIN uiface u ON t.implements_name = u.name WHERE t.kind = 'class'", _uiface)(lambda t: out(resolve.implements(t)))
query("iface_dispatch", (TYPES, METHODS), """SELECT from_id AS source, min(to_id) AS target, 'calls' AS kind, CAST(0.7 AS DOUBLE) AS confidence FROM
 (SELECT a.id AS from_id, b.owner_id AS class_id, max_by(b.id, b.seq) AS to_id FROM syn_type t JOIN uiface i ON t.implements_name = i.name JOIN uclass c ON c.id = t.id JOIN syn_method a ON a.owner_id = i.id JOIN syn_method b ON b.owner_id = t.id AND b.name = a.name WHERE t.kind = 'class' GROUP BY a.id, b.owner_id)
 GROUP BY from_id HAVING count(*) = 1""", f"{_uiface}, {_uclass}")(lambda t, m: out(resolve.interface_dispatch(t, m)))
query("tests_edges", (TYPES,), "SELECT DISTINCT t.id AS source, u.id AS target, 'tests' AS kind, CAST(0.7 AS DOUBLE) AS confidence FROM syn_type t JOIN uclass u ON regexp_replace(t.name, 'Test$', '') = u.name WHERE t.kind = 'class' AND t.name LIKE '%Test'", _uclass)(lambda t: out(resolve.tests(t)))
query("ambiguous_names", (TYPES,), "SELECT name, count(*) AS owners FROM syn_type GROUP BY name HAVING count(*) > 1")(lambda t: resolve.owners(t).where("owners > 1").select("name", "owners"))
query("ambiguity_notes", (TYPES,), "SELECT t.id AS holder, 'superclass' AS kind, t.superclass AS name, c.files AS candidates FROM syn_type t JOIN (SELECT name, string_agg(DISTINCT file, ',' ORDER BY file) AS files FROM syn_type GROUP BY name HAVING count(*) > 1) c ON c.name = t.superclass")(
    lambda t: resolve.notes(t.where("superclass is not null").select(F.col("id").alias("holder"), F.col("superclass").alias("name")), t, "superclass").withColumn("candidates", F.array_join("candidates", ","))
)
query("ambiguity_writeback", (TYPES,), "SELECT t.id AS holder, count(*) AS notes FROM syn_type t JOIN (SELECT name FROM syn_type GROUP BY name HAVING count(*) > 1) c ON c.name IN (t.superclass, t.implements_name) GROUP BY t.id")(
    lambda t: resolve.notes(t.select(F.col("id").alias("holder"), F.explode(F.array_distinct(F.array_compact(F.array("superclass", "implements_name")))).alias("name")), t, "type").groupBy("holder").agg(F.count("*").alias("notes"))
)
query("method_owner", (TYPES, METHODS), "SELECT t.name AS type_name, m.name AS method_name, max_by(m.id, m.seq) AS target FROM uniq t JOIN syn_method m ON m.owner_id = t.id GROUP BY t.name, m.name", _uniq)(resolve.method_targets)
_targets = "target AS (SELECT t.name AS type_name, m.name AS method_name, max_by(m.id, m.seq) AS target FROM uniq t JOIN syn_method m ON m.owner_id = t.id GROUP BY t.name, m.name)"
_calls = f"""{_uniq}, {_targets}, sure AS (SELECT i.*, m.owner_id FROM syn_invoke i JOIN syn_method m ON m.id = i.caller_id JOIN uniq u ON u.id = m.owner_id),
 field AS (SELECT owner_id, field_name, max(type_name) AS type_name FROM syn_injected GROUP BY ALL),
 w0 AS (SELECT s.caller_id, s.pos, t.target, 0 AS way, 0.7 AS confidence FROM sure s JOIN field f ON f.owner_id = s.owner_id AND f.field_name = s.receiver JOIN target t ON t.type_name = f.type_name AND t.method_name = s.callee_name WHERE s.receiver_kind IN ('field', 'name')),
 w1 AS (SELECT i.caller_id, i.pos, t.target, 1 AS way, 0.7 AS confidence FROM syn_invoke i JOIN target t ON t.type_name = i.receiver AND t.method_name = i.callee_name WHERE i.receiver_kind = 'name'),
 w2 AS (SELECT s.caller_id, s.pos, min(t.target) AS target, 2 AS way, 0.5 AS confidence FROM sure s JOIN (SELECT DISTINCT owner_id, type_name FROM syn_injected) b ON b.owner_id = s.owner_id JOIN target t ON t.type_name = b.type_name AND t.method_name = s.callee_name GROUP BY s.caller_id, s.pos HAVING count(*) = 1),
 every AS (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2),
 best AS (SELECT caller_id, pos, arg_min(target, (way, target)) AS target, arg_min(confidence, (way, target)) AS confidence FROM every WHERE target <> caller_id GROUP BY caller_id, pos)"""
query("calls_priority", (TYPES, METHODS, "syn_injected", "syn_invoke"), "SELECT caller_id AS source, target, 'calls' AS kind, CAST(max_by(confidence, pos) AS DOUBLE) AS confidence FROM best GROUP BY caller_id, target", _calls)(lambda t, m, j, i: out(resolve.calls(t, m, j, i)))
query("owner_injected", ("syn_injected",), "SELECT owner_id, string_agg(DISTINCT type_name, ',' ORDER BY type_name) AS types FROM syn_injected GROUP BY owner_id")(lambda j: j.groupBy("owner_id").agg(F.array_join(F.array_sort(F.collect_set("type_name")), ",").alias("types")))


def _bindings(t: DataFrame) -> DataFrame:
    return t.where("kind = 'class'").select(F.col("id").alias("class_id"), F.concat(F.lit("tab"), F.length("name")).alias("table"), F.length("file").alias("seq"))


def _mappers(t: DataFrame) -> DataFrame:
    return t.where("kind = 'interface'").select("id", "name", "file", F.concat(F.lit("T"), F.substr("id", F.lit(4)).cast("int") + 1).alias("entity_type"))


_class_table = f"{_uclass}, class_table AS (SELECT u.name, concat('tab', length(u.name)) AS tab FROM uclass u)"
query("class_table", (TYPES,), "SELECT name, tab AS \"table\" FROM class_table", _class_table)(lambda t: resolve.class_table(t, _bindings(t)))
query("mapper_table", (TYPES,), "SELECT DISTINCT m.id AS source, c.tab AS target, 'depends_on' AS kind, CAST(0.9 AS DOUBLE) AS confidence FROM syn_type m JOIN class_table c ON c.name = concat('T', CAST(substr(m.id, 4) AS INT) + 1) WHERE m.kind = 'interface'", _class_table)(lambda t: out(resolve.mapper_table(_mappers(t), resolve.class_table(t, _bindings(t)))))
query("mapper_method_table", (TYPES, METHODS), "SELECT DISTINCT me.id AS source, c.tab AS target, 'reads_table' AS kind, CAST(0.7 AS DOUBLE) AS confidence FROM syn_method me JOIN syn_type m ON m.id = me.owner_id JOIN class_table c ON c.name = concat('T', CAST(substr(m.id, 4) AS INT) + 1) WHERE m.kind = 'interface'", _class_table)(
    lambda t, m: out(resolve.mapper_method_table(m.join(t.select(F.col("id").alias("owner_id"), F.col("name").alias("owner_name"), "file"), "owner_id"), _mappers(t), resolve.class_table(t, _bindings(t))))
)
query("binds_statement", (TYPES, METHODS), """SELECT DISTINCT m.id AS source, concat(t2.id, '/', m2.name) AS target, 'binds_to_statement' AS kind, CAST(0.9 AS DOUBLE) AS confidence FROM syn_method m JOIN syn_type t ON t.id = m.owner_id
 JOIN (SELECT DISTINCT owner_id, name FROM syn_method) m2 ON m2.name = m.name JOIN syn_type t2 ON t2.id = m2.owner_id WHERE ends_with(t.file, replace(replace(t2.file, 'src/', ''), '.java', '') || '.java')""")(
    lambda t, m: out(resolve.binds_statement(
        m.join(t.select(F.col("id").alias("owner_id"), "file"), "owner_id"),
        m.select("owner_id", "name").distinct().join(t.select(F.col("id").alias("owner_id"), "file"), "owner_id").select(F.concat("owner_id", F.lit("/"), "name").alias("statement_id"), "name", F.regexp_replace(F.regexp_replace(F.regexp_replace("file", "^src/", ""), "\\.java$", ""), "/", ".").alias("namespace")),
    ))
)
query("intercepts_edges", (METHODS,), "SELECT a.id AS source, u.id AS target, 'intercepts' AS kind, CAST(0.5 AS DOUBLE) AS confidence FROM syn_method a JOIN (SELECT concat('m', seq) AS name, min(id) AS id FROM syn_method GROUP BY 1 HAVING count(*) = 1) u ON u.name = concat('m', a.seq + 1) WHERE a.id <> u.id")(
    lambda m: out(resolve.intercepts(m.select("id", F.concat(F.lit("com.acme.Svc.m"), (F.col("seq") + 1)).alias("pointcut")), m.select("id", F.concat(F.lit("m"), "seq").alias("name"))))
)
query("same_file_calls", (METHODS,), """SELECT a.id AS source, b.id AS target, 'calls' AS kind, CAST(0.7 AS DOUBLE) AS confidence FROM (SELECT owner_id, name, min(id) AS id FROM syn_method GROUP BY ALL HAVING count(*) = 1) a
 JOIN (SELECT owner_id, name, min(id) AS id FROM syn_method GROUP BY ALL HAVING count(*) = 1) b ON a.owner_id = b.owner_id AND a.name = 'm1' AND b.name = 'm2'""")(
    lambda m: out(resolve.same_file_calls(m.withColumnRenamed("owner_id", "file"), m.select(F.col("owner_id").alias("file"), F.lit("m1").alias("caller_name"), F.lit("m2").alias("callee_name")).distinct()))
)
query("mapped_from_chain", ("part",), """SELECT id AS source, nxt AS target, 'mapped_from' AS kind, CAST(0.9 AS DOUBLE) AS confidence FROM (SELECT id, lead(id) OVER (PARTITION BY p_name ORDER BY rank, id) AS nxt FROM
 (SELECT concat('p:', p_partkey) AS id, p_name, p_size % 5 AS rank FROM part WHERE p_size % 11 <> 0)) WHERE nxt IS NOT NULL""")(
    lambda p: out(resolve.mapped_from(p.select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.element_at(F.array(*[F.lit(k) for k in schema.SEMANTIC_ORDER]), F.col("p_size") % 5 + 1).alias("kind"), F.when(F.col("p_size") % 11 == 0, "where_join").alias("origin"))))
)
_norm = lambda c: f"regexp_replace('/' || regexp_replace(regexp_replace({c}, '\\{{[^}}]+\\}}|\\$\\{{[^}}]+\\}}|\\b\\d+\\b', '{{}}', 'g'), '^/+|/+$', '', 'g'), '/{{2,}}', '/', 'g')"
_http = f"""cl AS MATERIALIZED (SELECT page_id AS id, method, {_norm('raw_path')} AS path FROM syn_call), en AS MATERIALIZED (SELECT DISTINCT method, {_norm('raw_path')} AS path FROM syn_endpoint),
 clp AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM cl), enp AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM en),
 m AS (SELECT c.id, e.method, e.path, 0 AS more FROM clp c JOIN enp e ON c.path = e.path WHERE e.method IN ('', c.method)
  UNION ALL SELECT c.id, e.method, e.path, 1 FROM clp c JOIN enp e ON len(c.segs) - len(e.segs) BETWEEN 1 AND 3 AND len(e.segs) > 0 AND list_slice(c.segs, len(c.segs) - len(e.segs) + 1, len(c.segs)) = e.segs WHERE e.method IN ('', c.method))"""


def _http_rows(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    clients = calls.select(F.col("page_id").cast("string").alias("id"), "method", exprs.normalize_path("raw_path").alias("path"))
    ends = endpoints.select("method", exprs.normalize_path("raw_path").alias("path")).distinct().withColumn("id", F.concat_ws(" ", "method", "path"))
    return resolve.http_matches(clients, ends)


_conf = "CAST(round((CASE WHEN more = 0 THEN 0.95 ELSE 0.6 END) * (CASE WHEN method = '' THEN 0.6 ELSE 1.0 END), 4) AS DOUBLE)"
for _name, _where, _keep in (("http_match_exact", "more = 0 AND method <> ''", "classification = 'resolved'"), ("http_match_suffix", "more > 0 AND method <> ''", "classification = 'inferred' and confidence > 0.599 and confidence < 0.601"), ("http_match_wildcard", "method = ''", "confidence < 0.599")):
    query(_name, ("syn_call", "syn_endpoint"), f"SELECT DISTINCT CAST(id AS VARCHAR) AS source, concat_ws(' ', method, path) AS target, 'matches_endpoint' AS kind, {_conf} AS confidence FROM m WHERE {_where}", _http)(lambda c, e, k=_keep: out(_http_rows(c, e).where(k)))

# snapshots and tables
_diff = "diff AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN n.hash <> o.hash THEN 'changed' ELSE 'unchanged' END AS status FROM syn_file_new n FULL OUTER JOIN syn_file_old o ON n.path = o.path)"
SNAPSHOTS = ("syn_file_new", "syn_file_old")
query("scan_diff", SNAPSHOTS, "SELECT path, status FROM diff", _diff)(store.scan_diff)
query("scan_summary", SNAPSHOTS, "SELECT count(*) FILTER (status <> 'deleted') AS files_indexed, count(*) FILTER (status IN ('added', 'changed')) AS files_extracted, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status = 'unchanged') AS unchanged FROM diff", _diff)(
    lambda n, o: store.scan_summary(store.scan_diff(n, o))
)


def _batch(e: DataFrame) -> DataFrame:
    part = e.where("kind = 'method'").withColumns({"name": F.concat(F.lit("new_"), "name"), "seq": F.col("start_line")})
    return part.unionByName(part.withColumns({"name": F.concat(F.lit("newer_"), "name"), "seq": F.col("seq") + 1000000}).where("start_line % 2 = 0"))


query("upsert_last_wins", ("pg_entity",), "SELECT id, kind, CASE WHEN kind = 'method' AND start_line % 2 = 0 THEN 'newer_new_' || name WHEN kind = 'method' THEN 'new_' || name ELSE name END AS name FROM pg_entity")(
    lambda e: store.upsert(e.withColumn("seq", F.lit(0).cast("long")), _batch(e), ["id"]).select("id", "kind", "name")
)
query("upsert_edges", ("pg_edge",), "SELECT source, target, kind, CASE WHEN kind = 'calls' THEN 1.0 ELSE confidence END AS confidence FROM pg_edge")(
    lambda g: store.upsert(g.withColumn("seq", F.lit(0)), g.where("kind = 'calls'").withColumns({"confidence": F.lit(1.0), "seq": F.lit(1)}), store.EDGE_KEY).select("source", "target", "kind", "confidence")
)
query("remove_entities", PG, "SELECT source, target, kind FROM pg_edge WHERE source NOT IN (SELECT id FROM pg_entity WHERE kind = 'xml_statement') AND target NOT IN (SELECT id FROM pg_entity WHERE kind = 'xml_statement')")(
    lambda e, g: store.remove_entities(e, g, e.where("kind = 'xml_statement'"))[1].select(*EDGE_COLUMNS)
)
query("replace_resolved", ("pg_edge",), "SELECT source, target, kind, CAST(CASE WHEN kind = 'injects' THEN 1 ELSE 0 END AS BIGINT) AS resolved FROM pg_edge WHERE resolved = 0")(
    lambda g: store.replace_resolved(g, g.where("kind = 'injects'").drop("resolved").withColumn("resolved", F.lit(1))).select("source", "target", "kind", F.col("resolved").cast("long").alias("resolved"))
)
query("delete_subtree", PG, "SELECT id FROM pg_entity WHERE id <> 'r:1' AND id NOT IN (SELECT target FROM pg_edge WHERE source = 'r:1' AND kind = 'contains')")(lambda e, g: store.delete_subtree(e, g, "r:1")[0].select("id"))
query("delete_by_file", PG, "SELECT id FROM pg_entity WHERE file <> 'supplier'")(lambda e, g: store.delete_files(e, g, e.sparkSession.createDataFrame([("supplier",)], "file string"))[0].select("id"))
query("extract_edges", ("pg_edge",), "SELECT source, target, kind FROM pg_edge WHERE resolved = 0")(lambda g: g.where("resolved = 0").select(*EDGE_COLUMNS))
query("all_entities", ("pg_entity",), "SELECT id, kind, name, qualified_name FROM pg_entity")(lambda e: e.select(*COLUMNS))
query("edge_kind_filter", ("pg_edge",), "SELECT source, target, kind FROM pg_edge WHERE kind IN ('calls', 'injects')")(lambda g: g.where(F.col("kind").isin("calls", "injects")).select(*EDGE_COLUMNS))

# scalar functions
query("normalize_path", ("pages",), f"SELECT page_id, {_norm('url')} AS path FROM pages")(lambda p: p.select("page_id", exprs.normalize_path("url").alias("path")))
query("camel_to_snake", ("part",), "SELECT p_partkey, lower(regexp_replace(regexp_replace(replace(p_name, ' ', '') || 'XMLPart' || p_brand, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z])([A-Z])', '\\1_\\2', 'g')) AS snake FROM part")(
    lambda p: p.select("p_partkey", exprs.camel_to_snake(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("XMLPart"), "p_brand")).alias("snake"))
)
query("method_to_field", ("part",), "SELECT p_partkey, lower(left(x, 1)) || substr(x, 2) AS field FROM (SELECT p_partkey, regexp_replace(CASE WHEN p_size % 3 = 0 THEN 'get' WHEN p_size % 3 = 1 THEN 'is' ELSE '' END || p_type, '^(get|is)(.)', '\\2') AS x FROM part)")(
    lambda p: p.select("p_partkey", exprs.method_to_field(F.concat(F.when(F.col("p_size") % 3 == 0, "get").when(F.col("p_size") % 3 == 1, "is").otherwise(""), "p_type")).alias("field"))
)
query("line_of", ("documents",), "SELECT doc_id, CAST(length(substr(text, 1, length(text) // 2)) - length(replace(substr(text, 1, length(text) // 2), chr(10), '')) + 1 AS BIGINT) AS line FROM documents")(
    lambda d: d.select("doc_id", exprs.line_of("text", F.floor(F.length("text") / 2).cast("int")).cast("long").alias("line"))
)
query("snippet", ("documents",), "SELECT doc_id, trim(split_part(text, chr(10), 2), ' ') AS snippet FROM documents")(lambda d: d.select("doc_id", F.trim(F.split_part("text", F.lit("\n"), F.lit(2))).alias("snippet")))
_ext = {"java": ("java",), "javascript": ("js",), "vue": ("vue",), "xml": ("xml",), "unknown": ("min.js", "txt")}
query("kind_of_path", ("part",), "SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'java' WHEN 1 THEN 'javascript' WHEN 2 THEN 'typescript' WHEN 3 THEN 'vue' WHEN 4 THEN 'gradle' WHEN 5 THEN 'toml' WHEN 6 THEN 'unknown' ELSE 'unknown' END AS kind FROM part")(
    lambda p: p.select("p_partkey", exprs.file_kind(F.concat(F.lit("a/"), "p_name", F.element_at(F.array(*[F.lit(x) for x in (".java", ".jsx", ".ts", ".vue", ".gradle.kts", ".toml", ".min.js", ".txt")]), F.col("p_size") % 8 + 1))).alias("kind"))
)
query("stable_id", ("part",), "SELECT p_partkey, sha256('workspace' || chr(0) || p_brand || chr(0) || 'table' || chr(0) || p_name || chr(0) || '') AS id FROM part")(lambda p: p.select("p_partkey", exprs.stable_id(F.lit("workspace"), "p_brand", F.lit("table"), "p_name", F.lit("")).alias("id")))
query("plane_rank", ("pg_entity",), f"SELECT id, {grouped('kind', schema.PLANES, 'code')} AS plane, CAST({grouped('kind', schema.PLANE_RANKS, 0)} AS BIGINT) AS plane_rank FROM pg_entity")(
    lambda e: e.select("id", exprs.plane("kind").alias("plane"), exprs.plane_rank("kind").cast("long").alias("plane_rank"))
)
query("embed_text", ("pg_entity",), "SELECT id, kind || ' ' || qualified_name || ' ' || name AS text FROM pg_entity")(lambda e: e.select("id", exprs.embed_text("kind", "qualified_name", "name").alias("text")))
query("repository_id", ("documents",), "SELECT DISTINCT source, left(sha256(source), 16) AS repository_id FROM documents")(lambda d: d.select("source", exprs.repository_id("source").alias("repository_id")).distinct())
query("anchor", ("pg_entity",), "SELECT id, '{\"file\":\"' || file || '\",\"line\":' || start_line || '}' AS anchor FROM pg_entity")(lambda e: e.select("id", exprs.anchor("file", "start_line", "start_line").alias("anchor")))

# extraction
_re = lambda p: p.replace("'", "''")
query("extract_alias", ("syn_sql",), f"SELECT DISTINCT statement_id, p[1] AS source_column, p[2] AS alias FROM (SELECT statement_id, unnest(list_zip(regexp_extract_all(sql_text, '{_re(sql_text.ALIAS)}', 1), regexp_extract_all(sql_text, '{_re(sql_text.ALIAS)}', 2))) AS p FROM syn_sql)")(sql_text.aliases)
query("extract_tables", ("syn_sql",), f"SELECT DISTINCT statement_id, x[i] AS table_name, CASE WHEN i = 1 AND operation <> 'select' THEN 'writes_table' ELSE 'reads_table' END AS kind FROM (SELECT statement_id, operation, regexp_extract_all(sql_text, '{_re(sql_text.TABLE)}', 1) AS x FROM syn_sql), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i)")(sql_text.tables)
query("extract_insert_cols", ("syn_sql",), "SELECT DISTINCT statement_id, trim(c) AS column_name FROM (SELECT statement_id, unnest(string_split(regexp_extract(sql_text, '(?i)INSERT\\s+INTO\\s+[\\w.]+\\s*\\(([^)]+)\\)', 1), ',')) AS c FROM syn_sql WHERE operation = 'insert')")(lambda s: sql_text.written_columns(s.where("operation = 'insert'")))
query("extract_update_cols", ("syn_sql",), f"SELECT DISTINCT statement_id, unnest(regexp_extract_all(regexp_replace(regexp_extract(sql_text, '(?is)\\bSET\\s+(.*?)\\bWHERE\\b', 1), '{_re(sql_text.NOISE)}', ' ', 'g'), '([A-Za-z_]\\w*)\\s*=', 1)) AS column_name FROM syn_sql WHERE operation = 'update'")(lambda s: sql_text.written_columns(s.where("operation = 'update'")))
query("extract_where_cols", ("syn_sql",), f"""SELECT DISTINCT statement_id, regexp_replace(t, '^.*\\.', '') AS column_name FROM (SELECT statement_id, unnest(list_zip(regexp_extract_all(body, '{_re(sql_text.TOKEN)}', 1), regexp_extract_all(body, '{_re(sql_text.TOKEN)}', 2), regexp_extract_all(body, '{_re(sql_text.TOKEN)}', 3))) AS z, z[1] AS b, z[2] AS t, z[3] AS a
 FROM (SELECT statement_id, regexp_replace(unnest(list_concat(regexp_extract_all(sql_text, '{_re(sql_text.WHERE_BODY)}', 1), regexp_extract_all(sql_text, '{_re(sql_text.ON_BODY)}', 1))), '{_re(sql_text.NOISE)}', ' ', 'g') AS body FROM syn_sql)) WHERE coalesce(b, '') = '' AND coalesce(a, '') = '' AND lower(t) NOT IN ({quoted(sql_text.KEYWORDS)})""")(sql_text.filtered_columns)
query("extract_http_calls", ("syn_page_source",), """SELECT path, 'GET' AS method, '/api/{}/x' AS url, CAST(1.0 AS DOUBLE) AS confidence FROM syn_page_source
 UNION SELECT path, upper(regexp_extract(content, '\\$http\\.(\\w+)', 1)), regexp_replace(regexp_extract(content, ' = "([^"]+)"', 1), '\\{[^}]+\\}', '{}'), CAST(0.7 AS DOUBLE) FROM syn_page_source""")(extract.http_calls)
query("extract_frontend_fields", ("syn_page_source",), f"SELECT DISTINCT path, f AS name FROM (SELECT path, unnest(regexp_extract_all(content, '{_re(extract.MEMBER)}', 1)) AS f FROM syn_page_source) WHERE f NOT IN ({quoted(extract.FIELD_NOISE)}) AND NOT (regexp_matches(f, '^[^a-z]*$') AND regexp_matches(f, '[A-Z]') AND length(f) >= 2)")(extract.frontend_fields)
query("extract_vue_pages", ("syn_page_source",), "SELECT path, replace(path, '.vue', '') AS name FROM syn_page_source")(extract.vue_pages)
query("extract_gradle", ("syn_build_source",), "SELECT path, split_part(path, '/', 1) AS module, regexp_extract(content, '\"([^\":]+:[^\":]+):', 1) AS coordinate FROM syn_build_source UNION SELECT path, split_part(path, '/', 1), regexp_extract(content, 'api\\((libs[^)]+)\\)', 1) FROM syn_build_source")(extract.gradle_dependencies)
query("extract_pkg_deps", ("syn_package_source",), "SELECT path, json_extract_string(content, '$.name') AS module, unnest(list_concat(json_keys(content, '$.dependencies'), json_keys(content, '$.devDependencies'))) AS dependency FROM syn_package_source")(extract.package_dependencies)


def extracted(sources: DataFrame, kind: str) -> DataFrame:
    return files.extract(sources.select("path", F.lit(kind).alias("kind"), F.sha2("content", 256).alias("hash"), "content"))


def named_edges(found: DataFrame) -> DataFrame:
    names = files.entities_of(found).select("id", F.concat_ws(":", "kind", "name").alias("label")).distinct()
    ends = files.edges_of(found).where("kind != 'contains'").select("file", "source", "target", "kind").distinct()
    ends = ends.join(names.select(F.col("id").alias("source"), F.col("label").alias("from_name")), "source").join(names.select(F.col("id").alias("target"), F.col("label").alias("to_name")), "target")
    return ends.select(F.col("file").alias("path"), "from_name", "kind", "to_name").distinct()


_java_entities = [
    ("file", "'C' || k || '.java'"), ("class", "'C' || k"), ("field", "'svc'"), ("field", "'fieldA'"), ("method", "'get' || k"), ("method", "'job'"), ("method", "'help'"), ("method", "'checks'"), ("spring_bean", "'S' || k"),
    ("http_endpoint", "'GET /p/{}/{}'"), ("table", "'t_' || k"), ("column", "'svc'"), ("column", "'named_' || k"), ("annotation", "'Transactional'"), ("job", "'job'"), ("test_case", "'checks'"),
]
_java_edges = [
    ("'class:C' || k", "injects", "'spring_bean:S' || k"), ("'class:C' || k", "declares", "'method:get' || k"), ("'class:C' || k", "declares", "'method:job'"), ("'class:C' || k", "declares", "'method:help'"),
    ("'class:C' || k", "declares", "'method:checks'"), ("'method:get' || k", "exposes", "'http_endpoint:GET /p/{}/{}'"), ("'method:job'", "calls", "'method:help'"), ("'class:C' || k", "depends_on", "'table:t_' || k"),
    ("'field:svc'", "mapped_from", "'column:svc'"), ("'field:fieldA'", "mapped_from", "'column:named_' || k"), ("'class:C' || k", "annotated", "'annotation:Transactional'"), ("'job:job'", "schedules", "'method:job'"),
]
query("extract_java_entities", ("syn_java_source",), " UNION ALL ".join(f"SELECT path, '{kind}' AS kind, {name} AS name FROM syn_java_source" for kind, name in _java_entities))(
    lambda s: files.entities_of(extracted(s, "java")).select(F.col("file").alias("path"), "kind", "name")
)
query("extract_java_edges", ("syn_java_source",), " UNION ALL ".join(f"SELECT path, {a} AS from_name, '{kind}' AS kind, {b} AS to_name FROM syn_java_source" for a, kind, b in _java_edges))(lambda s: named_edges(extracted(s, "java")))
query("extract_java_heritage", ("syn_java_source",), "SELECT path, 'B' || n AS superclass, '[\"I' || n || '\"]' AS implements, 'true' AS transactional FROM syn_java_source")(
    lambda s: files.entities_of(extracted(s, "java")).where("kind = 'class'").select(F.col("file").alias("path"), *[F.get_json_object("metadata", f"$.{k}").alias(k) for k in ("superclass", "implements", "transactional")])
)
query("extract_java_methods", ("syn_java_source",), "SELECT path, unnest(['get' || k, 'job', 'help', 'checks']) AS name, CAST(unnest([0, 0, 0, 2]) AS BIGINT) AS arity, CAST(unnest([4, 5, 6, 7]) AS BIGINT) AS line FROM syn_java_source")(
    lambda s: files.entities_of(extracted(s, "java")).where("kind = 'method'").select(F.col("file").alias("path"), "name", F.get_json_object("metadata", "$.arity").cast("long").alias("arity"), F.col("evidence")[0]["start_line"].cast("long").alias("line"))
)
query("extract_java_invocations", ("syn_java_source",), "SELECT path, 'get' || k AS name, 'load' AS callee, 'name' AS receiver_kind, 'svc' AS receiver FROM syn_java_source UNION ALL SELECT path, 'job', 'help', 'bare', NULL FROM syn_java_source")(
    lambda s: files.entities_of(extracted(s, "java")).where("kind = 'method'").select(F.col("file").alias("path"), "name", F.explode(F.from_json(F.get_json_object("metadata", "$.invokes"), "array<struct<name:string,receiver_kind:string,receiver:string>>")).alias("i")).select("path", "name", F.col("i.name").alias("callee"), "i.receiver_kind", "i.receiver")
)
query("extract_xml_statements", ("syn_sql", "syn_xml_source"), "SELECT path, statement_id AS name, operation, 'com.acme.M' || statement_id AS namespace, sql_text AS sql FROM syn_xml_source")(
    lambda _, x: files.entities_of(extracted(x, "xml")).where("kind = 'xml_statement'").select(F.col("file").alias("path"), "name", *[F.get_json_object("metadata", f"$.{k}").alias(k) for k in ("operation", "namespace", "sql")])
)

# rules on paths, ids and places
_call = f"(SELECT page_id, {_norm('raw_path')} AS c, {_norm("regexp_extract(raw_path, '^/api(/.*)$', 1)")} AS e FROM syn_call)"
query("segment_suffix", ("syn_call",), f"""SELECT page_id, len(e_) > 0 AND len(c_) - len(e_) BETWEEN 1 AND 3 AND c_[len(c_) - len(e_) + 1:] = e_ AS whole, len(e_) > 1 AND c_[3:] = e_[2:] AND len(c_) - len(e_) + 1 BETWEEN 1 AND 3 AS tail
 FROM (SELECT page_id, list_filter(string_split(c, '/'), lambda x: x <> '') AS c_, list_filter(string_split(e, '/'), lambda x: x <> '') AS e_ FROM {_call})""")(
    lambda c: c.select("page_id", exprs.normalize_path("raw_path").alias("c"), exprs.normalize_path(F.regexp_extract("raw_path", "^/api(/.*)$", 1)).alias("e")).select(
        "page_id", exprs.suffix_aligned("c", "e").alias("whole"), exprs.suffix_aligned("c", F.array_join(F.slice(exprs.segments("e"), 2, 1000), "/")).alias("tail")
    )
)
query("clamp", ("region",), "SELECT CAST(x AS BIGINT) AS x, CAST(greatest(1, least(x, 500)) AS BIGINT) AS limit_, CAST(greatest(0, least(x, 10)) AS BIGINT) AS depth FROM range(-3, 600) r(x)")(
    lambda r: r.sparkSession.createDataFrame([(x, schema.clamp_limit(x), schema.clamp_depth(x)) for x in range(-3, 600)], "x long, limit_ long, depth long")
)
_PLACES = ("src/", "build/", "build/generated/sources/", "web/node_modules/", "target/x/", "lib/dist/", "a/build/generated/sources/")
_place = "list_value(" + ", ".join(f"'{x}'" for x in _PLACES) + ")"
_paths = f"(SELECT p_partkey, p_size, {_place}[p_size % 7 + 1] || replace(p_brand, '#', '') || CASE WHEN p_partkey % 3 = 0 THEN 'Test' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '.java' ELSE '.vue' END AS path FROM part)"


def part_paths(p: DataFrame) -> DataFrame:
    place = F.element_at(F.array(*[F.lit(x) for x in _PLACES]), F.col("p_size") % 7 + 1)
    ending = F.concat(F.when(F.col("p_partkey") % 3 == 0, "Test").otherwise(""), F.when(F.col("p_partkey") % 2 == 0, ".java").otherwise(".vue"))
    return p.select("p_partkey", "p_size", F.concat(place, F.replace("p_brand", F.lit("#"), F.lit("")), ending).alias("path"))


query("generated_allowed", ("part",), f"SELECT p_partkey, starts_with(path, 'build/generated/sources/') AS allowed FROM {_paths}")(lambda p: part_paths(p).select("p_partkey", exprs.generated_allowed("path", ["build/generated/sources/"]).alias("allowed")))
query("discover_kept", ("part",), f"""SELECT p_partkey, path FROM {_paths} WHERE (NOT list_has_any(string_split(path, '/')[:-2], ['node_modules', 'target', 'build', 'dist', '.gradle', '.git', '.claude', '.weft']) OR starts_with(path, 'build/generated/sources/'))
 AND NOT regexp_full_match(split_part(path, '/', -1), 'Brand[0-9]*Test[.]java')""")(
    lambda p: part_paths(p).where(discover.kept(F.col("path"), settings.Config(excluded_patterns=("Brand*Test.java",)))).select("p_partkey", "path")
)
query("content_hash", ("documents",), "SELECT doc_id, sha256(text) AS hash FROM documents WHERE octet_length(encode(text)) <= 20000")(
    lambda d: d.select("doc_id", F.encode("text", "utf-8").alias("content")).where(F.length("content") <= settings.Config(max_file_bytes=20000).max_file_bytes).select("doc_id", F.sha2("content", 256).alias("hash"))
)
query("extract_version_catalog", ("supplier",), "SELECT 'm' || s_suppkey || '/gradle/libs.versions.toml' AS path, 'libs.lib-' || s_nationkey AS alias, 'com.acme:n' || s_suppkey AS coordinate FROM supplier")(
    lambda s: extract.version_catalog(s.select(F.concat(F.lit("m"), "s_suppkey", F.lit("/gradle/libs.versions.toml")).alias("path"), F.concat(F.lit('[versions]\nx = "1"\n[libraries.lib-'), "s_nationkey", F.lit(']\nmodule = "com.acme:n'), "s_suppkey", F.lit('"\nversion = "1"\n')).alias("content")))
)
query("trace_views", PG, "SELECT source, target, kind, CASE WHEN classification = 'fact' THEN false WHEN classification = 'resolved' THEN confidence < 0.8 ELSE true END AS tentative FROM pg_edge WHERE source IN (SELECT node FROM dist WHERE d < 2)", walk_sql(one("c:1"), 2, True))(
    lambda e, g: from_one("c:1", 2, True)(e, g)[1].select(*EDGE_COLUMNS, exprs.tentative("classification", "confidence").alias("tentative"))
)


def proven(g: DataFrame) -> DataFrame:
    """The edges with a piece of evidence each, from what they say."""
    made = F.struct(F.col("source").alias("file"), F.lit(1).alias("start_line"), F.when(F.col("kind") == "calls", 3).otherwise(1).alias("end_line"), "classification", F.col("confidence").cast("float").alias("confidence"), F.col("kind").alias("reason"), F.lit("").alias("snippet"))
    return g.withColumn("evidence", F.when(F.col("kind") != "declares", F.array(made)))


_proof = "CASE WHEN kind = 'declares' THEN NULL ELSE source || ':' || kind END"
_body, _walk = impact_sql(impact.default_depth("remove"))
query("impact_evidence", PG, f"SELECT id, coalesce((SELECT string_agg(DISTINCT proof, ',' ORDER BY proof) FROM proof WHERE seed = page.id), '') AS evidence FROM page", _walk + f""", proof AS (SELECT seed, {_proof} AS proof FROM do_ JOIN pg_edge ON source = node WHERE d < {impact.default_depth('remove')}
 UNION ALL SELECT seed, {_proof} FROM di JOIN pg_edge ON target = node WHERE d < {impact.default_depth('remove')})""")(
    lambda e, g: impact.impact(e, proven(g), e.where("kind in ('field', 'table')").agg(F.min("name")).first()[0], "remove").select("id", F.array_join(F.array_sort(F.array_distinct(F.transform("evidence", lambda x: F.concat_ws(":", x["file"], x["reason"])))), ",").alias("evidence"))
)
query("relay_anchor", PG, """SELECT source, target, kind, CASE WHEN kind = 'declares' THEN '{"needs_review":"no evidence recorded"}' WHEN kind = 'calls' THEN '{"file":"' || source || '","line":[1,3]}' ELSE '{"file":"' || source || '","line":1}' END AS anchor, kind = 'declares' AS needs_review
 FROM pg_edge WHERE kind IN (""" + quoted(schema.RELAY_KINDS) + ") AND source IN (SELECT node FROM dist WHERE d < 2)", walk_sql(one("n:3"), 2, True, schema.RELAY_KINDS))(
    lambda e, g: impact.relay(e, proven(g), "n:3", True, 2).select("source", "target", "kind", "anchor", "needs_review")
)
query("resolved_evidence", (TYPES,), "SELECT u.id AS source, t.id AS target, u.file AS file, CAST(1.0 AS DOUBLE) AS confidence, 'resolved across files: superclass_of' AS reason FROM (SELECT DISTINCT id, kind, superclass FROM syn_type) t JOIN (SELECT a.id, a.name, a.file FROM syn_type a JOIN uclass ON uclass.id = a.id) u ON t.superclass = u.name WHERE t.kind = 'class' AND u.id <> t.id", _uclass)(
    lambda t: resolve.with_evidence(resolve.superclass(t), t.select("id", "file", F.lit(None).cast(impact.EVIDENCE_LIST).alias("evidence"))).select("source", "target", F.col("evidence")[0]["file"].alias("file"), F.col("evidence")[0]["confidence"].cast("double").alias("confidence"), F.col("evidence")[0]["reason"].alias("reason"))
)
query("ambiguous_metadata", (TYPES,), "SELECT t.id, '{\"kind\":\"' || t.kind || '\"' || CASE WHEN c.name IS NULL THEN '' ELSE ',\"ambiguous_resolution\":[{\"kind\":\"superclass\",\"name\":\"' || t.superclass || '\",\"candidates\":[' || c.files || ']}]' END || '}' AS metadata FROM syn_type t LEFT JOIN (SELECT name, string_agg(DISTINCT '\"' || file || '\"', ',' ORDER BY '\"' || file || '\"') AS files FROM syn_type GROUP BY name HAVING count(*) > 1) c ON c.name = t.superclass")(
    lambda t: resolve.with_ambiguity(
        t.select("id", F.concat(F.lit('{"kind":"'), "kind", F.lit('","ambiguous_resolution":[{"old":[1]}]}')).alias("metadata")), resolve.notes(t.where("superclass is not null").select(F.col("id").alias("holder"), F.col("superclass").alias("name")), t, "superclass")
    )
)


# similarity
_query_vector = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _top(v: DataFrame) -> DataFrame:
    q = v.where("vec_id = 0").first().embedding
    return search.top_similar(v.withColumnRenamed("vec_id", "id"), q, 20).select("id", F.round("score", 6).alias("score"))


query("semantic_topk", ("embeddings",), f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {_query_vector}::DOUBLE[]), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_query_vector}::DOUBLE[]) DESC, vec_id LIMIT 20")(_top)
query("cosine_pairs", ("embeddings",), "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")(
    lambda v: v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y")), F.col("b") == F.col("a") + 1).select("a", "b", F.round(exprs.cosine("x", "y"), 6).alias("score"))
)
query("embed_incremental", ("documents",), "SELECT doc_id AS id FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")(
    lambda d: search.changed_embeddings(d.select(F.col("doc_id").alias("id"), "text"), d.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("text_hash"))).select("id")
)
query("verify_edge", ("documents",), "SELECT count(*) AS match_count, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i), '') AS lines FROM (SELECT unnest(x) AS line, unnest(range(1, len(x) + 1)) AS i FROM (SELECT string_split(text, chr(10)) AS x FROM documents WHERE doc_id = 5)) WHERE contains(line, 'the')")(
    lambda d: search.verify_edge(d.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")), "5", "the").select("match_count", F.array_join("lines", ",").alias("lines"))
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, edges = load(spark, sf_dir, *PG)
    return reached(traverse.traverse(entities, edges, spark.createDataFrame([("n:3",)], "id string"), 4, True, schema.FULL_PATH_KINDS)[0].where("kind = 'table'"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
