"""Tools over a warehouse, for the command line and the line protocol: each takes arguments and gives plain data."""

from __future__ import annotations

import inspect
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import schema
from weft.functions import exprs
from weft.operators import impact, scan, search, traverse
from weft.sources import config as settings
from weft.sources.warehouse import Warehouse

VERSION = "1"
BRIEF = ("id", "kind", "name", "qualified_name")


def rows(df: DataFrame) -> list[dict]:
    """A page of rows; pages are bounded by MAX_LIMIT."""
    return [r.asDict(recursive=True) for r in df.collect()]


def envelope(data) -> dict:
    return {"protocol_version": VERSION, "status": "ok", "data": data}


def failure(message: str) -> dict:
    return {"protocol_version": VERSION, "status": "error", "error": {"message": message}}


def anchor(evidence) -> dict:
    """Where an entity stands: file and line, or first and last line."""
    if not evidence:
        return {"needs_review": "no evidence recorded"}
    first = evidence[0]
    return {"file": first.file, "line": [first.start_line, first.end_line] if first.end_line and first.end_line > first.start_line else first.start_line}


#: Arguments by names that clients also use.
OTHER_NAMES = {"from": "name", "workspace": "path"}
WHOLE, NUMBER, TEXT = {"type": "integer", "minimum": 0}, {"type": "number", "minimum": 0, "maximum": 1}, {"type": "string"}
#: What an argument takes, by its name; all others are texts.
ARGUMENTS = {
    "limit": {"type": "integer", "minimum": 1, "maximum": schema.MAX_LIMIT, "default": schema.DEFAULT_LIMIT}, "offset": WHOLE | {"default": 0}, "depth": WHOLE | {"maximum": schema.MAX_DEPTH, "default": 2},
    "min_confidence": NUMBER | {"default": 0.0}, "verbose": {"type": "boolean", "default": False}, "operation": TEXT | {"enum": list(schema.CHANGE_OPERATIONS)},
    "kind": {"type": "array", "items": TEXT | {"enum": list(schema.ENTITY_KINDS)}}, "to_kind": TEXT | {"enum": list(schema.ENTITY_KINDS)}, "edge_kinds": {"type": "array", "items": TEXT | {"enum": list(schema.EDGE_KINDS)}},
    "direction": TEXT, "repository": TEXT | {"default": "default"},
}
#: What differs by tool.
TOOL_ARGUMENTS = {
    "trace_callers": {"edge_kinds": {"default": list(schema.TRACE_KINDS)}}, "trace_callees": {"edge_kinds": {"default": list(schema.TRACE_KINDS)}},
    "trace_full_path": {"edge_kinds": {"default": list(schema.FULL_PATH_KINDS)}, "direction": {"enum": ["outbound", "inbound"], "default": "outbound"}},
    "trace_table_access": {"direction": {"enum": ["read", "write", "both"], "default": "both"}}, "build_relay_doc": {"depth": {"default": 1}}, "semantic_search": {"query": {"description": "words whose meaning is looked for"}},
}
OBJECTS, FLAG = {"type": "array", "items": {"type": "object"}}, {"type": "boolean"}
PAGE = {"limit": WHOLE, "offset": WHOLE, "has_more": FLAG}
#: What a tool's data hold.
RESULTS = {
    **dict.fromkeys(("search_entities", "find_endpoint", "analyze_requirement"), {"items": OBJECTS, "hint": TEXT} | PAGE), "semantic_search": {"items": OBJECTS, "hint": TEXT},
    **dict.fromkeys(("trace_callers", "trace_callees", "trace_table_access", "trace_full_path"), {"items": OBJECTS, "edges": OBJECTS, "hint": TEXT} | PAGE),
    "analyze_change": {"findings": OBJECTS, "open_questions": {"type": "array", "items": TEXT}, "total": WHOLE} | PAGE,
    "verify_edge": {"file": TEXT, "match_count": WHOLE, "lines": {"type": "array"}, "hint": TEXT}, "list_repositories": {"repositories": OBJECTS},
    "build_relay_doc": {"target": {"type": "object"}, "inbound": OBJECTS, "outbound": OBJECTS, "inbound_has_more": FLAG, "outbound_has_more": FLAG, "related": {"type": "object"}, "limit": WHOLE, "offset": WHOLE},
    **dict.fromkeys(("scan_workspace", "show_system_view", "get_index_status"), {"entities_by_kind": {"type": "object"}}),
}


def described(name: str, tool: Callable) -> dict:
    """A tool's entry in the list of tools, its arguments read from its signature (or from that of the tool it passes them to)."""
    parameters = dict(inspect.signature(tool).parameters)
    if any(p.kind is p.VAR_KEYWORD for p in parameters.values()):
        parameters = {k: p for k, p in inspect.signature(Service.search_entities).parameters.items() if k not in ("self", "query", "kind")} | {k: p for k, p in parameters.items() if p.kind is not p.VAR_KEYWORD}
    more = TOOL_ARGUMENTS.get(name, {})
    properties = {k: ARGUMENTS.get(k, TEXT) | more.get(k, {}) for k in parameters}
    required = [k for k, p in parameters.items() if p.default is p.empty]
    data = {"type": "object", "properties": RESULTS[name]}
    out = {"type": "object", "properties": {"protocol_version": TEXT, "status": TEXT | {"enum": ["ok", "error"]}, "data": data, "error": {"type": "object"}}, "required": ["protocol_version", "status"]}
    return {"name": name, "description": (tool.__doc__ or name.replace("_", " ")).strip(), "inputSchema": {"type": "object", "properties": properties, "required": required, "additionalProperties": False}, "outputSchema": out}


class Service:
    def __init__(self, spark: SparkSession, root: str, config: settings.Config | None = None):
        self.spark, self.root, self.config = spark, root, config or settings.Config()
        self.tools: dict[str, Callable[..., dict]] = {
            "scan_workspace": self.scan_workspace, "search_entities": self.search_entities, "find_endpoint": self.find_endpoint, "semantic_search": self.semantic_search,
            "analyze_change": self.analyze_change, "analyze_requirement": self.analyze_requirement, "trace_callers": self.trace_callers, "trace_callees": self.trace_callees,
            "trace_table_access": self.trace_table_access, "trace_full_path": self.trace_full_path, "verify_edge": self.verify_edge, "show_system_view": self.show_system_view,
            "get_index_status": self.get_index_status, "list_repositories": self.list_repositories, "build_relay_doc": self.build_relay_doc,
        }

    def warehouse(self, repository: str = "default") -> Warehouse:
        return Warehouse(self.spark, f"{self.root}/{repository}")

    def _hint(self, found: list, w: Warehouse) -> dict:
        if found:
            return {}
        return {"hint": "The index is empty; run scan_workspace first." if w.entities().isEmpty() else "Nothing matched; try fewer or shorter words."}

    def scan_workspace(self, path: str, repository: str = "default") -> dict:
        w = self.warehouse(repository)
        summary = scan.scan(self.spark, path, w, settings.load(path)).as_dict()
        return summary | {"entities_by_kind": {r.kind: r.n for r in search.counts_by_kind(w.entities()).collect()}}

    def search_entities(self, query: str, limit: int | None = None, offset: int = 0, kind=(), verbose: bool = False, repository: str = "default") -> dict:
        w, n = self.warehouse(repository), schema.clamp_limit(limit, min(schema.DEFAULT_LIMIT, self.config.search_limit))
        found = rows(search.search(w.entities(), query, n + 1, offset, kind).select(*BRIEF, F.size("evidence").alias("evidence_count"), *(["metadata", "evidence"] if verbose else [])))
        return {"items": found[:n], "has_more": len(found) > n, "limit": n, "offset": offset} | self._hint(found, w)

    def find_endpoint(self, query: str, **more) -> dict:
        return self.search_entities(query, kind=schema.ENDPOINT_KINDS, **more)

    def analyze_requirement(self, requirement: str, **more) -> dict:
        return self.search_entities(requirement, **more)

    def semantic_search(self, query: str, limit: int | None = None, repository: str = "default") -> dict:
        w = self.warehouse(repository)
        if not query.strip():
            return {"items": [], "hint": "The query is empty."}
        vector = self.spark.range(1).select(search.hashed_embedding(F.lit(query)).alias("v")).first().v
        top = search.top_similar(w.embeddings(), vector, schema.clamp_limit(limit)).select("id", "score")
        return {"items": rows(w.entities().select(*BRIEF).join(F.broadcast(top), "id").orderBy(F.desc("score"), "id"))}  # at most MAX_LIMIT rows

    def analyze_change(self, name: str, operation: str = "rename", target_kind: str | None = None, to: str | None = None, depth: int | None = None, limit: int | None = None, offset: int = 0, repository: str = "default") -> dict:
        """What a change of the entities of a name reaches; target_kind and to describe the change and do not narrow it."""
        w, n = self.warehouse(repository), schema.clamp_limit(limit, self.config.impact_limit)
        total = search.exact_name(w.entities(), name, schema.SEARCH_CAP).count()
        found = rows(impact.impact(w.entities(), w.edges(), name, operation, depth, n, offset))
        questions = impact.open_questions(total, len(found), [f["kind"] for f in found], not w.entities().isEmpty())
        return {"findings": found, "open_questions": questions, "total": total, "limit": n, "offset": offset, "has_more": offset + n < total}

    def _trace(self, name: str, kinds, outbound: bool, depth, min_confidence: float, limit, offset: int, to_kind=None, repository: str = "default") -> dict:
        w, n = self.warehouse(repository), schema.clamp_limit(limit, schema.TRACE_LIMIT)
        if to_kind:
            schema.check_kinds(to_kind)
        entities, edges = traverse.trace(w.entities(), w.edges(), name, schema.clamp_depth(depth), kinds, outbound, to_kind, max(0.0, min(1.0, min_confidence)), n + 1, offset)
        views = edges.select("source", "target", "kind", "classification", "confidence", exprs.tentative("classification", "confidence").alias("tentative"), F.size("evidence").alias("evidence_count"))
        items, links = rows(entities.select(*BRIEF, "distance")), rows(views)
        return {"items": items[:n], "edges": links[:n], "has_more": len(items) > n or len(links) > n, "limit": n, "offset": offset} | self._hint(items, w)

    def trace_callers(self, name: str, depth=None, edge_kinds=None, min_confidence: float = 0.0, limit=None, offset: int = 0, repository: str = "default") -> dict:
        return self._trace(name, edge_kinds or schema.TRACE_KINDS, False, depth, min_confidence, limit, offset, None, repository)

    def trace_callees(self, name: str, depth=None, edge_kinds=None, min_confidence: float = 0.0, limit=None, offset: int = 0, repository: str = "default") -> dict:
        return self._trace(name, edge_kinds or schema.TRACE_KINDS, True, depth, min_confidence, limit, offset, None, repository)

    def trace_table_access(self, name: str, direction: str = "both", depth=None, min_confidence: float = 0.0, limit=None, offset: int = 0, repository: str = "default") -> dict:
        kinds = schema.TABLE_ACCESS_KINDS + {"read": ("reads_table",), "write": ("writes_table",)}.get(direction, ("reads_table", "writes_table"))
        return self._trace(name, kinds, False, depth, min_confidence, limit, offset, None, repository)

    def trace_full_path(self, name: str, to_kind: str | None = None, direction: str = "outbound", depth=None, edge_kinds=None, min_confidence: float = 0.0, limit=None, offset: int = 0, repository: str = "default") -> dict:
        return self._trace(name, edge_kinds or schema.FULL_PATH_KINDS, direction != "inbound", depth, min_confidence, limit, offset, to_kind, repository)

    def verify_edge(self, source: str, target: str, repository: str = "default") -> dict:
        w = self.warehouse(repository)
        first = search.exact_name(w.entities(), source, 1).first()
        if first is None:
            return {"match_count": 0, "lines": [], "hint": "The source is not indexed."}
        found = search.verify_edge(w.table("file"), first.file, target).first()
        return {"file": first.file, "match_count": found.match_count, "lines": found.lines}

    def show_system_view(self, view: str = "repositories", repository: str = "default") -> dict:
        w = self.warehouse(repository)
        found = search.system_view(w.entities(), view).collect()
        out = {"view": view, "entities_by_kind": {r.kind: r.n for r in found}} | search.counts(w.entities(), w.edges()).first().asDict()
        return out if found else out | {"hint": f"Nothing of the view {view} is indexed."}

    def get_index_status(self, repository: str = "default") -> dict:
        w = self.warehouse(repository)
        return search.counts(w.entities(), w.edges()).first().asDict() | {"version": w.version()}

    def list_repositories(self) -> dict:
        fs, root = Warehouse(self.spark, self.root)._fs(self.root)
        names = sorted(x.getPath().getName() for x in fs.listStatus(root)) if fs.exists(root) else []
        return {"repositories": [{"repository": n} | self.get_index_status(n) for n in names]}

    def build_relay_doc(self, qn: str, depth: int | None = None, limit: int | None = None, offset: int = 0, verbose: bool = False, repository: str = "default") -> dict:
        """The hand-off document around one entity: edges with anchors at both sides, a page of each."""
        w, n = self.warehouse(repository), schema.clamp_limit(limit)
        target = w.entities().where(F.col("qualified_name") == qn).orderBy("id").first()
        if target is None:
            raise ValueError(f"no entity has the qualified name {qn}")
        depth = schema.clamp_depth(depth, 1)
        around = {}
        for way in ("inbound", "outbound"):
            found = impact.relay(w.entities(), w.edges(), target.id, way == "outbound", depth).orderBy("source", "target", "kind").offset(offset).limit(n + 1)
            found = rows(found if verbose else found.drop("evidence"))
            around[way] = [x | {"anchor": json.loads(x["anchor"])} for x in found[:n]]
            around[f"{way}_has_more"] = len(found) > n
        review = "custom:needs-review"  # what the graph does not know
        about = {k: target[k] for k in BRIEF} | {"anchor": anchor(target.evidence), "bean": review, "interface": review, "business": review}
        return {"target": about, **around, "limit": n, "offset": offset, "related": {"homonyms": rows(impact.homonyms(w.entities(), target.id).select(*BRIEF))}}

    def call(self, tool: str, arguments: dict) -> dict:
        """The tool's envelope; whatever fails in a tool becomes an error envelope."""
        try:
            if tool not in self.tools:
                raise ValueError(f"unknown tool: {tool}")
            return envelope(self.tools[tool](**{OTHER_NAMES.get(k, k): v for k, v in arguments.items()}))
        except Exception as error:
            return failure(f"{type(error).__name__}: {error}")


def answer(service: Service, line: str) -> dict | None:
    """The reply to one line of JSON-RPC 2.0; None to a notification."""
    try:
        message = json.loads(line)
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
    if not isinstance(message, dict) or "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "weft", "version": VERSION}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [described(n, f) for n, f in service.tools.items()]}}
    if method == "tools/call":
        found = service.call(params.get("name", ""), params.get("arguments") or {})
        return reply | {"result": {"content": [{"type": "text", "text": json.dumps(found, default=str)}], "structuredContent": found, "isError": found["status"] == "error"}}
    return reply | {"error": {"code": -32601, "message": f"unknown method: {method}"}}


def serve(service: Service, lines=sys.stdin, out=sys.stdout) -> None:
    for line in lines:
        if line.strip() and (reply := answer(service, line)) is not None:
            print(json.dumps(reply, default=str), file=out, flush=True)
