"""Row types and vocabularies of the code graph."""

from __future__ import annotations

# Kinds of entities and edges, evidence classes, and the groups of kinds that the operators use.
ENTITY_KINDS = (
    "workspace", "repository", "submodule", "file", "package", "class", "interface", "method", "field", "vue_page", "vue_component",
    "frontend_field", "http_client_call", "http_endpoint", "api_field", "spring_bean", "mapper", "mapper_method", "xml_statement",
    "result_map", "sql_field", "datasource", "database", "table", "column", "test_case", "config_file", "annotation", "job",
)
EDGE_KINDS = (
    "contains", "declares", "calls", "exposes", "sends_http_request", "matches_endpoint", "has_response_field", "serialized_from",
    "mapped_from", "binds_to_statement", "reads_table", "writes_table", "reads_column", "writes_column", "depends_on", "injects",
    "submodule_of", "annotated", "intercepts", "tests", "implements", "schedules", "superclass_of",
)
EVIDENCE_CLASSES = ("fact", "resolved", "inferred", "runtime_unknown")
CHANGE_OPERATIONS = ("add", "remove", "rename", "change_type", "change_nullable", "change_format", "change_semantics")
TRACE_KINDS = ("calls", "injects", "declares", "superclass_of")
TABLE_ACCESS_KINDS = ("calls", "injects", "binds_to_statement")
FULL_PATH_KINDS = ("calls", "injects", "declares", "superclass_of", "binds_to_statement", "reads_table", "writes_table", "exposes", "matches_endpoint")
RELAY_KINDS = (
    "calls", "depends_on", "injects", "declares", "exposes", "matches_endpoint", "sends_http_request", "binds_to_statement",
    "reads_table", "writes_table", "reads_column", "writes_column", "mapped_from",
)
BRIDGE_KINDS = ("contains", "matches_endpoint")
API_VIEW_KINDS = ("http_endpoint", "api_field", "http_client_call")
DATA_VIEW_KINDS = ("table", "column", "sql_field", "xml_statement", "result_map", "mapper", "mapper_method", "datasource", "database")
ENDPOINT_KINDS = ("http_endpoint", "http_client_call", "api_field")
SEARCH_PRIORITY = ("file", "class", "interface", "method", "spring_bean", "http_endpoint")
SEMANTIC_ORDER = ("frontend_field", "api_field", "field", "sql_field", "column")
PLANES = {
    "frontend": ("vue_page", "vue_component", "frontend_field"), "api": ("http_endpoint", "api_field", "http_client_call"),
    "data": ("sql_field", "xml_statement", "table", "column"), "test": ("test_case",), "delivery": ("config_file",),
}
PLANE_RANKS = {4: ("frontend_field", "vue_page", "vue_component"), 3: ("http_endpoint", "api_field", "http_client_call"), 2: ("sql_field", "xml_statement", "table", "column"), 1: ("field",)}
RELAY_LAYERS = {
    "db_mapper": ("table", "column", "database", "datasource", "mapper", "mapper_method", "xml_statement", "result_map", "sql_field"),
    "remote": ("http_endpoint", "http_client_call", "api_field"), "domain": ("spring_bean", "class", "interface", "method", "field"),
}
DEFAULT_DEPTHS = {"add": 2, "rename": 2}
MAX_DEPTH, MAX_LIMIT, DEFAULT_LIMIT, TRACE_LIMIT, SEARCH_CAP = 10, 500, 100, 50, 1000

EVIDENCE = "struct<file:string,start_line:int,end_line:int,classification:string,confidence:float,reason:string,snippet:string>"
ENTITY = f"id string, kind string, name string, qualified_name string, file string, metadata string, evidence array<{EVIDENCE}>, seq long"
EDGE = f"source string, target string, kind string, file string, evidence array<{EVIDENCE}>, seq long"
FILE = "path string, kind string, hash string, content string"


def check_kinds(kinds, allowed=ENTITY_KINDS) -> list[str]:
    """The kinds as a list; a name that is not in the vocabulary is an error."""
    kinds = [kinds] if isinstance(kinds, str) else list(kinds or ())
    if unknown := [k for k in kinds if k not in allowed]:
        raise ValueError(f"unknown kind: {', '.join(map(str, unknown))}")
    return kinds


def clamp_limit(limit: int | None, default: int = DEFAULT_LIMIT) -> int:
    return max(1, min(default if limit is None else limit, MAX_LIMIT))


def clamp_depth(depth: int | None, default: int = 2) -> int:
    return max(0, min(default if depth is None else depth, MAX_DEPTH))
