"""Scalar functions as column expressions; no Python runs for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft import schema

PATH_VARIABLE = r"\{[^}]+\}|\$\{[^}]+\}|\b\d+\b"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stable_id(*parts: Column | str) -> Column:
    """Identity of an entity: source, path, kind, qualified name and discriminator, joined by NUL and hashed."""
    return F.sha2(F.concat_ws("\0", *[col(p) for p in parts]), 256)


def line_of(content: Column | str, offset: Column | str) -> Column:
    """Line number of a 0-based character offset."""
    head = F.substr(col(content), F.lit(1), col(offset))
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def normalize_path(path: Column | str) -> Column:
    """Variables and numbers become {}, slashes are trimmed at the ends and single inside, one leads."""
    bare = F.regexp_replace(F.regexp_replace(col(path), PATH_VARIABLE, "{}"), "^/+|/+$", "")
    return F.regexp_replace(F.concat(F.lit("/"), bare), "/{2,}", "/")


def camel_to_snake(name: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(col(name), "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z])([A-Z])", "$1_$2"))


def method_to_field(name: Column | str) -> Column:
    """getX and isX to x; other names only lose the capital."""
    bare = F.regexp_replace(col(name), "^(?:get|is)(?=.)", "")
    return F.concat(F.lower(F.substring(bare, 1, 1)), F.substr(bare, F.lit(2)))


def file_kind(path: Column | str) -> Column:
    p = F.lower(F.regexp_extract(col(path), "[^/\\\\]*$", 0))
    ext = F.regexp_extract(p, r"\.([^.]+)$", 1)
    return (
        F.when(p.endswith(".gradle") | p.endswith(".gradle.kts"), "gradle").when(p.contains(".min."), "unknown").when(ext == "java", "java").when(ext.isin("js", "jsx"), "javascript")
        .when(ext.isin("ts", "tsx"), "typescript").when(ext.isin("vue", "xml", "toml", "json"), ext).otherwise("unknown")
    )


def case_of(kind: Column | str, table: dict, otherwise) -> Column:
    out = F.lit(otherwise)
    for value, kinds in table.items():
        out = F.when(col(kind).isin(*kinds), F.lit(value)).otherwise(out)
    return out


def plane(kind: Column | str) -> Column:
    return case_of(kind, schema.PLANES, "code")


def plane_rank(kind: Column | str) -> Column:
    return case_of(kind, schema.PLANE_RANKS, 0)


def relay_layer(kind: Column | str) -> Column:
    return case_of(kind, schema.RELAY_LAYERS, "infra")


def position(kind: Column | str, order: tuple[str, ...], otherwise: int) -> Column:
    return case_of(kind, {i: (k,) for i, k in enumerate(order)}, otherwise)


def semantic_rank(kind: Column | str) -> Column:
    return position(kind, schema.SEMANTIC_ORDER, len(schema.SEMANTIC_ORDER))


def search_priority(kind: Column | str) -> Column:
    return position(kind, schema.SEARCH_PRIORITY, 9)


def relay_edge_type(kind: Column | str, peer: Column | str) -> Column:
    k, p = col(kind), col(peer)
    return (
        F.when(k.isin("reads_table", "reads_column", "binds_to_statement"), "db_read").when(k.isin("writes_table", "writes_column"), "db_write")
        .when(k.isin("matches_endpoint", "sends_http_request") | ((k == "exposes") & (p == "http_endpoint")), "http_out").when(k == "mapped_from", "field_propagate")
        .when(k == "calls", "call").when(k == "declares", "declares").when((k == "exposes") & (p == "spring_bean"), "exposes").when(k == "injects", "inject")
        .when((k == "depends_on") & p.isin("table", "column", "database"), "db_read").otherwise("custom:needs-review")
    )


def tentative(classification: Column | str, confidence: Column | str) -> Column:
    c = col(classification)
    return F.when(c == "fact", False).when(c == "resolved", col(confidence) < F.lit(0.8)).otherwise(True)


def anchor(file: Column | str, start: Column | str, end: Column | str) -> Column:
    """Where an entity stands, as JSON."""
    file, start, end = col(file), col(start), col(end)
    several = F.to_json(F.struct(file.alias("file"), F.array(start, end).alias("line")))
    return F.when(file.isNull(), F.lit('{"needs_review":"no evidence recorded"}')).when(end > start, several).otherwise(F.to_json(F.struct(file.alias("file"), start.alias("line"))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine in double precision; 0 for vectors of different lengths, of no length, or with values that are not finite."""
    to_double = lambda x: F.transform(col(x), lambda v: v.cast("double"))
    x, y = to_double(a), to_double(b)
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))
    value = F.try_divide(dot, norm(x) * norm(y))
    fine = (F.size(x) == F.size(y)) & value.isNotNull() & ~F.isnan(value) & (F.abs(value) <= 1e300)
    return F.when(fine, value).otherwise(0.0)


def embed_text(kind: Column | str, qualified_name: Column | str, name: Column | str, annotations: Column | None = None) -> Column:
    base = F.concat_ws(" ", col(kind), col(qualified_name), col(name))
    return base if annotations is None else F.concat(base, F.coalesce(F.array_join(F.transform(F.array_sort(annotations), lambda a: F.concat(F.lit(" @"), a)), ""), F.lit("")))


def is_likely_field(name: Column | str, noise) -> Column:
    n = col(name)
    return ~n.isin(*noise) & ~(n.rlike("^[^a-z]*$") & n.rlike("[A-Z]") & (F.length(n) >= 2))


def segments(path: Column | str) -> Column:
    return F.filter(F.split(col(path), "/"), lambda s: s != "")


def suffix_aligned(call: Column | str, endpoint: Column | str) -> Column:
    """Whether the endpoint's segments are the last ones of the call, which has one to three more."""
    c, e = segments(call), segments(endpoint)
    more = F.size(c) - F.size(e)
    return (F.size(e) > 0) & more.between(1, 3) & (F.slice(c, F.greatest(more, F.lit(0)) + 1, F.greatest(F.size(e), F.lit(1))) == e)


def repository_id(path: Column | str) -> Column:
    return F.left(F.sha2(col(path), 256), F.lit(16))


def words_match(text: str, *columns: str) -> Column:
    """Any of the words in any of the columns, whatever the case; a single word keeps its blanks, no text matches all."""
    words = text.split() if len(text.split()) > 1 else [text]
    tests = [F.contains(F.lower(F.col(c)), F.lit(w.lower())) for w in words for c in columns]
    return reduce(lambda a, b: a | b, tests)


def generated_allowed(path: Column | str, prefixes) -> Column:
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    return reduce(lambda a, b: a | b, [p.startswith(x) for x in prefixes], F.lit(False))
