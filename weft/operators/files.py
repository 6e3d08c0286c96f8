"""From files to rows: one extractor for each kind of file, more can be registered.

extract() runs them over a file table. A file that makes an extractor fail becomes a row of ``failed`` and gives nothing
else; it is left out of the snapshot, so the next scan tries it again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft import schema
from weft.operators import extract as columns
from weft.operators import java, sql_text
from weft.operators.rows import FACT, INFERRED, FileRows

Extractor = Callable[[str, str, str, dict], FileRows]
STATEMENT = re.compile(r'<(select|insert|update|delete)\b[^>]*\bid="([^"]+)"[^>]*>(.*?)</(?:select|insert|update|delete)>', re.I | re.S)
NAMESPACE = re.compile(r'<mapper\b[^>]*\bnamespace\s*=\s*"([^"]+)"', re.I)


def python_pattern(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(r"\z", r"\Z"))


def condition_names(body: str) -> list[str]:
    plain = python_pattern(sql_text.NOISE).sub(" ", body)
    found = (m for m in python_pattern(sql_text.TOKEN).finditer(plain) if not m[1] and not m[3] and m[2].lower() not in sql_text.KEYWORDS)
    return [m[2].rsplit(".", 1)[-1] for m in found]


def written_names(operation: str, sql: str) -> list[str]:
    if operation == "insert" and (m := python_pattern(sql_text.INSERT_COLUMNS).search(sql)):
        return [n for n in (c.strip().strip('`"') for c in m[1].split(",")) if re.match("[A-Za-z]", n)]
    if operation == "update" and (m := python_pattern(sql_text.UPDATE_SET).search(sql)):
        return python_pattern(sql_text.ASSIGNED).findall(python_pattern(sql_text.NOISE).sub(" ", m[1]))
    return []


def extract_xml(path: str, text: str, file_hash: str, config: dict) -> FileRows:
    """Mapped statements with what they read, write and filter by."""
    rows = FileRows(path, text, file_hash)
    space = NAMESPACE.search(text)
    for m in STATEMENT.finditer(text):
        operation, name, sql, at = m[1].lower(), m[2], m[3], m.start(2)
        meta = {"operation": operation, "sql": sql.strip()} | ({"namespace": space[1]} if space else {})
        statement = rows.entity("xml_statement", name, f"{path}#{name}", at, meta=meta, contained=True, reason="mapped statement")

        def read(column: str, where: int, meta: dict, kind: str, confidence: float, name=name, statement=statement) -> None:
            found = rows.entity("sql_field", column, f"{path}#{name}:{column}", where, discriminator=name, meta=meta, classification=kind, confidence=confidence, reason="statement column")
            rows.edge(statement, found, "reads_column", where, kind, confidence, "statement reads column")

        for a in python_pattern(sql_text.ALIAS).finditer(sql):
            read(a[2], m.start(3) + a.start(), {"source_column": a[1]}, FACT, 1.0)
        for i, t in enumerate(python_pattern(sql_text.TABLE).finditer(sql)):
            table = rows.entity("table", t[1], t[1], m.start(3) + t.start(1), reason="table of a statement")
            rows.edge(statement, table, "writes_table" if i == 0 and operation != "select" else "reads_table", m.start(3) + t.start(1), reason="statement uses table")
        seen = set()
        for pattern in (sql_text.WHERE_BODY, sql_text.ON_BODY):
            for body in python_pattern(pattern).finditer(sql):
                for column in condition_names(body[1]):
                    if column not in seen:
                        seen.add(column)
                        read(column, m.start(3) + body.start(1), {"source_column": column, "origin": "where_join"}, INFERRED, 0.7)
        for column in written_names(operation, sql):
            found = rows.entity("column", column, f"{path}#{column}", at, meta={"source": "xml_write"}, reason="written column")
            rows.edge(statement, found, "writes_column", at, reason="statement writes column")
    return rows


def extract_frontend(path: str, text: str, file_hash: str, config: dict) -> FileRows:
    """Pages, members that look like fields, and HTTP calls, those through constants too."""
    rows = FileRows(path, text, file_hash)
    if path.endswith(".vue"):
        stem = path.rsplit("/", 1)[-1].removesuffix(".vue")
        rows.entity("vue_page", stem, path, 0, contained=True, reason="page")
    noise = set(config.get("field_noise", columns.FIELD_NOISE))
    for m in re.finditer(columns.MEMBER, text):
        if m[1] not in noise and not (len(m[1]) >= 2 and m[1].upper() == m[1] and re.search("[A-Z]", m[1])):
            rows.entity("frontend_field", m[1], f"{path}#{m[1]}", m.start(1), contained=True, reason="member access")

    def call(verb: str, url: str, at: int, kind: str, confidence: float) -> None:
        label = f"{verb.upper()} {java.normalized(url)}"
        rows.entity("http_client_call", label, f"{path}#{label}", at, meta={"method": verb.upper(), "path": java.normalized(url)}, classification=kind, confidence=confidence, contained=True, reason="client call")

    for m in re.finditer(columns.HTTP_CALL, text):
        call(m[1], m[2], m.start(), FACT, 1.0)
    constants = {m[1]: m[2] for m in re.finditer(columns.CONSTANT, text) if m[2].startswith("/")}
    for m in re.finditer(columns.HTTP_CALL_NAME, text):
        if m[2] in constants:
            call(m[1], constants[m[2]], m.start(), INFERRED, 0.7)
    return rows


def package(rows: FileRows, name: str, at: int, meta: dict) -> str:
    return rows.entity("package", name, name, at, meta=meta, reason="package")


def extract_gradle(path: str, text: str, file_hash: str, config: dict) -> FileRows:
    rows = FileRows(path, text, file_hash)
    parts = path.split("/")
    module = package(rows, parts[-2] if len(parts) > 1 else "root", 0, {"ecosystem": "gradle"})
    for m in re.finditer(columns.GRADLE, text):
        found = package(rows, m[1] or m[2], m.start(), {"ecosystem": "gradle", "coordinate": m[1] or m[2]})
        rows.edge(module, found, "depends_on", m.start(), reason="declared dependency")
    return rows


def extract_toml(path: str, text: str, file_hash: str, config: dict) -> FileRows:
    rows = FileRows(path, text, file_hash)
    if path.rsplit("/", 1)[-1] == "libs.versions.toml":
        for m in re.finditer(columns.CATALOG, text):
            package(rows, f"libs.{m[1]}", m.start(), {"ecosystem": "gradle", "alias": f"libs.{m[1]}", "coordinate": m[2]})
    return rows


def extract_json(path: str, text: str, file_hash: str, config: dict) -> FileRows:
    rows = FileRows(path, text, file_hash)
    if path.rsplit("/", 1)[-1] != "package.json":
        return rows
    try:
        found = json.loads(text)
    except ValueError:
        return rows
    if not isinstance(found, dict):
        return rows
    module = package(rows, str(found.get("name") or path), 0, {"ecosystem": "npm"})
    for kind in ("dependencies", "devDependencies", "peerDependencies"):
        for name in found.get(kind) or ():
            rows.edge(module, package(rows, name, max(0, text.find(f'"{name}"')), {"ecosystem": "npm", "coordinate": name}), "depends_on", max(0, text.find(f'"{name}"')), reason="declared dependency")
    return rows


EXTRACTORS: dict[str, Extractor] = {
    "java": java.extract, "xml": extract_xml, "vue": extract_frontend, "javascript": extract_frontend, "typescript": extract_frontend,
    "gradle": extract_gradle, "toml": extract_toml, "json": extract_json,
}


def register(kind: str, extractor: Extractor) -> None:
    """Use the extractor for files of the kind from now on."""
    EXTRACTORS[kind] = extractor


def extract(files: DataFrame, config: dict | None = None) -> DataFrame:
    """One row for each file (path, kind, hash, content): its entities, its edges, or what failed."""
    config, extractors = config or {}, dict(EXTRACTORS)

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for f in frame.itertuples(index=False):
                try:
                    make = extractors.get(f.kind)
                    found = make(f.path, f.content, f.hash, config) if make else FileRows(f.path, f.content, f.hash)
                    entities, edges = found.rows()
                    names = [c.split(" ")[0] for c in schema.ENTITY.replace(schema.EVIDENCE, "x").split(", ")]
                    edge_names = [c.split(" ")[0] for c in schema.EDGE.replace(schema.EVIDENCE, "x").split(", ")]
                    out.append((f.path, [dict(zip(names, e, strict=True)) for e in entities], [dict(zip(edge_names, e, strict=True)) for e in edges], None))
                except Exception as error:  # one bad file does not end the scan
                    out.append((f.path, [], [], f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["path", "entities", "edges", "failed"])

    struct = lambda s: "array<struct<" + s.replace(" ", ":").replace(",:", ",") + ">>"
    return files.select("path", "kind", "hash", "content").mapInPandas(run, f"path string, entities {struct(schema.ENTITY)}, edges {struct(schema.EDGE)}, failed string")


def entities_of(extracted: DataFrame) -> DataFrame:
    return extracted.select(F.explode("entities").alias("e")).select("e.*")


def edges_of(extracted: DataFrame) -> DataFrame:
    return extracted.select(F.explode("edges").alias("e")).select("e.*")
