"""Extraction from front-end and build files by patterns, as table-generating column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import exprs
from weft.operators.sql_text import all_of

# Patterns, and names that are no fields.
MEMBER = r"\b[A-Za-z_]\w*\.([A-Za-z_]\w*)"
HTTP_CALL = r"""(?i)\b(?:[\w$]*(?:\.[\w$]+|\[[^\]]+\])*\.)?(get|post|put|delete|patch)\(\s*["'`]([^"'`]+)["'`]"""
HTTP_CALL_NAME = r"(?i)\b(?:[\w$]*(?:\.[\w$]+|\[[^\]]+\])*\.)?(get|post|put|delete|patch)\(\s*([A-Za-z_$]\w*)\s*\)"
CONSTANT = r"""(?i)(?:const|let|var)\s+([A-Za-z_$]\w*)\s*=\s*["'`]([^"'`]+)["'`]"""
GRADLE = r'(?:implementation|api|compileOnly|runtimeOnly|testImplementation|developmentOnly)\s*\(\s*(?:"([^":]+:[^":]+)(?::[^"]*)?"|(libs\.[A-Za-z0-9_.]+))'
CATALOG = r'(?ms)^\[libraries\.([^\]]+)\][\s\S]*?module\s*=\s*"([^"]+)"'
FIELD_NOISE = (
    "length", "size", "toString", "valueOf", "prototype", "constructor", "call", "apply", "bind", "push", "pop", "shift", "unshift",
    "split", "join", "slice", "splice", "concat", "reverse", "sort", "map", "filter", "forEach", "find", "findIndex", "some", "every",
    "reduce", "reduceRight", "includes", "indexOf", "lastIndexOf", "flat", "flatMap", "fill", "copyWithin", "floor", "ceil", "round",
    "random", "abs", "max", "min", "pow", "sqrt", "log", "exp", "sign", "keys", "values", "entries", "assign", "freeze", "from", "isArray",
    "create", "getPrototypeOf", "trim", "trimStart", "trimEnd", "replace", "replaceAll", "match", "matchAll", "search", "toLowerCase",
    "toUpperCase", "charAt", "charCodeAt", "padStart", "padEnd", "startsWith", "endsWith", "then", "catch", "finally", "resolve", "reject",
    "all", "race", "allSettled", "error", "warn", "info", "debug", "time", "timeEnd", "createElement", "appendChild", "querySelector",
    "querySelectorAll", "getElementById", "addEventListener", "removeEventListener", "preventDefault", "stopPropagation",
)


def pairs(files: DataFrame, pattern: str, first: str, second: str) -> DataFrame:
    both = F.arrays_zip(all_of("content", pattern, 1).alias(first), all_of("content", pattern, 2).alias(second))
    return files.select("path", F.explode(both).alias("p")).select("path", f"p.{first}", f"p.{second}")


def frontend_fields(files: DataFrame, noise=FIELD_NOISE) -> DataFrame:
    """(path, name): members that are likely fields, each once in a file."""
    found = files.select("path", F.explode(all_of("content", MEMBER, 1)).alias("name"))
    return found.where(exprs.is_likely_field("name", noise)).distinct()


def http_calls(files: DataFrame) -> DataFrame:
    """(path, method, url, confidence): calls with a literal, and calls with a name that the file binds to a path."""
    shaped = lambda df, conf: df.select("path", F.upper("verb").alias("method"), exprs.normalize_path("target").alias("url"), F.lit(conf).alias("confidence"))
    literal = shaped(pairs(files, HTTP_CALL, "verb", "target"), 1.0)
    bound = pairs(files, CONSTANT, "variable", "target").where(F.col("target").startswith("/")).groupBy("path", "variable").agg(F.max("target").alias("target"))
    named = shaped(pairs(files, HTTP_CALL_NAME, "verb", "variable").join(bound, ["path", "variable"]), 0.7)
    return literal.union(named).distinct()


def vue_pages(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").endswith(".vue")).select("path", F.regexp_extract("path", r"([^/\\]+)\.vue$", 1).alias("name"))


def gradle_dependencies(files: DataFrame) -> DataFrame:
    """(path, module, coordinate): the module is the file's folder; versions are left out."""
    found = pairs(files, GRADLE, "group_artifact", "alias")
    module = F.coalesce(F.nullif(F.regexp_extract("path", r"([^/\\]+)[/\\][^/\\]+$", 1), F.lit("")), F.lit("root"))
    return found.select("path", module.alias("module"), F.when(F.col("group_artifact") != "", F.col("group_artifact")).otherwise(F.col("alias")).alias("coordinate")).distinct()


def version_catalog(files: DataFrame) -> DataFrame:
    found = pairs(files.where(F.col("path").endswith("libs.versions.toml")), CATALOG, "library", "coordinate")
    return found.select("path", F.concat(F.lit("libs."), "library").alias("alias"), "coordinate")


def package_dependencies(files: DataFrame) -> DataFrame:
    """(path, module, dependency) of package.json files; one that is no JSON gives nothing."""
    kinds = ("dependencies", "devDependencies", "peerDependencies")
    schema = "struct<name:string," + ",".join(f"{k}:map<string,string>" for k in kinds) + ">"
    parsed = files.where(F.col("path").rlike(r"(^|/)package\.json$")).select("path", F.from_json("content", schema).alias("j")).where("j is not null")
    names = F.flatten(F.array(*[F.coalesce(F.map_keys(f"j.{k}"), F.array().cast("array<string>")) for k in kinds]))
    return parsed.select("path", F.col("j.name").alias("module"), F.explode(names).alias("dependency")).distinct()
