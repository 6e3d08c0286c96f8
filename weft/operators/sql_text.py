"""What a mapped SQL statement names: aliases, tables, written and filtered columns. Pattern columns, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import exprs

# The patterns and words by which statements are read.
ALIAS = r"(?i)\b([A-Za-z_]\w*)\s+AS\s+([A-Za-z_]\w*)"
TABLE = r"(?i)\b(?:FROM|JOIN|UPDATE|INTO)\s+([A-Za-z_][\w.]*)"
INSERT_COLUMNS = r"(?i)INSERT\s+INTO\s+[\w.]+\s*\(([^)]+)\)"
UPDATE_SET = r"(?is)\bSET\s+(.*?)(?:\bWHERE\b|;|\z)"
WHERE_BODY = r"(?is)\bWHERE\b(.*?)(?:\bGROUP\s+BY\b|\bORDER\s+BY\b|\bHAVING\b|\bLIMIT\b|\z|;)"
ON_BODY = r"(?is)\bON\b\s+(.*?)(?:\bWHERE\b|\bGROUP\s+BY\b|\bORDER\s+BY\b|\bHAVING\b|\bLIMIT\b|\bJOIN\b|\z|;)"
NOISE = r"(?s)#\{[^}]*\}|\$\{[^}]*\}|<[^>]*>"
ASSIGNED = r"([A-Za-z_]\w*)\s*="
TOKEN = r"(?i)(?:\b(from|join|into)\s+)?\b([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)(\s*\()?"
KEYWORDS = (
    "and", "or", "not", "null", "is", "in", "like", "between", "exists", "as", "on", "where", "select", "from", "join", "inner", "left", "right", "full", "outer",
    "group", "order", "by", "having", "limit", "union", "case", "when", "then", "else", "end", "distinct", "all", "any", "true", "false", "asc", "desc",
)


def all_of(text: Column | str, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(exprs.col(text), F.lit(pattern), F.lit(group))


def aliases(statements: DataFrame) -> DataFrame:
    """(statement_id, source_column, alias)."""
    pairs = F.arrays_zip(all_of("sql_text", ALIAS, 1).alias("source_column"), all_of("sql_text", ALIAS, 2).alias("alias"))
    return statements.select("statement_id", F.explode(pairs).alias("p")).select("statement_id", "p.source_column", "p.alias").distinct()


def tables(statements: DataFrame) -> DataFrame:
    """(statement_id, table_name, kind): the first table of what is not a select is written, the others are read."""
    found = statements.select("statement_id", "operation", F.posexplode(all_of("sql_text", TABLE, 1)).alias("at", "table_name"))
    return found.select("statement_id", "table_name", F.when((F.col("at") == 0) & (F.col("operation") != "select"), "writes_table").otherwise("reads_table").alias("kind")).distinct()


def written_columns(statements: DataFrame) -> DataFrame:
    """(statement_id, column_name) of an insert's list and an update's assignments."""
    listed = F.transform(F.split(F.regexp_extract("sql_text", INSERT_COLUMNS, 1), ","), lambda c: F.regexp_replace(F.trim(c), '^[`"]+|[`"]+$', ""))
    inserted = F.filter(listed, lambda c: c.rlike("^[A-Za-z]"))
    assigned = all_of(F.regexp_replace(F.regexp_extract("sql_text", UPDATE_SET, 1), NOISE, " "), ASSIGNED, 1)
    found = F.when(F.col("operation") == "insert", inserted).when(F.col("operation") == "update", assigned)
    return statements.select("statement_id", F.explode(found).alias("column_name")).distinct()


def condition_columns(body: Column) -> Column:
    """Columns of a condition: not placeholders, keywords, tables or functions; without the table before the dot."""
    plain = F.regexp_replace(body, NOISE, " ")
    tokens = F.arrays_zip(all_of(plain, TOKEN, 1).alias("before"), all_of(plain, TOKEN, 2).alias("token"), all_of(plain, TOKEN, 3).alias("after"))
    kept = F.filter(tokens, lambda t: (t["before"] == "") & (t["after"] == "") & ~F.lower(t["token"]).isin(*KEYWORDS))
    return F.transform(kept, lambda t: F.substring_index(t["token"], ".", -1))


def filtered_columns(statements: DataFrame) -> DataFrame:
    """(statement_id, column_name) of all WHERE and ON conditions, each once."""
    bodies = F.concat(all_of("sql_text", WHERE_BODY, 1), all_of("sql_text", ON_BODY, 1))
    return statements.select("statement_id", F.explode(F.flatten(F.transform(bodies, condition_columns))).alias("column_name")).distinct()
