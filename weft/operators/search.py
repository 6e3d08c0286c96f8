"""Search over names, vector similarity, and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft import schema
from weft.functions import exprs


def search(entities: DataFrame, text: str, limit: int = 50, offset: int = 0, kinds=()) -> DataFrame:
    """Exact names first, then by kind, name and id. Kinds are filtered before the page is cut."""
    kinds = schema.check_kinds(kinds)
    found = entities.where(exprs.words_match(text, "name", "qualified_name"))
    if kinds:
        found = found.where(F.col("kind").isin(*kinds))
    exact = F.when(F.lower("name") == text.lower(), 0).otherwise(1)
    return found.orderBy(exact, exprs.search_priority("kind"), "name", "id").offset(offset).limit(limit).withColumn("score", F.lit(1.0))


def exact_name(entities: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    found = entities.where(F.col("name") == name)
    return found if limit is None else found.orderBy("id").limit(limit)


def find_endpoint(entities: DataFrame, text: str, limit: int = 50, offset: int = 0) -> DataFrame:
    return search(entities, text, limit, offset, schema.ENDPOINT_KINDS)


def trigram_index(entities: DataFrame) -> DataFrame:
    """(trigram, id) of the lower-case names, each once."""
    both = F.lower(F.concat_ws("\n", "name", "qualified_name"))
    grams = F.when(F.length(both) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(both) - 2, F.lit(1))), lambda i: F.substr(both, i, F.lit(3)))))
    return entities.select(F.explode(grams).alias("trigram"), "id")


def search_by_index(entities: DataFrame, index: DataFrame, word: str) -> DataFrame:
    """Entities with the word, found by its trigrams and verified; words under three characters are looked for in all."""
    word = word.lower()
    wanted = sorted({word[i : i + 3] for i in range(len(word) - 2)})
    if not wanted:
        return entities.where(exprs.words_match(word, "name", "qualified_name"))
    ids = index.where(F.col("trigram").isin(*wanted)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("id")
    return entities.join(ids, "id", "left_semi").where(exprs.words_match(word, "name", "qualified_name"))


def counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    return entities.agg(F.count("*").alias("entity_count")).join(edges.agg(F.count("*").alias("edge_count")))


def counts_by_kind(entities: DataFrame) -> DataFrame:
    return entities.groupBy("kind").agg(F.count("*").alias("n"))


def system_view(entities: DataFrame, view: str) -> DataFrame:
    """Counts by kind of one plane (api, data), or of everything, with the plane's total."""
    kinds = {"api": schema.API_VIEW_KINDS, "data": schema.DATA_VIEW_KINDS}.get(view)
    found = counts_by_kind(entities.where(F.col("kind").isin(*kinds)) if kinds else entities)
    return found.withColumn("plane_total", F.sum("n").over(Window.partitionBy()))  # one row for each kind at most


def list_repositories(files: DataFrame) -> DataFrame:
    return files.groupBy("repository").agg(F.count("*").alias("n"))


def top_similar(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k vectors of the largest cosine: exact, over all rows, kept by the top-k operator."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("score", exprs.cosine("embedding", q))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def hashed_embedding(text, dimensions: int = 64):
    """Vector of character trigrams hashed to buckets: a stand-in for a model, the same everywhere."""
    t = F.lower(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.substr(t, i, F.lit(3))), F.lit(dimensions)))
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.size(F.filter(grams, lambda g: g == d)).cast("float"))


def changed_embeddings(texts: DataFrame, state: DataFrame) -> DataFrame:
    """(id, text, text_hash) of those whose text is not the one embedded before."""
    hashed = texts.withColumn("text_hash", F.sha2("text", 256))
    return hashed.join(state.select("id", "text_hash"), ["id", "text_hash"], "left_anti")


def verify_edge(files: DataFrame, path: str, target: str, shown: int = 50) -> DataFrame:
    """Lines of one file that name the target: their number, and the first ones."""
    lines = files.where(F.col("path") == path).select(F.posexplode(F.split("content", "\n", -1)).alias("at", "line")).where(F.contains("line", F.lit(target)))
    kept = F.slice(F.array_sort(F.collect_list(F.col("at") + 1)), 1, shown)  # as many as the file has lines
    return lines.agg(F.count("*").alias("match_count"), kept.alias("lines"))
