"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of the k-gram hashes of a text, the least of every W consecutive ones is kept. Two texts that share SPAN = K + W - 1 words in
a row share a kept hash, so joining the kept hashes finds every document with a hit. Those documents are then compared word
by word: their windows of SPAN words are joined with the items' windows as texts, and the words inside are counted.
Items of fewer than SPAN words are one window each and found by the hashes of all runs of their number of words.

The benchmark is broadcast only where its windows were counted and are at most BROADCAST_WINDOWS; else it is shuffled.

Defined cases: item ids may be of any type and are listed as strings; null text has no words; items without words are never found; equal rows have equal results; a null item_id
is left out of the list, its hits count; extra columns are ignored; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Scratch, sized_broadcast

SPAN, K = 10, 5
W = SPAN - K + 1
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_WINDOWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BREAKS), "")


def combined(x: Column, y_from: int, y: Column, f) -> Column:
    """f over x and y shifted, as long as both reach."""
    n = F.greatest(F.least(F.size(x), F.size(y) - y_from), F.lit(0))
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(y_from + 1), n), f)


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def gram_hashes(words: Column, k: int) -> Column:
    """Hashes of all k-word runs, by doubling; the result is bound before it is used again."""
    hash_two = lambda a, b: F.xxhash64(a, b)

    def grow(have: dict[int, Column], size: int) -> Column:
        if 2 * size <= k:
            return let(combined(have[size], size, have[size], hash_two), lambda x: grow(have | {2 * size: x}, 2 * size))
        now, column = size, have[size]
        for part in sorted((s for s in have if s < size), reverse=True):
            if now + part <= k:
                column = combined_bound(column, now, have[part], hash_two)
                now += part
        return column

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda x: grow({1: x}, 1))


def combined_bound(x: Column, y_from: int, y: Column, f) -> Column:
    return let(x, lambda bound: combined(bound, y_from, y, f))


def winnowed(words: Column) -> Column:
    """The least hash of every W consecutive K-grams, each value once."""
    least = lambda a, b: F.least(a, b)

    def grow(x: Column, size: int) -> Column:
        if 2 * size <= W:
            return let(combined(x, size, x, least), lambda y: grow(y, 2 * size))
        return combined(x, W - size, x, least) if size < W else x

    return F.array_distinct(let(gram_hashes(words, K), lambda g: grow(g, 1)))


def windows(df: DataFrame, key: str, size: Column) -> DataFrame:
    """(key, size, at, window) for every run of so many words, as text."""
    last = F.size("words") - size
    runs = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat_ws(" ", F.slice("words", i + 1, size))))
    return df.select(key, size.alias("size"), F.posexplode(runs).alias("at", "window"))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, n_hit, items) of the documents (key, text) with a hit."""
    scratch = Scratch()
    items = scratch(benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0), "items")
    size = F.least(F.size("words"), F.lit(SPAN))
    item_windows = scratch(windows(items, "item_id", size).select("item_id", "window", "size").distinct(), "item-windows")
    n_windows = item_windows.count()
    small = (lambda df: F.broadcast(df)) if n_windows <= BROADCAST_WINDOWS else (lambda df: df)
    worded = docs.select("key", words(F.col("text")).alias("words"))
    # explode_outer: for explode the optimizer would add a filter that computes the hashes a second time
    kept = worded.select("key", F.explode_outer(winnowed(F.col("words"))).alias("hash"))
    found = [kept.join(small(items.select(F.explode_outer(winnowed(F.col("words"))).alias("hash")).where("hash is not null").distinct()), "hash", "left_semi")]
    short = sorted(r[0] for r in items.where(F.size("words") < SPAN).select(F.size("words")).distinct().collect())  # at most SPAN - 1 numbers
    for k in short:
        wanted = items.where(F.size("words") == k).select(F.explode_outer(gram_hashes(F.col("words"), k)).alias("hash")).distinct()
        found.append(worded.select("key", F.explode_outer(F.array_distinct(gram_hashes(F.col("words"), k))).alias("hash")).join(small(wanted), "hash", "left_semi"))
    candidates = found[0].select("key")
    for more in found[1:]:
        candidates = candidates.union(more.select("key"))
    candidates = scratch(candidates.distinct(), "candidates")
    chosen = docs.join(sized_broadcast(candidates), "key", "left_semi").select("key", words(F.col("text")).alias("words"))
    near = [windows(chosen, "key", F.lit(k)) for k in [*short, SPAN]]
    rows = near[0]
    for more in near[1:]:
        rows = rows.union(more)
    matched = rows.join(small(item_windows), ["window", "size"]).select("key", "at", "size", "item_id")
    matched = scratch(matched, "hits")
    covered = matched.select("key", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("word")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    listed = matched.groupBy("key").agg(F.collect_set("item_id").alias("items"))
    out = scratch(covered.join(listed, "key"), "found")
    scratch.clear(out)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """key: two hashes of doc_id and text, so that no two of many documents share one by chance."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("key", F.struct(F.xxhash64("doc_id", text).alias("a"), F.xxhash64(text, "doc_id").alias("b")))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, words hit, items, digest of the item ids, contaminated."""
    docs = keyed(docs.select("doc_id", "text"))
    found = hits(docs, benchmark)
    joined = docs.select("doc_id", "key", F.size(words(F.col("text"))).cast("long").alias("n_words")).join(found, "key", "left")
    items = F.array_sort(F.coalesce("items", F.array().cast("array<string>")))
    return joined.select(
        F.col("doc_id").cast("long"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, all columns as they were."""
    held = keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.col("text").cast("string").alias("text")))
    return held.join(hits(held.select("key", "text"), benchmark).select("key"), "key", "left_anti").select("row.*")
