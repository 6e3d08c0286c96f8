"""Quality classification by nearest-neighbour voting in a latent-semantic space.

Fit, on a bounded sample of labelled rows: hashed counts of byte trigrams and of words, weighted by inverse document
frequency in the sample, projected to DIMENSIONS by a truncated singular value decomposition. The sample's unit vectors and
labels are broadcast; every document is projected in the same way, its cosines with all of them are computed as blocked
matrix products, and the labels of the NEIGHBOURS most similar, and of all as similar as the last of them, vote with weights that grow with the similarity. Votes of a
class are divided by its share of the sample, so that the rarer class is not voted down.

The bound: at most SAMPLE labelled rows of each class, those with the smallest hashes of doc_id, with one text each. Labels are taken only from
rows whose crc32(doc_id as text) mod FOLDS is not HELD_OUT. doc_id, lang, source and labels are no inputs of a score.

Defined cases: null text is empty; a text without features scores 0.5; cosines are equal that agree in five decimals; a
doc_id with several labels counts for each; of a labelled doc_id's texts the one with the least hash counts; labels without a document are skipped; without labelled rows of both classes
every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Prefixes, mix, steps, text_buffer

FOLDS, HELD_OUT = 3, 1
SAMPLE = 1500
TRIGRAMS, TERMS = 2048, 1024
DIMENSIONS = 64
NEIGHBOURS = 25
#: Documents in one matrix product.
BLOCK = 512


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashed counts of the byte trigrams and of the runs between white space, per document, as float32."""
    n_docs = len(bounds) - 1
    width = TRIGRAMS + TERMS
    out = np.zeros((n_docs, width), np.float32)
    if len(data) < 3:
        return out
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(n_docs), sizes)
    x = data.astype(np.uint32)
    gram = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
    column = (gram * np.uint32(2654435761) >> np.uint32(32 - 11)).astype(np.int64)
    inside = doc[:-2] == doc[2:]
    out[:, :TRIGRAMS] = np.bincount((doc[:-2] * TRIGRAMS + column)[inside], minlength=n_docs * TRIGRAMS).reshape(n_docs, TRIGRAMS)
    # words by their shape: letters' case, digits and signs, so that shouting, tables and markers are seen
    shape = np.full(256, ord("a"), np.uint8)
    shape[:128] = np.arange(128)
    shape[65:91], shape[97:123], shape[48:58] = ord("A"), ord("a"), ord("0")
    solid = ~np.isin(data, (32, 9, 10, 11, 12, 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    owner = doc[start]
    kind = (Prefixes(shape[data]).of(start, end) % np.uint64(TERMS // 2)).astype(np.int64)
    terms = np.bincount(owner * TERMS + kind, minlength=n_docs * TERMS)
    # and whether a word repeats the one before
    word = Prefixes(data).of(start, end)
    again = np.flatnonzero((word[1:] == word[:-1]) & (owner[1:] == owner[:-1])) + 1
    terms += np.bincount(owner[again] * TERMS + TERMS // 2 + (mix(word[again]) % np.uint64(8)).astype(np.int64), minlength=n_docs * TERMS)
    out[:, TRIGRAMS:] = terms.reshape(n_docs, TERMS)
    return out


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square roots of the shares, times inverse document frequency; each of the two parts has length 1."""
    x = np.sqrt(x) * idf
    for part in (slice(None, TRIGRAMS), slice(TRIGRAMS, None)):
        norm = np.linalg.norm(x[:, part], axis=1, keepdims=True)
        np.divide(x[:, part], norm, out=x[:, part], where=norm > 0)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def leading(w: np.ndarray, k: int, turns: int = 4) -> np.ndarray:
    """The first k right singular vectors, by subspace iteration from a fixed start."""
    base = np.random.default_rng(0).standard_normal((w.shape[1], k + 16)).astype(np.float32)
    for _ in range(turns):
        base, _ = np.linalg.qr(w.T @ (w @ base))
    small = w @ base
    _, vectors = np.linalg.eigh(small.T @ small)
    return (base @ vectors[:, ::-1][:, :k]).astype(np.float32)


class Model:
    """What the executors get: a projection, the sample's vectors, and their votes. Bounded by the parameters."""

    def __init__(self, x: np.ndarray, y: np.ndarray, neighbours: int = NEIGHBOURS):
        seen = (x > 0).sum(axis=0)
        self.idf = np.log((1 + len(x)) / (1 + seen)).astype(np.float32) + 1
        w = weighted(x, self.idf)
        self.projection = leading(w, DIMENSIONS)
        self.vectors = unit(w @ self.projection)
        self.neighbours = min(neighbours, len(x))
        share = np.array([np.mean(y == 0), np.mean(y == 1)])
        self.votes = np.where(y == 1, 0.5 / share[1], 0.5 / share[0]).astype(np.float32)
        self.label = y.astype(np.float32)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        vectors = unit(weighted(x, self.idf) @ self.projection)
        out = np.empty(len(x))
        for a in range(0, len(x), BLOCK):
            cosine = np.round(vectors[a : a + BLOCK] @ self.vectors.T, 5)
            last = -np.partition(-cosine, self.neighbours - 1, axis=1)[:, self.neighbours - 1 : self.neighbours]
            weight = np.where(cosine >= last, np.exp(8 * (cosine - 1)) * self.votes, 0)
            out[a : a + BLOCK] = (weight * self.label).sum(axis=1) / weight.sum(axis=1)
        out[~vectors.any(axis=1)] = 0.5
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of a bounded sample; what reaches the driver is hashed counts of at most 2 * sample documents."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~held_out(F.col("doc_id")))
    chosen = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    picked = chosen[0].union(chosen[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked.groupBy("doc_id", "quality").agg(F.count("*").alias("times"))), "doc_id")
    texts = texts.groupBy("doc_id", "quality", "times").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "quality", F.explode(F.array_repeat("text", F.col("times").cast("int"))).alias("text"))

    def run(batches):
        for step in steps(batches):
            x = counts(*text_buffer(step.column("text")))
            row, column = np.nonzero(x)
            split = np.searchsorted(row, np.arange(step.num_rows + 1))
            cells = [np.stack((column[a:b], x[row[a:b], column[a:b]].astype(np.int64))).astype("<i4").tobytes() for a, b in zip(split[:-1], split[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([step.column("doc_id"), step.column("quality"), pa.array(cells, pa.binary())], ["doc_id", "quality", "cells"])

    rows = texts.mapInArrow(run, "doc_id long, quality int, cells binary").toArrow()
    y = rows.column("quality").to_numpy()
    if len(np.unique(y)) < 2:
        return None
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    x = np.zeros((len(y), TRIGRAMS + TERMS), np.float32)
    for i, cell in enumerate(rows.column("cells")):
        column, value = np.frombuffer(cell.as_buffer(), "<i4").reshape(2, -1)
        x[i, column] = value
    return Model(x[order], y[order])


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(row, score): each row of docs as it was, and the likelihood of label 1."""
    model = fit(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for step in steps(batches):
            score = model(counts(*text_buffer(step.column("text")))) if model else np.full(step.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([step.column("row"), pa.array(score)], ["row", "score"])

    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    return held.mapInArrow(run, held.select("row").schema.add("score", "double"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    return scored.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that score at least so much."""
    return scores(docs, labels).where(F.col("score") >= least).select("row.*")
