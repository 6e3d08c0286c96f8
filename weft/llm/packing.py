"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of its documents. A window grants source s a quantum of tokens in its target share; s sends
head documents as long as its deficit (grants so far less tokens sent) covers them, and what is left over carries to the
next window. With e the end of a document in its queue, that is window ceil(e / quantum) - 1: a closed form, so the
deficit needs no sequential pass and carries across partitions as the running sum of the queue. Windows follow each other
gaplessly and are cut every ``length`` tokens, so only the very last sequence is padded.

Defined cases: null text is the empty document (its end id alone); null source is the source ''; equal or repeated
rows are packed once each; extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import steps, written
from weft.llm.tokens import WORD_VOCABULARY, WordEncoder, vocabulary_path

LENGTH = 4096
#: Tokens in a window of the round-robin.
WINDOW = 64 * LENGTH
END_ID = 2
#: Power of a source's tokens that is its target share where no weights are given.
MIXTURE = 0.7
#: Rows of a queue that one running sum covers; their totals are summed in a second level.
CHUNK = 8192

TOKENS = "uid long, doc_id long, source string, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, window_id long"


def tokenized(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(uid, doc_id, source, n, ids): ids little-endian unsigned 16-bit, or 32-bit for larger vocabularies."""
    path = vocabulary or vocabulary_path(WORD_VOCABULARY)

    def run(batches):
        encode = WordEncoder(path)
        kind = "<u2" if encode.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        uid = TaskContext.get().partitionId() << 40
        for batch in steps(batches, size=3 << 20):
            ids, bounds = encode(batch.column("text"))
            ids = np.insert(ids, bounds[1:], END_ID).astype(kind)
            bounds = bounds + np.arange(len(bounds))
            width = ids.itemsize
            data = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer((bounds * width).astype(np.int64)), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(uid, uid + batch.num_rows)), batch.column("doc_id"), batch.column("source"), pa.array(np.diff(bounds)), data.cast(pa.binary())],
                ["uid", "doc_id", "source", "n", "ids"],
            )
            uid += batch.num_rows

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("source"), "text").mapInArrow(run, TOKENS)


def running_sum(df: DataFrame, value: str, group: list[str], block: Column, order: list[str], name: str) -> DataFrame:
    """Sum of value over the group's earlier blocks and over earlier rows of the same block.

    Two levels: a window never holds more than one block's rows, or one row per block.
    """
    df = df.withColumn("_block", block)
    totals = df.groupBy(*group, "_block").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    inside = Window.partitionBy(*group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(totals.drop("_total"), [*group, "_block"]).withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_block", "_base")


def positions(lengths: DataFrame, window: int = WINDOW, weights: dict[str, float] | None = None, mixture: float = MIXTURE) -> DataFrame:
    """(uid, window_id, position) of the rows (uid, source, n): the place of each document in the packed stream.

    weights: target share by source; a source without a weight gets the smallest one. Without weights, a source's target
    is its number of tokens to the power mixture: below 1 small sources come sooner, at 1 all queues last equally long.
    A queue that has run dry grants nothing more, so later windows are smaller; no token is left out or repeated.
    """
    queued = running_sum(lengths, "n", ["source"], F.col("uid").bitwiseAND(~(CHUNK - 1)), ["uid"], "before")
    shares = lengths.groupBy("source").agg(F.sum("n").alias("tokens"))
    if weights is None:
        share = F.pow(F.col("tokens").cast("double"), F.lit(float(mixture)))
    else:
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        share = F.coalesce(F.element_at(table, F.col("source")), F.lit(float(min(weights.values()))))
    shares = shares.withColumn("share", share.cast("double"))
    total = shares.agg(F.sum("share")).first()[0] or 1.0
    quantum = shares.select("source", (F.col("share") / F.lit(total) * F.lit(float(window))).alias("quantum"))
    served = queued.join(quantum, "source").withColumn("window_id", F.ceil((F.col("before") + F.col("n")) / F.col("quantum")) - 1)
    # places: all earlier windows, in two levels, and then the order inside the window (at most one window's rows)
    per_window = served.groupBy("window_id").agg(F.sum("n").alias("n"))
    starts = running_sum(per_window.withColumn("all", F.lit(0)), "n", ["all"], F.floor(F.col("window_id") / CHUNK), ["window_id"], "base").select("window_id", "base")
    inside = Window.partitionBy("window_id").orderBy("source", "before", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = served.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return placed.join(starts, "window_id").select("uid", "window_id", (F.col("base") + F.col("within")).alias("position"))


def pack(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, weights: dict[str, float] | None = None, vocabulary: str | None = None, mixture: float = MIXTURE) -> DataFrame:
    """One row per piece; see the module's text for the method."""
    tokens = written(tokenized(docs, vocabulary), "packing-tokens")
    placed = positions(tokens.select("uid", "source", "n"), window, weights, mixture)

    def cut(batches):
        for batch in batches:
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "window_id")}
            for doc, source, n, ids, window_id, at in zip(*(batch.column(k).to_pylist() if k != "ids" else batch.column(k) for k in ("doc_id", "source", "n", "ids", "window_id", "position")), strict=True):
                raw = ids.as_buffer()
                data = memoryview(np.frombuffer(raw, f"<u{raw.size // n}").astype("<u4").tobytes())
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    for k, v in zip(out, (doc, start, size, zlib.crc32(data[4 * start : 4 * (start + size)]), n, sequence, offset, source, window_id), strict=True):
                        out[k].append(v)
                    start += size
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.string() if k == "source" else pa.int64()) for k in out]))

    return tokens.join(placed, "uid").select("doc_id", "source", "n", "ids", "window_id", "position").mapInArrow(cut, PIECES)
