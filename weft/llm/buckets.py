"""A shuffle of packed arrays: one row holds what one batch sends to one hash bucket.

Rows per (batch, bucket) instead of per item keep Spark's row overhead off the items; a reducer sees one bucket at a time
and sorts it in numpy. The number of buckets follows the input's size, so a bucket stays small as data grow.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm.common import shuffle_width

Arrays = dict[str, np.ndarray]
#: Bytes of input, as Spark's statistics have them, for each bucket.
BUCKET_BYTES = 16 << 20


def how_many(df: DataFrame) -> int:
    """Buckets for what is sent from df: two for each shuffle partition, more where these would grow too large."""
    # of the tables read, as Spark's estimate for a join is the product of its sides
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)  # beyond, Spark knows none
    return min(max(2 * shuffle_width(df.sparkSession), size // BUCKET_BYTES), 1 << 30)


def schema(fields: dict[str, str]) -> str:
    return "bucket int, " + ", ".join(f"{k} binary" for k in fields)


def packed(bucket: np.ndarray, arrays: Arrays, fields: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Rows for the shuffle; within a bucket the items keep their order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    columns = [pa.array(bucket[cuts[:-1]].astype(np.int32))]
    for k, kind in fields.items():
        data = np.ascontiguousarray(arrays[k][order].astype(kind))
        columns.append(pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * data.itemsize).astype(np.int64)), pa.py_buffer(data.tobytes())]).cast(pa.binary()))
    yield pa.RecordBatch.from_arrays(columns, ["bucket", *fields])


def by_bucket(rows: DataFrame, fields: dict[str, str], reduce: Callable[[int, Arrays], Iterator[pa.RecordBatch]], out: str) -> DataFrame:
    """reduce(bucket, arrays) for every bucket, with all that was sent to it."""

    def run(batches):
        def items():
            for batch in batches:
                yield from zip(batch.column("bucket").to_pylist(), *(batch.column(k) for k in fields), strict=True)

        for bucket, group in itertools.groupby(items(), key=lambda x: x[0]):
            parts = [[] for _ in fields]
            for _, *values in group:
                for p, v in zip(parts, values, strict=True):
                    p.append(v.as_py())
            arrays = {k: np.frombuffer(b"".join(p), kind) for (k, kind), p in zip(fields.items(), parts, strict=True)}
            yield from reduce(bucket, arrays)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, out)
