"""Continuous indexing: files that arrive in a folder are scanned batch by batch.

The state is the warehouse's snapshot, not a state store, and a batch that is run again finds nothing changed, so each file
counts once even where a batch is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.functions import exprs
from weft.operators import scan, store
from weft.sources import discover
from weft.sources.config import Config
from weft.sources.warehouse import Warehouse

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, root: str, config: Config | None = None, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (path, kind, hash, content)."""
    config = config or Config()
    raw = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(root)
    files = raw.withColumn("rel", discover.relative(F.col("path"), root))
    files = files.where(discover.kept(F.col("rel"), config) & (F.col("length") <= config.max_file_bytes))
    return files.select(F.col("rel").alias("path"), exprs.file_kind("rel").alias("kind"), F.sha2("content", 256).alias("hash"), F.try_validate_utf8(F.col("content").cast("string")).alias("content")).where("kind != 'unknown' and content is not null")


def merge_batch(batch: DataFrame, warehouse: Warehouse, config: Config | None = None) -> scan.Summary:
    """Scan the batch's files together with those indexed before."""
    fresh = store.last_wins(batch.withColumn("seq", F.lit(0)), ["path"]).drop("seq")
    before = warehouse.table("file").withColumn("hash", F.regexp_replace("hash", f"^{scan.FORMAT}", ""))
    return scan.scan_files(batch.sparkSession, before.join(fresh, "path", "left_anti").unionByName(fresh), warehouse, config)


def start(spark: SparkSession, root: str, warehouse: Warehouse, checkpoint: str, config: Config | None = None, once: bool = False) -> StreamingQuery:
    writer = arriving(spark, root, config).writeStream.foreachBatch(lambda df, _: None if df.isEmpty() else merge_batch(df, warehouse, config) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


