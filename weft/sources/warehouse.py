"""The graph's tables as Parquet, replaced by new versions.

A version is a list of folders, one for each table; a pointer file holds the list that counts and is moved into place last, so
a reader sees the old or the new version and never half of one. Tables that a version does not change keep their folder.
Folders that neither the new version nor the one before it names are removed, so readers of the one before can end.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import schema
from weft.operators import store

TABLES = {
    "entity": schema.ENTITY, "edge": schema.EDGE, "resolved": f"source string, target string, kind string, classification string, confidence double, evidence array<{schema.EVIDENCE}>",
    "file_state": "path string, hash string, indexed_at long", "file": schema.FILE, "embedding": "id string, embedding array<float>, dim int, text_hash string",
    "note": "holder string, kind string, name string, candidates array<string>",
}


def facts_of(edges: DataFrame) -> DataFrame:
    """Stored edges with class and confidence of their first evidence."""
    first = F.get("evidence", F.lit(0))
    return edges.select("source", "target", "kind", first["classification"].alias("classification"), F.coalesce(first["confidence"].cast("double"), F.lit(1.0)).alias("confidence"), "evidence")


class Warehouse:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _pointer(self) -> dict:
        fs, pointer = self._fs(f"{self.path}/CURRENT")
        return json.loads(self.spark.read.text(f"{self.path}/CURRENT").first()[0]) if fs.exists(pointer) else {"version": None, "tables": {}, "before": {}}

    def version(self) -> str | None:
        return self._pointer()["version"]

    def table(self, name: str) -> DataFrame:
        folder = self._pointer()["tables"].get(name)
        if folder is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{folder}")

    def replace(self, **tables: DataFrame) -> str:
        """A new version with these tables, and the others as they are."""
        version, now = f"v-{uuid.uuid4().hex}", self._pointer()
        folders = dict(now["tables"])
        for name, df in tables.items():
            columns = self.spark.createDataFrame([], TABLES[name]).columns
            folders[name] = f"{name}-{version}"
            df.select(*columns).write.parquet(f"{self.path}/{folders[name]}")
        fs, draft = self._fs(f"{self.path}/CURRENT-{version}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"version": version, "tables": folders, "before": now["tables"]}).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(draft, self._fs(f"{self.path}/CURRENT")[1], overwrite)
        named = {*folders.values(), *now["tables"].values()}
        for folder in now.get("before", {}).values():
            if folder not in named:
                fs.delete(self._fs(f"{self.path}/{folder}")[1], True)
        return version

    def entities(self) -> DataFrame:
        return self.table("entity")

    def facts(self) -> DataFrame:
        return facts_of(self.table("edge"))

    def edges(self) -> DataFrame:
        """Resolved edges, and the facts they do not override."""
        return store.visible_edges(self.facts(), self.table("resolved"))

    def embeddings(self) -> DataFrame:
        return self.table("embedding").where(F.size("embedding") == F.col("dim"))
