"""Token-count rollups kept up by signed deltas.

A delta row says that a document of a source and language, counted by one version of a tokenizer, came (+1), went (-1), or,
as one row of each sign, was counted anew. Totals are sums, so deltas may come in any order and in any number of tasks.

A batch is summed, written under a folder of its own, and committed by a small file named by the batch's id, which is moved
into place only if none is there: a batch that was committed is skipped when it is sent again, one that failed half-way was
never committed, and of two drivers that send one batch at a time the first to commit counts. compact() sums what is
committed into a base in the same way, so that totals read one base and the batches since, however many have been.

Defined cases: null text has no tokens but is a document; null source or language is a group of its own; equal rows count
each; a group whose totals are all zero is left out; extra columns are ignored; an empty batch can be committed; a batch id
may hold any characters.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import fresh_path, until_exit
from weft.llm.tokens import BYTE_VOCABULARY, MULTI_VOCABULARY, byte_counter, vocabulary_path

#: Versions of the counting: the vocabulary's name and a number that rises when the counting changes.
VERSION = "byte_bpe_50k/1"
MULTI_VERSION = "byte_bpe_multi_50k/1"
VOCABULARIES = {VERSION: BYTE_VOCABULARY, MULTI_VERSION: MULTI_VOCABULARY}
GROUP = ["source", "lang", "tokenizer_version"]
TOTALS = ["n_docs", "n_tokens", "n_chars"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_chars long"

Term = tuple[int, str, str | None]


def signed(docs: DataFrame, terms: list[Term]) -> DataFrame:
    """Signed counts of the documents for every term (sign, version, path of its vocabulary or None for the version's own).

    One row for each group, term and task; a text is counted once by each vocabulary, however many terms need it.
    """
    resolved = [(sign, version, path or vocabulary_path(VOCABULARIES.get(version, BYTE_VOCABULARY))) for sign, version, path in terms]

    def run(batches):
        counters = {path: byte_counter(path) for _, _, path in resolved}
        sums: dict = defaultdict(lambda: [0, 0, 0])
        for batch in batches:
            for text, source, lang in zip(batch.column("text"), batch.column("source").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                text = text.as_py() or ""
                n = {path: count(text) for path, count in counters.items()}
                for i, (sign, _, path) in enumerate(resolved):
                    held = sums[source, lang, i]
                    held[0] += sign
                    held[1] += sign * n[path]
                    held[2] += sign * len(text)
        rows = [(source, lang, resolved[i][1], *v) for (source, lang, i), v in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, [pa.string()] * 3 + [pa.int64()] * 3, strict=True)], [*GROUP, *TOTALS])

    return docs.select(F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")).mapInArrow(run, SCHEMA)


def deltas(docs: DataFrame, sign: int = 1, version: str = VERSION, vocabulary: str | None = None) -> DataFrame:
    return signed(docs, [(sign, version, vocabulary)])


def revision(docs: DataFrame, old: str, new: str, old_vocabulary: str | None = None, new_vocabulary: str | None = None) -> DataFrame:
    """Deltas that replace the documents' counts under one version by those under another."""
    return signed(docs, [(-1, old, old_vocabulary), (1, new, new_vocabulary)])


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in TOTALS])


class Rollup:
    """Totals under a folder: data/ has the batches' sums, commits/ a file for each batch that counts, bases/ the sums of many."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "rollup")

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _commit(self, folder: str, name: str, content: dict) -> bool:
        """Make the file with its content, all at once; False if there is one."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        fs, target = self._fs(f"{self.path}/{folder}/b-{quote(name, safe='')}")
        _, draft = self._fs(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        fs.mkdirs(target.getParent())
        try:
            context = hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(draft, target, self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(draft, False)
            return False
        return True

    def _read(self, folder: str) -> dict[str, dict]:
        fs, root = self._fs(f"{self.path}/{folder}")
        found = {}
        for x in fs.listStatus(root) if fs.exists(root) else []:
            name = x.getPath().getName()
            if name.startswith("b-"):
                stream = fs.open(x.getPath())
                found[unquote(name[2:])] = json.loads(bytes(stream.readAllBytes()))
                stream.close()
        return found

    def committed(self, batch: str) -> bool:
        fs, target = self._fs(f"{self.path}/commits/b-{quote(batch, safe='')}")
        return fs.exists(target)

    def batches(self) -> list[str]:
        return sorted(self._read("commits"))

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        summed(rows).write.parquet(f"{self.path}/data/{name}")
        return name

    def _delete(self, name: str) -> None:
        fs, target = self._fs(f"{self.path}/data/{name}")
        fs.delete(target, True)

    def apply(self, batch: str, rows: DataFrame) -> bool:
        """Commit the batch; False if it was committed before."""
        if self.committed(batch):
            return False
        name = self._write(rows)
        if self._commit("commits", batch, {"data": name}):
            return True
        self._delete(name)
        return False

    def _live(self) -> tuple[dict, dict]:
        """(the latest base, the commits that it does not hold)."""
        bases = self._read("bases")
        base = bases[max(bases)] if bases else {"data": None, "holds": []}
        held = set(base["holds"])
        return base, {b: c for b, c in self._read("commits").items() if b not in held}

    def _rows(self, base: dict, commits: dict) -> DataFrame:
        paths = [f"{self.path}/data/{x}" for x in [base["data"], *(c["data"] for c in commits.values())] if x]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def totals(self) -> DataFrame:
        return summed(self._rows(*self._live())).where(" or ".join(f"{c} != 0" for c in TOTALS))

    def compact(self) -> bool:
        """Sum all that is committed into a new base. The commits' files stay, as they tell what was sent; their data go.

        Totals that were planned before and not yet computed need those data: compute them first.
        """
        base, commits = self._live()
        if not commits:
            return False
        name = self._write(self._rows(base, commits))
        if not self._commit("bases", f"{len(self._read('bases')) + 1:012d}", {"data": name, "holds": [*base["holds"], *commits]}):
            self._delete(name)  # another driver was first
            return False
        for x in [base, *commits.values()]:
            if x["data"]:
                self._delete(x["data"])
        return True


def rollup(docs: DataFrame) -> DataFrame:
    """Totals of all documents after a whole history, which must equal a plain count under the later version.

    All documents are loaded under the first version, and the batch is sent again; a revision counts them anew under the
    second; what is committed is compacted; then each document goes and comes back, as an edit does, and that is sent again.
    """
    held = Rollup(docs.sparkSession, until_exit(docs.sparkSession, fresh_path(docs.sparkSession, "rollup")))
    load = deltas(docs)
    held.apply("load", load)
    held.apply("load", load)
    held.apply("revision", revision(docs, VERSION, MULTI_VERSION))
    held.compact()
    edits = signed(docs, [(-1, MULTI_VERSION, None), (1, MULTI_VERSION, None)])
    held.apply("edits", edits)
    held.apply("edits", edits)
    return held.totals()
