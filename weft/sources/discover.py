"""Source files of a tree as a table.

The files are listed and read by Spark's binary source, so the tree may be in any store that Spark reads; files whose names
begin with a dot or an underscore are not listed by it. Folders, patterns, sizes and kinds are column filters on the paths.
Ignore files are read first, they are few, and each of their lines becomes a pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import exprs
from weft.sources.config import Config


def glob_pattern(glob: str, whole_path: bool = False) -> str:
    """A regular expression for a glob; ** crosses folders, * and ? do not."""
    if glob.count("[") != glob.count("]"):
        raise ValueError(f"invalid pattern: {glob}")
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return f"^{out}$" if not whole_path else out


def ignore_rule(line: str, folder: str) -> tuple[bool, str] | None:
    """(ignored, pattern on the relative path) of one line of an ignore file in a folder."""
    line = line.rstrip()
    if not line or line.startswith("#"):
        return None
    ignored = not line.startswith("!")
    line = line.lstrip("!")
    only_folders, anchored = line.endswith("/"), "/" in line.strip("/") or line.startswith("/")
    inner = glob_pattern(line.strip("/"), whole_path=True)
    start = re.escape(folder + "/") if folder else ""
    return ignored, f"^{start}{'' if anchored else '(?:.*/)?'}{inner}{'/.*' if only_folders else '(?:/.*)?'}$"


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(path, "^(?:[a-z]+:)?/*" + re.escape(re.sub("^[a-z]+:", "", root).strip("/")) + "/", "")


def listed(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).withColumn("rel", relative(F.col("path"), root))


def kept(rel: Column, config: Config) -> Column:
    """Not in an excluded folder (generated sources are let in below one), not matching an excluded name."""
    folders = F.slice(F.split(rel, "/"), 1, F.greatest(F.size(F.split(rel, "/")) - 1, F.lit(0)))
    excluded = F.arrays_overlap(folders, F.array(*[F.lit(d) for d in config.excluded_dirs])) if config.excluded_dirs else F.lit(False)
    fine = ~excluded | exprs.generated_allowed(rel, [p.rstrip("/") + "/" for p in config.generated_sources])
    name = F.substring_index(rel, "/", -1)
    for p in config.excluded_patterns:
        fine = fine & ~name.rlike(glob_pattern(p))
    return fine


def ignore_files(spark: SparkSession, root: str, config: Config) -> list[tuple[str, str]]:
    """(folder, text) of the ignore files, outer folders first. Spark's sources do not list hidden files, so the folders are walked."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found, waiting = [], [(path(root), "")]
    while waiting:
        here, rel = waiting.pop(0)
        for child in fs.listStatus(here):
            name = child.getPath().getName()
            if child.isDirectory():
                if name not in config.excluded_dirs:
                    waiting.append((child.getPath(), f"{rel}/{name}".lstrip("/")))
            elif name in config.ignored:
                stream = fs.open(child.getPath())
                found.append((rel, bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")))
                stream.close()
    return found


def discover(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """(path, kind, hash, content) of the tree's files that are to be indexed."""
    config = config or Config()
    files = listed(spark, root)
    rules = []
    for folder, text in ignore_files(spark, root, config):
        rules += [x for line in text.splitlines() if (x := ignore_rule(line, folder))]
    ignored = F.lit(False)
    for on, pattern in rules:  # a later rule overrides an earlier one
        ignored = F.when(F.col("rel").rlike(pattern), on).otherwise(ignored)
    kind = exprs.file_kind("rel")
    chosen = files.where(kept(F.col("rel"), config) & ~ignored & (F.col("length") <= config.max_file_bytes) & (kind != "unknown"))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return chosen.select(F.col("rel").alias("path"), kind.alias("kind"), F.sha2("content", 256).alias("hash"), text.alias("content")).where("content is not null")
