"""A folder of text files as a table.

Listing and reading are apart: a listing has no contents, so files whose length and
time match their stamp are never opened.
"""

from __future__ import annotations

import fnmatch
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, root: str, patterns: tuple[str, ...] = ("*.md",)) -> DataFrame:
    """path (relative, with "/"), uri, len, mtime (ns); hidden files and those a
    .gitignore names are left out.

    On a file system Spark alone can read, its own lister is used (which also hides
    names that begin with "_")."""
    local = root.removeprefix("file://")
    if "://" not in local and os.path.isdir(local):
        rows = [(p, f"file://{os.path.abspath(os.path.join(local, p))}", s.st_size, s.st_mtime_ns) for p, s in walk(local, patterns)]
        return spark.createDataFrame(rows, "path string, uri string, len long, mtime long")
    glob = "{" + ",".join(patterns) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/") + "/"
    relative = F.element_at(F.split(F.col("path"), F.lit("\\Q" + base.split("://")[-1] + "\\E"), 2), -1)
    return files.select(relative.alias("path"), F.col("path").alias("uri"), F.col("length").alias("len"), (F.unix_micros("modificationTime") * 1000).alias("mtime"))


def walk(root: str, patterns: tuple[str, ...]):
    """(relative path, stat) of the files, ignore rules applied; an unreadable entry raises."""

    def fail(error: OSError):
        raise error

    rules: list[tuple[str, str, bool]] = []
    for folder, names, files in os.walk(root, onerror=fail):
        here = os.path.relpath(folder, root).replace(os.sep, "/")
        here = "" if here == "." else here + "/"
        if ".gitignore" in files:
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                for line in map(str.strip, f):
                    if line and not line.startswith("#"):
                        rules.append((here, line.lstrip("!"), line.startswith("!")))
        names[:] = sorted(n for n in names if not n.startswith(".") and not ignored(here + n, True, rules))
        for n in sorted(files):
            if not n.startswith(".") and any(fnmatch.fnmatchcase(n, p) for p in patterns) and not ignored(here + n, False, rules):
                yield here + n, os.stat(os.path.join(folder, n))


def ignored(path: str, folder: bool, rules: list[tuple[str, str, bool]]) -> bool:
    out = False
    for base, rule, keep in rules:
        if not path.startswith(base):
            continue
        only_folder, pattern, rest = rule.endswith("/"), rule.rstrip("/"), path[len(base) :]
        met = fnmatch.fnmatchcase(rest, pattern.lstrip("/")) if "/" in pattern else fnmatch.fnmatchcase(rest.rpartition("/")[2], pattern)
        if met and (folder or not only_folder):
            out = not keep
    return out


def changed(files: DataFrame, stamps: DataFrame) -> DataFrame:
    """Files without a stamp of the same length and time."""
    s = stamps.select("path", F.col("len").alias("_l"), F.col("mtime").alias("_m"))
    return files.join(s, "path", "left").where(F.coalesce((F.col("len") != F.col("_l")) | (F.col("mtime") != F.col("_m")), F.lit(True))).drop("_l", "_m")


def contents(files: DataFrame) -> DataFrame:
    """Adds text and hash (64 bits of the bytes) by reading the files' uris, on the executors."""
    spark = files.sparkSession
    uris = [r["uri"] for r in files.select("uri").collect()]  # names of changed files alone
    if not uris:
        return files.withColumn("text", F.lit(None).cast("string")).withColumn("hash", F.lit(None).cast("long")).where("false")
    read = spark.read.format("binaryFile").load([u.replace("[", "\\[").replace("{", "\\{") for u in uris])
    key = lambda c: F.regexp_replace(c, "^file:/+", "/")
    body = read.select(key(F.col("path")).alias("_k"), F.decode("content", "UTF-8").alias("text"), F.xxhash64("content").alias("hash"))
    # Spark's reader leaves out files without contents.
    both = files.withColumn("_k", key(F.col("uri"))).join(body, "_k", "left").where((F.col("len") == 0) | F.col("hash").isNotNull())
    return both.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("hash", F.coalesce("hash", F.xxhash64(F.lit(b"")))).drop("_k")
