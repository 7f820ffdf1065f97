"""Arrivals as a stream: files that appear are cut, embedded and committed by micro-batch.

A stream of files shows neither deletions nor renames; :meth:`Index.update` stays
the authority for those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanrank.functions import embed as E
from spanrank.functions import text as T
from spanrank.operators import snapshots
from spanrank.plans.index import PROBE, Index


def arrivals(spark: SparkSession, folder: str, pattern: str = "*.md", per_batch: int = 1000) -> DataFrame:
    """path, text, hash, len and mtime of files as they appear."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    read = source.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(folder)
    base = folder.removeprefix("file://").rstrip("/") + "/"
    return read.select(
        F.regexp_replace("path", "^(file:)?/*" + base.lstrip("/"), "").alias("path"),
        F.decode("content", "UTF-8").alias("text"),
        F.xxhash64("content").alias("hash"),
        F.col("length").alias("len"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime"),
    )


def ingest(index: Index, stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """Commit each micro-batch; a batch that is replayed replaces its own files, so nothing doubles."""

    def commit(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        with index.catalog.lock(60):
            s, base = index.settings, index.catalog.state()["next"]
            made = snapshots.numbered(index.cut(batch.select("path", "text")), base)
            made = made.withColumn("_sent", T.embedded_text(F.col("path"), F.col("text"), s.document_prefix, s.function_prefix))
            made = E.embed(made.drop("text"), "_sent", index.embedder).persist()
            names = batch.select("path")
            print_ = index.embedder.embed([PROBE])[0].tolist()
            space = {"max_chars": s.max_chars, "document_prefix": s.document_prefix, "function_prefix": s.function_prefix, "code": s.code}
            top = made.agg(F.max("slot")).first()[0]
            index.catalog.commit(
                space | {"fingerprint": print_, "dim": len(print_), "query_prefix": s.query_prefix},
                next_slot=base if top is None else int(top) + 1,
                retired={"sections": names, "files": names},
                sections=made.drop("embedding"),
                vectors=made.select("slot", "embedding"),
                files=batch.select("path", "hash", "len", "mtime"),
            )
            made.unpersist()
        batch.unpersist()

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str, key: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by window and key; rows later than the watermark are dropped in a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
