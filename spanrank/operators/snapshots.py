"""Keeping an index current: what changed between two listings, and what follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """path, state (unchanged, changed, new, gone), old_hash, new_hash of two file tables."""
    a = previous.select("path", F.col("hash").alias("old_hash"))
    b = current.select("path", F.col("hash").alias("new_hash"))
    both = a.join(b, "path", "full_outer")
    state = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash").isNull(), "gone")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged")
        .otherwise("changed")
    )
    return both.select("path", state.alias("state"), "old_hash", "new_hash")


def moves(difference: DataFrame) -> DataFrame:
    """(source, target): files that left and files that came with the same content,
    paired one to one in path order.  A copy is no move: its source is still there."""
    order = lambda h: Window.partitionBy(h).orderBy("path")
    left = difference.where("state = 'gone'").select(F.col("old_hash").alias("h"), F.col("path").alias("source"), F.row_number().over(order("old_hash")).alias("n"))
    came = difference.where("state = 'new'").select(F.col("new_hash").alias("h"), F.col("path").alias("target"), F.row_number().over(order("new_hash")).alias("n"))
    return left.join(came, ["h", "n"]).select("source", "target")


def renamed(sections: DataFrame, pairs: DataFrame) -> DataFrame:
    """Records under their new paths; slots and vectors stay."""
    names = sections.columns
    moved = sections.join(pairs, sections["path"] == pairs["source"], "left")
    return moved.withColumn("path", F.coalesce("target", "path")).select(*names)


def retired(sections: DataFrame, difference: DataFrame, pairs: DataFrame) -> DataFrame:
    """Records without those of changed and vanished files.  A changed file loses its
    records even if it has no units now."""
    lost = difference.where("state in ('changed', 'gone')").select("path").join(pairs.select(F.col("source").alias("path")), "path", "left_anti")
    return sections.join(lost, "path", "left_anti")


def stable(df: DataFrame) -> DataFrame:
    """``df`` such that it is worked out once: checkpointed where the session names a
    shared folder (spark.checkpoint.dir), else kept by this process."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist()


def numbered(units: DataFrame, base: int, order: tuple[str, ...] = ("path", "start")) -> DataFrame:
    """Units with slots from ``base`` on, in order, without bringing them to one task:
    ranges are sorted by themselves and numbered by what the ranges before them hold."""
    ranged = units.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stable(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    held = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("low"))
    # One row a partition: bounded by the number of partitions.
    before = held.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = ranged.join(F.broadcast(before.select("_part", "low", "base")), "_part")
    return out.withColumn("slot", F.col("_id") - F.col("low") + F.col("base") + base).drop("_part", "_id", "low", "base")


def high_water(sections: DataFrame) -> DataFrame:
    return sections.agg((F.coalesce(F.max("slot"), F.lit(-1)) + 1).alias("high_water"))


def compacted(sections: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Live records and vectors numbered densely, in slot order."""
    remap = numbered(sections.select(F.col("slot").alias("old")), 0, ("old",)).select("old", F.col("slot").alias("new"))
    s = sections.join(remap, sections["slot"] == remap["old"]).withColumn("slot", F.col("new")).drop("old", "new")
    v = vectors.join(remap, vectors["slot"] == remap["old"]).withColumn("slot", F.col("new")).drop("old", "new")
    return s, v


def stale(hits: DataFrame, stamps: DataFrame, listing: DataFrame) -> DataFrame:
    """Hits whose file is missing, unstamped, or differs in length or time."""
    a = stamps.select("path", F.col("len").alias("_sl"), F.col("mtime").alias("_sm"))
    b = listing.select("path", F.col("len").alias("_fl"), F.col("mtime").alias("_fm"))
    return hits.join(a, "path", "left").join(b, "path", "left").where(F.coalesce((F.col("_sl") != F.col("_fl")) | (F.col("_sm") != F.col("_fm")), F.lit(True))).drop("_sl", "_sm", "_fl", "_fm")


def counts(sections: DataFrame) -> DataFrame:
    """files (with a section), sections, functions (not of .md files), truncated."""
    return sections.agg(
        F.countDistinct("path").alias("files"),
        F.count(F.lit(1)).alias("sections"),
        F.coalesce(F.sum((~F.col("path").ilike("%.md")).cast("long")), F.lit(0)).alias("functions"),
        F.coalesce(F.sum(F.col("truncated").cast("long")), F.lit(0)).alias("truncated"),
    )


def fm_keys(sections: DataFrame, fm: str = "fm") -> DataFrame:
    return sections.select(F.explode(F.map_keys(fm)).alias("key")).distinct().orderBy("key")


def sliced(sections: DataFrame, prefix: str) -> DataFrame:
    """Records under a folder, with paths relative to it."""
    base = prefix.strip("/") + "/"
    return sections.where(F.startswith("path", F.lit(base))).withColumn("path", F.substring("path", len(base) + 1, 2**31 - 1))


def mismatches(stamps: DataFrame, destination: DataFrame) -> DataFrame:
    """path, reason for stamps that the destination's files don't bear out."""
    d = destination.select("path", F.col("hash").alias("_there"))
    both = stamps.select("path", "hash").join(d, "path", "left")
    reason = F.when(F.col("_there").isNull(), "missing").when(F.col("hash").isNull(), "no hash").when(F.col("hash") != F.col("_there"), "different text")
    return both.withColumn("reason", reason).where("reason is not null").select("path", "reason")


def compatible(meta: DataFrame) -> DataFrame:
    """Whether all roots agree in dim, budget and prefixes, and have a fingerprint if there are several."""
    same = F.count_distinct(F.struct("dim", "max_chars", F.coalesce("prefixes", F.lit("")))) <= 1
    proven = (F.count(F.lit(1)) <= 1) | F.min(F.coalesce(F.length("fingerprint") > 0, F.lit(False)))
    return meta.agg((same & proven).alias("compatible"))


def upserted(stamps: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stamps with those of ``fresh`` in place of their own paths' old ones."""
    return stamps.join(fresh.select("path"), "path", "left_anti").unionByName(fresh)


def forgotten(stamps: DataFrame, difference: DataFrame) -> DataFrame:
    """Stamps without those of vanished files."""
    return stamps.join(difference.where("state = 'gone'").select("path"), "path", "left_anti")


def held_duplicates(top: DataFrame, key: list[str]) -> DataFrame:
    """How many rows a dedup by ``key`` collapses."""
    return top.agg((F.count(F.lit(1)) - F.count_distinct(F.struct(*key))).alias("held"))
