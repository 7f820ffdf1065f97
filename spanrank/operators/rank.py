"""Exact ranking: filter, anti-join, score, window, dedup, hydrate.

Every row is scored; there is no approximate index.  The order is by score, ties by
(owner, slot), so results never depend on partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanrank.functions import vectors
from spanrank.operators import predicates as P

WINDOW = 128


def hydration_window(limit: int) -> int:
    return max(limit, WINDOW)


def ranked(rows: DataFrame, vector, limit: int, embedding: str = "embedding") -> DataFrame:
    """The best ``limit`` rows with score and rank.

    Only (owner, slot) and vectors are scored and sorted; what else the rows have is read
    for the winners."""
    scored = vectors.scores(rows, ("owner", "slot"), embedding, vector)
    top = scored.orderBy(F.col("score").desc(), "owner", "slot").limit(limit)  # TakeOrderedAndProject
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "owner", "slot")))  # at most ``limit`` rows
    rest = rows.drop(embedding)
    return hydrate(top, rest, limit) if len(rest.columns) > 2 else top


def union_roots(roots: list[DataFrame]) -> DataFrame:
    """Several indexes as one, told apart by ``owner``."""
    return reduce(lambda a, b: a.unionByName(b), [r.withColumn("owner", F.lit(k)) for k, r in enumerate(roots)])


def deduplicated(top: DataFrame, key: list[str]) -> DataFrame:
    """The best-ranked row of each key (a file seen through several roots)."""
    best = Window.partitionBy(*key).orderBy("rank")
    return top.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def background(top: DataFrame) -> DataFrame:
    """One row: the median score of a full window (before dedup), else null."""
    return top.agg(F.when(F.count(F.lit(1)) >= WINDOW, F.median("score")).alias("background"))


def select(rows: DataFrame, where: list[str] = (), exclude: list[str] = (), identity: str = "id") -> DataFrame:
    """Rows that pass the predicates and aren't pointed at by any row, filtered or not."""
    kept = rows.where(P.keeps(P.parse(list(where))[0])) if where else rows
    return P.exclude_pointed_at(kept, rows, list(exclude), identity) if exclude else kept


#: Winners up to which they are sent to the records rather than the records to them.
FEW = 10_000


def hydrate(top: DataFrame, records: DataFrame, limit: int) -> DataFrame:
    """Full records of the winners alone, with score and rank; there are ``limit`` at most."""
    winners = top.select("owner", "slot", "score", "rank")
    return records.join(F.broadcast(winners) if limit <= FEW else winners, ["owner", "slot"])
