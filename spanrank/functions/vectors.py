"""Vector functions on array columns; sums are in double precision.

These are the exact, composable forms.  :func:`score_batches` ranks many queries
over many rows at once, by blocks of rows in NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Products of the common length, summed."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def normalize(v: Column | str) -> Column:
    """Unit length; a zero vector stays."""
    v = F.col(v) if isinstance(v, str) else v
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def same_space(a: Column, b: Column) -> Column:
    """Their dot product, or 0 if the lengths differ or the second is empty."""
    return F.when((F.size(a) != F.size(b)) | (F.size(b) == 0), F.lit(0.0)).otherwise(dot(a, b))


def score_batches(rows: DataFrame, key: str, embedding: str, queries: np.ndarray, k: int) -> DataFrame:
    """(query, key, score): for each row of ``queries`` the ``k`` best rows, ties by key.

    Each batch sends its ``k`` best of every query at most; the rest is one window."""
    kind = rows.schema[key].dataType.simpleString()
    asked = np.asarray(queries, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            scores = flat.reshape(batch.num_rows, -1) @ asked.T
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            top = np.lexsort((np.broadcast_to(keys, scores.T.shape), -scores.T), axis=1)[:, :k]
            q = np.repeat(np.arange(len(asked)), top.shape[1])
            at = top.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(keys[at]), pa.array(scores[at, q])], names=["query", key, "score"])

    from pyspark.sql import Window

    best = rows.select(key, embedding).where(F.size(embedding) == asked.shape[1]).mapInArrow(run, f"query int, {key} {kind}, score double")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), key)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_by_owner(rows: DataFrame, owner: str, embedding: str, queries: np.ndarray) -> DataFrame:
    """(query, owner, score): the best score that any of an owner's rows has for each query.
    A batch sends one row for each of its owners and queries."""
    kind = rows.schema[owner].dataType.simpleString()
    asked = np.asarray(queries, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            owners, mine = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            best = np.full((len(owners), len(asked)), -np.inf)
            np.maximum.at(best, mine, flat.reshape(batch.num_rows, -1) @ asked.T)
            q = np.tile(np.arange(len(asked), dtype=np.int32), len(owners))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.repeat(owners, len(asked))), pa.array(best.ravel())], names=["query", owner, "score"])

    each = rows.select(owner, embedding).where(F.size(embedding) == asked.shape[1]).mapInArrow(run, f"query int, {owner} {kind}, score double")
    return each.groupBy("query", owner).agg(F.max("score").alias("score"))


def scores(rows: DataFrame, keep: tuple[str, ...], embedding: str, vector) -> DataFrame:
    """The columns ``keep`` and ``score``, the dot product with one query, a batch at a
    time; of vectors of unlike lengths the shorter one's places count."""
    asked = np.asarray(list(vector), np.float64)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(sizes) and (sizes == len(asked)).all():
                # Row by row in one fixed order, so that equal vectors have equal scores.
                out = (flat.reshape(len(sizes), -1) * asked).sum(axis=1) if len(asked) else np.zeros(len(sizes))
            else:
                ends = np.cumsum(sizes)
                out = np.array([(flat[e - n : e][: len(asked)] * asked[:n]).sum() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], np.float64)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(out)], names=[*keep, "score"])

    return rows.select(*keep, embedding).where(F.col(embedding).isNotNull()).mapInArrow(run, f"{kinds}, score double")
