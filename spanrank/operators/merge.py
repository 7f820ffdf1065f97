"""Touching hits of one file merged into ranges to read.

Hits of a file that touch (one ends where the next begins) form an island.  Inside
it the best hit, the later of equals, grows outwards over neighbours that score at
least a floor; the run is one result, and what is left on either side is treated
the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanrank.schema import HITS


@dataclass(frozen=True)
class Rule:
    """The floor: the best score less a share of its distance to the background, or a
    ratio of the best score where there is no background (``keep`` None: always)."""

    keep: float | None = 0.25
    ratio: float = 0.95

    def floor(self, best: float, background: float | None) -> float:
        if self.keep is None or background is None or pd.isna(background):
            return self.ratio * best
        return best - self.keep * max(best - background, 0.0)


def islands(rows: DataFrame) -> DataFrame:
    """Adds ``island``: the number of the touching group within (owner, path)."""
    order = Window.partitionBy("owner", "path").orderBy("start", "rank")
    apart = F.coalesce(F.lag("end").over(order) + 1 != F.col("start"), F.lit(True)).cast("int")
    return rows.withColumn("_apart", apart).withColumn("island", F.sum("_apart").over(order)).drop("_apart")


def runs(scores: list[float], rule: Rule, background: float | None) -> list[tuple[int, int]]:
    """(first, last) of each run of an island, in the order they are found."""
    out, todo = [], [(0, len(scores) - 1)]
    while todo:
        lo, hi = todo.pop()
        if lo > hi:
            continue
        best = max(range(lo, hi + 1), key=lambda i: (scores[i], i))
        floor = rule.floor(scores[best], background)
        first = last = best
        while first > lo and scores[first - 1] >= floor:
            first -= 1
        while last < hi and scores[last + 1] >= floor:
            last += 1
        out.append((first, last))
        todo += [(lo, first - 1), (last + 1, hi)]
    return out


def shared_trail(trails: list[str], sep: str = " > ") -> str:
    """The headings all trails begin with, or the first trail if they share none."""
    split = [t.split(sep) for t in trails]
    common = []
    for parts in zip(*split, strict=False):
        if len(set(parts)) > 1:
            break
        common.append(parts[0])
    return sep.join(common) or trails[0]


def merged(rows: DataFrame, background: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """Hits (owner, path, start, end, score, rank, trail) as merged ranges.

    The rows are a ranking's window, so an island holds at most that many."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["start", "rank"]).reset_index(drop=True)
        ground = group["background"].iloc[0]
        out = []
        for lo, hi in runs(group["score"].tolist(), rule, ground):
            part = group.iloc[lo : hi + 1]
            lines = part["end"] - part["start"] + 1
            score = float((part["score"] * lines).sum() / lines.sum())
            out.append((int(part["owner"].iloc[0]), part["path"].iloc[0], int(part["start"].iloc[0]), int(part["end"].iloc[-1]), score, shared_trail(part["trail"].fillna("").tolist()), len(part)))
        return pd.DataFrame(out, columns=HITS.fieldNames())

    ready = islands(rows.select("owner", "path", "start", "end", "score", "rank", "trail")).join(F.broadcast(background))  # one row
    return ready.groupBy("owner", "path", "island").applyInPandas(one, HITS)


def results(rows: DataFrame, background: DataFrame, limit: int, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """Merged ranges by score, cut to ``limit`` after merging."""
    return merged(rows, background, rule).orderBy(F.col("score").desc(), "owner", "path", "start").limit(limit)
