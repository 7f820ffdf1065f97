"""Text into units: markdown sections, division to a budget, fixed windows.

Everything but the division works on arrays of a document's lines inside its row,
so no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanrank.functions import text as T
from spanrank.operators import snapshots
from spanrank.schema import BUDGET

FENCE = r"^(?:```|~~~)"
HEADING = r"^(#{1,6}) (.*)$"


def with_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_lines`` and ``_body``, the line after the front matter (0 if there is none)."""
    out = docs.withColumn("_lines", T.lines(F.col(text)))
    bars = F.filter(
        F.transform("_lines", lambda x, i: F.when(T.trim_end(x) == "---", i)), lambda i: i.isNotNull()
    )
    out = out.withColumn("_bars", bars)
    closed = (F.size("_bars") > 1) & (F.get("_bars", F.lit(0)) == 0)
    return out.withColumn("_body", F.when(closed, F.get("_bars", F.lit(1)) + 1).otherwise(0)).drop("_bars")


def headings(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_heads``: (at, level, title) of the headings outside fences and front matter."""
    lined = with_lines(docs, text).withColumn(
        "_fences",
        F.filter(F.transform("_lines", lambda x, i: F.when(T.trim_start(x).rlike(FENCE) & (i >= F.col("_body")), i)), lambda i: i.isNotNull()),
    )
    found = F.transform(
        "_lines",
        lambda x, i: F.when(
            (i >= F.col("_body")) & x.rlike(HEADING),
            F.struct(
                i.alias("at"), F.length(F.regexp_extract(x, HEADING, 1)).alias("level"), T.trim(F.regexp_extract(x, HEADING, 2)).alias("title")
            ),
        ),
    )
    lined = lined.withColumn("_found", F.filter(found, lambda h: h.isNotNull()))
    outside = F.filter("_found", lambda h: F.size(F.filter("_fences", lambda f: f < h["at"])) % 2 == 0)
    # Without fences nothing has to be counted; and two uses of ``_fences`` keep the
    # optimiser from working it out anew for every heading.
    return lined.withColumn("_heads", F.when(F.size("_fences") == 0, F.col("_found")).otherwise(outside)).drop("_found", "_fences")


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per section: the other columns, start and end (lines from 1), heading,
    breadcrumb, truncated and the section's text."""
    trail = F.expr(
        "aggregate(_heads, struct(cast(array() as array<struct<level:int,title:string>>) as stack, "
        "cast(array() as array<struct<at:int,heading:string,breadcrumb:array<string>>>) as out), (a, h) -> "
        "struct(concat(filter(a.stack, s -> s.level < h.level), array(struct(h.level as level, h.title as title))) as stack, "
        "concat(a.out, array(struct(h.at as at, h.title as heading, "
        "transform(filter(a.stack, s -> s.level < h.level), s -> s.title) as breadcrumb))) as out), a -> a.out)"
    )
    parts = headings(docs, text).withColumn("_trail", trail)
    first = F.coalesce(F.get("_trail", F.lit(0))["at"], F.size("_lines"))
    blank = F.size(F.filter(F.slice("_lines", F.col("_body") + 1, F.greatest(first - F.col("_body"), F.lit(0))), lambda x: T.trim(x) != "")) == 0
    lead = F.array(F.struct(F.col("_body").alias("at"), F.lit(None).cast("string").alias("heading"), F.array().cast("array<string>").alias("breadcrumb")))
    parts = parts.withColumn("_all", F.when(blank, F.col("_trail")).otherwise(F.concat(lead, F.col("_trail"))))
    spans = F.transform(
        "_all",
        lambda s, k: F.struct(
            (s["at"] + 1).alias("start"),
            F.coalesce(F.get("_all", k + 1)["at"], F.size("_lines")).alias("end"),
            s["heading"].alias("heading"),
            s["breadcrumb"].alias("breadcrumb"),
        ),
    )
    rows = parts.withColumn("_s", F.explode(spans))
    body = F.array_join(F.slice("_lines", F.col("_s.start"), F.col("_s.end") - F.col("_s.start") + 1), "\n")
    keep = [c for c in docs.columns if c != text]
    return rows.select(*keep, "_s.start", "_s.end", "_s.heading", "_s.breadcrumb", F.lit(False).alias("truncated"), body.alias("text"))


def pieces(lines: list[str], budget: int) -> list[tuple[int, int, str, bool]]:
    """(first, last, text, truncated) of each piece: whole lines, as many as fit, the
    cut moved back to a blank line in the last fifth if there is one."""
    out, first, n = [], 0, len(lines)
    while first < n:
        size, last = len(lines[first]) + 1, first
        while last + 1 < n and size + len(lines[last + 1]) + 1 <= budget:
            last += 1
            size += len(lines[last]) + 1
        if last + 1 < n:
            back = [i for i in range(first + (last - first) * 4 // 5, last + 1) if not lines[i].strip()]
            last = back[-1] if back else last
        text = "\n".join(lines[first : last + 1])
        out.append((first, last, text[:budget], len(text) > budget))
        first = last + 1
    return out


def divided(units: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Units over the budget cut into pieces with their own ranges.  Only long ones go to Python."""
    kind = "array<struct<first:int,last:int,text:string,truncated:boolean>>"

    @F.udf(kind, useArrow=True)
    def cut(text: str):
        return pieces(text.split("\n"), budget)

    long = units.where(F.length("text") > budget).withColumn("_p", F.explode(cut("text")))
    names = units.columns
    new = {"start": F.col("start") + F.col("_p.first"), "end": F.col("start") + F.col("_p.last"), "text": F.col("_p.text"), "truncated": F.col("_p.truncated")}
    return units.where(F.length("text") <= budget).unionByName(long.select(*[new[c].alias(c) if c in new else F.col(c) for c in names]))


def line_windows(docs: DataFrame, size: int = 40, step: int = 20, text: str = "text") -> DataFrame:
    """Overlapping windows of lines: start, end."""
    n = F.size(T.lines(F.col(text)))
    return docs.withColumn("_n", n).where("_n > 0").withColumn("start", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("_n") - size + step), F.lit(step)))).withColumn(
        "end", F.least(F.col("start") + size - 1, F.col("_n"))
    ).where("start <= _n").drop("_n", text)


def greedy_batches(files: DataFrame, key: str, size: str, want: int, closes_before: bool = False) -> DataFrame:
    """(key, size, batch): a batch is a run of neighbours by ``key``.  It closes with the
    row that brings it to ``want``, or (``closes_before``) before the row that would take
    it beyond ``want``; a row larger than that is a batch of its own.

    A range of rows takes whatever is held where it starts to what is held where it
    ends.  There are about ``want`` such states, and those that close at the same row end
    alike: each range sends a table of the different ones, the driver goes through the
    tables (partitions x ``want`` rows at most), and rows are numbered where they are."""
    kind = files.schema[key].dataType.simpleString()
    ranged = snapshots.stable(files.select(key, F.col(size).cast("long").alias(size)).repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()))

    def step(held: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether a row of size ``n`` closes a batch, and what is held after it."""
        if closes_before:
            over = (held > 0) & (held + n > want)
            return over, np.minimum(np.where(over, 0, held) + n, want + 1)  # beyond the limit all are alike
        over = held + n >= want
        return over, np.where(over, 0, held + n)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.arange(want + 2)
        closed, total, part = np.zeros(len(held), np.int64), 0, None
        for batch in batches:
            for n in batch.column(1).to_pylist():
                over, held = step(held, n)
                closed, total = closed + over, total + n
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
        if part is not None:
            # States that close at the same rows end alike; those that never close only add.
            at = np.flatnonzero(np.append(True, (closed[1:] != closed[:-1]) | (closed[1:] > 0) & (held[1:] != held[:-1])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(at), pa.int32()), pa.array(at), pa.array(closed[at]), pa.array(held[at]), pa.array([total] * len(at), pa.int64())], names=["part", "state", "closed", "held", "total"]
            )

    tables: dict[int, list] = {}
    for r in ranged.mapInArrow(ends, "part int, state long, closed long, held long, total long").collect():
        tables.setdefault(r["part"], []).append(r)
    number, held, begins = 0, 0, {}
    for part in sorted(tables):
        begins[part] = (number, held)
        row = max((r for r in tables[part] if r["state"] <= held), key=lambda r: r["state"])
        number, held = number + row["closed"], min(held + row["total"], want + 1) if not row["closed"] else row["held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            out = []
            for n, part in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                state = state or begins[part]
                over, after = step(np.array([state[1]]), n)
                out.append(state[0] + int(over[0]) if closes_before else state[0])
                state = (state[0] + int(over[0]), int(after[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], names=[key, size, "batch"])

    return ranged.mapInArrow(run, f"{key} {kind}, {size} long, batch int")


def commit_batches(files: DataFrame, want: int = 512) -> DataFrame:
    """A batch number for each file (path, n units): a batch closes with the file that brings
    it to ``want`` units."""
    return greedy_batches(files, "path", "n", want)


def char_batches(units: DataFrame, key: str, chars: str, budget: int = 40_000) -> DataFrame:
    """A batch number for each unit, as many neighbours together as the budget of characters holds."""
    return greedy_batches(units, key, chars, budget, closes_before=True)


def parents(sections: DataFrame) -> DataFrame:
    """Each section as its outermost one: a cutter that keeps what a first heading heads
    together.  Columns path, start, end, heading."""
    top = F.coalesce(F.get("breadcrumb", F.lit(0)), "heading")
    runs = sections.withColumn("_top", F.when(F.size("breadcrumb") == 0, F.col("start")))
    order = Window.partitionBy("path").orderBy("start")
    runs = runs.withColumn("_top", F.coalesce(F.last("_top", ignorenulls=True).over(order), F.lit(0)))
    return runs.groupBy("path", "_top").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by(top, "start").alias("heading")).drop("_top")


def pattern_units(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Units from each line that matches a pattern to the line before the next one: path, start, end, heading."""
    lines = docs.select("path", T.lines(F.col(text)).alias("_l")).withColumn("_n", F.size("_l"))
    heads = lines.withColumn("_h", F.filter(F.transform("_l", lambda x, i: F.when(x.rlike(pattern), F.struct((i + 1).alias("at"), x.alias("line")))), lambda x: x.isNotNull()))
    each = heads.select("path", "_n", "_h", F.posexplode("_h").alias("_i", "_x"))
    return each.select("path", F.col("_x.at").alias("start"), (F.coalesce(F.get("_h", F.col("_i") + 1)["at"], F.col("_n") + 1) - 1).alias("end"), F.trim("_x.line").alias("heading"))


#: Stands in where a corpus has no section to send.
PROSE = "The quick brown fox jumps over the lazy dog and runs on through the wood. "


def longest(sections: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row: the longest section's length, its text as far as the budget, and where the
    text comes from; prose of the budget's length where there are no sections."""
    found = sections.where("text <> ''").agg(F.max(F.length("text")).cast("long").alias("longest"), F.max_by("text", F.struct(F.length("text"), "path", "start")).alias("text"))
    made = (PROSE * (budget // len(PROSE) + 1))[:budget]
    return found.select(F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce(F.substring("text", 1, budget), F.lit(made)).alias("text"), F.when(F.col("text").isNull(), "prose").otherwise("section").alias("origin"))
