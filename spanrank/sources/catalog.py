"""An index on a shared file system: runs that are only ever added, and one pointer.

A commit writes the new rows of each table as a run of their own, beside the paths
whose older rows they retire, and a snapshot that names all runs; then the pointer
moves.  Nothing that was written before is written again, so an update of one file
costs that file's rows.  A row counts while no later run retires its path; vectors are
never retired, as their slots are never given again.  Runs become one when there are
more than RUNS of them, or when the caller commits whole tables.

Readers see the old state or the new one and keep what they opened, until a vacuum.
Writers take a lock file that only one can create.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrank import schema
from spanrank.sources.files import Files

TABLES = {"sections": schema.SECTIONS, "vectors": schema.VECTORS, "files": schema.FILES}
#: Runs up to which a table is read as they are.
RUNS = 32


class Locked(RuntimeError):
    """Another writer holds the index."""


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self.root = self.files.root
        self.files.fs.mkdirs(self.files.path())

    @contextmanager
    def lock(self, wait: float = 0.0):
        until = time.monotonic() + wait
        while not self.files.create("LOCK", json.dumps({"since": time.time()})):
            if time.monotonic() >= until:
                raise Locked(self.root)
            time.sleep(0.05)
        try:
            yield self
        finally:
            self.files.delete("LOCK")

    def current(self) -> str | None:
        return self.files.read("CURRENT")

    def state(self, snapshot: str | None = None) -> dict:
        """What a snapshot names: meta, the runs of each table in order, the paths they retire."""
        snapshot = snapshot or self.current()
        empty = {"meta": {}, "runs": {t: [] for t in TABLES}, "retired": {t: [] for t in TABLES}, "next": 0}
        return json.loads(self.files.read(f"{snapshot}/snapshot.json")) if snapshot else empty

    def meta(self, snapshot: str | None = None) -> dict:
        return self.state(snapshot)["meta"]

    def read(self, table: str, snapshot: str | None = None) -> DataFrame:
        return self.rows(table, self.state(snapshot))

    def rows(self, table: str, state: dict) -> DataFrame:
        kind, runs, retired = TABLES[table], state["runs"][table], state["retired"][table]
        if not runs:
            return self.spark.createDataFrame([], kind)
        one = lambda n: self.spark.read.schema(kind).parquet(f"{self.root}/{n}")
        if not retired:
            return self.spark.read.schema(kind).parquet(*[f"{self.root}/{n}" for _, n in runs])
        rows = reduce(DataFrame.unionByName, [one(n).withColumn("_run", F.lit(k)) for k, n in runs])
        gone = reduce(DataFrame.unionByName, [self.spark.read.schema("path string").parquet(f"{self.root}/{n}").withColumn("_at", F.lit(k)) for k, n in retired])
        last = gone.groupBy(F.col("path").alias("_path")).agg(F.max("_at").alias("_at"))
        return rows.join(last, (rows["path"] == last["_path"]) & (rows["_run"] < last["_at"]), "left_anti").drop("_run")

    def commit(self, meta: dict, replace: bool = False, retired: dict[str, DataFrame] | None = None, next_slot: int | None = None, **tables: DataFrame) -> str:
        """A new snapshot with the rows of ``tables`` added after the paths of ``retired``
        have gone from them; with ``replace`` the tables named are all there is."""
        was, name = self.state(), f"snap-{time.time_ns():020d}-{uuid.uuid4().hex[:6]}"
        number = was.get("number", 0) + 1
        new = {"meta": meta, "number": number, "next": was["next"] if next_slot is None else next_slot, "runs": {}, "retired": {}}
        for t in TABLES:
            new["runs"][t] = [] if replace else list(was["runs"][t])
            new["retired"][t] = [] if replace else list(was["retired"][t])
            if not replace and len(new["runs"][t]) >= RUNS:  # one run of what is left
                self.rows(t, was).write.parquet(f"{self.files.root}/{name}/{t}-whole")
                new["runs"][t], new["retired"][t] = [[number - 1, f"{name}/{t}-whole"]], []
            if t in (retired or {}):
                retired[t].select("path").distinct().coalesce(1).write.parquet(f"{self.root}/{name}/{t}-retired")
                new["retired"][t].append([number, f"{name}/{t}-retired"])
            if t in tables:
                tables[t].select(*TABLES[t].fieldNames()).write.parquet(f"{self.root}/{name}/{t}")
                new["runs"][t].append([number, f"{name}/{t}"])
        self.files.fs.mkdirs(self.files.path(name))
        self.files.create(f"{name}/snapshot.json", json.dumps(new))
        self.files.replace("CURRENT", name)
        return name

    def vacuum(self, keep: int = 2) -> None:
        """Drop all snapshots but the newest, and the runs that none of those names."""
        names = [n for n in self.files.names() if n.startswith("snap-")]
        kept = set(names[-keep:]) | {self.current()}
        named = {run for s in kept if s for x in ("runs", "retired") for runs in self.state(s)[x].values() for _, run in runs}
        for n in names:
            for part in self.files.names(n):
                if f"{n}/{part}" not in named and not (n in kept and part == "snapshot.json"):
                    self.files.delete(f"{n}/{part}")
            if not self.files.names(n):
                self.files.delete(n)

    def inconsistent(self) -> int:
        """Records without a vector."""
        return self.read("sections").join(self.read("vectors"), "slot", "left_anti").count()
