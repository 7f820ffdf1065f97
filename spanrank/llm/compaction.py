"""A store of immutable shards under size-tiered compaction.

Arrivals are appended as they come, as a run of small shards.  When enough runs
of one tier (a power of ``fanout`` of their bytes) have gathered, they are
merged into one run of shards near the target size.  What the store holds is
what the newest manifest names: a manifest is a new file, made under another name
and renamed without overwriting, so a version appears whole or not at all, two
writers can't commit the same version, and readers keep the version they opened:
nothing is deleted by a commit, only by a vacuum, after a time of retention.  A writer
that finds its version taken commits to the next one.  Data moves from executor to
executor only inside Spark; the driver handles names and sizes of shards.

Defined results: an empty arrival commits a run without rows; repeated rows, nulls and
very long texts are kept as they are; runs of equal size are merged together; columns
are the table's own, whatever their names.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrank.llm.common import sha256_hex, shared_dir, text_of

FANOUT, TARGET = 4, 128 << 20
#: Seconds for which a vacuum leaves old versions readable.
RETENTION = 7 * 24 * 3600.0
#: A merge never reads its shards in more pieces than files it writes, times this.
SPLITS = 4


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Run:
    name: str
    files: int
    bytes: int

    def tier(self, fanout: int, unit: int) -> int:
        return max(0, math.floor(math.log(max(1, self.bytes / unit), fanout)))


class Store:
    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT, target: int = TARGET, unit: int = 1 << 20):
        self.spark, self.root, self.fanout, self.target, self.unit = spark, root.rstrip("/"), fanout, target, unit
        self.jvm = spark.sparkContext._jvm
        self.hadoop = self.jvm.org.apache.hadoop
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(self.root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.hadoop.fs.Path(name)

    # -- versions ---------------------------------------------------------
    def version(self) -> int:
        place = self.path(f"{self.root}/manifest")
        if not self.fs.exists(place):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(place)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "runs": []}
        stream = self.fs.open(self.path(f"{self.root}/manifest/v{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, was: dict, runs: list[Run], schema: dict) -> dict:
        new = {"version": was["version"] + 1, "schema": schema, "runs": [vars(r) for r in runs]}
        final, draft = self.path(f"{self.root}/manifest/v{new['version']:08d}.json"), self.path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(json.dumps(new).encode())
        out.close()
        context = self.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.conf) if draft.toUri().getScheme() else self.hadoop.fs.FileContext.getFileContext(self.conf)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
        try:
            context.rename(draft, final, none)
        except Exception as e:
            self.fs.delete(draft, False)
            if self.fs.exists(final):
                raise Conflict(str(final)) from e
            raise
        return new

    # -- contents ---------------------------------------------------------
    def measure(self, name: str) -> Run:
        files = [s.getLen() for s in self.fs.listStatus(self.path(f"{self.root}/{name}")) if s.getPath().getName().endswith(".parquet")]
        return Run(name, len(files), sum(files))

    def add(self, runs: list[Run], schema: dict) -> dict:
        """Commit runs beside what the newest version names, after whichever writer came first."""
        while True:
            was = self.manifest()
            try:
                return self.commit(was, [Run(**r) for r in was["runs"]] + runs, schema)
            except Conflict:  # each one is another writer's progress
                continue

    def append(self, arrivals: DataFrame) -> dict:
        """One arrival: its partitions become one run of small shards."""
        name = f"runs/{uuid.uuid4().hex}"
        arrivals.write.parquet(f"{self.root}/{name}")
        return self.add([self.measure(name)], json.loads(arrivals.schema.json()))

    def append_each(self, arrivals: DataFrame, by: str, compact: bool = True) -> dict:
        """Many arrivals, told by column ``by``, written in one pass and committed
        one after another, each followed by the compaction that is due."""
        name = f"runs/{uuid.uuid4().hex}"
        arrivals.write.partitionBy(by).parquet(f"{self.root}/{name}")
        schema = json.loads(arrivals.drop(by).schema.json())
        parts = sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(f"{self.root}/{name}")) if s.isDirectory())
        last = self.add([], schema) if not parts else {}
        for part in parts:
            last = self.add([self.measure(f"{name}/{part}")], schema)
            if compact:
                last = self.compact()
        return last

    def due(self, runs: list[Run]) -> list[Run]:
        tiers: dict[int, list[Run]] = {}
        for r in runs:
            tiers.setdefault(r.tier(self.fanout, self.unit), []).append(r)
        for _, found in sorted(tiers.items()):
            if len(found) >= self.fanout:
                return found
        return []

    def load(self, runs: list[Run], schema: dict) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(schema)
        if not any(r.files for r in runs):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("basePath", self.root).option("recursiveFileLookup", "true").parquet(*[f"{self.root}/{r.name}" for r in runs])

    def compact(self) -> dict:
        """Merge while a tier has enough runs; each merge is one commit.

        The merged runs stay on disk for those who read older versions, until a
        vacuum.  After a conflict the merge is committed to the version that won, if
        that still names all it merged; else it is dropped and what is due chosen anew."""
        now = self.manifest()
        while chosen := self.due([Run(**r) for r in now["runs"]]):
            name, held = f"runs/{uuid.uuid4().hex}", sum(r.bytes for r in chosen)
            # Whole partitions are joined, nothing is shuffled.
            self.load(chosen, now["schema"]).coalesce(max(1, round(held / self.target))).write.parquet(f"{self.root}/{name}")
            merged, gone = self.measure(name), {r.name for r in chosen}
            while gone <= {r["name"] for r in now["runs"]}:
                kept = [Run(**r) for r in now["runs"] if r["name"] not in gone]
                try:
                    now = self.commit(now, [*kept, merged], now["schema"])
                    break
                except Conflict:
                    now = self.manifest()
            else:
                self.fs.delete(self.path(f"{self.root}/{name}"), True)
        return now

    def vacuum(self, retention: float = RETENTION) -> int:
        """Delete manifests, but for the newest, and runs that no manifest left names,
        all older than ``retention`` seconds; how many went.

        Runs that were written but never committed go by the same rule, so a writer
        must commit within that time."""
        before = time.time() - retention
        newest, named = self.version(), set()
        for s in self.listed("manifest"):
            file = s.getPath().getName()
            if file.startswith("v") and (int(file[1:-5]) == newest or s.getModificationTime() / 1000 > before):
                named |= {r["name"] for r in self.manifest(int(file[1:-5]))["runs"]}
            elif s.getModificationTime() / 1000 <= before:
                self.fs.delete(s.getPath(), False)
        gone = 0
        for s in self.listed("runs"):
            name = f"runs/{s.getPath().getName()}"
            parts = [f"{name}/{x.getPath().getName()}" for x in self.listed(name) if x.isDirectory() and "=" in x.getPath().getName()]
            dead = [n for n in (parts or [name]) if n not in named] if s.getModificationTime() / 1000 <= before else []
            for n in [name] if dead and len(dead) == len(parts or [name]) else dead:
                self.fs.delete(self.path(f"{self.root}/{n}"), True)
            gone += len(dead)
        return gone

    def listed(self, name: str) -> list:
        place = self.path(f"{self.root}/{name}")
        return list(self.fs.listStatus(place)) if self.fs.exists(place) else []

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("the store is empty")
        return self.load([Run(**r) for r in m["runs"]], m["schema"])


def compacted(docs: DataFrame, arrivals: int = 8, target: int = TARGET, unit: int = 1 << 20) -> Store:
    """``docs`` as a store: dealt over ``arrivals`` batches by a digest of the row's id and text."""
    store = Store(docs.sparkSession, f"{shared_dir(docs.sparkSession).rstrip('/')}/store-{uuid.uuid4().hex}", target=target, unit=unit)
    by = "_arrival"
    while by in docs.columns:
        by += "_"
    store.append_each(docs.withColumn(by, F.pmod(F.xxhash64(docs["doc_id"], docs["text"]), F.lit(arrivals))), by)
    store.vacuum(0)  # nobody else has opened it
    return store


def op7(docs: DataFrame) -> DataFrame:
    """Every row as the store's last version gives it, with a digest of its text."""
    kept = compacted(docs).read()
    text = text_of(kept)
    return kept.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), sha256_hex(text).alias("text_sha256"))


