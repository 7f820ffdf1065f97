"""The public face: build and update an index, query one or several, extract, report."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrank.functions import embed as E
from spanrank.functions import text as T
from spanrank.operators import code, frontmatter, merge, predicates, rank, snapshots, units
from spanrank.schema import BUDGET
from spanrank.session import ship
from spanrank.sources import corpus
from spanrank.sources.catalog import Catalog

PROBE = "A fixed sentence by which two runs know that they share a vector space."


@dataclass
class Settings:
    """Options, each from the first of: argument, environment, project, user, default."""

    max_chars: int = BUDGET
    query_prefix: str = ""
    document_prefix: str = ""
    function_prefix: str = ""
    code: bool = False
    patterns: tuple[str, ...] = field(default=("*.md",))

    @staticmethod
    def resolve(*layers: dict) -> Settings:
        chosen: dict = {}
        for layer in reversed(layers):
            chosen |= {k: v for k, v in layer.items() if v is not None}
        if "code" in chosen and isinstance(chosen["code"], str):
            chosen["code"] = chosen["code"].strip().lower() in ("1", "true", "yes", "on")
        out = Settings(**chosen)
        out.max_chars = out.max_chars or BUDGET
        if out.code:
            out.patterns = (*out.patterns, *(f"*.{x}" for x in code.LANGUAGES))
        return out


class Index:
    def __init__(self, spark: SparkSession, place: str, embedder=None, settings: Settings | None = None):
        ship(spark)
        self.spark, self.catalog = spark, Catalog(spark, place)
        self.embedder, self.settings = embedder or E.HashEmbedder(), settings or Settings()

    def cut(self, files: DataFrame) -> DataFrame:
        """Files (path, text) into units with front matter, divided to the budget."""
        lined = units.with_lines(files.where(F.endswith("path", F.lit(".md"))).select("path", "text"))
        fms = lined.select("path", frontmatter.fm(F.col("_lines"), F.col("_body")).alias("fm"))
        md = units.sections(files.where(F.endswith("path", F.lit(".md"))).select("path", "text")).join(fms, "path")
        out = md
        if self.settings.code:
            empty = F.create_map().cast("map<string,struct<is_list:boolean,vals:array<string>>>")
            fn = code.functions(files.select("path", "text")).withColumn("breadcrumb", F.array().cast("array<string>")).withColumn("truncated", F.lit(False)).withColumn("fm", empty)
            out = md.unionByName(fn)
        return units.divided(out, self.settings.max_chars)

    def update(self, root: str, rebuild: bool = False, wait: float = 0.0) -> dict:
        """Bring the index up to date with a folder; returns what was done."""
        s = self.settings
        with self.catalog.lock(wait):
            meta, snap = self.catalog.meta(), self.catalog.current()
            print_ = self.embedder.embed([PROBE])[0].tolist()
            space = {"max_chars": s.max_chars, "document_prefix": s.document_prefix, "function_prefix": s.function_prefix, "code": s.code}
            drifted = not np.allclose(np.dot(meta.get("fingerprint") or [0.0] * len(print_), print_), 1, atol=1 - E.FINGERPRINT_FLOOR) if meta and len(meta.get("fingerprint") or []) == len(print_) else bool(meta)
            fresh = rebuild or drifted or any(meta.get(k) != v for k, v in space.items())
            held = {t: self.catalog.read(t, snap) for t in ("sections", "vectors", "files")}
            if fresh:
                held = {t: d.where("false") for t, d in held.items()}
            files = corpus.listing(self.spark, root, s.patterns)
            opened = corpus.contents(corpus.changed(files, held["files"])).persist()
            same = files.join(opened.select("path"), "path", "left_anti").join(held["files"].select("path", "hash"), "path").select("path", "hash", "len", "mtime")
            current = same.unionByName(opened.select("path", "hash", "len", "mtime")).persist()
            difference = snapshots.diff(held["files"], current).persist()
            pairs = snapshots.moves(difference).persist()
            moved = pairs.select(F.col("target").alias("path"))
            new = difference.where("state in ('new', 'changed')").join(moved, "path", "left_anti").join(opened.select("path", "text"), "path")
            made = snapshots.numbered(self.cut(new.select("path", "text")), 0 if fresh else self.catalog.state(snap)["next"])
            made = made.withColumn("_sent", T.embedded_text(F.col("path"), F.col("text"), s.document_prefix, s.function_prefix))
            made = E.embed(made.drop("text"), "_sent", self.embedder).persist()
            # What changes: the rows of changed, vanished and moved files, and the stamps that differ.
            lost = difference.where("state in ('changed', 'gone')").select("path")
            carried = snapshots.renamed(held["sections"].join(pairs.select(F.col("source").alias("path")), "path", "left_semi"), pairs)
            stamps = current.join(held["files"], ["path", "hash", "len", "mtime"], "left_anti")
            old_stamps = held["files"].join(current, ["path", "hash", "len", "mtime"], "left_anti").select("path")
            top = made.agg(F.max("slot")).first()[0]
            after = (0 if fresh else self.catalog.state(snap)["next"]) if top is None else int(top) + 1
            whole = meta | space | {"fingerprint": print_, "dim": len(print_), "query_prefix": s.query_prefix}
            self.catalog.commit(
                whole, replace=fresh, next_slot=after, retired={} if fresh else {"sections": lost, "files": old_stamps},
                sections=carried.unionByName(made.drop("embedding").select(*carried.columns)), vectors=made.select("slot", "embedding"), files=stamps,
            )
            live, rows = self.catalog.read("sections").count(), self.catalog.read("vectors").count()
            dead = rows - live
            if dead > live:  # more dead rows than live ones: everything anew, densely
                sections, vectors = snapshots.compacted(self.catalog.read("sections"), self.catalog.read("vectors"))
                self.catalog.commit(whole, replace=True, next_slot=live, sections=sections, vectors=vectors, files=self.catalog.read("files"))
                dead = 0
            done = {r["state"]: r["count"] for r in difference.groupBy("state").count().collect()}
            for d in (opened, current, difference, pairs, made):
                d.unpersist()
            return {"files": done, "sections": live, "dead": dead, "embedded": made.count(), "held": live - made.count()}

    def rows(self) -> DataFrame:
        return self.catalog.read("sections").join(self.catalog.read("vectors"), "slot")

    def query(self, text: str, where: list[str] = (), exclude_pointed_by: list[str] = (), identity: str = "id", limit: int = 5, others: tuple = ()) -> DataFrame:
        return query([self, *others], text, where, exclude_pointed_by, identity, limit)

    def status(self) -> DataFrame:
        return snapshots.counts(self.catalog.read("sections"))

    def keys(self) -> DataFrame:
        return snapshots.fm_keys(self.catalog.read("sections"))

    def truncated(self) -> DataFrame:
        return self.catalog.read("sections").where("truncated").orderBy("path", "start").select("path", "start", "end")

    def stale(self, hits: DataFrame, root: str) -> DataFrame:
        return snapshots.stale(hits, self.catalog.read("files"), corpus.listing(self.spark, root, self.settings.patterns))

    def extract(self, prefix: str, place: str, destination: str) -> Index:
        """The slice under a folder as an index of its own, once the destination's files prove the same."""
        out = Index(self.spark, place, self.embedder, self.settings)
        if out.catalog.current() is not None or out.catalog.root == self.catalog.root:
            raise ValueError(f"{place} has an index")
        stamps = snapshots.sliced(self.catalog.read("files"), prefix)
        files = corpus.contents(corpus.listing(self.spark, destination, self.settings.patterns))
        bad = snapshots.mismatches(stamps, files).limit(5).collect()
        if bad:
            raise ValueError("; ".join(f"{r['path']}: {r['reason']}" for r in bad))
        sections, vectors = snapshots.compacted(snapshots.sliced(self.catalog.read("sections"), prefix), self.catalog.read("vectors"))
        if not sections.limit(1).count():
            raise ValueError(f"nothing under {prefix}")
        out.catalog.commit(self.catalog.meta(), replace=True, next_slot=sections.count(), sections=sections, vectors=vectors, files=files.join(stamps.select("path"), "path", "left_semi"))
        return out

    def doctor(self, longest: str | None = None) -> dict:
        """Probes of the endpoint, and the budget it accepts."""
        got = E.probe(self.embedder)
        return got | {"max_chars": E.calibrate(self.embedder, longest or "word " * self.settings.max_chars, self.settings.max_chars)}


def query(indexes: list[Index], text: str, where=(), exclude_pointed_by=(), identity: str = "id", limit: int = 5) -> DataFrame:
    """Ranked, merged ranges over several indexes; they must share a vector space."""
    seen, roots = set(), []
    for i in indexes:
        if i.catalog.root not in seen:
            seen.add(i.catalog.root)
            roots.append(i)
    metas = [i.catalog.meta() for i in roots]
    for m in metas[1:]:
        if any(m.get(k) != metas[0].get(k) for k in ("dim", "max_chars", "document_prefix", "query_prefix")) or np.dot(m["fingerprint"], metas[0]["fingerprint"]) < E.FINGERPRINT_FLOOR:
            raise ValueError("the indexes don't share a vector space")
    vector = roots[0].embedder.embed([metas[0].get("query_prefix", "") + text])[0].tolist()
    # Predicates see records alone, the ranking slots and vectors; whole records are read for the winners.
    records = rank.union_roots([i.catalog.read("sections") for i in roots])
    vectors = rank.union_roots([i.catalog.read("vectors") for i in roots])
    chosen = rank.select(records, list(where), list(exclude_pointed_by), identity).select("owner", "slot")
    window = rank.hydration_window(limit)
    top = rank.ranked(vectors.join(chosen, ["owner", "slot"]), vector, window)
    top = rank.hydrate(top, records.drop("fm"), window)
    top = top.withColumn("trail", F.array_join(F.array_append("breadcrumb", F.coalesce("heading", F.lit("(preamble)"))), " > "))
    ground = rank.background(top)
    return merge.results(rank.deduplicated(top, ["owner", "path", "start", "end"]), ground, limit)


def blamed(index: Index, where: list[str]) -> DataFrame:
    """The predicates no record meets by itself, to explain an empty answer."""
    return predicates.blames(index.catalog.read("sections"), predicates.parse(where)[0])
