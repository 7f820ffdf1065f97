"""MinHash near-dedup by ProbMinHash over weighted five-word shingles.

Each shingle has arrivals of a Poisson process at the rate of its weight, with a slot
each, all drawn from the shingle's own hash; a slot keeps the shingle of its first
arrival, and a shingle drops out once its next arrival is later than every slot's.
Two texts agree in a slot with their probability Jaccard, so equal bands of ROWS slots
propose candidates.  Texts are alike by their sets of shingles: with all weights 1
probability Jaccard is just that, so these bands find them with the chance the banding
promises, however often a shingle is repeated.  Texts that repeat shingles have a
second family of bands, by occurrences, which finds those that repeat alike.

Texts with the same words are one node, and nodes that share bands, directly or
through others, are a family.  Every node is verified (exact Jaccard of the
shingle sets, at least 0.8) against its family's centre, the node with the most
company in its bands.  Nodes that fail are few unless a family really falls apart;
they are verified, a block of them at a time, against all of their family, which
streams by.  So every pair that could still join two classes is tested, while only
links that join classes are ever made into rows.

Defined results: a text with one to four words has one shingle, all of them; a
text without words (or null) is in no group and its class is its own id; rows of
one id and text are one document; a null id counts as the largest and gives a
null class unless a group has another; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanrank.llm import repeats
from spanrank.llm.common import LAST, materialise, ship
from spanrank.llm.repeats import C1, C2, C3, U

WORDS, BANDS, ROWS = 5, 24, 5
SLOTS = BANDS * ROWS
#: Similarity, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: Members sent to one copy of a pivot, and unresolved nodes compared at once.
PER_PIVOT, BLOCK = 4096, 1024


def shingles(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight), by text and shingle; ``counts`` are the texts' word offsets."""
    sums = repeats.prefix_sums(words)
    sizes = np.diff(counts)
    number = np.where(sizes == 0, 0, np.maximum(sizes - WORDS + 1, 1))
    text = np.repeat(np.arange(len(sizes)), number)
    start = counts[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    value = repeats.digest(sums, start, np.minimum(start + WORDS, counts[1:][text]))
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, len(text)))


def prob_min_hash(text: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """The shingle in each of ``slots`` slots of each of ``n`` texts (0 where a text has none)."""
    first, kept = np.full(n * slots, np.inf), np.zeros(n * slots, U)
    time = np.zeros(len(value))
    limit = np.full(n, np.inf)
    k = 0
    while len(value):
        k += 1
        x = repeats.mix(value ^ repeats.mix(np.array([k], U)))
        time = time - np.log1p(-((x >> U(11)).astype(np.float64) * 2.0**-53)) / weight
        live = time < limit[text]
        text, value, weight, time, x = text[live], value[live], weight[live], time[live], x[live]
        at = text * slots + (((repeats.mix(x ^ C3) >> U(32)) * U(slots)) >> U(32)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        kept[at[won]] = value[won]
        on = np.unique(text)
        limit[on] = first.reshape(n, slots)[on].max(axis=1)
        live = time < limit[text]
        text, value, weight, time = text[live], value[live], weight[live], time[live]
    return kept.reshape(n, slots)


def binaries(a: np.ndarray, b: np.ndarray, null: np.ndarray) -> pa.Array:
    """16-byte keys from two digests each."""
    data = np.ascontiguousarray(np.stack([a, b], axis=1)).view(np.uint8)
    offsets = np.arange(len(a) + 1, dtype=np.int32) * 16
    valid = pa.py_buffer(np.packbits(~null, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(a), [valid, pa.py_buffer(offsets), pa.py_buffer(data)])


def read_words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word digests, the texts' offsets in them, and each text's node: 128 bits of a digest of all its words."""
    data, offsets = repeats.utf8(part.column("text"))
    starts, ends, counts = repeats.words_at(data, offsets)
    words = repeats.word_symbols(data, starts, ends)
    node = repeats.strong(words.tobytes(), counts[:-1] * 8, counts[1:] * 8, 16)
    return words, counts, binaries(node[:, 0], node[:, 1], np.diff(counts) == 0)


def band_keys(kept: np.ndarray) -> np.ndarray:
    """A key for each band of each text's slots."""
    n = len(kept)
    keys = np.tile(np.arange(BANDS, dtype=U) * C1, (n, 1))
    for r in range(ROWS):
        keys = repeats.mix((keys ^ kept.reshape(n, BANDS, ROWS)[:, :, r]) * C2)
    return keys


def banded(texts: DataFrame) -> DataFrame:
    """doc, digest, node (null without words), bands: by set, and where shingles repeat by occurrences too."""
    schema = "doc long, digest int, node binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in repeats.pieces(batch, 1 << 21):
                words, counts, node = read_words(part)
                n = part.num_rows
                text, value, weight = shingles(words, counts)
                plain = band_keys(prob_min_hash(text, value, np.ones(len(value)), n))
                many = np.bincount(text[weight > 1], minlength=n) > 0
                number = np.cumsum(many) - 1
                some = many[text]
                by = band_keys(prob_min_hash(number[text[some]], value[some], weight[some], int(many.sum())))
                lengths = BANDS * (1 + many)
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                keys = np.empty(int(offsets[-1]), U)
                place = offsets[:-1, None] + np.arange(BANDS)
                keys[place] = plain
                keys[place[many] + BANDS] = by
                bands = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("digest"), node, bands], names=["doc", "digest", "node", "bands"])

    return texts.mapInArrow(run, schema)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """node, set: the sorted shingle digests of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in repeats.pieces(batch, 1 << 21):
                words, counts, node = read_words(part)
                text, value, _ = shingles(words, counts)
                offsets = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
                # In the order of signed numbers.
                sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array((value ^ U(1 << 63)).view(np.int64)))
                yield pa.RecordBatch.from_arrays([node, sets], names=["node", "set"])

    return texts.mapInArrow(run, "node binary, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (pivot, node) those whose Jaccard reaches the threshold.

    Every pair sends its node's set to its pivot; a pivot with many partners is
    copied, one copy for PER_PIVOT of them, so none gathers in one task."""
    salts = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / PER_PIVOT).cast("int").alias("salts"))
    heads = salts.join(sets, salts["pivot"] == sets["node"]).select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("binary").alias("node"), "set")
    rest = pairs.join(salts, "pivot").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    rest = rest.join(sets, "node").select("pivot", "salt", "node", "set")
    dealt = heads.unionByName(rest).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.col("node").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = own = None
        for batch in batches:
            sets_ = batch.column("set")
            flat, cuts = sets_.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(sets_).to_numpy(zero_copy_only=False))])
            out: tuple[list, list] = ([], [])
            for k, (p, node) in enumerate(zip(batch.column("pivot").to_pylist(), batch.column("node").to_pylist(), strict=True)):
                x = flat[cuts[k] : cuts[k + 1]]
                if node is None:
                    pivot, own = p, x.copy()
                elif p == pivot:
                    short, long = (x, own) if len(x) < len(own) else (own, x)
                    at = np.minimum(np.searchsorted(long, short), len(long) - 1)
                    both = int((long[at] == short).sum())
                    if SIMILAR[1] * both >= SIMILAR[0] * (len(x) + len(own) - both):
                        out[0].append(p)
                        out[1].append(node)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], names=["pivot", "node"])

    return dealt.mapInArrow(run, "pivot binary, node binary")


def components(links: DataFrame, name: str = "classes") -> DataFrame:
    """(node, root): the least node each node of the graph can reach.

    Labels spread along links and are looked up in each other (pointer jumping), so
    rounds are few even for long chains; each round's labels are written."""
    edges = materialise(links.select(F.col("pivot").alias("a"), F.col("node").alias("b")).unionByName(links.select(F.col("node").alias("a"), F.col("pivot").alias("b"))).distinct(), name)
    labels = materialise(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), name)
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("best"))
        met = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "best").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = materialise(met.join(up, "root").select("node", "was", F.least("root", "above").alias("root")), name)
        labels = new.select("node", "root")
        if not new.where("was <> root").limit(1).count():
            return labels


def joining(families: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (pivot, node) that join what a family's centre left apart.

    ``families`` has node, family, and whether the node is resolved.  Each block of
    unresolved nodes is held by one task while the family streams by."""
    blocks = families.groupBy("family").agg(F.sum((~F.col("resolved")).cast("long")).alias("left")).where("left > 0").withColumn("blocks", F.ceil(F.col("left") / BLOCK).cast("int"))
    placed = families.join(blocks.select("family", "blocks"), "family").withColumn("own", F.when(~F.col("resolved"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    rows = placed.join(sets, "node").select("family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "own", "resolved", "node", "set")
    rows = rows.withColumn("mine", F.coalesce(F.col("own") == F.col("block"), F.lit(False))).drop("own")
    dealt = rows.repartition("family", "block").sortWithinPartitions("family", "block", F.col("mine").desc(), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, Held()
        for batch in batches:
            sets_ = batch.column("set")
            flat = sets_.flatten().to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(sets_).to_numpy(zero_copy_only=False))])
            nodes, mine, solved = (batch.column(c).to_pylist() for c in ("node", "mine", "resolved"))
            keys = list(zip(batch.column("family").to_pylist(), batch.column("block").to_pylist(), strict=True))
            out: tuple[list, list] = ([], [])
            lo = 0
            while lo < len(keys):
                hi = lo + 1
                while hi < len(keys) and keys[hi] == keys[lo]:
                    hi += 1
                if keys[lo] != block:
                    block, held = keys[lo], Held()
                for k in range(lo, hi):
                    if mine[k]:
                        held.add(nodes[k], flat[cuts[k] : cuts[k + 1]])
                held.compare(nodes[lo:hi], solved[lo:hi], flat[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo], out)
                lo = hi
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], names=["pivot", "node"])

    return dealt.mapInArrow(run, "pivot binary, node binary")


class Held:
    """A block of unresolved nodes, and which of them are joined already."""

    def __init__(self):
        self.nodes: list[bytes] = []
        self.sets: list[np.ndarray] = []
        self.above: dict[bytes, bytes] = {}
        self.words = None

    def add(self, node: bytes, values: np.ndarray) -> None:
        self.nodes.append(node)
        self.sets.append(values.copy())
        self.words = None

    def root(self, x: bytes) -> bytes:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = x = self.above.get(up, up)
        return x

    def compare(self, nodes: list[bytes], solved: list[bool], flat: np.ndarray, cuts: np.ndarray, out: tuple[list, list]) -> None:
        """Each held node with all of ``nodes``; links that join two classes go out."""
        if not self.nodes:
            return
        if self.words is None:
            self.words = np.unique(np.concatenate(self.sets))
            self.codes = [np.searchsorted(self.words, x) for x in self.sets]
        sizes = np.diff(cuts)
        at = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
        known = self.words[at] == flat
        codes, heads = at[known], np.concatenate([[0], np.cumsum(known)])[cuts]
        mark = np.zeros(len(self.words), bool)
        for node, own in zip(self.nodes, self.codes, strict=True):
            mark[own] = True
            sums = np.concatenate([[0], np.cumsum(mark[codes], dtype=np.int64)])[heads]
            mark[own] = False
            both = np.diff(sums)
            for k in np.flatnonzero(SIMILAR[1] * both >= SIMILAR[0] * (sizes + len(own) - both)).tolist():
                # All resolved nodes of a family are in its centre's class.
                a, b = self.root(node), self.root(b"centre" if solved[k] else nodes[k])
                if a != b:
                    self.above[a] = b
                    out[0].append(node)
                    out[1].append(nodes[k])


def classes(docs: DataFrame) -> DataFrame:
    """doc, digest, class (the least id of the class) for every row of ``docs``."""
    ship(docs.sparkSession)
    texts = repeats.identified(docs)
    told = materialise(banded(texts), "bands")
    nodes = told.where("node is not null").groupBy("node").agg(F.min("doc").alias("doc"), F.first("bands").alias("bands"))
    members = materialise(nodes.select("node", "doc", F.explode(F.array_distinct("bands")).alias("key")), "band-members")
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = materialise(members.join(shared, "key"), "band-groups")
    # A band is held together by its member with the most company, so that a family's
    # nodes hang on few others.
    score = materialise(held.groupBy("node").agg(F.sum("n").alias("score"), F.min("doc").alias("doc")), "scores")
    known = held.select("key", "node").join(score.select("node", "score"), "node")
    pivot = known.groupBy("key").agg(F.max(F.struct("score", "node")).alias("pivot"))
    # A node hangs on the best of its bands' pivots alone, and the other ones on that: as
    # many links as nodes, and a few between pivots, however many bands they share.
    own = held.join(pivot, "key").groupBy("node").agg(F.collect_set("pivot").alias("pivots"))
    ends = F.explode(F.array_union(F.array("node"), F.transform("pivots", lambda p: p["node"])))
    hung = own.select(F.array_max("pivots")["node"].alias("pivot"), ends.alias("node")).where("node <> pivot").distinct()
    family = components(hung).withColumnRenamed("root", "family")
    placed = materialise(family.join(score, "node"), "families")
    centre = placed.groupBy("family").agg(F.max_by("node", F.struct("score", "node")).alias("pivot"))
    star = placed.join(centre, "family").where("node <> pivot").select("pivot", "node")
    # The texts of the nodes that have a candidate at all; a node's text is that of its least document.
    sets = materialise(shingle_sets(texts.join(placed.select("doc").distinct(), "doc", "left_semi")).join(placed.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    links = materialise(verified(star, sets), "links")
    solved = links.select("node").unionByName(centre.select(F.col("pivot").alias("node"))).withColumn("yes", F.lit(True))
    families = placed.select("node", "family").join(solved, "node", "left").select("node", "family", F.coalesce("yes", F.lit(False)).alias("resolved"))
    roots = components(links.unionByName(joining(families, sets)))
    where = told.select("doc", "digest", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = where.where("root is not null").groupBy("root").agg(F.min("doc").alias("class"))
    return where.join(least, "root", "left").select("doc", "digest", F.coalesce("class", "doc").alias("class"))


def op5(docs: DataFrame) -> DataFrame:
    """A row per document: its class, and the least id of the class."""
    return classes(docs).select(F.nullif("doc", F.lit(LAST)).alias("doc_id"), F.nullif("class", F.lit(LAST)).alias("class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents whose id is the least of its class, with all their columns."""
    found = classes(docs)
    # A text that another document of the same id has too is told by its digest.
    gone = found.where("doc <> class").select(F.col("doc").alias("_doc"), F.col("digest").alias("_digest")).distinct()
    tagged = docs.withColumn("_k", F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST))).withColumn("_g", repeats.text_digest(docs["text"]))
    return tagged.join(gone, (F.col("_k") == F.col("_doc")) & (F.col("_g") == F.col("_digest")), "left_anti").drop("_k", "_g")
