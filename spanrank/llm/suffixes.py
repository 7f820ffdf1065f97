"""Suffix-array dedup: bytes covered by a 100-byte string that starts earlier.

Stretches of windows (see :mod:`spanrank.llm.repeats`) bring together what can be
equal.  The different ones of a shard are laid end to end and their suffixes sorted by
external induction.  A suffix tuple (place, bytes it shares with the tuple before it)
waits in a priority queue by first symbol and then by arrival, which in an induction is
the order of the suffixes; a queue keeps IN_MEMORY tuples and puts the rest on disk, as
runs by symbol, from where they are read back a stretch at a time.  The shard's text
and the finished order are mapped files.

One induction sorts the LMS substrings; their names form a shorter string, which is
sorted by the same induction in turn while its alphabet is small against the number of
buckets a queue can have, and by prefix doubling of the names where it is not.  The
last induction hands common prefixes on: what stands before two suffixes in one bucket
shares one byte more than the least prefix of all tuples scanned between them, a range
minimum that each bucket carries from block to block.

Defined results: a null text is empty; a text under 100 bytes loses nothing; rows
with the same id and text get the same verdict, as one document; rows with one id
and different texts are separate documents; a null id counts as the largest; a very
long text is cut into stretches like any other.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanrank.llm import repeats
from spanrank.llm.common import LAST
from spanrank.llm.repeats import Shape, U, binary

LENGTH, GRAM = 100, 32
#: Grams, of eights of bytes, for stretches of very frequent keys.
FINER = (64, 88)
#: Tuples a queue keeps in memory, and tuples scanned at once.
IN_MEMORY, SCANNED = 1 << 16, 1 << 15
#: Symbols of a string of names up to which it is sorted by induction, if it is so many times longer.
BUCKETS, LONGER = 1 << 13, 16
#: Common prefixes are known as far as this; as a byte, so below 255.
DEEP = LENGTH + 4


class Queue:
    """Suffix tuples by first symbol, then by arrival; what exceeds ``limit`` tuples
    waits on disk.  A tuple is one number, place * 256 + common prefix."""

    def __init__(self, sigma: int, folder: str | None = None, limit: int = IN_MEMORY, kind: type = np.int64):
        self.folder, self.limit, self.held, self.kind, self.files = folder, limit, 0, kind, []
        self.parts: list[list[np.ndarray]] = [[] for _ in range(sigma)]
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []  # on disk: tuples, and where each symbol's start
        self.from_run = np.zeros(sigma, np.int64)  # runs of which a symbol's tuples were taken
        self.spilled = 0

    def push(self, symbol: int, tuples: np.ndarray) -> None:
        if len(tuples):
            self.parts[symbol].append(tuples.astype(self.kind))
            self.held += len(tuples)
            if self.folder and self.held > self.limit:
                self.spill()

    def deal(self, symbols: np.ndarray, tuples: np.ndarray) -> None:
        """``tuples`` by their ``symbols``, which ascend."""
        heads = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1])) if len(symbols) else []
        for lo, hi in zip(heads, [*heads[1:], len(symbols)]):
            self.push(int(symbols[lo]), tuples[lo:hi])

    def spill(self) -> None:
        sizes = np.array([sum(map(len, p)) for p in self.parts])
        name = os.path.join(self.folder, uuid.uuid4().hex + ".npy")
        np.save(name, np.concatenate([x for p in self.parts for x in p]))
        self.files.append(name)
        self.runs.append((np.load(name, mmap_mode="r"), np.concatenate([[0], np.cumsum(sizes)])))
        self.parts = [[] for _ in self.parts]
        self.spilled += self.held
        self.held = 0

    def close(self) -> None:
        """Its files go."""
        self.runs.clear()
        for name in self.files:
            os.remove(name)
        self.files.clear()

    def take(self, symbol: int) -> Iterator[np.ndarray]:
        """The tuples of a symbol that wait now, in order, once, a block at a time."""
        first, self.from_run[symbol] = self.from_run[symbol], len(self.runs)
        parts, self.parts[symbol] = self.parts[symbol], []
        self.held -= sum(map(len, parts))
        yield from together([r[o[symbol] : o[symbol + 1]] for r, o in self.runs[first:]] + parts)

    def falling(self, symbol: int) -> Iterator[np.ndarray]:
        """All tuples of a symbol, the last one first; they stay."""
        yield from together([x[::-1] for x in reversed([r[o[symbol] : o[symbol + 1]] for r, o in self.runs] + self.parts[symbol])])


def together(pieces: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The pieces in order, in blocks of about SCANNED."""
    held: list[np.ndarray] = []
    for x in pieces:
        for at in range(0, len(x), SCANNED):
            held.append(np.asarray(x[at : at + SCANNED]))
            if sum(map(len, held)) >= SCANNED:
                yield np.concatenate(held)
                held = []
    if held:
        yield np.concatenate(held)


def smaller_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S), the last being so."""
    n = len(text)
    differs = np.ones(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    at = np.where(differs, np.arange(n, dtype=np.int32), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal symbols ends
    rises = np.ones(n, bool)
    rises[:-1] = text[:-1] < text[1:]
    return rises[at]


def least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of ``values[lo .. hi]``, both ends in, lo <= hi."""
    if not len(lo):
        return np.empty(0, values.dtype)
    depth = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1  # the greatest power of two inside
    out, level = np.empty(len(lo), values.dtype), values
    for k in range(int(depth.max()) + 1):
        here = np.flatnonzero(depth == k)
        out[here] = np.minimum(level[lo[here]], level[hi[here] - (1 << k) + 1])
        level = np.minimum(level[: -(1 << k)], level[1 << k :]) if len(level) > (1 << k) else level
    return out


class Scan:
    """The suffixes of one pass in order: what stands before each goes to its queue."""

    def __init__(self, text: np.ndarray, is_s: np.ndarray, kind: bool, queue: Queue, sigma: int, told: bool):
        self.text, self.is_s, self.kind, self.queue, self.told = text, is_s, kind, queue, told
        # The least common prefix since a symbol's last tuple; below 0 before its first.
        self.least = np.full(sigma, -1, np.int16)

    def feed(self, places: np.ndarray, shared: np.ndarray, own: int) -> None:
        """``shared``: with the suffix scanned before; ``own``: the symbol of the suffixes."""
        for at in range(0, len(places), SCANNED):
            self.feed_block(places[at : at + SCANNED], shared[at : at + SCANNED], own)

    def feed_block(self, places: np.ndarray, shared: np.ndarray, own: int) -> None:
        before = places - 1
        known = np.flatnonzero(places > 0)
        known = known[self.is_s[before[known]] == self.kind]
        symbols = self.text[before[known]]
        known, symbols = known[symbols != own], symbols[symbols != own]  # see chained
        order = np.argsort(symbols, kind="stable")
        at, symbols = known[order], symbols[order]
        if not self.told:
            return self.queue.deal(symbols, before[at] * 256)
        new = np.append(True, symbols[1:] != symbols[:-1]) if len(at) else np.empty(0, bool)
        least = np.empty(len(at), np.int16)
        heads = np.flatnonzero(new)
        least[heads] = np.minimum(self.least[symbols[heads]], np.minimum.accumulate(shared)[at[heads]])
        rest = np.flatnonzero(~new)
        least[rest] = least_between(shared, at[rest - 1] + 1, at[rest])
        # What the symbols carry on: all of this block, or what is left after their last tuple.
        np.minimum(self.least, shared.min(initial=DEEP), out=self.least)
        if len(at):
            after = np.append(np.minimum.accumulate(shared[::-1])[::-1], DEEP)
            lasts = np.append(heads[1:], len(at)) - 1
            self.least[symbols[lasts]] = after[at[lasts] + 1]
        self.queue.deal(symbols, before[at] * 256 + np.minimum(least + 1, DEEP))


def chained(places: np.ndarray, shared: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A symbol's suffixes that start with it once, in order, and after them those that
    start with runs of it: what a place with ``back`` more of its symbol before it
    induces in its own bucket, run by run, however long the runs."""
    more = back[places]
    if not more.any():
        return places, shared
    who = np.repeat(np.arange(len(places)), more)
    step = 1 + np.arange(len(who)) - np.repeat(np.cumsum(more) - more, more)
    order = np.lexsort((who, step))
    who, step = who[order], step[order]
    new = np.append(True, step[1:] != step[:-1])
    rest = np.flatnonzero(~new)
    own = step.copy()  # the first of a run's length shares the shorter run with the one before
    own[rest] += least_between(shared, who[rest - 1] + 1, who[rest])
    return np.concatenate([places, places[who] - step]), np.concatenate([shared, np.minimum(own, DEEP).astype(np.int16)])


def one(blocks: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places and common prefixes of tuples."""
    x = np.concatenate([np.empty(0, np.int64), *blocks]).astype(np.int64)
    return x >> 8, (x & 255).astype(np.int16)


def induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, shared: np.ndarray | None, sigma: int, folder: str | None, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order and what each shares with the one before it, induced from
    the LMS suffixes in order and what they share (or nothing: the order alone)."""
    n, told = len(text), shared is not None
    shared = shared if told else np.zeros(len(lms), np.uint8)
    cuts = np.searchsorted(text[lms], np.arange(sigma + 1))
    runs = run_lengths(text)
    starts = np.maximum.accumulate(np.where(np.append(True, text[1:] != text[:-1]), np.arange(n, dtype=np.int32), 0))
    back = np.arange(n, dtype=np.int32) - starts
    kind = np.uint32 if n < 1 << 24 else np.int64
    larger, out, rising, waiting = (Queue(sigma, folder, limit, kind) for _ in range(4))
    scan = Scan(text, is_s, False, rising, sigma, told)
    last = np.full(sigma, -1, np.int64)  # the greatest L suffix of each symbol
    for c in range(sigma):
        places, l = one(rising.take(c))
        if len(places):
            l[0] = 0
            places, l = chained(places, l, back)
            larger.push(c, places * 256 + l)
            last[c] = places[-1]
            scan.feed(places, l, c)
        if cuts[c] < cuts[c + 1]:
            places, l = lms[cuts[c] : cuts[c + 1]], shared[cuts[c] : cuts[c + 1]].astype(np.int16)
            l[0] = min(runs[last[c]], runs[places[0]]) if last[c] >= 0 else 0
            scan.feed(places, l, c)
    rising.close()
    waiting.push(int(text[-1]), np.array([(n - 1) * 256], np.int64))  # nothing follows the last suffix to induce it
    scan = Scan(text, is_s, True, waiting, sigma, told)
    for c in range(sigma - 1, -1, -1):
        above = 0
        places, l = one(waiting.take(c))
        if len(places):
            l[0] = 0
            places, l = chained(places, l, back)
            out.push(c, places * 256 + l)
            scan.feed(places, l, c)
            above = min(runs[last[c]], runs[places[-1]]) if last[c] >= 0 else 0
        for x in larger.falling(c):
            l = (x & 255).astype(np.int16)
            l[1:], l[0], above = l[:-1].copy(), above, l[-1]
            scan.feed((x >> 8).astype(np.int64), l, c)
    order, common = mapped(folder, n, np.int32), mapped(folder, n, np.uint8)
    at = 0
    for c in range(sigma):
        first = at
        for x in larger.take(c):
            order[at : at + len(x)], common[at : at + len(x)] = x >> 8, x & 255
            at += len(x)
        middle, above = at, 0
        for x in out.falling(c):  # from the smallest S suffix up: what it shares stands with the one before it
            order[at : at + len(x)] = x >> 8
            l = x & 255
            common[at + 1 : at + len(x)], common[at], above = l[:-1], above, l[-1]
            at += len(x)
        if first < middle < at:
            common[middle] = min(runs[order[middle - 1]], runs[order[middle]])
        if first < at:
            common[first] = 0
    for queue in (larger, out, waiting):
        queue.close()
    return order, common


def mapped(folder: str | None, n: int, kind: type) -> np.ndarray:
    """An array of ``n``, on disk where there is a folder."""
    return np.memmap(os.path.join(folder, uuid.uuid4().hex), kind, "w+", shape=(n,)) if folder and n else np.zeros(n, kind)


def unmapped(*arrays: np.ndarray) -> None:
    """Their files go."""
    for x in arrays:
        if isinstance(x, np.memmap):
            os.remove(x.filename)


def run_lengths(text: np.ndarray) -> np.ndarray:
    """How often each place's symbol follows itself from there, DEEP at most."""
    n = len(text)
    ends = np.where(np.append(text[:-1] != text[1:], True), np.arange(n, dtype=np.int32), n)
    return np.minimum(np.minimum.accumulate(ends[::-1])[::-1] - np.arange(n, dtype=np.int32) + 1, DEEP).astype(np.int16)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each suffix the symbols it shares with the one before it, as far as its own ``most``."""
    out = np.zeros(len(order), np.int32)
    padded = np.concatenate([text.astype(np.uint32 if int(text.max(initial=0)) > 65535 else np.uint16), np.zeros(8, np.uint16)])
    each = 8 // padded.itemsize
    wide = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (len(padded) - each + 1, each), (padded.itemsize,) * 2)).view("<u8").ravel()
    live, depth = np.arange(1, len(order)), 0
    while len(live := live[most[live] > depth]):
        a, b = order[live] + depth, order[live - 1] + depth
        inside = np.maximum(a, b) < len(text)
        live, a, b = live[inside], a[inside], b[inside]
        differ = wide[a] ^ wide[b]
        equal = np.where(differ == 0, each, np.bitwise_count((differ & (~differ + U(1))) - U(1)).astype(np.int64) // (64 // each))
        out[live] = np.minimum(depth + equal, most[live])
        live, depth = live[differ == 0], depth + each
    return out


def doubled(names: np.ndarray, rounds: int) -> np.ndarray:
    """Ranks of the suffixes of a string of names by their first 2 ** rounds names."""
    rank, step = names.astype(np.int64), 1
    for _ in range(rounds):
        after = np.zeros(len(rank), np.int64)
        after[:-step or None] = rank[step:] + 1 if step < len(rank) else 0
        key = rank * (int(rank.max()) + 2) + after
        distinct, rank = np.unique(key, return_inverse=True)
        if len(distinct) == len(rank):
            break
        step *= 2
    return rank


def suffix_order(text: np.ndarray, folder: str | None = None, limit: int = IN_MEMORY, rounds: int = 7, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``text`` (the last symbol 0 and nowhere else) by their suffixes, and
    what each shares with the one before it, as far as DEEP; exact as far as 2 ** rounds
    LMS substrings, so at least 128 symbols, reach."""
    sigma = int(text.max()) + 1
    is_s = smaller_types(text)
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int64)
    if not len(lms):
        return np.arange(len(text), dtype=np.int32)[::-1], np.zeros(len(text), np.uint8)
    start = lms[np.argsort(text[lms], kind="stable")]
    every = induce(text, is_s, start, None, sigma, folder, limit)
    marked = np.zeros(len(text), bool)
    marked[lms] = True
    order = np.asarray(every[0][marked[every[0]]], np.int64)  # the LMS substrings in order
    unmapped(*every)
    ends = np.full(len(text), len(text), np.int64)
    ends[lms[:-1]] = lms[1:] + 1
    size = ends[order] - order
    # Equal substrings get one name: compared symbol by symbol.
    same = np.append(False, (size[1:] == size[:-1]) & (common_prefixes(text, order, size)[1:] >= size[1:]))
    names = np.empty(len(text), np.int64)
    names[order] = np.cumsum(~same) - 1
    short = names[lms]
    alphabet = int(short.max()) + 1
    if alphabet == len(short):
        sorted_ = lms[np.argsort(short, kind="stable")]
    elif alphabet <= buckets and len(short) > LONGER * alphabet and short[-1] == 0 and (short[:-1] > 0).all():
        shorter = suffix_order(short.astype(np.int16), folder, limit, rounds, buckets)
        sorted_ = lms[shorter[0]]
        unmapped(*shorter)
    else:
        sorted_ = lms[np.argsort(doubled(short, rounds), kind="stable")]
    return induce(text, is_s, sorted_, common_prefixes(text, sorted_, np.full(len(sorted_), DEEP)), sigma, folder, limit)


def equal_windows(blobs: pa.Array, windows: np.ndarray, doc: np.ndarray, dig: np.ndarray, start: np.ndarray, folder: str | None, length: int = LENGTH, limit: int = IN_MEMORY) -> np.ndarray:
    """True for each window of the blobs of which an equal one starts earlier."""
    data, offsets = binary(blobs)
    sizes = np.diff(offsets)
    # One separator after each blob; windows end before it.
    at = offsets[:-1] + np.arange(len(sizes))
    text = mapped(folder, len(data) + len(sizes) + 1, np.int16)
    text[:] = 1
    text[np.repeat(at - offsets[:-1], sizes) + np.arange(len(data))] = data.astype(np.int16) + 2
    text[-1] = 0
    order, common = suffix_order(text, folder, limit)
    owner = np.repeat(np.arange(len(windows)), windows)
    heads = np.cumsum(windows) - windows
    place = np.repeat(at - heads, windows) + np.arange(len(owner))
    number = np.full(len(text), -1, np.int32)
    number[place] = np.arange(len(place))
    group = np.cumsum(common < length, dtype=np.int32)
    who = number[order]
    unmapped(text, order, common)
    group, who = group[who >= 0], who[who >= 0]
    places = np.stack([doc[owner[who]], dig[owner[who]], start[owner[who]] + who - heads[owner[who]]])
    best = np.lexsort((places[2], places[1], places[0], group))
    head = np.append(True, group[best][1:] != group[best][:-1]) if len(best) else np.empty(0, bool)
    least = places[:, best][:, np.flatnonzero(head)[np.cumsum(head) - 1]]
    flags = np.zeros(len(owner), bool)
    flags[who[best]] = (places[:, best] != least).any(axis=0)
    return flags


def bytes_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def slices(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    sizes = hi - lo
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    index = np.repeat(lo - offsets[:-1], sizes) + np.arange(int(offsets[-1]))
    return pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[index])])


def cut(data: np.ndarray, offsets: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    return slices(data, offsets[text] + start, offsets[text] + end)


def bounds(blobs: pa.Array, windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """The blobs' bytes; for each window its blob, its place there, and its bytes' start and end."""
    data, offsets = binary(blobs)
    owner = np.repeat(np.arange(len(windows)), windows)
    place = np.arange(len(owner)) - (np.cumsum(windows) - windows)[owner]
    lo = offsets[owner] + place
    return data, owner, place, lo, lo + LENGTH


def op4(docs: DataFrame) -> DataFrame:
    shape = Shape(LENGTH, GRAM, FINER)
    texts, spans = repeats.repeated_spans(docs, bytes_symbols, cut, bounds, equal_windows, shape, True, "suffixes")
    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in repeats.pieces(batch):
                data, offsets = repeats.utf8(part.column("text"))
                gone = repeats.covered(np.diff(offsets), part.column("spans"), LENGTH)
                rows = []
                for doc, lo, hi in zip(part.column("doc").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    off = gone[lo:hi]
                    runs = int(off[:1].sum() + (off[1:] & ~off[:-1]).sum())
                    rows.append((doc, hi - lo, int(off.sum()), runs, hashlib.sha256(data[lo:hi][~off].tobytes()).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=[f.split(" ")[0] for f in schema.split(", ")])

    out = repeats.spans_by_text(texts, spans).select("doc", "text", "spans").mapInArrow(finish, schema)
    return out.select(F.nullif("doc", F.lit(LAST)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
