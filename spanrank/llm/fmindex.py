"""Substring dedup: 13-word windows that also start in a document with a smaller id.

Stretches of windows (see :mod:`spanrank.llm.repeats`) bring together what can be
equal.  The different ones of a shard become one text over word numbers (words told
apart by their bytes); its Burrows-Wheeler transform stands in a wavelet matrix of
packed bits with counts per 64 bits, which is the shard's FM-index, beside the least
document of any interval of suffixes.

The documents' stretches are streamed against it, a block at a time.  Backward search
gives each place its matching statistic: the most words before it, as far as the
threshold, that also stand in a document with a smaller id.  A search ends where its
interval has no such document left, and the places whose statistic reaches the
threshold end the intervals that are reported.

Defined results: a null text has no words; fewer than 13 words lose nothing; rows
with one id are one document to each other; a null id counts as the largest; a very
long text or word is treated like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanrank.llm import repeats
from spanrank.llm.common import LAST
from spanrank.llm.repeats import Shape, U
from spanrank.llm.suffixes import binary, doubled, slices

LENGTH, GRAM = 13, 4


class Bits:
    """Packed bits with the number of ones before each word of 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        part = self.words[word] & ((U(1) << (at & 63).astype(U)) - U(1))
        return self.before[word] + np.bitwise_count(part)


class Wavelet:
    """Symbols by their bits, from the highest down, zeros first at each level."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels = []
        for k in range(self.depth - 1, -1, -1):
            bit = (symbols >> k) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        low = np.zeros_like(at)
        for k, bits in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            one = ((symbols >> k) & 1).astype(bool)
            a, b = bits.ones(low), bits.ones(at)
            low = np.where(one, bits.zeros + a, low - a)
            at = np.where(one, bits.zeros + b, at - b)
        return at - low


class FMIndex:
    """An index over symbols 1 .. sigma - 1, 0 ending each piece; suffixes are in
    order as far as ``reach`` symbols, so patterns may be that long."""

    def __init__(self, text: np.ndarray, sigma: int, reach: int):
        rank = doubled(text, max(1, int(reach - 1).bit_length()))
        self.suffixes = np.argsort(rank, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.wavelet = Wavelet(text[self.suffixes - 1], sigma)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + pattern, from those of the patterns."""
        return self.first[symbol] + self.wavelet.rank(symbol, low), self.first[symbol] + self.wavelet.rank(symbol, high)

    def statistics(self, text: np.ndarray, ends: np.ndarray, owner: np.ndarray, threshold: int) -> np.ndarray:
        """For each end in a streamed text of ``owner`` the most words before it, ``threshold``
        at most, that also stand in a smaller document (``hold`` names the suffixes')."""
        out = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.suffixes), np.int64)
        live = np.arange(len(ends))
        for k in range(threshold):
            symbol = text[ends[live] - 1 - k]
            low, high = self.step(symbol, low, high)
            go = np.flatnonzero((low < high) & (symbol > 0))
            go = go[self.least.between(low[go], high[go]) < owner[live[go]]]
            live, low, high = live[go], low[go], high[go]
            out[live] = k + 1
        return out

    def hold(self, whose: np.ndarray) -> None:
        """Note whose each suffix is."""
        self.least = Least(whose[self.suffixes])


class Least:
    """The least of any interval, from the least of each power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > (half := 1 << (len(self.levels) - 1)):
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least of [low, high), none empty."""
        out, depth = np.empty(len(low), self.levels[0].dtype), np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(depth).tolist():
            here = np.flatnonzero(depth == k)
            out[here] = np.minimum(self.levels[k][low[here]], self.levels[k][high[here] - (1 << k)])
        return out


#: Places searched at once.
STREAMED = 1 << 16


def earlier_elsewhere(blobs: pa.Array, windows: np.ndarray, doc: np.ndarray, dig: np.ndarray, start: np.ndarray, folder: str | None, length: int = LENGTH) -> np.ndarray:
    """True for each window of the blobs that also starts in a document with a smaller id."""
    data, offsets = binary(blobs)
    starts, ends, counts = repeats.words_at(data, offsets)
    distinct, numbers = repeats.distinct_words(data, starts, ends)
    sizes = np.diff(counts)
    at = counts[:-1] + np.arange(len(sizes))  # one mark after each piece
    text = np.zeros(len(starts) + len(sizes), np.int64)
    text[np.repeat(at - counts[:-1], sizes) + np.arange(len(starts))] = numbers + 1
    index = FMIndex(text, len(distinct) + 1, length + 1)
    order = np.unique(doc, return_inverse=True)[1].astype(np.int32)
    index.hold(np.repeat(order, sizes + 1))
    owner = np.repeat(np.arange(len(windows)), windows)
    place = np.repeat(at - (np.cumsum(windows) - windows), windows) + np.arange(len(owner))
    parts = [index.statistics(text, place[k : k + STREAMED] + length, order[owner[k : k + STREAMED]], length) for k in range(0, len(place), STREAMED)]
    return np.concatenate([np.empty(0, np.int64), *parts]) >= length


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, counts = repeats.words_at(data, offsets)
    return repeats.word_symbols(data, starts, ends), counts


def cut(data: np.ndarray, offsets: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    starts, ends, counts = repeats.words_at(data, offsets)
    return slices(data, starts[counts[text] + start], ends[counts[text] + end - 1])


def bounds(blobs: pa.Array, windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """The blobs' bytes; for each window its blob, its place there, and its bytes' start
    and end, one blank between words."""
    data, offsets = binary(blobs)
    starts, ends, counts = repeats.words_at(data, offsets)
    owner = np.repeat(np.arange(len(windows)), windows)
    place = np.arange(len(owner)) - (np.cumsum(windows) - windows)[owner]
    first = counts[owner] + place
    text, to = joined(data, starts, ends)
    return text, owner, place, to[first], to[first + LENGTH] - 1


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one blank after each, and where each starts."""
    sizes = ends - starts + 1
    to = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(int(to[-1]), 32, np.uint8)
    index = np.repeat(starts - to[:-1], sizes) + np.arange(int(to[-1]))
    word = np.ones(len(out), bool)
    word[to[1:] - 1] = False
    out[word] = data[index[word]]
    return out, to


def op9(docs: DataFrame) -> DataFrame:
    shape = Shape(LENGTH, GRAM)
    texts, spans = repeats.repeated_spans(docs, word_rows, cut, bounds, earlier_elsewhere, shape, False, "passages")
    schema = "doc long, n_words long, n_removed long, kept_sha256 string"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in repeats.pieces(batch):
                data, offsets = repeats.utf8(part.column("text"))
                starts, ends, counts = repeats.words_at(data, offsets)
                gone = repeats.covered(np.diff(counts), part.column("spans"), LENGTH)
                kept = np.flatnonzero(~gone)
                out, to = joined(data, starts[kept], ends[kept])
                cuts = np.searchsorted(kept, counts)
                rows = []
                for k, doc in enumerate(part.column("doc").to_pylist()):
                    lo, hi = to[cuts[k]], to[cuts[k + 1]]
                    n = int(counts[k + 1] - counts[k])
                    rows.append((doc, n, n - int(cuts[k + 1] - cuts[k]), hashlib.sha256(out[lo : max(lo, hi - 1)].tobytes()).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=[f.split(" ")[0] for f in schema.split(", ")])

    out = repeats.spans_by_text(texts, spans).select("doc", "text", "spans").mapInArrow(finish, schema)
    return out.select(F.nullif("doc", F.lit(LAST)).alias("doc_id"), "n_words", "n_removed", "kept_sha256")
