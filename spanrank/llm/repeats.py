"""Windows that occur more than once: what substring and passage dedup share.

A text is a row of 64-bit symbols (bytes, or digests of words).  Every window of
``length`` symbols has a *key*: the least hash of the ``gram`` grams in it.
Equal windows have equal keys, and neighbouring windows mostly share theirs, so
the windows of a text fall into about ``2 / (length - gram + 2)`` *stretches* per
symbol with one key each.  Only stretches meet in a shuffle, by key:

* stretches of one key with the same content (64 bits of BLAKE2 beside the key) are one
  string with several places: all but the first are repeated as a whole;
* the different strings of one key are *open*: some of their windows may be equal and
  some not.  They go to the caller's index, by key, as bytes, and are compared exactly;
* where a key has very many of them (HOT), as at the edges of a passage that many texts
  share, their windows are cut into stretches anew by longer grams (``Shape.finer``), of
  which again only the open ones go to the index as bytes; what has a very frequent key
  even then is dealt singly, by the window's own digest, still as bytes and to the same
  index.

Copies inside one batch of rows are merged before the shuffle, so a passage
that a third of all rows share sends one row per batch, not one per copy.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import os
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanrank.llm.common import LAST, let_go, materialise, ship

U = np.uint64
C1, C2, C3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
BASE = U(0x5851F42D4C957F2D)
INVERSE = U(pow(int(BASE), -1, 2**64))
#: Symbols worked on at once; longer texts are cut with an overlap of one window.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * C2
    x ^= x >> U(27)
    x *= C3
    x ^= x >> U(31)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i for i < n."""
    if len(_powers.get("up", ())) < max(n, 1):
        for name, b in (("up", BASE), ("down", INVERSE)):
            x = np.full(max(n, 1), b, U)
            x[0] = U(1)
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Sums from which :func:`digest` gives any slice's digest."""
    out = np.zeros(len(symbols) + 1, U)
    np.cumsum(symbols * powers(len(symbols))[0], out=out[1:])
    return out


def digest(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Digests of short slices [start, end) of digests; not for long ones, as some
    strings of 1,024 and more symbols have equal sums whatever the symbols are."""
    down = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * C1)


def strong(data: bytes, start: np.ndarray, end: np.ndarray, size: int = 8) -> np.ndarray:
    """BLAKE2 digests of the slices [start, end), as one or two numbers each."""
    make = hashlib.blake2b
    out = b"".join([make(data[a:b], digest_size=size).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(out, U).reshape(-1, size // 8) if size > 8 else np.frombuffer(out, U)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls and its n + 1 offsets."""
    _, offsets, data = blobs.buffers()
    offsets = np.frombuffer(offsets, np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words_at(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of words before it."""
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = is_space(data)
    before = np.ones(len(data) + 1, bool)
    before[1:] = gap[:-1]
    head = np.zeros(len(data) + 1, bool)
    head[offsets] = True  # words end where texts do
    starts = np.flatnonzero(~gap & (before | head))
    ends = np.flatnonzero((gap | head)[1:] & ~gap[:-1]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def coded_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The words with the white space behind them as a list of different ones, and for
    each word its place in it.  Arrow tells them apart by their bytes; none is moved."""
    if not len(starts):
        return [], np.empty(0, np.int64)
    offsets = np.append(starts, ends[-1]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


BLANK = b" \t\n\v\f\r"


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different words, and for each word the number of its own."""
    words, coded = coded_words(data, starts, ends)
    number: dict[bytes, int] = {}
    same = np.array([number.setdefault(w.rstrip(BLANK), len(number)) for w in words], np.int64)
    return list(number), same[coded]


def word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests (XXH3, 64 bits) of the words' bytes, and for each word the place of its own."""
    words, coded = coded_words(data, starts, ends)
    make = xxhash.xxh3_64_intdigest
    return np.fromiter((make(w.rstrip(BLANK)) for w in words), U, len(words)), coded


def word_symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A digest of each word's bytes."""
    digests, coded = word_digests(data, starts, ends)
    return digests[coded]


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` consecutive symbols."""
    n = len(symbols) - gram + 1
    if symbols.dtype == np.uint8:  # eight bytes at a time
        wide = np.lib.stride_tricks.as_strided(symbols, (len(symbols) - 7, 8), (1, 1))
        eight = np.ascontiguousarray(wide).view("<u8").ravel()
        out = np.full(n, C1, U)
        for k in range(0, gram, 8):
            out = (out ^ eight[k : k + n]) * C2
            out ^= out >> U(29)
        return mix(out)
    out = np.full(n, C1, U)
    for k in range(gram):
        out = (out ^ symbols[k : k + n]) * C2
        out ^= out >> U(29)
    return mix(out)


def sliding(least: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """The least (or greatest) of each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = least(x[:-done], x[done:])
        done *= 2
    return least(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def twice_near(grams: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
    """Places of grams that are the least of some window and come again
    within ``width``: only there can a stretch hold a window twice."""
    least = np.concatenate([np.zeros(width - 1, U), keys, np.zeros(width - 1, U)])
    at = np.flatnonzero(sliding(np.maximum, least, width) == grams)
    return at[:-1][(grams[at[1:]] == grams[at[:-1]]) & (np.diff(at) <= width)]


@dataclass
class Shape:
    length: int
    gram: int
    finer: tuple[int, ...] = ()  # longer grams for the stretches of very frequent keys

    @property
    def width(self) -> int:
        return self.length - self.gram + 1


def stretches(symbols: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """(text, start, windows, key, content, own) of every stretch of the texts laid
    end to end; own: the stretch may hold a window twice."""
    found = []
    n, at, edge = len(symbols), 0, shape.length - 1
    while at + shape.length <= n:
        upto = min(n, at + CHUNK)
        part = symbols[at:upto]
        grams = gram_hashes(part, shape.gram)
        keys = sliding(np.minimum, grams, shape.width)
        first, last = np.searchsorted(offsets, [at, at + len(keys)], "left")
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        new[offsets[first:last] - at] = True
        # Windows across a text's end are its last ones: they only shorten a stretch.
        delta = np.zeros(len(keys) + 1, np.int32)
        ends = offsets[1:]
        np.add.at(delta, np.clip(np.maximum(ends - edge, offsets[:-1]) - at, 0, len(keys)), 1)
        np.add.at(delta, np.clip(ends - at, 0, len(keys)), -1)
        inside = np.cumsum(delta[:-1]) == 0
        starts = np.flatnonzero(new)
        counts = np.add.reduceat(inside.astype(np.int64), starts)
        starts, counts = starts[counts > 0], counts[counts > 0]
        text = np.searchsorted(offsets, starts + at, "right") - 1
        near = twice_near(grams, keys, shape.width)
        own = np.searchsorted(near, starts + counts + shape.width - 2) > np.searchsorted(near, starts)
        content = strong(part.tobytes(), starts * part.itemsize, (starts + counts + edge) * part.itemsize)
        found.append((text, starts + at, counts, keys[starts], content, own))
        if upto == n:
            break
        at = upto - edge
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, U, U, bool))
    text, start, count, key, content, own = (np.concatenate(x) for x in zip(*found, strict=True))
    return text, start - offsets[text], count, key, content, own


STRETCH = "key long, content long, doc long, digest int, start int, windows int, own boolean, seen boolean"
SPANS = "doc long, digest int, start int, windows int"
PLACE = ["key", "doc", "digest", "start", "windows"]
BLOBS = f"key long, {SPANS}, blob binary"


def batch_of(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split(" ")[0] for f in schema.split(", ")])


def text_digest(text: Column) -> Column:
    return F.hash(F.coalesce(text.cast("string"), F.lit("")))


def identified(docs: DataFrame) -> DataFrame:
    """doc (the id, a null the largest number), digest (tells texts of one id apart), text."""
    return docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("doc"),
        text_digest(docs["text"]).alias("digest"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
    )


def trim() -> None:
    """Give freed memory back to the machine: a stage's idle workers would sit on it."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def keep() -> None:
    """Let this worker use freed memory again, until :func:`trim`, in place of new pages for each large array."""
    with contextlib.suppress(OSError, AttributeError):
        for option in (-1, -3):  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
            ctypes.CDLL(None).mallopt(option, 1 << 30)


def pieces(batch: pa.RecordBatch, most: int = 1 << 22, column: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch cut into runs of rows of about ``most`` bytes of text, or of another column."""
    let_go()
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto
    trim()


def repeated_rows(*columns: np.ndarray, last: tuple | None = None) -> np.ndarray:
    """Of sorted rows those equal to the one before: the same place, of a row that stands twice in its table."""
    out = np.ones(len(columns[0]), bool)
    for k, x in enumerate(columns):
        out[1:] &= x[1:] == x[:-1]
        out[:1] &= last is not None and x[:1] == last[k]
    return out


def ordered(key: np.ndarray, content: np.ndarray, doc: np.ndarray, dig: np.ndarray, start: np.ndarray, same_doc: bool) -> tuple[np.ndarray, np.ndarray]:
    """The order of stretches by key, content and place, each place once, and which of
    them have an equal one earlier."""
    columns = (key, content, doc, dig, start)
    order = np.lexsort(columns[::-1])
    order = order[~repeated_rows(*(x[order] for x in columns))]
    key, content, doc = (x[order] for x in columns[:3])
    same = np.zeros(len(order), bool)
    same[1:] = (key[1:] == key[:-1]) & (content[1:] == content[:-1])
    if same_doc:
        return order, same
    # Earlier means in a document with a smaller id.
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else order
    return order, same & (doc != doc[head])


def all_stretches(texts: DataFrame, symbols: Callable, shape: Shape, same_doc: bool) -> DataFrame:
    """The stretches of every text.  ``seen``: an equal one stands earlier in the
    same batch, which settles it.  ``same_doc``: whether an earlier place in the
    same document counts as earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                doc = part.column("doc").to_numpy(zero_copy_only=False)
                dig = part.column("digest").to_numpy(zero_copy_only=False)
                flat, offsets = symbols(*utf8(part.column("text")))
                text, start, count, key, content, own = stretches(flat, offsets, shape)
                order, seen = ordered(key, content, doc[text], dig[text], start, same_doc)
                text, start, count, key, content, own = (x[order] for x in (text, start, count, key, content, own))
                yield batch_of(STRETCH, key.view(np.int64), content.view(np.int64), doc[text], dig[text], start.astype(np.int32), count.astype(np.int32), own & same_doc, seen)

    return texts.mapInArrow(run, STRETCH)


def split_stretches(rows: DataFrame, same_doc: bool) -> DataFrame:
    """Of all stretches: those repeated as a whole (key null), and the open ones
    (first places of the different contents of a key)."""
    schema = "key long, " + SPANS
    sorted_ = rows.where(~F.col("seen")).drop("seen").repartition("key").sortWithinPartitions("key", "content", "doc", "digest", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last key's rows may go on in the next batch: only its first rows per
        # content are held back, and of the content at hand its first document.
        last_key = last_content = last_doc = last = None
        held: list | None = None  # the last key's only open row so far, not yet let go
        for batch in batches:
            key, content, doc, dig, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            windows, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in (5, 6))
            once = ~repeated_rows(key, content, doc, dig, start, last=last)
            if not once.any():
                continue
            last = (key[-1], content[-1], doc[-1], dig[-1], start[-1])
            key, content, doc, dig, start, windows, own = (x[once] for x in (key, content, doc, dig, start, windows, own))
            n = len(key)
            new_key = np.ones(n, bool)
            new_key[1:] = key[1:] != key[:-1]
            new_key[0] = last_key is None or key[0] != last_key
            new = new_key.copy()
            new[1:] |= content[1:] != content[:-1]
            new[0] |= last_content is None or content[0] != last_content
            head = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            first_doc = np.where(head >= 0, doc[np.maximum(head, 0)], last_doc if last_doc is not None else 0)
            whole = ~new if same_doc else ~new & (doc != first_doc)
            # Open: first rows (and, where a document doesn't count against itself, its
            # further copies) of keys with more than one content.
            first = ~whole if not same_doc else new
            group = np.cumsum(new_key) - 1
            contents = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key)) if new_key.any() else np.empty(0, np.int64)
            lead = int(np.flatnonzero(new_key)[0]) if new_key.any() else n  # rows of the key carried over
            several = np.zeros(n, bool)
            if new_key.any():
                several[lead:] = (contents > 1)[group[lead:] - group[lead]]
            carried: list[tuple] = []
            if lead and held is not None:
                more = held[0] + int(new[:lead].sum())
                several[:lead] = more > 1
                if more > 1:
                    carried, held = held[1], [more, []]
                else:
                    held = [more, held[1]]
            if lead < n:  # a new key began: what was held stays alone
                held = None
            open_ = first & (several | own)
            k0 = int(np.flatnonzero(new_key)[-1]) if new_key.any() else 0
            if held is None:
                count = int(new[k0:].sum())
                keep = [] if count > 1 else [(key[i], doc[i], dig[i], start[i], windows[i]) for i in (np.flatnonzero((first & ~own)[k0:]) + k0).tolist()]
                held = [count, keep]
            elif held[0] == 1:
                held[1] += [(key[i], doc[i], dig[i], start[i], windows[i]) for i in np.flatnonzero(first & ~own).tolist()]
            last_key, last_content, last_doc = key[-1], content[-1], first_doc[-1]
            take = np.flatnonzero(whole | open_)
            cols = [key[take], doc[take], dig[take], start[take], windows[take]]
            null = whole[take]
            if carried:
                extra = [np.array(x) for x in zip(*carried, strict=True)]
                cols = [np.concatenate([a, b.astype(a.dtype)]) for a, b in zip(cols, extra, strict=True)]
                null = np.concatenate([null, np.zeros(len(carried), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], mask=null), *map(pa.array, cols[1:])], names=["key", "doc", "digest", "start", "windows"])

    return sorted_.mapInArrow(run, schema)


#: Open stretches of one key up to which they stay whole.
HOT = 4096


def repeated_spans(
    docs: DataFrame,
    symbols: Callable,
    cut: Callable,
    bounds: Callable,
    index: Callable,
    shape: Shape,
    same_doc: bool,
    name: str,
) -> tuple[DataFrame, DataFrame]:
    """The texts (doc, digest, text) and all runs of repeated windows in them
    (doc, digest, start, windows).

    ``symbols(data, offsets)`` gives a batch's symbols and offsets; ``cut(data,
    offsets, text, start, end)`` the bytes of symbol slices as a binary array;
    ``bounds(blobs, windows)`` the bytes of all blobs and where in them each window
    starts and ends; ``index(blobs, windows, doc, digest, start, folder)`` a boolean
    for every window of open stretches with one set of keys, true where an equal one is
    earlier.
    """
    ship(docs.sparkSession)
    texts = identified(docs)
    rows = all_stretches(texts, symbols, shape, same_doc)
    # ``seen`` rows bypass the shuffle by key; both kinds are written once.
    every = materialise(rows, f"{name}-stretches")
    found = materialise(split_stretches(every, same_doc), f"{name}-found")
    whole = every.where("seen").select("doc", "digest", "start", "windows").unionByName(found.where("key is null").select("doc", "digest", "start", "windows"))
    open_ = found.where("key is not null")
    hot = hot_keys(open_)
    names = [*PLACE, "blob"]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                asked = part.column("asked")
                lengths = pc.list_value_length(asked).to_numpy(zero_copy_only=False)
                flat = asked.flatten()
                key, start, windows, hot = (pc.struct_field(flat, i).to_numpy(zero_copy_only=False) for i in range(4))
                text = np.repeat(np.arange(part.num_rows), lengths)
                blob = cut(*utf8(part.column("text")), text, start, start + windows + shape.length - 1)
                doc, dig = (part.column(c).to_numpy(zero_copy_only=False)[text] for c in ("doc", "digest"))
                batch_ = pa.RecordBatch.from_arrays([*map(pa.array, (key, doc, dig, start, windows)), blob], names=names)
                yield batch_.filter(pa.array(~hot))
                for at in range(0, len(many := np.flatnonzero(hot)), 4096):
                    yield singly(batch_.take(pa.array(many[at : at + 4096])), bounds, same_doc)

    def fetched(texts: DataFrame, places: DataFrame) -> DataFrame:
        """The bytes of open stretches (PLACE, hot), hot ones' windows singly."""
        wanted = places.groupBy("doc", "digest").agg(F.collect_list(F.struct("key", "start", "windows", "hot")).alias("asked"))
        # Rows repeated with their id and text give the same places; none counts against itself.
        return texts.join(wanted, ["doc", "digest"]).select("doc", "digest", "text", "asked").mapInArrow(fetch, BLOBS)

    if not shape.finer:
        got = fetched(texts, open_.join(hot, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False))))
    else:
        whole_ones = lambda places: places.select(*PLACE, F.lit(False).alias("hot"))
        if hot.isEmpty():
            got = fetched(texts, whole_ones(open_))
        else:
            # Only texts with hot stretches are dealt a second time: the other open ones are
            # fetched in the plan that deals all texts for their spans, which does so once.
            many = open_.join(hot, "key", "left_semi")
            blobs = materialise(fetched(marked(texts, many), whole_ones(many)), f"{name}-blobs")
            ready, more = by_longer_grams(blobs, symbols, cut, bounds, shape, same_doc, name)
            got = fetched(texts, whole_ones(open_.join(hot, "key", "left_anti"))).unionByName(ready)
            whole = whole.unionByName(more)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled: list[pa.RecordBatch] = []

        def to_sort() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = pc.is_null(batch.column("blob"))
                settled.append(batch.filter(known).select(["doc", "digest", "start", "windows"]))
                yield batch.filter(pc.invert(known))

        for batch in by_key(to_sort()):
            with tempfile.TemporaryDirectory(dir=os.environ.get("TMPDIR")) as folder:
                doc, dig, start, windows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "digest", "start", "windows"))
                flags = index(batch.column("blob"), windows, doc, dig, start, folder)
            yield runs_of(flags, doc, dig, start, windows)
            yield from settled
            settled.clear()
        yield from settled
        trim()

    return texts, whole.unionByName(got.repartition("key").sortWithinPartitions("key").mapInArrow(decide, SPANS))


def hot_keys(open_: DataFrame) -> DataFrame:
    return open_.groupBy("key").count().where(F.col("count") > HOT).select("key", F.lit(True).alias("hot"))


#: Bits of the mark for texts with hot stretches.
MARKS = 1 << 24


def marked(texts: DataFrame, places: DataFrame) -> DataFrame:
    """The texts that have some of the places, and few others: by one bit for each digest
    of id and text, MARKS in all, so that what is sent to all tasks is of a fixed size."""
    bit = F.pmod(F.xxhash64("doc", "digest"), F.lit(MARKS))
    bytes_ = places.select(bit.alias("bit")).groupBy(F.expr("cast(bit div 8 as int)").alias("at")).agg(F.expr("bit_or(shiftleft(1, cast(bit % 8 as int)))").alias("bits")).toArrow()
    marks = np.zeros(MARKS // 8, np.uint8)
    marks[bytes_.column("at").to_numpy()] = bytes_.column("bits").to_numpy()
    held = texts.sparkSession.sparkContext.broadcast(marks)

    @F.arrow_udf("boolean")
    def some(bit: pa.Array) -> pa.Array:
        at = bit.to_numpy(zero_copy_only=False)
        return pa.array((held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return texts.where(some(bit))


def by_longer_grams(blobs: DataFrame, symbols: Callable, cut: Callable, bounds: Callable, shape: Shape, same_doc: bool, name: str) -> tuple[DataFrame, DataFrame]:
    """The blobs to index, for open stretches with very frequent keys; and spans that are
    settled.  They are cut into shorter stretches by each longer gram in turn.
    Equal windows have equal keys by any gram, so they meet at each step or not at all."""
    ready, settled = [], []
    for gram in shape.finer:
        every = materialise(finer_stretches(blobs, symbols, cut, Shape(shape.length, gram), same_doc), f"{name}-stretches-{gram}")
        found = materialise(split_stretches(every.drop("blob"), same_doc), f"{name}-found-{gram}")
        settled += [x.select(*PLACE[1:]) for x in (every.where("seen"), found.where("key is null"))]
        open_ = found.where("key is not null")
        again = every.where("not seen").select(*PLACE, "blob").join(open_, PLACE).join(hot_keys(open_), "key", "left")
        both = materialise(again.withColumn("hot", F.coalesce("hot", F.lit(False))), f"{name}-blobs-{gram}")
        ready.append(both.where("not hot").drop("hot"))
        blobs = both.where("hot").drop("hot")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                yield singly(batch.slice(at, 4096), bounds, same_doc)

    ready.append(blobs.mapInArrow(windows, BLOBS))
    return reduce(DataFrame.unionByName, ready), reduce(DataFrame.unionByName, settled)


def finer_stretches(blobs: DataFrame, symbols: Callable, cut: Callable, shape: Shape, same_doc: bool) -> DataFrame:
    """The stretches of blobs' windows, with their bytes."""
    schema = STRETCH + ", blob binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, column="blob"):
                doc, dig, first = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "digest", "start"))
                data, offsets = binary(part.column("blob"))
                text, at, count, key, content, own = stretches(*symbols(data, offsets), shape)
                order, seen = ordered(key, content, doc[text], dig[text], first[text] + at, same_doc)
                text, at, count, key, content, own = (x[order] for x in (text, at, count, key, content, own))
                rows = batch_of(STRETCH, key.view(np.int64), content.view(np.int64), doc[text], dig[text], (first[text] + at).astype(np.int32), count.astype(np.int32), own & same_doc, seen)
                yield rows.append_column("blob", cut(data, offsets, text, at, at + count + shape.length - 1))

    return blobs.select(*PLACE, "blob").mapInArrow(run, schema)


def singly(rows: pa.RecordBatch, bounds: Callable, same_doc: bool) -> pa.RecordBatch:
    """The windows of stretches as stretches of their own, by their digest.  Of equal
    ones only the first keeps its bytes; the others are settled: they have none."""
    data, owner, place, lo, hi = bounds(rows.column("blob"), rows.column("windows").to_numpy(zero_copy_only=False))
    key = strong(data.tobytes(), lo, hi)
    doc, dig, start = (rows.column(c).to_numpy(zero_copy_only=False)[owner] for c in ("doc", "digest", "start"))
    start = start + place.astype(np.int32)
    order = np.lexsort((start, dig, doc, key))
    order = order[~repeated_rows(*(x[order] for x in (key, doc, dig, start)))]
    key, doc, dig, start, lo, hi = (x[order] for x in (key, doc, dig, start, lo, hi))
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    if not same_doc:  # earlier means in a document with a smaller id
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(key)))) if len(key) else order
        same &= doc != doc[head]
    blob = pa.array([None if s else data[a:b].tobytes() for s, a, b in zip(same.tolist(), lo.tolist(), hi.tolist(), strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([*map(pa.array, (key.view(np.int64), doc, dig, start, np.ones(len(key), np.int32))), blob], names=["key", "doc", "digest", "start", "windows", "blob"])


def runs_of(flags: np.ndarray, doc: np.ndarray, dig: np.ndarray, start: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    """The runs of flagged windows, the windows of all stretches laid end to end."""
    ends = np.cumsum(windows)
    owner = np.repeat(np.arange(len(windows)), windows)
    place = np.arange(len(owner)) - np.repeat(ends - windows, windows) + np.repeat(start, windows)
    new = flags.copy()
    new[1:] &= ~(flags[:-1] & (owner[1:] == owner[:-1]))
    heads, total = np.flatnonzero(new), np.concatenate([[0], np.cumsum(flags)])
    upto = np.append(heads[1:], len(flags)) if len(heads) else heads
    return batch_of(SPANS, doc[owner[heads]], dig[owner[heads]], place[heads].astype(np.int32), (total[upto] - total[heads]).astype(np.int32))


#: Bytes of open stretches indexed together.
SHARD = 1 << 20


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut anew so that no key is in two of them; a key has HOT different
    stretches at most, or one window, once from each batch that had it."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < SHARD:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = whole.column("key").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(key[1:] != key[:-1]) + 1
        if not len(edges):
            held = [whole]
            continue
        last = int(edges[-1])
        lens = np.cumsum(pc.binary_length(whole.column("blob")).to_numpy(zero_copy_only=False))
        at = 0
        while at < last:
            goal = (lens[at - 1] if at else 0) + SHARD
            ok = edges[(edges > at) & (lens[edges - 1] <= goal)]
            upto = int(ok[-1]) if len(ok) else int(edges[edges > at][0])
            yield whole.slice(at, upto - at)
            at = upto
        held = [whole.slice(last)]
        size = held[0].nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def spans_by_text(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Every text with its spans, both sides dealt by id and digest."""
    by = spans.groupBy("doc", "digest").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    return texts.join(by, ["doc", "digest"], "left")


def covered(n: np.ndarray, asked: pa.Array, length: int) -> np.ndarray:
    """A mark for every symbol of texts with ``n`` symbols each, true where a span covers it."""
    asked = pc.fill_null(pc.list_value_length(asked), 0).to_numpy(zero_copy_only=False), asked.flatten()
    offsets = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), asked[0])
    start, windows = (pc.struct_field(asked[1], i).to_numpy(zero_copy_only=False) for i in range(2))
    delta = np.zeros(int(offsets[-1]) + 1, np.int32)
    np.add.at(delta, offsets[text] + start, 1)
    np.add.at(delta, offsets[text] + start + windows + length - 1, -1)
    return np.cumsum(delta[:-1]) > 0
