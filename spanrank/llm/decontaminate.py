"""Benchmark decontamination by latent semantic retrieval.

Passages are overlapping windows of words.  TF-IDF weights come from the whole
corpus; a randomised SVD of TF-IDF passages, its products with the passage matrix
summed over executors, gives a latent space in which every passage of every
document is compared by cosine with the benchmark's items.  Near passages are
checked word by word: the longest common subsequence of the item with the passage
and its surroundings must hold most of the item, or half of it together with
nearly all of its answer, which is its last sentence (eight words at least), and half of
those of its words that aren't common, as common ones alone prove little.  Pairs
that can't come to that are left out first, by how many of the item's words that
aren't common are there at all (a bound, not a rule of its own).

An item of more than PIECE words is searched for by its pieces, each with its own
vector and its share of the item's rare words; where one is near, the whole item is
compared with half as many words again as it has, around the place where it would stand.

The items are a stated query set, taken BLOCK at a time, long ones by BLOCK pieces, with
a space for each block and SCAN blocks to a pass over the documents; the spaces are
fitted on every passage of every document and the items, and all of them are searched.
Texts are read once: their words, as the numbers of the items' words, are written to the
shared folder, and all later passes read those.

Defined results: a null or empty text has no passages; an item without words
matches nothing, one of fewer than MIN_ITEM words only as a whole, in order and
without gaps; rows of one id and item count once, with the best share; an empty
corpus or benchmark gives an empty result; a null id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanrank.llm import repeats
from spanrank.llm.common import materialise, ship
from spanrank.llm.repeats import U

#: Words from one passage to the next; a passage has two such strides.
STRIDE = 32
RANK, EXTRA, TINY = 96, 8, 1e-6
#: Power of the inverse document frequency: common words would make all passages of
#: a language alike.  Words of no item have no weight.  Items count so many times in the fit, so that the space holds them.
POWER, EMPHASIS = 2, 20.0
BLOCK, SCAN, MIN_ITEM = 512, 8, 8
#: Bytes of word numbers worked on at once; numbers sorted words are summed by; terms to a partial sum.
CODES, SUMMED, PART = 1 << 18, 1 << 14, 256
#: Most frequent words that are counted as a matrix, and strides at once.
DENSE, AT_ONCE = 256, 512
#: Words of the longest item that the four strides around a passage surely hold.
PIECE = 3 * STRIDE
#: A word of more than this share of all documents is common: it takes no part in bounds.
OFTEN = 0.1
#: An answer is the last sentence, or so many last words where that is shorter.
MIN_ANSWER = 8
NEAR, MOST, HALF, ANSWER = 0.2, 0.7, 0.55, 0.85
#: Bytes of a word that its short key tells apart.
SHORT = 16
#: Bytes to letters: ASCII letters in lower case, digits, what lies beyond ASCII; all else divides words.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def read_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the words in lower case without signs, and the texts' offsets in them."""
    digests, coded, counts = different_words(column)
    return digests[coded], counts


def different_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as different digests and for each word the place of its own, and the offsets."""
    data, starts, ends, counts = placed_words(column)
    return *repeats.word_digests(data, starts, ends), counts


def placed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' letters, where words start and end in them, and the texts' offsets in words."""
    data, offsets = repeats.utf8(column)
    data = np.frombuffer(data.tobytes().translate(LETTERS.tobytes()), np.uint8)
    return data, *repeats.words_at(data, offsets)


def short_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A digest of each word's first and last eight bytes and its length: of words of SHORT
    bytes and less as much as of all bytes."""
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))  # at each byte, with the seven after it
    size = ends - starts
    spare = (8 * np.maximum(8 - size, 0)).astype(U)  # bits of the bytes beyond a word of less than eight
    first = eight[starts + 8] << spare
    return repeats.mix(repeats.mix(first + size.astype(U) * repeats.C1) ^ np.where(size > 8, eight[ends], U(0)))


def tiled(n: int) -> list[tuple[int, int]]:
    """An item's words cut into pieces of equal size, PIECE at most."""
    k = max(1, -(-n // PIECE))
    return [(n * j // k, n * (j + 1) // k) for j in range(k)]


def places(numbers: list[np.ndarray], limbs: int = 0) -> np.ndarray:
    """For each list of word numbers and each different number in it, ascending, a bit
    for each place it stands at, in 64-bit limbs; a row without bits comes first."""
    limbs = limbs or max(1, -(-max(map(len, numbers), default=1) // 64))
    own = [np.unique(x, return_inverse=True) for x in numbers]
    heads = np.concatenate([[1], 1 + np.cumsum([len(x) for x, _ in own])])
    out = np.zeros((int(heads[-1]), limbs), U)
    for head, (_, back) in zip(heads.tolist(), own):
        at = np.arange(len(back))
        np.bitwise_or.at(out, (head + back, at // 64), U(1) << (at % 64).astype(U))
    return out


def in_blocks(asked: list) -> list[Items]:
    """The items in blocks of at most BLOCK pieces, long ones by themselves."""
    counts = np.diff(read_words(pa.array([r[1].lower() for r in asked], pa.string()))[1]).tolist()
    out: list[list] = []
    for long in (False, True):
        room = 0
        for row, n in zip(asked, counts, strict=True):
            if (n > PIECE) == long:
                if room < (k := len(tiled(n))):
                    out.append([])
                    room = max(BLOCK, k)
                out[-1].append(row)
                room -= k
    return [Items([r[0] for r in b], [r[1].lower() for r in b]) for b in out]


class Words:
    """The different words of some texts, numbered from 1."""

    def __init__(self, words: np.ndarray):
        self.known = np.unique(words)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known >> U(44)).astype(np.int64)] = True

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Their numbers, 0 for other words."""
        out = np.zeros(len(words), np.int64)
        if len(self.known):
            maybe = np.flatnonzero(self.filter[(words >> U(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.known, words[maybe]), len(self.known) - 1)
            out[maybe] = np.where(self.known[at] == words[maybe], at + 1, 0)
        return out


class Numbers:
    """The numbers of :class:`Words` for words of texts, of which few have to be digested."""

    def __init__(self, items: Words, texts: list[str]):
        data, starts, ends, _ = placed_words(pa.array(texts, pa.string()))
        digests, coded = repeats.word_digests(data, starts, ends)
        self.items = items
        self.keys, first = np.unique(short_keys(data, starts, ends), return_index=True)
        self.number = np.append(items.numbers(digests[coded][first]), 0)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys >> U(44)).astype(np.int64)] = True

    def of(self, column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers, 0 for other words, and the texts' offsets in them."""
        data, starts, ends, counts = placed_words(column)
        out = np.zeros(len(starts), kind)
        keys = short_keys(data, starts, ends)
        maybe = np.flatnonzero(self.filter[(keys >> U(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        same = self.keys[at] == keys[maybe]
        maybe, at = maybe[same], at[same]
        out[maybe] = self.number[at]
        # Of longer words the bytes between count too.
        long = maybe[ends[maybe] - starts[maybe] > SHORT]
        digests = np.array([xxhash.xxh3_64_intdigest(data[a:b].tobytes()) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)], U)
        out[long] = self.items.numbers(digests)
        return out, counts


class Items(Words):
    """The items of one block, ready for comparison: all of at most PIECE words, or all longer."""

    def __init__(self, ids: list, texts: list[str]):
        words, counts = read_words(pa.array(texts, pa.string()))
        self.ids, self.texts = ids, texts
        self.words = [words[a:b] for a, b in zip(counts[:-1], counts[1:], strict=True)]
        self.lengths = np.diff(counts)
        super().__init__(words)
        self.long = int(self.lengths.max(initial=0)) > PIECE
        # What is searched for: the items, or pieces of them.
        tiles = [(i, lo, hi) for i, n in enumerate(self.lengths.tolist()) for lo, hi in tiled(n)]
        self.piece_item = np.array([i for i, _, _ in tiles], np.int64)
        self.piece_at = np.array([lo for _, lo, _ in tiles], np.int64)
        self.pieces = [self.words[i][lo:hi] for i, lo, hi in tiles]
        self.answers = np.zeros(len(ids), np.int64)  # words of the last sentence
        for i, own in enumerate(self.words):
            last = read_words(pa.array([texts[i].rstrip(" .!?\n").replace("!", ".").replace("?", ".").rpartition(".")[2]], pa.string()))[0]
            self.answers[i] = min(len(own), max(len(last), MIN_ANSWER))
        if self.long:
            return  # their masks are made one by one, over their own words
        each = [self.numbers(w) for w in self.words]
        self.places, self.keys = self.masked(each)
        # The same places, counted from the answer's start, for it alone.
        self.tail_places, self.tail_keys = self.masked([x[len(x) - n :] for x, n in zip(each, self.answers.tolist(), strict=True)])

    def masked(self, each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places of each item's own words, and their keys: item and word number as one."""
        size = len(self.known) + 1
        return places(each), np.concatenate([np.empty(0, np.int64), *[i * size + np.unique(x) for i, x in enumerate(each)]])

    def rows_of(self, keys: np.ndarray, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Rows of word numbers as rows of places: those of the item's own words, 0 for others."""
        out = np.zeros(rows.shape, np.int32)
        at = np.nonzero(rows)
        wanted = which[at[0]] * (len(self.known) + 1) + rows[at]
        found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        out[at] = np.where(keys[found] == wanted, found + 1, 0) if len(keys) else 0
        return out

    def whole(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one item its words' numbers counted from 1 (0: not its own), its places and its answer's."""
        numbers = self.numbers(self.words[i])
        own = np.unique(numbers)
        local = np.zeros(len(self.known) + 1, np.int64)
        local[own] = np.arange(1, len(own) + 1)
        tail = np.zeros((len(own) + 1, -(-len(numbers) // 64)), U)
        last = numbers[len(numbers) - self.answers[i] :]
        tail[local[np.unique(last)]] = places([last], tail.shape[1])[1:]
        return local, places([numbers]), tail

    def bound(self, often: np.ndarray) -> None:
        """Note what a match cannot do without.  ``often`` marks common word numbers, which
        count as there; for each other one, the pieces that have it, and whose answers do."""
        self.rare_of = [np.unique(x[~often[x]]) for x in map(self.numbers, self.words)]
        pieces = [self.numbers(p) for p in self.pieces]
        tails = [] if self.long else [x[len(x) - n :] for x, n in zip(pieces, self.answers.tolist(), strict=True)]
        self.posted, self.tail_posted = self.postings(pieces, often), self.postings(tails, often)
        sizes, lost = np.array([len(x) for x in pieces]), lambda each: np.array([int(often[x].sum()) for x in each], np.int64)
        least = lambda share, n: np.ceil(share * n - 1e-9).astype(np.int64)
        common = lost(pieces)
        # So many of the other words must be there, as each word of the text serves once.
        self.most = np.where(sizes < MIN_ITEM, sizes, least(MOST, sizes)) - common
        self.half = np.where(sizes < MIN_ITEM, sizes, least(HALF, sizes)) - common
        self.tail = np.zeros(len(sizes), np.int64) if self.long else least(ANSWER, self.answers) - lost(tails)
        whole = [self.numbers(w) for w in self.words]
        # Of a long item, as different words in its whole row.
        spare = np.array([len(x) - len(r) for x, r in zip(whole, self.rare_of, strict=True)], np.int64)
        self.need = np.maximum(0, least(HALF, self.lengths) - spare)

    def postings(self, each: list[np.ndarray], often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word number that is not common where its numbers in a list start, and
        the list, of the pieces that have it."""
        pairs = np.array(sorted({(int(n), k) for k, x in enumerate(each) for n in x[~often[x]].tolist()}), np.int64).reshape(-1, 2)
        return np.searchsorted(pairs[:, 0], np.arange(len(self.known) + 2)), pairs[:, 1]

    def hits(self, posted: tuple[np.ndarray, np.ndarray], numbers: np.ndarray, start: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """For each stride and piece: how often posted words of the piece stand between
        the stride before it and the two after it (texts' borders aside).  With ``rows``
        only marked strides have to be right."""
        heads, owner = posted
        at = np.flatnonzero(heads[numbers + 1] > heads[numbers])
        stride = np.searchsorted(start, at, "right") - 1
        if rows is not None:
            near = rows.copy()
            near[1:] |= rows[:-1]
            near[2:] |= rows[:-2]
            near[:-1] |= rows[1:]
            at, stride = at[near[stride]], stride[near[stride]]
        lo, n = heads[numbers[at]], heads[numbers[at] + 1] - heads[numbers[at]]
        row = np.repeat(stride, n)
        item = owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        # A word counts once for a piece, so four strides make at most 128.
        one = np.zeros((len(start), len(self.pieces)), np.uint8)
        np.add.at(one.reshape(-1), row * len(self.pieces) + item, np.uint8(1))
        out = one.copy()
        out[1:] += one[:-1]
        out[:-1] += one[1:]
        out[:-2] += one[2:]
        return out

    def possible(self, close: np.ndarray, numbers: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Of the close strides and pieces those where the words around can make a match."""
        there = self.hits(self.posted, numbers, start, close.any(axis=1))
        bounds = [np.maximum(x, 0).astype(np.uint8) for x in (self.half, self.most, self.tail)]  # PIECE words at most
        half = close & (there >= bounds[0])
        if self.long or not half.any():
            return half
        sure = half & (there >= bounds[1])
        left = half & ~sure
        return sure | left & (self.hits(self.tail_posted, numbers, start, left.any(axis=1)) >= bounds[2])

    def telling(self, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether each row of word numbers has half of the item's words that aren't common."""
        return np.array([np.isin(self.rare_of[i], row).sum() >= HALF * len(self.rare_of[i]) for row, i in zip(rows, which.tolist(), strict=True)], bool)

    def rarely(self, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether each row of word numbers has enough different words of its long item."""
        out = np.zeros(len(rows), bool)
        for k, (row, i) in enumerate(zip(rows, which.tolist(), strict=True)):
            out[k] = np.isin(self.rare_of[i], row).sum() >= self.need[i]
        return out


def coded(texts: DataFrame, items: Numbers | Items) -> DataFrame:
    """doc_id, and the words of the text as numbers of the items' words, end to end."""
    items = Numbers(items, items.texts) if isinstance(items, Items) else items
    kind = code_type(items.items)
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, codes binary"
    held = texts.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        repeats.keep()
        for batch in batches:
            for part in repeats.pieces(batch):
                data, counts = own.of(part.column("text"), kind)
                offsets = (counts * data.itemsize).astype(np.int32)
                codes = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), codes], names=["doc_id", "codes"])

    return materialise(texts.mapInArrow(run, schema), "words")


def code_type(items: Words) -> type:
    return np.uint16 if len(items.known) < 1 << 16 else np.uint32


def read_codes(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers, and the texts' offsets in them."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data.copy().view(kind).astype(np.int64), (offsets - offsets[0]) // np.dtype(kind).itemsize


def document_frequencies(words: DataFrame, items: Words) -> tuple[int, np.ndarray]:
    """Documents with a word, and how many have each word of the items: one number a
    word, summed on the executors."""
    size, kind = len(items.known) + 1, code_type(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in repeats.pieces(batch, CODES, "codes"):
                numbers, counts = read_codes(part.column("codes"), kind)
                at = np.flatnonzero(numbers)
                pairs = np.unique((np.searchsorted(counts, at, "right") - 1) * size + numbers[at])
                total += np.bincount(pairs % size, minlength=size)
                total[0] += int((np.diff(counts) > 0).sum())
        some = np.flatnonzero(total)
        yield repeats.batch_of("term int, n long", some.astype(np.int32), total[some])

    out = np.zeros(size, np.int64)
    for r in words.select("codes").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return int(out[0]), out


def columns_of(weight: np.ndarray) -> np.ndarray:
    """For each word number its column among the DENSE most frequent words, which weigh least, or -1."""
    out = np.full(len(weight), -1, np.int64)
    out[np.argsort(weight[1:], kind="stable")[:DENSE] + 1] = np.arange(min(DENSE, len(weight) - 1))
    return out


def counted(terms: np.ndarray, heads: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often strides have each word with a column, as a matrix; and a mark for the other words.

    Most words of a text are among few: their sums are one matrix product."""
    at, n = columns[terms], int(columns.max(initial=-1)) + 1
    other = at < 0
    stride = np.repeat(np.arange(len(heads) - 1) * n, np.diff(heads))
    out = np.zeros((len(heads) - 1) * n, np.float32)
    np.add.at(out, (stride + at)[~other], np.float32(1))
    return out.reshape(len(heads) - 1, n), other


def strides(terms: np.ndarray, counts: np.ndarray, rows: np.ndarray, columns: np.ndarray | None = None, kept: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, latent vector) of every stride of words, and whether its text
    goes on after it.  ``terms`` are word numbers, ``rows`` their weighted vectors; number
    0, a word of no item, weighs nothing.  ``columns``: see :func:`columns_of`.  ``kept``
    gets what is counted, for AT_ONCE strides at a time."""
    sizes = np.diff(counts)
    number = -(-sizes // STRIDE)
    text = np.repeat(np.arange(len(sizes)), number)
    start = counts[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)) * STRIDE
    vectors = np.empty((len(start), rows.shape[1]), np.float32)
    if not len(start):
        return text, start, vectors, np.empty(0, bool)
    columns = np.full(len(rows), -1, np.int64) if columns is None else columns
    often = rows[np.argsort(columns, kind="stable")[int((columns < 0).sum()) :]]
    used = np.flatnonzero(terms)  # words of no item add nothing
    heads = np.append(np.searchsorted(used, start), len(used))
    for a in range(0, len(start), AT_ONCE):  # some strides at a time, so that the words' rows stay few
        b = min(len(start), a + AT_ONCE)
        own = terms[used[heads[a] : heads[b]]]
        many, other = counted(own, heads[a : b + 1] - heads[a], columns)
        if kept is not None:
            kept.append((own, many, other))
        left = np.append(0, np.cumsum(other))[heads[a : b + 1] - heads[a]]
        vectors[a:b] = np.add.reduceat(rows[np.append(own[other], 0)], left[:-1], axis=0)
        vectors[a:b][left[1:] == left[:-1]] = 0
        vectors[a:b] += many @ often
    return text, start, vectors, np.append(text[1:] == text[:-1], False)


def doubled(vectors: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Each stride's vector plus the next one's of its text."""
    both = vectors.copy()
    both[:-1] += vectors[1:] * more[:-1, None]
    return both


def squared(terms: np.ndarray, counts: np.ndarray, rows: np.ndarray, total: np.ndarray, columns: np.ndarray | None = None) -> None:
    """Add to ``total`` the product of the passages' matrix, turned, and their vectors.

    A passage is two strides, or what the text has; so a word gets the vectors of the
    passages that begin with its stride and with the one before."""
    columns = np.full(len(rows), -1, np.int64) if columns is None else columns
    text, start, vectors, more = strides(terms, counts, rows, columns, kept := [])
    made = doubled(vectors, more)
    made[~more & (start > counts[:-1][text])] = 0  # a last stride is in the passage before
    back = made.copy()
    back[1:] += made[:-1] * more[:-1, None]
    often = np.argsort(columns, kind="stable")[int((columns < 0).sum()) :]
    used = np.flatnonzero(terms)
    heads = np.append(np.searchsorted(used, start), len(used))
    for a, (some, many, other) in zip(range(0, len(start), AT_ONCE), kept, strict=True):
        b = min(len(start), a + AT_ONCE)
        total[often] += many.T @ back[a:b]
        stride = a + np.repeat(np.arange(b - a), np.diff(heads[a : b + 1]))[other]
        some = some[other]
        order = np.argsort(some.astype(np.uint16 if len(rows) < 1 << 16 else np.int64), kind="stable")
        for lo in range(0, len(order), SUMMED):
            at = order[lo : lo + SUMMED]
            own = some[at]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            total[own[first]] += np.add.reduceat(back[stride[at]], first, axis=0)


def latent_spaces(words: DataFrame, every: Words, blocks: list[tuple[Items, np.ndarray]]) -> list[np.ndarray]:
    """For each block an orthonormal base (terms x RANK) by randomised SVD with one power
    step, on all passages of all documents.  Nystrom's form takes the singular values from
    the last product itself, so it needs no third one for them.

    The passage matrix is never formed: each product with it is summed over the
    executors' passages, terms x (RANK + EXTRA) numbers a block and task, and these by
    PART terms on the executors again."""
    kind, schema = code_type(every), "block int, part int, task int, sum binary"
    lookups = [lookup(every, items) for items, _ in blocks]
    columns = [columns_of(weight) for _, weight in blocks]
    context = words.sparkSession.sparkContext

    def products(rights: list[np.ndarray]) -> list[np.ndarray]:
        """A'A right, A the TF-IDF passages of a block."""
        rows = [(weight[:, None] * right).astype(np.float32) for (_, weight), right in zip(blocks, rights, strict=True)]
        held = context.broadcast((rows, lookups, columns))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, lookups, columns = held.value
            repeats.keep()
            totals = [np.zeros(r.shape) for r in rows]
            for batch in batches:
                for piece in repeats.pieces(batch, CODES, "codes"):
                    numbers, counts = read_codes(piece.column("codes"), kind)
                    for own, right, total, often in zip(lookups, rows, totals, columns, strict=True):
                        squared(own[numbers], counts, right, total, often)
            task = TaskContext.get().partitionId()
            for block, total in enumerate(totals):
                for part, at in enumerate(range(0, len(total), PART)):
                    if (some := total[at : at + PART]).any():
                        yield row_of(block, part, task, some.astype(np.float32))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple, np.ndarray] = {}
            for batch in batches:
                for r in batch.to_pylist():
                    key, one = (r["block"], r["part"]), np.frombuffer(r["sum"], np.float32)
                    sums[key] = sums[key] + one if key in sums else one.astype(np.float64)
            for (block, part), total in sums.items():
                yield row_of(block, part, 0, total)

        def row_of(block: int, part: int, task: int, some: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (block, part, task)), pa.array([some.tobytes()], pa.binary())], names=["block", "part", "task", "sum"])

        out = [np.zeros(r.shape) for r in rows]
        for (items, _), right, total in zip(blocks, rows, out, strict=True):
            for x in items.words:
                squared(items.numbers(x), np.array([0, len(x)]), right, total)
            total *= EMPHASIS**2
        # In the tasks' order, so that a sum is the same each time.
        parts = words.select("codes").mapInArrow(run, schema).repartition("block", "part").sortWithinPartitions("block", "part", "task").mapInArrow(add, schema)
        for r in parts.collect():  # one row for PART terms of a block
            at = r["part"] * PART
            out[r["block"]][at : at + PART] += np.frombuffer(r["sum"], np.float64).reshape(-1, out[r["block"]].shape[1])
        held.unpersist()
        return [total * weight[:, None] for total, (_, weight) in zip(out, blocks, strict=True)]

    draw = lambda n: np.random.default_rng(0).standard_normal((n, min(n, RANK + EXTRA)))
    bases = [np.linalg.qr(draw(len(weight)))[0] for _, weight in blocks]
    bases = [np.linalg.qr(x)[0] for x in products(bases)]
    out = []
    for base, made in zip(bases, products(bases), strict=True):
        small = base.T @ made
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        some = values > TINY * values.max(initial=0)
        out.append(np.linalg.svd(made @ (vectors[:, some] / np.sqrt(values[some])), full_matrices=False)[0][:, :RANK])
    return out


def lookup(every: Words, items: Words) -> np.ndarray:
    """For each number of all items' words the number among a block's, or 0."""
    return np.append(0, items.numbers(every.known))


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size == 0, 1, size)


def close_pairs(vectors: np.ndarray, more: np.ndarray, wanted: np.ndarray, near: float) -> np.ndarray:
    """For each stride and unit vector whether their cosine is ``near`` at least, or that of
    the stride and the next one together."""
    out = np.zeros((len(vectors), len(wanted)), bool)
    made = vectors @ wanted.T
    for x, sums in ((vectors, made), (doubled(vectors, more), doubled(made, more))):
        size = np.sqrt(np.einsum("ij,ij->i", x, x))
        out |= sums >= np.where(size == 0, np.inf, near * size)[:, None].astype(np.float32)
    return out


def lcs(rows: np.ndarray, masks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each row, and an item of so many words, their longest common subsequence.

    ``rows`` has for each word its row of ``masks``, which has a bit for each place of
    the item with that word, in 64-bit limbs."""
    limbs = masks.shape[1]
    state = np.full((len(rows), limbs), ~U(0), U)
    for k in range(rows.shape[1]):
        hit = masks[rows[:, k]]
        for_add = state & hit
        carry = np.zeros(len(rows), U)
        new = np.empty_like(state)
        for j in range(limbs):
            a, b = state[:, j], for_add[:, j]
            s = a + b
            c = s < a
            t = s + carry
            carry = (c | (t < s)).astype(U)
            new[:, j] = t | (a & ~hit[:, j])
        state = new
    bits = np.zeros((len(rows), limbs), U)
    for j in range(limbs):
        n = np.clip(lengths - 64 * j, 0, 64).astype(np.int64)
        bits[:, j] = np.where(n == 64, ~U(0), (U(1) << np.minimum(n, 63).astype(U)) - U(1))
    return np.bitwise_count(~state & bits).sum(axis=1).astype(np.int64)


def within(numbers: np.ndarray, counts: np.ndarray, text: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``width`` word numbers from ``first`` on, 0 outside the text; their places, and which are inside."""
    place = first[:, None] + np.arange(width)
    inside = (place >= counts[:-1][text][:, None]) & (place < counts[1:][text][:, None])
    return np.where(inside, numbers[np.clip(place, 0, len(numbers) - 1)], 0), place, inside


def compare(own: Items, numbers: np.ndarray, counts: np.ndarray, text: np.ndarray, start: np.ndarray, item: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(text, item, share) of those near pairs of stride and item that hold."""
    for at in range(0, len(text), 1 << 14):
        t, s, i = (x[at : at + (1 << 14)] for x in (text, start, item))
        row, place, inside = within(numbers, counts, t, s - STRIDE, 4 * STRIDE)
        length = own.lengths[i]
        got = lcs(own.rows_of(own.keys, row, i), own.places, length)
        share = got / length
        yes = (share >= MOST) & (length >= MIN_ITEM)
        half = np.flatnonzero((share >= HALF) & ~yes & (length >= MIN_ITEM))
        tail = lcs(own.rows_of(own.tail_keys, row[half], i[half]), own.tail_places, own.answers[i[half]])
        yes[half] = (tail >= ANSWER * own.answers[i[half]]) & own.telling(row[half], i[half])
        for k in np.flatnonzero((length < MIN_ITEM) & (got == length)):
            yes[k] = any((numbers[p : p + length[k]] == own.numbers(own.words[i[k]])).all() for p in place[k][inside[k]] if p + length[k] <= counts[t[k] + 1])
        yield from zip(t[yes].tolist(), i[yes].tolist(), share[yes].tolist())


def compare_long(own: Items, made: dict[int, tuple], numbers: np.ndarray, counts: np.ndarray, text: np.ndarray, start: np.ndarray, piece: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """The same for long items, whole, and the words around each near (text, first word, piece)."""
    item = own.piece_item[piece]
    for i in np.unique(item).tolist():
        if i not in made:
            made[i] = own.whole(i)
        local, masks, tails = made[i]
        length, answer = int(own.lengths[i]), int(own.answers[i])
        width = length + length // 2 + 4 * STRIDE
        mine, step = np.flatnonzero(item == i), max(1, (1 << 21) // width)
        for at in range(0, len(mine), step):
            p = mine[at : at + step]
            before = own.piece_at[piece[p]]
            row, _, _ = within(numbers, counts, text[p], start[p] - before - before // 2 - STRIDE, width)
            some = np.flatnonzero(own.rarely(row, np.full(len(p), i)))
            p, whole, row = p[some], row[some], local[row[some]]
            share = lcs(row, masks, np.full(len(p), length)) / length
            yes = share >= MOST
            half = np.flatnonzero((share >= HALF) & ~yes)
            yes[half] = (lcs(row[half], tails, np.full(len(half), answer)) >= ANSWER * answer) & own.telling(whole[half], np.full(len(half), i))
            yield from zip(text[p[yes]].tolist(), [i] * int(yes.sum()), share[yes].tolist())


def contaminated(docs: DataFrame, benchmark: DataFrame, near: float = NEAR) -> DataFrame:
    """doc_id, item_id, share (of the item's words found, in order)."""
    spark = docs.sparkSession
    ship(spark)
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, share double"
    texts = docs.select(docs["doc_id"], F.lower(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("text"))
    asked = benchmark.where("text is not null").select("item_id", "text").orderBy("item_id", "text").collect()  # the stated query set
    blocks = in_blocks(asked) if asked else []
    if not blocks:
        return spark.createDataFrame([], schema)

    every = Words(np.concatenate([x.known for x in blocks]))
    words = coded(texts, Numbers(every, [r["text"].lower() for r in asked]))
    kind_of_code = code_type(every)
    n, found = document_frequencies(words, every)
    weighed = []
    for items in blocks:
        weight = np.append(0, (np.log((n + 1) / (found[every.numbers(items.known)] + 1)) + 0.1) ** POWER)
        items.bound(np.append(False, found[every.numbers(items.known)] > OFTEN * n))
        weighed.append((items, weight))
    ready = []
    for at in range(0, len(weighed), SCAN):
        some = weighed[at : at + SCAN]
        for (items, weight), base in zip(some, latent_spaces(words, every, some), strict=True):
            ready.append((items, lookup(every, items), (weight[:, None] * base).astype(np.float32), columns_of(weight)))

    def search(some: list[tuple[Items, np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
        # At most SCAN * BLOCK pieces, and RANK numbers for each of their words.
        shared = spark.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            repeats.keep()
            sought = [(own, known, rows, often, unit(np.stack([rows[own.numbers(w)].sum(axis=0) for w in own.pieces])), {}) for own, known, rows, often in shared.value]
            for batch in batches:
                for part in repeats.pieces(batch, CODES, "codes"):
                    codes, counts = read_codes(part.column("codes"), kind_of_code)
                    best: dict[tuple, float] = {}
                    for own, known, rows, often, wanted, made in sought if len(codes) else ():
                        numbers = known[codes]
                        text, start, vectors, more = strides(numbers, counts, rows, often)
                        # A stride by itself serves short items, two together long ones.
                        close = close_pairs(vectors, more, wanted, near)
                        at, piece = np.nonzero(own.possible(close, numbers, start))
                        pairs = (text[at], start[at], piece)
                        for t, i, share in compare_long(own, made, numbers, counts, *pairs) if own.long else compare(own, numbers, counts, *pairs):
                            best[t, own.ids[i]] = max(best.get((t, own.ids[i]), 0.0), share)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array([t for t, _ in best], pa.int64())), pa.array([i for _, i in best], batch_type), pa.array(list(best.values()), pa.float64())],
                        names=["doc_id", "item_id", "share"],
                    )

        return words.mapInArrow(run, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = search(ready[:SCAN])
    for at in range(SCAN, len(ready), SCAN):
        out = out.unionByName(search(ready[at : at + SCAN]))
    return out.groupBy("doc_id", "item_id").agg(F.round(F.max("share"), 6).alias("share"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    gone = contaminated(docs, benchmark).select(F.col("doc_id").alias("_doc")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_doc"]), "left_anti")


def op2(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark)
