"""BPE encoding and decoding by speculating and verifying.

A word's tokens are proposed by greedy longest match.  A sequence of tokens is
what merging by rank gives if and only if every token stands for itself and
every adjacent pair of tokens is left alone by merging; so all adjacent pairs of
a batch's new words are looked up at once among the known pairs, unknown pairs
are settled by merging just the two, and only words with a failing pair are
merged in full.  Words meet again and again, so results are kept per worker.

Defined results: a null or empty text has no tokens; the special tokens' strings
in a text become their ids; repeated rows repeat; an empty table stays empty;
every other column of the input is left alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanrank.llm.common import KEPT, ship

END = "</w>"
NEVER = 1 << 60
#: Unicode's White_Space (fixed values).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The vocabulary's pre-tokenizer, its \s spelt out (fixed value).
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+"
#: Words kept per worker; beyond that the older half goes.
KEPT_WORDS = 600_000
#: Above these code points Unicode versions may differ: the library's own normaliser and splitter are asked.
PLAIN = regex.compile(r"[\x00-ɏ‐-‧‰-⁞₠-₿]*+")


def byte_letters() -> list[str]:
    """The printable letter standing for each byte: itself if printable, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def halve(memory: dict, most: int, wanted: set) -> None:
    """Drop the older half of a full memory, but nothing that is wanted now."""
    if len(memory) > most:
        for k in list(memory)[: len(memory) // 2]:
            if k not in wanted:
                del memory[k]


class Codec:
    """A vocabulary with everything found out about it so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(spec["model"]["merges"])}
        self.letters = byte_letters()
        #: Every beginning of a token, the end mark aside.
        self.heads = {t[:k] for t in map(lambda t: t.removesuffix(END), self.ids) for k in range(1, len(t) + 1)}
        self.pieces = regex.compile(PIECES, regex.V0)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.size = max(self.names) + 1
        self.pairs = np.empty(0, np.int64)  # known pairs, sorted: first * size + second
        self.fits = np.empty(0, bool)  # whether merging leaves the pair alone
        self.selfs: dict[int, bool] = {}
        self.words: dict[str, str] = {}  # the ids, joined by blanks
        self.decoded: dict[str, str] = {}  # the tokens, joined likewise
        self.speculated = self.merged = 0
        self._library = None

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def symbols(self, token: str) -> list[str]:
        """A token's letters, the last one with the end mark if the token has it."""
        if token.endswith(END) and len(token) > len(END):
            body = token[: -len(END)]
            return [*body[:-1], body[-1] + END]
        return list(token)

    def merge(self, symbols: list[str]) -> list[str]:
        """Merging by rank, leftmost first: by search while short, else a heap of
        pairs over a linked list, so that no word costs the square of its length."""
        if len(symbols) <= 24:
            out, rank = list(symbols), self.ranks.get
            ranks = [rank(pair, NEVER) for pair in zip(out, out[1:], strict=False)]
            while ranks and (least := min(ranks)) < NEVER:
                i = ranks.index(least)
                out[i] += out.pop(i + 1)
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = rank((out[i], out[i + 1]), NEVER)
                if i:
                    ranks[i - 1] = rank((out[i - 1], out[i]), NEVER)
            return out
        n, out = len(symbols), list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, out[i], out[i + 1]) for i in range(n - 1) if (r := self.ranks.get((out[i], out[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if out[i] != a or (j := after[i]) >= n or out[j] != b:
                continue
            out[i], out[j], k = a + b, None, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := self.ranks.get((out[i], out[k]))) is not None:
                    heapq.heappush(heap, (r, i, out[i], out[k]))
            if (h := before[i]) >= 0 and (r := self.ranks.get((out[h], out[i]))) is not None:
                heapq.heappush(heap, (r, h, out[h], out[i]))
        return [x for x in out if x is not None]

    def greedy(self, symbols: list[str]) -> list[int] | None:
        """Longest match first, over the letters; None where nothing matches."""
        text, out, at = "".join(symbols), [], 0
        ids, heads = self.ids.get, self.heads
        end = len(text)
        body = end - len(END)  # no token ends inside the end mark
        while at < end:
            found = None
            for upto in range(at + 1, body + 1):
                if (part := text[at:upto]) not in heads:
                    break
                if (i := ids(part)) is not None:
                    found, stop = i, upto
            else:
                if (i := ids(text[at:])) is not None:
                    found, stop = i, end
            if found is None:
                return None
            out.append(found)
            at = stop
        return out

    def stands(self, token: int) -> bool:
        if token not in self.selfs:
            name = self.names[token]
            self.selfs[token] = self.merge(self.symbols(name)) == [name]
        return self.selfs[token]

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """For each pair, whether merging leaves it alone."""
        new = np.setdiff1d(keys, self.pairs)
        if len(new):
            names = [(self.names[k // self.size], self.names[k % self.size]) for k in new.tolist()]
            told = np.fromiter((self.merge(self.symbols(a) + self.symbols(b)) == [a, b] for a, b in names), bool, len(new))
            at = np.searchsorted(self.pairs, new)
            self.pairs, self.fits = np.insert(self.pairs, at, new), np.insert(self.fits, at, told)
        return self.fits[np.searchsorted(self.pairs, keys)]

    def tokens(self, words: list[str]) -> list[list[int]]:
        """The ids of each word (a piece of the pre-tokenizer)."""
        made = []
        for w in words:
            letters = [self.letters[b] for b in w.encode("utf-8", "surrogatepass")]
            letters[-1] += END
            made.append(letters)
        found = [self.greedy(x) for x in made]
        lengths = np.fromiter((len(x or ()) for x in found), np.int64, len(found))
        flat = np.fromiter((i for x in found if x for i in x), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(found)), lengths)
        good = lengths > 0
        known, back = np.unique(flat, return_inverse=True)
        alone = np.fromiter((self.stands(int(t)) for t in known), bool, len(known))
        good[owner[~alone[back]]] = False
        if len(flat) > 1:
            inside = owner[1:] == owner[:-1]
            fits = self.compatible((flat[:-1] * self.size + flat[1:])[inside])
            good[owner[1:][inside][~fits]] = False
        self.speculated += len(words)
        self.merged += int((~good).sum())
        return [x if ok else [self.ids[t] for t in self.merge(m)] for x, ok, m in zip(found, good.tolist(), made, strict=True)]

    def learn(self, met: set[str]) -> None:
        """Words (pieces of the pre-tokenizer) into the memory."""
        halve(self.words, KEPT_WORDS, met)
        halve(self.decoded, KEPT_WORDS, met)
        new = list(met - self.words.keys())
        for p, own in zip(new, self.tokens(new), strict=True):
            self.words[p] = " ".join(map(str, own))
            self.decoded[p] = " ".join([self.names[i] for i in own])

    def split(self, text: str) -> list[str]:
        """The pre-tokenizer's pieces of the normalised text (its white space never gets into a piece)."""
        if PLAIN.fullmatch(text):
            return self.pieces.findall(unicodedata.normalize("NFC", text).lower())
        byte = {c: b for b, c in enumerate(self.letters)}
        got = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(byte[c] for c in p).decode("utf-8") for p, _ in got]

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text the number of ids, the ids joined by blanks, and the decoded
        text (the tokens joined: the vocabulary names no decoder)."""
        split = [self.split_special.split(t) if "<|" in t else [t] for t in texts]
        rows = [[p if p in self.special else self.split(p) for p in parts] for parts in split]
        self.learn(set().union(*(p for row in rows for p in row if isinstance(p, list))))
        out = []
        for row in rows:
            ids, names = [], []
            for p in row:
                if isinstance(p, str):
                    ids.append(str(self.special[p]))
                    names.append(p)
                elif p:
                    ids.append(" ".join(map(self.words.__getitem__, p)))
                    names.append(" ".join(map(self.decoded.__getitem__, p)))
            joined = " ".join(ids)
            out.append((joined.count(" ") + bool(joined), joined, " ".join(names)))
        return out


_codecs: dict[str, Codec] = {}
KEPT.append(_codecs)


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(docs: DataFrame, path: str | None = None, full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with ``full`` the ids and the decoded text too.

    ``path`` must name the vocabulary file on every executor."""
    ship(docs.sparkSession)
    path = path or default_vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            # A few rows at a time, so that the strings of long texts don't add up.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = own.encode([t or "" for t in part.column(1).to_pylist()])
                cols = [
                    part.column(0),
                    pa.array([x[0] for x in got], pa.int64()),
                    pa.array([sha(x[1]) for x in got], pa.string()),
                    pa.array([sha(x[2]) for x in got], pa.string()),
                ]
                if full:
                    cols += [pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[f.split(" ")[0] for f in schema.split(", ")])

    return docs.select(docs["doc_id"], docs["text"].cast("string").alias("text")).mapInArrow(run, schema)


def encoded_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The documents' columns with their ids, for a pipeline's last stage."""
    return encoded(docs, path, full=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.col("ids"))
