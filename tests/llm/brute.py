"""Plain versions of the operators, to hold them against."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def bytes_dedup(rows, length=100):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def words_dedup(rows, length=13):
    words = [(doc, WORD.findall(text or "")) for doc, text in rows]
    first = {}
    for doc, w in words:
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < doc:
                gone[s : s + length] = [True] * length
        out.append((doc, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return out


def near_classes(rows):
    sets = {}
    for doc, text in rows:
        w = WORD.findall(text or "")
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return [(d, root(d)) for d in ids]


PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_pii(text):
    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()

    found = {k: [f"{k}:{m.start()}:{m.end()}" for m in p.finditer(text or "") if good(k, m.group())] for k, p in PII.items()}
    return (*map(len, found.values()), sha(",".join(x for v in found.values() for x in v).encode()))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def leaks(docs, items, stride=32, piece=96):
    """(doc, item) by the definition: shares of items in the words around each stride."""
    def words(t):
        return re.findall(r"[a-z0-9\x80-\uffff]+", (t or "").lower())

    out, df, n_docs = set(), {}, 0
    for _, t in docs:
        n_docs += bool(words(t))
        for w in set(words(t)):
            df[w] = df.get(w, 0) + 1
    for i, t in items:
        own = words(t)
        telling = {w for w in own if df.get(w, 0) <= 0.1 * n_docs}
        n = len(own)
        answer = own[n - min(n, max(8, len(words(t.rstrip(" .!?\n").replace("!", ".").replace("?", ".").rpartition(".")[2])))) :]
        k = max(1, -(-n // piece))
        for d, text in docs:
            w = words(text)
            for s in range(0, len(w), stride):
                for j in range(k):
                    before = n * j // k
                    lo, width = (s - stride, 4 * stride) if k == 1 else (s - before - before // 2 - stride, n + n // 2 + 4 * stride)
                    row = w[max(0, lo) : max(0, lo + width)]
                    share = lcs(own, row) / n
                    if share >= 0.7 or share >= 0.55 and lcs(answer, row) >= 0.85 * len(answer) and len(telling & set(row)) >= 0.55 * len(telling):
                        out.add((d, i))
    return sorted(out)
