import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from spanrank.llm import bpe, compaction, decontaminate, fmindex, lines, neardup, pii, quality, repeats, suffixes, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, set string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None if i == 3 else "en", "s", 0, 1, "x") for i, t in rows], SCHEMA)


def corpus(seed=0, n=40):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(60)]
    passage = [" ".join(r.choice(vocabulary) for _ in range(40)) for _ in range(3)]
    out = []
    for i in range(n):
        parts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(4)]
        for k, p in enumerate(passage):
            if r.random() < 0.4:
                parts.insert(k, p[r.randint(0, 20) :] if r.random() < 0.5 else p)
        out.append((i, "\n".join(parts)))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t\n"), (n + 3, out[5][1]), (n + 4, out[5][1] + " one more"), (n + 5, "ab " * 3000), (n + 6, "x" * 3000), (n + 7, "x" * 3000 + "\n" + passage[0]), (n + 8, "1 2 3"), (n + 9, "1 2 3")]
    return out


EMPTY = []


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_suffix_dedup(spark, seed):
    rows = corpus(seed)
    assert collected(suffixes.op4(frame(spark, rows))) == sorted(brute.bytes_dedup(rows))


def test_suffix_dedup_of_hot_keys(spark, monkeypatch):
    rows = corpus(2)
    monkeypatch.setattr(repeats, "HOT", 1)
    assert collected(suffixes.op4(frame(spark, rows))) == sorted(brute.bytes_dedup(rows))
    assert collected(fmindex.op9(frame(spark, rows))) == sorted(brute.words_dedup(rows))


def test_suffix_dedup_sends_few_bytes_of_hot_keys(spark, monkeypatch, tmp_path):
    """A passage in many texts, each time amid other words: its edges' windows are not sorted one by one."""
    r = random.Random(6)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 8))) for _ in range(n))
    passage = text(60)
    rows = [(i, f"{text(30)} {passage} {text(30)}") for i in range(120)]
    monkeypatch.setattr(repeats, "HOT", 30)
    plain, folder = suffixes.equal_windows, str(tmp_path)

    def noted(blobs, *rest):
        Path(folder, str(random.SystemRandom().random())).write_text(str(int(np.diff(repeats.utf8(blobs.cast("string"))[1]).sum())))
        return plain(blobs, *rest)

    monkeypatch.setattr(suffixes, "equal_windows", noted)
    assert collected(suffixes.op4(frame(spark, rows))) == sorted(brute.bytes_dedup(rows))
    sent = sum(int(p.read_text()) for p in tmp_path.iterdir())
    assert sent < 15 * 100 * len(rows) * 2  # two edges a text, of 68 windows and less


def test_suffix_dedup_deals_only_texts_with_hot_keys_twice(spark, monkeypatch):
    """Texts are dealt by id for their spans; for the bytes of very frequent keys only those that have some are dealt before."""
    r = random.Random(7)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 8))) for _ in range(n))
    passage, rare = text(60), text(60)
    rows = [(i, f"{text(30)} {passage if i < 40 else rare if i < 44 else text(20)} {text(30)}") for i in range(200)]
    monkeypatch.setattr(repeats, "HOT", 30)
    plain, written = repeats.materialise, {}
    monkeypatch.setattr(repeats, "materialise", lambda df, name: written.setdefault(name, plain(df, name)))
    monkeypatch.setattr(repeats, "MARKS", 1 << 16)
    out = suffixes.op4(frame(spark, rows))
    assert collected(out) == sorted(brute.bytes_dedup(rows))
    assert {r["doc"] for r in written["suffixes-blobs"].collect()} == set(range(40))
    monkeypatch.setattr(repeats, "MARKS", 8)  # marks that hit nearly every text
    assert collected(suffixes.op4(frame(spark, rows))) == sorted(brute.bytes_dedup(rows))


def test_words_of_no_item_are_not_digested(monkeypatch):
    """Numbers of words are those by whole digests; words that no item has are told apart without one."""
    import pyarrow as pa
    import xxhash

    r = random.Random(8)
    word = lambda n: "".join(r.choice("ab\u00e9") for _ in range(n))
    words = [word(r.randint(1, 12)) for _ in range(150)] + [word(8) + word(n) + "abcdefgh" for n in (0, 1, 4, 9, 40) for _ in range(4)]
    long = "aaaaaaaa{}bbbbbbbb"
    items = [" ".join(words[::3]), long.format("xyz") + ", " + long.format("xyw"), ""]
    texts = [" ".join(r.choice(words) for _ in range(400)), "", long.format("xyz") + " " + long.format("qqq") + "!" + long.format("xyw"), "A a B.b  ab"]
    texts = [t.lower() for t in texts]
    every = decontaminate.Words(decontaminate.read_words(pa.array(items, pa.string()))[0])
    numbers = decontaminate.Numbers(every, items)
    digests, counts = decontaminate.read_words(pa.array(texts, pa.string()))
    plain, asked = xxhash.xxh3_64_intdigest, []
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda w: (asked.append(w), plain(w))[1])
    got, offsets = numbers.of(pa.array(texts, pa.string()), np.uint16)
    assert got.tolist() == every.numbers(digests).tolist() and offsets.tolist() == counts.tolist()
    assert 0 < np.count_nonzero(got) < len(got)
    assert all(len(w) > decontaminate.SHORT for w in asked)
    none = decontaminate.Numbers(decontaminate.Words(np.empty(0, np.uint64)), [""])
    assert not none.of(pa.array(texts, pa.string()), np.uint16)[0].any()


@pytest.mark.parametrize("buckets", [2, 30000])
def test_suffix_order_and_common_prefixes(tmp_path, monkeypatch, buckets):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(suffixes, "LONGER", 1)
    words = [rng.integers(1, 9, rng.integers(2, 8)) for _ in range(40)]
    texts = [rng.integers(1, s + 1, n) for n, s in ((1, 1), (60, 2), (500, 1), (2000, 3), (3000, 60))] + [np.concatenate([words[i] for i in rng.integers(0, 40, 500)])]
    for scanned, text in [(1 << 15, t) for t in texts] + [(7, texts[3][:600])]:
        monkeypatch.setattr(suffixes, "SCANNED", scanned)
        text = np.append(text, 0).astype(np.int16)
        b = text.astype(np.uint8).tobytes()
        want = sorted(range(len(text)), key=lambda i: b[i : i + 128])
        for folder, limit in ((None, 1 << 17), (str(tmp_path), 16)):
            order, common = suffixes.suffix_order(text, folder, limit, buckets=buckets)
            assert [b[i : i + 100] for i in order] == [b[i : i + 100] for i in want]
            for j in range(1, len(order)):
                x, y = (b[i : i + suffixes.DEEP] for i in order[j - 1 : j + 1])
                assert common[j] == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


def test_suffix_shards_larger_than_the_queues(spark, monkeypatch):
    r = random.Random(9)
    text = lambda n: " ".join(r.choice(("ab", "c", "dea", "fff", "gh")) for _ in range(n))
    parts = [text(60) for _ in range(6)]
    rows = [(i, text(r.randint(0, 90)) + r.choice(parts)[r.randint(0, 30) :] + text(90) + r.choice(parts)) for i in range(60)]
    spilt = []
    plain = suffixes.Queue.spill
    monkeypatch.setattr(suffixes.Queue, "spill", lambda self: (spilt.append(1), plain(self)))
    monkeypatch.setattr(suffixes, "IN_MEMORY", 64)
    shape = repeats.Shape(suffixes.LENGTH, suffixes.GRAM)
    import pyarrow as pa

    def index(*given):  # the query's own, told to keep fewer tuples
        return suffixes.equal_windows(*given, limit=64)

    texts, spans = repeats.repeated_spans(frame(spark, rows), suffixes.bytes_symbols, suffixes.cut, suffixes.bounds, index, shape, True, "small")
    gone = {}
    for x in spans.collect():
        gone.setdefault(x.doc, set()).update(range(x.start, x.start + x.windows + 99))
    assert [len(gone.get(i, ())) for i, _ in rows] == [x[2] for x in sorted(brute.bytes_dedup(rows))]
    blobs = pa.array([t.encode() for _, t in rows], pa.binary())
    n = np.array([len(t) - 99 for _, t in rows])
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        flags = suffixes.equal_windows(blobs, n, np.arange(60), np.zeros(60, np.int64), np.zeros(60, np.int64), folder, limit=64)
    assert spilt and flags.sum() > 0


THUE = "ab"
for _ in range(10):
    THUE += THUE.translate(str.maketrans("ab", "ba"))


def test_words_and_texts_with_equal_polynomials(spark):
    """Strings whose polynomials modulo 2 ** 64 are equal for any odd base."""
    one, two = THUE, THUE.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([one] * 6 + ["x"] * 9)), (2, " ".join([two] * 6 + ["x"] * 9)), (3, " ".join(one)), (4, " ".join(two)), (5, one + "y" * 120), (6, two + "y" * 120)]
    assert collected(fmindex.op9(frame(spark, rows))) == sorted(brute.words_dedup(rows))
    assert collected(suffixes.op4(frame(spark, rows))) == sorted(brute.bytes_dedup(rows))
    assert collected(neardup.op5(frame(spark, rows)))[:2] == [(1, 1), (2, 2)]


def test_matching_statistics():
    import pyarrow as pa

    texts = ["a b c d e f", "x a b c d y", "b c d e f"]
    data = pa.array([t.encode() for t in texts], pa.binary())
    got = fmindex.earlier_elsewhere(data, np.array([3, 3, 2]), np.array([3, 1, 9]), np.zeros(3), np.zeros(3), None, 4)
    assert got.tolist() == [True, False, False, False, False, False, True, True]


@pytest.mark.parametrize("seed", [0, 1])
def test_passages(spark, seed):
    rows = corpus(seed)
    assert collected(fmindex.op9(frame(spark, rows))) == sorted(brute.words_dedup(rows))


def test_wavelet_ranks():
    x = np.random.default_rng(0).integers(0, 37, 500)
    w = fmindex.Wavelet(x, 37)
    at, s = np.arange(501), np.full(501, 5)
    assert w.rank(s, at).tolist() == [int((x[:i] == 5).sum()) for i in range(501)]


def near_corpus():
    r = random.Random(5)
    base = [f"w{r.randint(0, 500)}" for _ in range(120)]
    out = []
    for i in range(60):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 4, 6, 9])):
            w[r.randrange(len(w))] = f"z{r.randint(0, 10**6)}"
        out.append((i, " ".join(w)))
    return out + [(i + 100, t) for i, t in corpus(3)]


def test_near_classes(spark):
    rows = near_corpus()
    got = collected(neardup.op5(frame(spark, rows)))
    assert got == sorted(brute.near_classes(rows))
    left = collected(neardup.one_of_each(frame(spark, rows)).select("doc_id"))
    assert left == sorted({(c,) for _, c in got})


def test_near_classes_of_unlike_weights(spark):
    r = random.Random(8)
    rows = []
    for k in range(40):
        w = [f"v{r.randint(0, 10**6)}" for _ in range(100)]
        # The same shingles but for a few at a joint, some of them very many times in one of the two.
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:50] * (1 + k % 7) + w[50:55] * (30 * k) + w[50:]))]
    assert collected(neardup.op5(frame(spark, rows))) == sorted(brute.near_classes(rows))


def test_probability_jaccard():
    one, two = {k: 1 + k % 3 for k in range(300)}, {k: 1 + k % 3 for k in range(60, 360)}
    values = repeats.mix(np.array([*one, *two], np.uint64))
    text = np.array([0] * 300 + [1] * 300)
    sig = neardup.prob_min_hash(text, values, np.array([*one.values(), *two.values()]), 2, 4096)
    both = set(one) & set(two)
    exact = sum(1 / sum(max(one.get(e, 0) / one[d], two.get(e, 0) / two[d]) for e in set(one) | set(two)) for d in both)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03


def test_lines(spark):
    a, b = "one\n\ntwo\nthree\nfour", "x\ntwo\nthree\n \nfour\ny"
    rows = [(2, b), (1, a), (3, None), (4, ""), (5, "two\nthree"), (6, "q\nq\nq\nq"), (1, a)]
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.deduplicated(frame(spark, rows)).collect()}
    assert got == {1: (a, 0), 2: ("x\n \ny", 3), 3: (None, 0), 4: ("", 0), 5: ("two\nthree", 0), 6: got[6]}
    assert got[6] == ("q", 3)
    assert lines.deduplicated(frame(spark, EMPTY)).count() == 0


def test_line_fingerprints_are_small(spark):
    """What is shuffled for each place: 16 bytes and a number for each line, no structs."""
    got = {r.near[2] // 2: r for r in lines.fingerprints(frame(spark, [(1, "a\nb\n\nc c\nd")])).collect()}
    assert {len(r.told) for r in got.values()} == {16 * (2 * lines.WINDOW - 1)}
    assert all(x is None or isinstance(x, int) for r in got.values() for x in r.near)


def test_quality(spark):
    good = [(i, "the cat sat on the mat and then it went to sleep for a very long time " + " ".join(f"w{i}x{k}" for k in range(30))) for i in range(3000)]
    bad = [(i + 5000, " ".join(f"w{i}$$$ ###{k}" for k in range(30))) for i in range(300)]
    extra = [(9000, None), (9001, ""), (9002, "a b " * 100), (9003, "x\n\ny\nx\n" * 10)]
    docs = frame(spark, good + bad + extra)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (9003, None)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.op3(docs, labels).collect()}
    assert all(rows[i].kept for i, _ in good) and not any(rows[i].kept for i, _ in bad)
    assert rows[9000].n_words == 0 and rows[9000].base_failed
    assert rows[9002].n_repeat_words == 200 and rows[9002].base_failed
    assert rows[9003].n_dup_lines == 28
    assert collected(quality.kept_documents(docs, labels).select("doc_id")) == [(i,) for i in sorted(i for i, _ in good)]
    none = {r.doc_id: r.kept for r in quality.op3(docs, labels.where("false")).collect()}
    assert none[5000]  # nothing is rejected without labels
    assert quality.op3(frame(spark, EMPTY), labels).count() == 0


def test_quality_with_few_labels(spark):
    plain = "the cat sat on the mat and then it went to sleep for a very long time "
    made = [(lang, k, n) for lang, good, bad in (("de", 300, 20), ("fr", 120, 10), ("es", 130, 10)) for k, n in ((1, good), (0, bad))]
    rows = [(lang, k, plain + " ".join(f"w{i}x{j}" + ("" if k else " ###$") for j in range(20))) for lang, k, n in made for i in range(n)]
    rows += [("it", None, rows[300][2])]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, _, t) in enumerate(rows)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, k) for i, (_, k, _) in enumerate(rows)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.op3(docs, labels).collect()}
    # de stands alone, fr and es have enough labels together; without any there is no rule.
    assert all(kept[i] == (k != 0) for i, (_, k, _) in enumerate(rows))
    # 100 good labels show nothing: even a rule that rejects none of them is not admitted.
    few = labels.where("doc_id < 100 or quality = 0")
    assert all(r.kept for r in quality.op3(docs, few).collect())


def test_quality_joint_risk(spark):
    # Each of two measures rejects 1 % of the good documents, other ones: 2 % together is too much.
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines")
    row = lambda s, c, good: (100, 500, s, 0, 0, c, 10, "en", good)
    good = [row(50 * (i < 20), 50 * (20 <= i < 40), True) for i in range(2000)]
    bad = [row(50, 0, False)] * 900 + [row(0, 50, False)] * 100 + [row(99, 0, False)] * 5
    facts = spark.createDataFrame(good + bad, ", ".join(f"{n} long" for n in names) + ", stratum string, good boolean")
    got = [tuple(r) for r in quality.cutoffs(facts).collect()]
    assert got == [("en", "symbols", 32)]


def test_binomial_tail(spark):
    from math import comb, log

    for k, n, p in ((0, 50, 0.1), (3, 400, 0.02), (40, 5000, 0.01)):
        want = log(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
        got = spark.range(1).select(F.expr(quality.log_tail(str(k), str(n), p))).first()[0]
        assert abs(got - want) < 1e-6 * max(1, abs(want)) or k == 0 and got >= want


def test_bpe(spark):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("word_bpe_49k.json")
    lib, own = tokenizers.Tokenizer.from_file(path), bpe.Codec(path)
    r = random.Random(1)
    texts = ["", "  \n", "Hello, world! it's THEY'LL 1234", "<|startoftext|>a<|endoftext|> b<|startoftext|>", "ΣΑΣ ﬁ Å é naïve 漢字 🙂\x1c x\x85y", "x" * 3000, "ab" * 900, "!?" * 300]
    texts += ["".join(chr(r.choice([r.randint(32, 126), r.randint(160, 900), r.randint(0x2000, 0x30FF)])) for _ in range(80)) for _ in range(200)]
    for text, got in zip(texts, own.encode(texts)):
        e = lib.encode(text, add_special_tokens=False)
        assert got == (len(e.ids), " ".join(map(str, e.ids)), lib.decode(e.ids, skip_special_tokens=False))
    assert own.merged < own.speculated
    out = {r.doc_id: r.n_tokens for r in bpe.encoded(frame(spark, [(1, None), (2, "a b"), (2, "a b")])).collect()}
    assert out == {1: 0, 2: 2}
    assert bpe.encoded(frame(spark, EMPTY)).count() == 0


def test_store(spark, tmp_path):
    docs = frame(spark, corpus(4) + [(1, None), (None, "x")])
    store = compaction.Store(spark, f"file://{tmp_path}/s", fanout=2, target=1 << 12, unit=1 << 10)
    store.append_each(docs.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(4))), "b")
    first = store.manifest()
    assert sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))
    assert not store.due([compaction.Run(**x) for x in first["runs"]])
    store.append(docs)
    assert store.read().count() == 2 * docs.count() and store.read(first["version"]).count() == docs.count()
    with pytest.raises(compaction.Conflict):
        store.commit(first, [], first["schema"])
    # A frame opened before a compaction reads on after it, until a vacuum.
    opened, n = store.read(), docs.count()
    for _ in range(3):
        store.append(docs)
    store.compact()
    assert opened.count() == 2 * n and store.read().count() == 5 * n
    assert store.vacuum() == 0 and store.read(first["version"]).count() == n
    assert store.vacuum(-60) > 0 and store.read().count() == 5 * n
    # A writer that comes second commits to the next version.
    plain, late = store.manifest, []

    def stale(version=None):
        out = plain(version)
        if version is None and not late:
            late.append(compaction.Store.add(compaction.Store(spark, store.root), [], out["schema"]))
        return out

    store.manifest = stale
    assert store.append(docs)["version"] == late[0]["version"] + 1 and store.read().count() == 6 * n
    empty = compaction.op7(frame(spark, EMPTY))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "text_sha256"]


def test_urls(spark):
    cases = {
        "http://A.Example.com/en/1?x": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://b.net/es/#t": ("b.net", "/es/", "net/es/", "block"),
        "http://x.com": ("x.com", "", None, "allow"),
        "http://x.com/": ("x.com", "/", "com/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "no scheme": ("", "", None, "allow"),
        "http://Ä.org/é?": ("Ä.org", "/é", None, "allow"),
        "http://casino-pills.example.org/x": ("casino-pills.example.org", "/x", None, "block"),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)] + [(99, None, None), (100, "http://y.org/" + "z" * 50000, None)], "page_id long, url string, score string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.op8(pages).collect()}
    assert got[99] == ("", "", None, "allow") and got[100][3] == "allow"
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert urls.op8(pages.where("false")).count() == 0


def test_url_model_on_hosts_it_has_not_seen(spark):
    seeds = urls.seed_table(spark)
    got = urls.held_out(seeds, "host", folds=2).first()
    chance = len(urls.BLOCK_WORDS) / (len(urls.BLOCK_WORDS) + len(urls.ALLOW_WORDS))
    assert got.n == 2 * (len(urls.BLOCK_WORDS) + len(urls.ALLOW_WORDS)) and got.precision > chance


def test_url_model_is_fitted_in_time_and_lends_no_weights(spark):
    import time

    start = time.perf_counter()
    weights = urls.fit(urls.seed_table(spark).select("url", "label"))
    assert time.perf_counter() - start < 120  # minutes more if lists are made anew in every round
    host, path = urls.host_path(F.lit("http://y.org/" + "z" * 50))
    rows = urls.features(spark.range(1).select(host.alias("h"), path.alias("p")), "h", "p")
    assert rows.select(urls.score("_f", weights)).first()[0] < 0.5  # nothing of it was seen


def test_pii(spark):
    texts = ["mail a.b@c-d.org, or x@y", "a@b.c@d.e", "1.2.3.4 256.1.1.1 001.002.003.004.5", "card 4111 1111 1111 1111 x", "+1 (222) 333-4444.", "é" * 5 + " q@w.de", None, "", "9" * 5000, "a" * 20000 + "@", "@" * 500, "+" + "(" * 3000, "4111-1111-1111-1111 4111111111111112", "z@a.b_x@c.d"]
    r = random.Random(2)
    texts += ["".join(r.choice("a1.@+- (9é\n") for _ in range(120)) for _ in range(150)]
    got = {x.doc_id: tuple(x[1:6]) for x in pii.op10(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {i: brute.base_pii(t) for i, t in enumerate(texts)}
    assert pii.op10(frame(spark, EMPTY)).count() == 0


def test_pii_finds_unseen(spark):
    seeds = [(i, f"hello please write to user{i}@mail.org today") for i in range(20)]
    rows = pii.op10(frame(spark, seeds + [(100, "hello please write to user7(at)mail today"), (101, "in the year 1999 we met")])).collect()
    got = {r.doc_id: (r.n_email, r.spans, r.n_found) for r in rows}
    assert got[100][0] == 0 and got[100][2] == 1 and got[100][1].startswith("email:22:")
    assert got[101] == (0, "", 0) and got[3] == (1, "email:22:36", 0)


def test_pii_bootstraps_from_what_it_found(spark):
    rows = [(i, f"hello please write to user{i}@mail.org today") for i in range(20)]
    rows += [(100 + i, f"hello please write to user{i}(at)mail today") for i in range(8)]  # beside seeds
    rows += [(400 + i, f"signed by user{i}(at)mail for good") for i in range(5)]  # the same words elsewhere
    rows += [(200 + i, f"we asked of boss{i}(at)mail about it") for i in range(5)]  # their shape elsewhere
    rows += [(300 + i, f"in the year {1900 + i} we met") for i in range(20)] + [(500, "hello please write to 1999 today")]
    rows += [(600, "x please 5 write7 user1(at)mail"), (601, "user2@mail.org")]
    got = {r.doc_id: r.n_found for r in pii.op10(frame(spark, rows)).collect()}
    assert {i for i, n in got.items() if n} == {*range(100, 108), *range(400, 405), *range(200, 205)}


@pytest.mark.parametrize("text", ["w" * 10**6 + " 1 " + "x" * 10**6 + "1", "1 " * 50000, "." * 10**6 + "1.", "9" * 10**6, "9 " * 10**5, "@" * 10**5, "+1" * 10**4, "a1@b.cd " * 20000])
def test_pii_in_long_texts(spark, text):
    got = tuple(pii.op10(frame(spark, [(1, text)])).first()[1:6])
    assert got == brute.base_pii(text) if len(text) < 10**6 else got[:4] == (0, 0, 0, 0)


def test_decontamination(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(30) + ". " + text(9) + ".") for i in range(12)] + [(50, ""), (51, None), (52, "qqq zzz")]
    docs = [(i, text(r.randint(0, 400))) for i in range(150)]
    paraphrase = items[1][1].split()
    for k in (3, 9, 17, 25):
        paraphrase[k] = "other"
    docs += [(200, text(90) + " " + items[0][1].upper() + " " + text(50)), (201, text(20) + " " + " ".join(paraphrase)), (202, None), (203, ""), (204, "a qqq zzz b"), (205, "qqq a zzz"), (206, items[2][1]), (206, items[2][1])]
    got = collected(decontaminate.op2(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")))
    assert [(d, i) for d, i, _ in got] == [(200, 0), (201, 1), (204, 52), (206, 2)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.op2(frame(spark, EMPTY), bench).count() == 0
    assert decontaminate.op2(frame(spark, docs), bench.where("false")).count() == 0
    assert decontaminate.clean_documents(frame(spark, docs), bench).count() == len(docs) - 5


def test_decontamination_against_brute_force(spark):
    """Every passage with every item, no vectors: what the gates may not lose, and what they find of it."""
    r = random.Random(6)
    common, rare = ["the", "of", "and", "to", "in", "a", "is", "that"], ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(common if r.random() < 0.4 else rare) for _ in range(n))
    items = [(i, text(n - 9) + ". " + text(9)) for i, n in enumerate((15, 20, 25, 33, 60, 96, 97, 130, 240))]

    def changed(words, rate, first):
        """Some words put in others' place: the rarest ones ``first``, or any."""
        order = sorted(range(len(words)), key=lambda k: ((words[k] in common) if first else 0, r.random()))
        gone = set(order[: int(rate * len(words))])
        return " ".join(f"syn{r.randint(0, 10**6)}" if k in gone else w for k, w in enumerate(words))

    docs, n = [], 0
    for i, t in items:
        for rate in (0.0, 0.1, 0.2, 0.25, 0.3, 0.4, 0.6):
            for first in (False, True):
                docs.append((n, text(r.randint(0, 90)) + " " + changed(t.split(), rate, first) + " " + text(r.randint(0, 60))))
                n += 1
    docs += [(n + k, text(r.randint(0, 300))) for k in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.leaks(docs, items)
    every = collected(decontaminate.contaminated(frame(spark, docs), bench, near=-2.0).select("doc_id", "item_id"))
    assert every == want
    found = collected(decontaminate.op2(frame(spark, docs), bench).select("doc_id", "item_id"))
    assert set(found) <= set(want) and len(found) >= 0.95 * len(want)


def test_latent_space_of_all_documents(spark):
    """Its base makes the product of all passages, 2,600 documents' and the items', diagonal."""
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.choice([0, 3, 40, 100]))) for _ in range(2600)]
    items = decontaminate.Items([1, 2], [" ".join(vocabulary[:20]), " ".join(vocabulary[10:])])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    weight = np.append(0, np.linspace(0.5, 3, 30))
    base = decontaminate.latent_spaces(decontaminate.coded(docs, items), items, [(items, weight)])[0]
    rows = []
    for t, times in [(x, 1.0) for x in texts] + [(" ".join(vocabulary[:20]), decontaminate.EMPHASIS), (" ".join(vocabulary[10:]), decontaminate.EMPHASIS)]:
        words = t.split()
        starts = range(0, max(1, len(words) - decontaminate.STRIDE), decontaminate.STRIDE)
        numbers = items.numbers(decontaminate.read_words(__import__("pyarrow").array([t]))[0])
        rows += [times * np.bincount(numbers[at : at + 2 * decontaminate.STRIDE], minlength=31) for at in starts]
    a = np.array(rows) * weight
    got = base.T @ (a.T @ a) @ base
    assert np.abs(got - np.diag(np.diag(got))).max() < 1e-4 * np.abs(got).max()


def test_latent_space_takes_two_passes(spark, monkeypatch):
    """The words of all documents are read twice for a base, and frequent words as a matrix sum up as others do."""
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choice(vocabulary[: r.choice([10, 400])]) for _ in range(r.choice([0, 5, 70, 200]))) for _ in range(300)]
    items = decontaminate.Items([1], [" ".join(vocabulary[:90])])
    words = decontaminate.coded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), items)
    read, plain = [], type(words).select
    monkeypatch.setattr(type(words), "select", lambda self, *c: (read.append(c) if self is words else None, plain(self, *c))[1])
    weight = np.append(0, np.linspace(0.5, 3, 90))
    base = decontaminate.latent_spaces(words, items, [(items, weight)])[0]
    assert len(read) == 2 and np.allclose(base.T @ base, np.eye(base.shape[1]), atol=1e-6)
    numbers, counts = items.numbers(decontaminate.read_words(__import__("pyarrow").array(texts))[0]), decontaminate.read_words(__import__("pyarrow").array(texts))[1]
    rows = (weight[:, None] * np.random.default_rng(0).standard_normal((91, 9))).astype(np.float32)
    monkeypatch.setattr(decontaminate, "DENSE", 20)
    monkeypatch.setattr(decontaminate, "AT_ONCE", 7)
    got, want = np.zeros((91, 9)), np.zeros((91, 9))
    decontaminate.squared(numbers, counts, rows, got, decontaminate.columns_of(weight))
    for lo, hi in zip(counts[:-1], counts[1:]):
        for at in range(lo, max(lo + 1, hi - decontaminate.STRIDE), decontaminate.STRIDE):
            some = np.bincount(numbers[at : min(hi, at + 2 * decontaminate.STRIDE)], minlength=91) * (np.arange(91) > 0)
            want += np.outer(some, some @ rows)
    assert np.abs(got - want).max() < 1e-4 * np.abs(want).max()


def test_decontamination_by_long_items(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(3000)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(n - 9) + ". " + text(9) + ".") for i, n in enumerate((30, 97, 200, 300, 1500))]
    some = lambda i, share: " ".join("other" if k % 20 >= 20 * share else w for k, w in enumerate(items[i][1].split()))
    docs = [(i, text(r.randint(0, 400))) for i in range(60)]
    docs += [(100 + i, text(150) + " " + t + " " + text(90)) for i, t in items]
    docs += [(200 + i, text(77) + " " + some(i, 0.8)) for i in (2, 3, 4)]
    docs += [(300 + i, text(77) + " " + some(i, 0.5)) for i in (2, 3, 4)]
    docs += [(400, " ".join(items[3][1].split()[:100])), (401, text(50) + " " + " ".join(items[3][1].split()[120:]))]
    got = collected(decontaminate.op2(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")))
    assert [(d, i) for d, i, _ in got] == [(100, 0), (101, 1), (102, 2), (103, 3), (104, 4), (202, 2), (203, 3), (204, 4), (401, 3)]
    assert [s for d, _, s in got if d < 200] == [1.0] * 5


@pytest.mark.parametrize("op", [suffixes.op4, fmindex.op9, neardup.op5, lines.op1])
def test_empty_table(spark, op):
    assert op(frame(spark, EMPTY)).count() == 0


@pytest.mark.parametrize("op", [suffixes.op4, fmindex.op9, neardup.op5, lines.op1])
def test_tasks_without_words(spark, op):
    """Workers that have seen no word before."""
    repeats._powers.clear()
    docs = frame(spark, [(1, None), (2, ""), (3, " \n")]).repartition(1)
    assert sorted(r.doc_id for r in op(docs).collect()) == [1, 2, 3]
    assert [len(x) for x in repeats.powers(0)] == [0, 0]


@pytest.mark.parametrize("op", [suffixes.op4, fmindex.op9, neardup.op5, lines.op1])
def test_repeated_rows_and_null_ids(spark, op):
    text = " ".join(f"w{i}" for i in range(60))
    docs = frame(spark, [(1, text), (1, text), (None, text), (None, None)])
    rows = op(docs).collect()
    assert len(rows) == 4 and sum(r.doc_id is None for r in rows) == 2
    assert len({tuple(r) for r in rows if r.doc_id == 1}) == 1
    if "n_removed" in rows[0]:  # as one document: nothing stands before it
        assert [r.n_removed for r in rows if r.doc_id == 1] == [0, 0]
