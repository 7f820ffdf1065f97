import hashlib
import os
import random

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _d long, key string, _digest string, digest int"


def test_stages(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in c.STAGES:
        out = stage(spark, docs, SF)
        if name != c.STAGES[-1][0]:
            assert tuple(out.columns) == c.COLUMNS
        kept = out.count()
        assert 0 < kept <= before
        docs, before = out, kept
    assert c.run(spark, SF).count() == before


def tables(spark, place, docs, items, labels):
    for name, rows, schema in (
        ("documents", [(i, t, lang, "s", len(t or ""), 7, "k", "d", 1) for i, t, lang in docs], DOCS),
        ("benchmark", items, "item_id long, text string, key string"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{place}/{name}.parquet")
    return str(place)


def test_what_goes_and_what_stays(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    import corpus_pipeline as c

    r = random.Random(1)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    item = text(30) + ". " + text(10) + "."
    notice = "\n".join(text(6) for _ in range(4))
    clean = {i: text(80) for i in range(1, 9)}
    near = clean[3].split()
    near[40] = "other"
    docs = [(i, t, "en") for i, t in clean.items()]
    docs += [
        (20, None, "en"), (21, "", "en"), (22, "too short", None),
        (23, " ".join(near), "en"),  # near 3
        (24, clean[4], "en"),  # a copy of 4: its one long line goes first
        (25, text(40) + " " + item + " " + text(40), "en"),
        (26, text(50) + "\n" + notice + "\n" + text(30), "en"), (27, text(60) + "\n" + notice + "\n" + text(20), "en"),
        (None, text(90), None),
    ]
    sf = tables(spark, tmp_path, docs, [(1, item, "x"), (2, None, "y"), (None, "", "z")], [(1, 1, 0), (None, 1, 0), (20, None, None)])
    got = {x.doc_id: x for x in c.run(spark, sf).collect()}
    by_id = {i: t for i, t, _ in docs}
    want = {**clean, 26: by_id[26], 27: "\n".join(by_id[27].split("\n")[::5]), None: by_id[None]}
    assert set(got) - {24} == set(want)  # 24 is left empty by line dedup, in no group, and stays as such
    lib = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    for i, t in want.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert got[24].n_tokens == 0


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as c

    assert c.run(spark, tables(spark, tmp_path / "none", [], [], [])).count() == 0
    some = [(1, " ".join(f"w{i}" for i in range(40)), "en")]
    assert c.run(spark, tables(spark, tmp_path / "some", some, [], [])).count() == 1
