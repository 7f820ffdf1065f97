import numpy as np
import pytest

from spanrank.functions import embed as E
from spanrank.plans.index import Index, Settings, query
from spanrank.sources.catalog import Catalog, Locked
from spanrank.streaming import ingest


def write(root, **files):
    for name, text in files.items():
        p = root / (name.replace("__", "/") + ".md")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def test_life_of_an_index(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    write(docs, a="---\nid: 1\nstatus: live\n---\n# Cats\ncats purr softly\n", sub__b="# Dogs\ndogs bark loudly\n", c="")
    index = Index(spark, str(tmp_path / "index"))
    assert index.update(str(docs))["files"] == {"new": 3}
    assert index.status().first().asDict() == {"files": 2, "sections": 2, "functions": 0, "truncated": 0}
    assert index.query("cats purr", limit=1).first()["path"] == "a.md"
    assert index.query("dogs", where=["status=live"]).first()["path"] == "a.md"
    assert [r.key for r in index.keys().collect()] == ["id", "status"]
    assert index.update(str(docs))["files"] == {"unchanged": 3}
    (docs / "sub" / "b.md").rename(docs / "d.md")
    write(docs, a="")
    done = index.update(str(docs))
    assert done["files"] == {"unchanged": 1, "changed": 1, "gone": 1, "new": 1} and done["sections"] == 1
    assert [r.path for r in index.catalog.read("sections").collect()] == ["d.md"]
    hits = index.query("dogs")
    assert index.stale(hits, str(docs)).count() == 0
    write(docs, d="# Dogs\nother words here\n")
    assert index.stale(hits, str(docs)).count() == 1
    assert index.catalog.inconsistent() == 0
    assert query([index, index], "dogs").count() == 1


def test_an_update_writes_its_own_rows_alone(spark, tmp_path, monkeypatch):
    from spanrank.sources import catalog

    docs = tmp_path / "docs"
    write(docs, **{f"f{i}": f"# T{i}\nwords number {i}\n" for i in range(6)})
    index = Index(spark, str(tmp_path / "index"))
    index.update(str(docs))
    state = index.catalog.state()
    old = {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    write(docs, f3="# Other\nnew text\n")
    (docs / "f4.md").rename(docs / "g4.md")
    done = index.update(str(docs))
    assert (done["embedded"], done["held"], done["dead"]) == (1, 5, 1)
    now = index.catalog.state()
    assert all(p.stat().st_mtime_ns == t for p, t in old.items())
    assert all(now["runs"][t][:1] == state["runs"][t] for t in now["runs"])
    new = lambda t: spark.read.parquet(f"{index.catalog.root}/{now['runs'][t][-1][1]}")
    assert (new("vectors").count(), sorted(r.path for r in new("sections").collect())) == (1, ["f3.md", "g4.md"])
    # A slot that died is never given again.
    assert index.catalog.read("vectors").agg({"slot": "max"}).first()[0] == 6 and index.catalog.inconsistent() == 0
    assert index.query("new text", limit=1).first()["path"] == "f3.md"
    monkeypatch.setattr(catalog, "RUNS", 2)
    write(docs, f0="# Zero\nagain\n")
    index.update(str(docs))
    assert len(index.catalog.state()["runs"]["sections"]) == 2 and index.catalog.read("sections").count() == 6
    index.catalog.vacuum(1)
    assert index.catalog.read("sections").count() == 6 and index.catalog.read("vectors").count() == 8


def test_a_query_set_and_arms(spark):
    from spanrank.operators import evaluate

    results = spark.createDataFrame([(1, "a", 1, 5, 1), (1, "a", 300, 900, 2), (2, "a", 1, 5, 1)], "query int, file string, start int, end int, rank int")
    pairs = spark.createDataFrame([(1, "a", 700, "x"), (2, "a", 6, "x")], "query int, file string, line int, lang string")
    assert evaluate.scored(results, pairs, ("lang",)).first().asDict() == {"lang": "x", "n": 2, "top1": 0, "top5": 1, "top10": 1, "top20": 1, "mrr": 0.25}


def test_extract(spark, tmp_path):
    docs = tmp_path / "docs"
    write(docs, keep__a="# A\none\n", keeper="# B\ntwo\n")
    index = Index(spark, str(tmp_path / "index"))
    index.update(str(docs))
    out = index.extract("keep", str(tmp_path / "slice"), str(docs / "keep"))
    assert [(r.path, r.slot) for r in out.catalog.read("sections").collect()] == [("a.md", 0)]
    write(docs, keep__a="# A\nchanged\n")
    with pytest.raises(ValueError):
        index.extract("keep", str(tmp_path / "other"), str(docs / "keep"))


def test_stream(spark, tmp_path):
    docs = tmp_path / "docs"
    write(docs, a="# Cats\ncats purr\n")
    index = Index(spark, str(tmp_path / "index"))
    for text in (None, "# Dogs\ndogs bark\n"):
        if text:
            write(docs, b=text)
        ingest.ingest(index, ingest.arrivals(spark, str(docs)), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.path for r in index.catalog.read("sections").collect()) == ["a.md", "b.md"]


def test_lock_and_isolation(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    with c.lock(), pytest.raises(Locked):
        with c.lock():
            pass
    assert c.read("files").count() == 0 and c.current() is None
    old = c.commit({}, files=spark.createDataFrame([("a", -1, 2, -3)], c.read("files").schema))
    seen = c.read("files", old)
    c.commit({}, replace=True, files=spark.createDataFrame([("b", 1, 2, 3)], c.read("files").schema))
    assert [r.path for r in seen.collect()] == ["a"] and [r.path for r in c.read("files").collect()] == ["b"]


def test_settings_and_embedders():
    assert Settings.resolve({"max_chars": None}, {"max_chars": 5}, {"max_chars": 7, "code": "yes"}).max_chars == 5
    assert Settings.resolve({"max_chars": 0}).max_chars == 8000
    e = E.HashEmbedder()
    assert np.allclose((e.embed(["a b", ""]) ** 2).sum(axis=1), [1, 0])

    class Picky:
        def embed(self, texts):
            if len(texts[0]) > 1000:
                raise E.Refused
            return np.zeros((1, 1))

    assert E.calibrate(Picky(), "x" * 9000, 8000) == 1000
    with pytest.raises(ValueError):
        E.check_transport("http://example.org/v1", False)
    E.check_transport("http://localhost:1/v1", False)
