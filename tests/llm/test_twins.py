"""The corpus queries against their twins in SQL, on the smallest tables."""

import glob
import os

import pytest

from spanrank.llm import queries, sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = c.sql(f"SELECT {', '.join(columns)} FROM ({sql.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))


def test_urls_on_every_kind_of_row(spark):
    """Hosts, paths and rules against a plain version."""
    import random
    import re

    from spanrank.llm import urls

    r = random.Random(4)
    made = ["".join(r.choice(("http", "://", "://", "/", "?", "#", "www.", "example", ".com", ".net", ".NET", "/en/", "/es/", "/fr/", "a", "É", ".")) for _ in range(r.randint(0, 9))) for _ in range(400)] + [None, ""]

    def plain(url):
        if not url or "://" not in url:
            return "", "", None, None
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(t), t, v) for v, t in urls.RULES for name, _, tail in [t.partition("/")] if (host == name or host.endswith("." + name)) and path.startswith("/" + tail)]
        best = max(fit, default=(0, None, None))
        return host, path, best[1], best[2]

    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    ruled = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in urls.ruled(pages).collect()}
    assert [ruled[i] for i in range(len(made))] == [plain(u) for u in made]
    for x in urls.op8(pages).collect():
        host, path, rule, verdict = plain(made[x.page_id])
        assert (x.host, x.path, x.rule) == (host, path, rule) and x.verdict in ("allow", "block") and (verdict is None or x.verdict == verdict)
    empty = spark.createDataFrame([], "url string, label int")
    assert {x.verdict for x in urls.op8(pages, empty).collect() if x.rule is None} == {"allow"}
