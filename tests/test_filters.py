import pytest
from pyspark.sql import functions as F

from spanrank.operators import frontmatter
from spanrank.operators import predicates as P
from spanrank.schema import FM


def rows(spark, *maps):
    data = [(i, {k: (isinstance(v, list), [frontmatter.scalar_text(x) for x in (v if isinstance(v, list) else [v])]) for k, v in m.items()}) for i, m in enumerate(maps)]
    return spark.createDataFrame(data, f"i int, fm {FM.simpleString()}")


def kept(df, *where):
    return sorted(r.i for r in df.where(P.keeps(P.parse(list(where))[0])).collect())


def test_presence_absence_and_alternatives(spark):
    df = rows(spark, {"status": "live", "type": "guide"}, {"status": "draft"}, {"tags": ["a", "b"]}, {"n": 1, "x": None})
    assert kept(df, "status=live") == [0]
    assert kept(df, "status!=live") == [1, 2, 3]
    assert kept(df, "!status") == [2, 3]
    assert kept(df, "x") == [3]
    assert kept(df, "tags=b") == [2]
    assert kept(df, "n=1") == [3]
    assert kept(df, "status=live|status=draft", "type") == [0]
    assert kept(df) == [0, 1, 2, 3]


@pytest.mark.parametrize("bad", ["version>=7", "version<2", "a>b|c", "a&b", "=live", "!", ""])
def test_refusals(bad):
    with pytest.raises(ValueError):
        P.parse([bad])


def test_hint():
    preds, hints = P.parse(["status=live|draft"])
    assert len(preds) == 1 and len(hints) == 1


def test_blames_only_what_no_row_meets(spark):
    df = rows(spark, {"status": "live"}, {"type": "note"})
    got = P.blames(df, P.parse(["status=live", "type=guide"])[0])
    assert [r.predicate for r in got.collect()] == ["type=guide"]


def test_anti_join(spark):
    df = rows(spark, {"id": 1, "supersedes": ["2", ""]}, {"id": 2}, {"name": "x"}, {"id": 4, "supersedes": ["4"]})
    assert sorted(r.i for r in P.exclude_pointed_at(df, df, ["supersedes"]).collect()) == [0, 2]
    # The pointers of rows that a filter drops still count.
    assert sorted(r.i for r in P.exclude_pointed_at(df.where("i > 0"), df, ["supersedes"]).collect()) == [2]


def test_frontmatter():
    got = frontmatter.parse("a:\n  b: 1.5\n  c: [x, 2]\nd: 2020-01-01\ne: yes\nf: null\ng: []\nh:\n- k: v\n- 3\ni: {}")
    assert got == {"a.b": (False, ["1.5"]), "a.c": (True, ["x", "2"]), "d": (False, ["2020-01-01"]), "e": (False, ["yes"]), "f": (False, ["null"]), "g": (True, []), "h[0].k": (False, ["v"]), "h[1]": (False, ["3"])}
    assert frontmatter.parse("a: 1\na: 2") == {} and frontmatter.parse("[") == {} and frontmatter.parse("x") == {} and frontmatter.parse(None) == {}


def test_null_map_counts_as_empty(spark):
    df = spark.range(1).select(F.lit(None).cast(FM).alias("fm"), F.col("id").cast("int").alias("i"))
    assert kept(df, "a!=b") == [0] and kept(df, "a") == []
