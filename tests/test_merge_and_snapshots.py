from pyspark.sql import functions as F

from spanrank.operators import merge, rank, snapshots

# Scores, ranges and expected results below are fixed values: behaviour that must match.


def test_runs():
    s = [0.674, 0.673, 0.676, 0.674, 0.716, 0.791]
    assert merge.runs(s, merge.Rule(), 0.61) == [(5, 5), (4, 4), (0, 3)]
    assert merge.runs([0.78, 0.77, 0.76, 0.75], merge.Rule(), 0.55) == [(0, 3)]
    assert len(merge.runs([0.87, 0.87, 0.86, 0.86], merge.Rule(), None)) == 1
    assert len(merge.runs([0.62, 0.81], merge.Rule(), None)) == 2
    assert merge.runs([-0.5, -0.6], merge.Rule(), None) == [(0, 0), (1, 1)]
    assert merge.shared_trail(["a > b", "a > c"]) == "a" and merge.shared_trail(["x", "y"]) == "x"


def test_merging_keeps_owners_apart(spark):
    rows = spark.createDataFrame([(0, "p", 1, 2, 0.9, 1, "a"), (0, "p", 3, 4, 0.9, 2, "a"), (1, "p", 5, 6, 0.9, 3, "a")], "owner int, path string, start int, end int, score double, rank int, trail string")
    none = spark.range(1).select(F.lit(None).cast("double").alias("background"))
    got = merge.results(rows, none, 5).collect()
    assert sorted((r.owner, r.start, r.end, r.pieces) for r in got) == [(0, 1, 4, 2), (1, 5, 6, 1)]


def test_window():
    assert rank.hydration_window(4) == rank.hydration_window(10) == 128 and rank.hydration_window(10000) >= 10000


def files(spark, **hashes):
    return spark.createDataFrame([(p, h) for p, h in hashes.items()], "path string, hash long")


def test_moves(spark):
    def pairs(a, b):
        return [tuple(r) for r in snapshots.moves(snapshots.diff(files(spark, **a), files(spark, **b))).collect()]

    assert pairs({"a": 1}, {"b": 1}) == [("a", "b")]
    assert pairs({"a": 1}, {"a": 1, "b": 1}) == []
    assert pairs({"a": 1}, {"b": 1, "c": 1}) == [("a", "b")]


def test_slots(spark):
    s = spark.createDataFrame([(7, "b", 1), (1, "a", 2), (9, "c", 3)], "slot long, path string, start int")
    assert snapshots.high_water(s).first()[0] == 10
    assert snapshots.high_water(s.where("false")).first()[0] == 0
    out, vectors = snapshots.compacted(s, s.select("slot"))
    assert [(r.slot, r.path) for r in out.orderBy("slot").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert sorted(r.slot for r in vectors.collect()) == [0, 1, 2]
    assert [r.path for r in snapshots.sliced(spark.createDataFrame([("keep/a",), ("keeper.md",)], "path string"), "keep").collect()] == ["a"]


