"""Measuring retrieval: ranks, fusion, contamination, overlap, reading cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a counted side of a join is broadcast.
SMALL = 500_000
#: Lines to a bin of ranges, where ranges meet.
BIN = 256


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has been counted and is small, else as it is."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def binned(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """A row for every bin of lines that a range touches (column ``_bin``)."""
    return ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor(F.greatest(F.col(start), F.col(end)) / BIN))))


def first_hits(results: DataFrame, query: str, relevant: Column) -> DataFrame:
    """The rank of each query's first relevant result, null if it has none."""
    return results.groupBy(query).agg(F.min(F.when(relevant, F.col("rank"))).alias("first"))


def summary(first: DataFrame, by: tuple[str, ...] = (), cut: int | None = None) -> DataFrame:
    """n, top1/5/10/20 and MRR, for all or by groups; ranks beyond ``cut`` are misses."""
    r = F.col("first") if cut is None else F.when(F.col("first") <= cut, F.col("first"))
    return first.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.sum((r <= k).cast("long")), F.lit(0)).alias(f"top{k}") for k in (1, 5, 10, 20)],
        F.round(F.coalesce(F.sum(1.0 / r), F.lit(0.0)) / F.count(F.lit(1)), 6).alias("mrr"),
    )


def fused(arms: list[DataFrame], query: str, item: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of arms (query, item, rank)."""
    union = arms[0].select(query, item, "rank")
    for a in arms[1:]:
        union = union.unionByName(a.select(query, item, "rank"))
    scored = union.groupBy(query, item).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    order = Window.partitionBy(query).orderBy(F.round("score", 9).desc(), item)
    return scored.withColumn("rank", F.row_number().over(order))


def containing(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """Results on (file, line) pairs: the range holds the line.  They meet by file and
    bin of lines, so that a file with very many of both is no single group."""
    near = binned(results, "start", "end").join(pairs.withColumn("_bin", F.floor(F.col("line") / BIN)), ["file", "_bin"])
    return near.where((F.col("start") <= F.col("line")) & (F.col("line") <= F.col("end"))).drop("_bin")


def overlapping(a: DataFrame, b: DataFrame, share: float = 0.5) -> DataFrame:
    """Pairs of ranges of one file that share at least ``share`` of the shorter one.
    They meet by file and bin of lines, each pair in the first bin both touch."""
    x = binned(a.select("file", *[F.col(c).alias(f"a_{c}") for c in ("id", "start", "end")]), "a_start", "a_end")
    y = binned(b.select("file", *[F.col(c).alias(f"b_{c}") for c in ("id", "start", "end")]), "b_start", "b_end")
    common = F.least("a_end", "b_end") - F.greatest("a_start", "b_start") + 1
    short = F.least(F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start")) + 1
    met = x.join(y, ["file", "_bin"]).where(F.col("_bin") == F.floor(F.greatest("a_start", "b_start") / BIN)).drop("_bin")
    return met.where(common >= share * short).withColumn("overlap", common)


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """For each (file, line) the start of the tightest span around it.  Spans are met
    line by line, so a file's spans are never crossed with its points."""
    lines = spans.select("file", F.col("id").alias("span"), "start", F.explode(F.sequence("start", "end")).alias("line"))
    return points.join(lines, ["file", "line"], "left").groupBy("file", "line").agg(F.max_by("span", F.struct("start", "span")).alias("span"))


def rolled_up(chunks: DataFrame, query: str, owner: str) -> DataFrame:
    """The best chunk's score for each owner, ranked."""
    best = chunks.groupBy(query, owner).agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.round("score", 9).desc(), owner)))


def reading_cost(ranked: DataFrame, query: str) -> DataFrame:
    """Distinct lines shown up to and including the first relevant unit (columns file, start, end, rank, hit)."""
    first = ranked.groupBy(query).agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("stop"))
    shown = ranked.join(first, query).where("rank <= stop").select(query, "file", F.explode(F.sequence("start", "end")).alias("line"))
    return shown.distinct().groupBy(query).agg(F.count(F.lit(1)).alias("lines"))


def lexical(units: DataFrame, queries: DataFrame, pattern: str = r"[A-Za-z0-9_]{3,}") -> DataFrame:
    """(query, id, words, matches): distinct query words in a unit, then all their matches.
    Units' words that nobody asks for go before anything is grouped."""
    words = lambda df, c: df.withColumn("word", F.explode(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))))
    asked = words(queries, F.col("q")).select("query", "word").distinct()
    wanted = small(asked.select("word").distinct())
    found = words(units, F.col("text")).select("id", "word").join(wanted, "word", "left_semi").groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    scored = found.join(asked, "word").groupBy("query", "id").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("matches"))
    order = Window.partitionBy("query").orderBy(F.col("words").desc(), F.col("matches").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order))


def contamination(hits: DataFrame, flagged: DataFrame, key: list[str]) -> DataFrame:
    """Share of hits that are flagged, in percent."""
    marked = hits.join(flagged.select(*key).distinct().withColumn("_bad", F.lit(1)), key, "left")
    return marked.agg(F.count(F.lit(1)).alias("hits"), F.count("_bad").alias("flagged"), F.round(100.0 * F.count("_bad") / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("percent"))


def grams(words: Column, n: int = 5) -> Column:
    """A digest of each run of ``n`` words."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))


def copies(a: DataFrame, b: DataFrame, a_id: str, b_id: str, n: int = 5) -> DataFrame:
    """Pairs with a common run of ``n`` words, and how many distinct ones they share.
    Runs are told by 64-bit digests; where ``b``'s are few, ``a``'s others are never shuffled."""
    words = F.array_remove(F.split(F.lower("text"), r"\s+"), "")  # a column of its own, or each gram would split the text again
    split = lambda df, i, name: df.select(F.col(i).alias(name), words.alias("_w")).select(name, F.explode(F.array_distinct(grams(F.col("_w"), n))).alias("gram"))
    x, y = split(a, a_id, a_id), split(b, b_id, b_id)
    return x.join(small(y), "gram").groupBy(a_id, b_id).agg(F.count(F.lit(1)).alias("shared"))


def stratified(rows: DataFrame, by: str, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows of each group, by a digest of seed and key."""
    order = Window.partitionBy(by).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def verdicts(cases: DataFrame) -> DataFrame:
    """kind of each case from its target's and its best other's score (0, 1, 2)."""
    kind = (
        F.when(F.col("target_score") < 1, "bad query").when(F.col("best_above") >= 2, "false miss").when(F.col("best_above") >= 1, "ambiguous").otherwise("true miss")
    )
    return cases.withColumn("kind", kind)


def bootstrap(rows: DataFrame, value: str, key: str, rounds: int = 200, seed: str = "0") -> DataFrame:
    """mean, low, high of a 95 % interval from Poisson resampling of whole rows.

    Draws come from a digest of the row's ``key`` and the round, so partitioning changes
    nothing; each task sends one row a round."""
    drawn = rows.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("k", F.lit("")), F.col("round").cast("string")))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2**32
    #: The Poisson distribution's sums.
    k = F.when(u < 0.367879, 0).when(u < 0.735759, 1).when(u < 0.919699, 2).when(u < 0.981012, 3).when(u < 0.996340, 4).otherwise(5)
    means = drawn.select("round", "v", k.alias("k")).groupBy("round").agg((F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def leaks_name(question: Column, name: Column, prefix: int = 5) -> Column:
    """Whether a question gives a name away: some word of it begins like the name."""
    return F.exists(F.split(F.lower(question), r"[^a-z0-9_]+"), lambda w: (F.length(w) >= prefix) & F.startswith(F.lower(name), F.substring(w, 1, prefix)))


def upper_median(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """The middle value, the upper one of two, by an exact discrete percentile from above."""
    return rows.groupBy(*by).agg((-F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -{value})")).alias("median"))


def group_sample(rows: DataFrame, by: str, key: str, n: int, seed: str, proposals: DataFrame | None = None) -> DataFrame:
    """:func:`stratified`, leaving out what has been proposed already."""
    left = rows if proposals is None else rows.join(proposals.select(key), key, "left_anti")
    return stratified(left, by, key, n, seed)


def rates(hits: DataFrame, flagged: DataFrame, query: str, key: list[str], arms: str) -> DataFrame:
    """:func:`contamination` of each arm (as with and without a filter): queries, hits, and the
    mean over queries of the percentage of hits that are flagged."""
    marked = hits.join(flagged.select(*key).distinct().withColumn("_bad", F.lit(1)), key, "left")
    each = marked.groupBy(arms, query).agg(F.count(F.lit(1)).alias("n"), F.count("_bad").alias("bad"))
    return each.groupBy(arms).agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("hits"), F.round(F.avg(100.0 * F.col("bad") / F.col("n")), 6).alias("percent"))


def title_sample(titles: DataFrame, title: str, n: int, seed: str) -> DataFrame:
    """``n`` distinct titles of two words or more, by a digest of seed and title."""
    tidy = F.trim(F.regexp_replace(title, r"\s+", " "))
    some = titles.select(tidy.alias("title")).where(F.contains("title", F.lit(" "))).distinct()
    return some.orderBy(F.md5(F.concat(F.lit(seed), "title")), "title").limit(n)


def control_pairs(proposals: DataFrame, ids: DataFrame, n: int, seed: str) -> DataFrame:
    """(a, b): ``n`` random pairs that nobody proposed.  Each id is paired with the next
    one in a seeded order, so pairs are as many as ids and none is made twice."""
    order = F.md5(F.concat(F.lit(seed), F.col("id").cast("string")))
    few = ids.select("id").distinct().orderBy(order, "id").limit(4 * n)  # enough, as proposals are rarely random
    ring = few.withColumn("next", F.lead("id").over(Window.orderBy(order, "id"))).where("next is not null")  # 4 n rows
    pairs = ring.select(F.least("id", "next").alias("a"), F.greatest("id", "next").alias("b"))
    left = pairs.join(proposals.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")), ["a", "b"], "left_anti")
    return left.orderBy(F.md5(F.concat(F.lit(seed), F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string"))), "a", "b").limit(n)


def judged(cases: DataFrame, verdicts_: DataFrame, labels: DataFrame) -> DataFrame:
    """Cases with their verdict's score (0, 1, 2) and label: what a judge said of each
    case's target, and of the best thing ranked above it."""
    best = verdicts_.where("not target").groupBy("case").agg(F.max("score").alias("best_above"))
    target = verdicts_.where("target").groupBy("case").agg(F.max("score").alias("target_score"))
    return verdicts(cases.join(target, "case").join(best, "case", "left").join(labels, "case", "left").withColumn("best_above", F.coalesce("best_above", F.lit(0))))


def lenient(results: DataFrame, query: str, score: str = "score") -> DataFrame:
    """The first rank that a judge gave 2, and the first that it gave at least 1."""
    return results.groupBy(query).agg(F.min(F.when(F.col(score) >= 2, F.col("rank"))).alias("strict"), F.min(F.when(F.col(score) >= 1, F.col("rank"))).alias("lenient"))


def tallies(verdicts_: DataFrame, by: str) -> DataFrame:
    """Of each group the share of verdicts 2, 1 and 0, and their mean."""
    share = lambda k: F.round(F.avg((F.col("score") == k).cast("double")), 6).alias(f"share_{k}")
    return verdicts_.groupBy(by).agg(F.count(F.lit(1)).alias("n"), share(2), share(1), share(0), F.round(F.avg("score"), 6).alias("mean"))


def scored(results: DataFrame, pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A query set's summary: ``results`` (query, file, start, end, rank) against ``pairs``
    (query, file, line and the columns of ``by``); a query without a hit is a miss."""
    hits = containing(results.withColumnRenamed("query", "_q"), pairs).where("_q = query").groupBy("query").agg(F.min("rank").alias("first"))
    return summary(pairs.select("query", *by).distinct().join(hits, "query", "left"), by)


def first_kinds(results: DataFrame, query: str, kind: str) -> DataFrame:
    """How many queries have each kind of unit as their first result."""
    first = results.groupBy(query).agg(F.min_by(kind, "rank").alias("kind"))
    return first.groupBy("kind").agg(F.count(F.lit(1)).alias("queries"))
