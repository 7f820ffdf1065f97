"""Quality rules whose cut-offs carry a guarantee (DataFrame functions only).

Each rule measures a document and rejects it at or above a cut-off.  The cut-offs
of all measures stand in one order per stratum, and the joint rule of the first
so many of them is tested, from the mildest on, by an exact binomial test of
labelled good documents against the whole ``risk``, stopping at the first that
fails; so no correction is due inside the sequence, and the error is split evenly
over the strata (Bonferroni).  The order is fixed without the good labels it is
tested on: cut-offs that reject fewer good documents of the other strata come
first, then those of the measure that more of the stratum's bad ones stand out by.
Every rule inside the last admitted joint rule rejects less than it, so together
the rules reject less than ``risk`` of the good documents of any stratum, with
probability ``1 - error``.  Of the admitted cut-offs of a measure the one is taken
that gains most bad documents, counting a good one ``penalty`` times.

A stratum with too few good labels to admit even a rule that rejects none of them
(n ln(1 - risk) > ln(error / strata)) is tested together with all others like it;
what is promised then holds for their documents taken together.

The labels are not split: the order is fixed without the good labels of the stratum
that it is tested on, and the test stops at its first failure, so each of them serves
as held out.  Strata are those that have labels.

Defined results: a null or empty text has no words and fails the base rules; equal
gains go to the milder cut-off, and a very long text is measured as a whole; a
null stratum is a stratum of its own; where even the pooled strata have too few
labels, or a stratum has none, it gets no rule and so loses nothing; rows are judged one by one, so repeated
rows get equal verdicts; labels that repeat count once per row; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanrank.llm.common import materialise, text_of, words_of

#: Steps of a measure's scale; a value lands in step floor(value * SCALE).
STEPS, SCALE = 64, 64.0
MEASURES = ("symbols", "capitals", "repeats", "dup_lines")
RISK, ERROR, PENALTY = 0.02, 0.05, 20.0
WINDOW = 8


def measured(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of every row's whole text, beside the carried columns."""
    keep = [docs[c].alias(c) for c in carry]
    text = text_of(docs)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.select(
        *keep,
        words_of(text).alias("_w"),
        lines.alias("_l"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}{2,}")).cast("long").alias("n_capitals"),
    )
    b = a.select(
        *carry,
        "n_symbols",
        "n_capitals",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    grams = F.expr(
        f"if(size(_h) < {WINDOW}, cast(array() as array<bigint>), "
        f"transform(sequence(1, size(_h) - {WINDOW - 1}), i -> xxhash64(slice(_h, i, {WINDOW}))))"
    )
    c = b.withColumn("_g", grams)
    # Only a text with some window twice is sorted to find which ones.
    d = c.withColumn(
        "_s",
        F.expr(
            "if(size(_g) = size(array_distinct(_g)), cast(array() as array<struct<x:bigint,i:int>>), "
            "sort_array(transform(_g, (x, i) -> struct(x, i))))"
        ),
    )
    e = d.withColumn(
        "_p",
        F.expr(
            "if(size(_s) = 0, cast(array() as array<int>), sort_array(transform(filter(_s, (x, i) -> "
            "(i > 0 and _s[greatest(i - 1, 0)].x = x.x) or "
            "(i + 1 < size(_s) and _s[least(i + 1, size(_s) - 1)].x = x.x)), x -> x.i)))"
        ),
    )
    covered = F.expr(
        "aggregate(_p, struct(0L as n, 0 as upto), (a, p) -> "
        f"struct(a.n + p + {WINDOW} - greatest(p, a.upto) as n, p + {WINDOW} as upto)).n"
    )
    return e.select(
        *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "n_capitals", "n_lines"
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def step_of(measure: str) -> Column:
    """The step of the measure's scale on which a row stands."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    value = {
        "symbols": F.col("n_symbols") / words,
        "capitals": F.col("n_capitals") / words,
        "repeats": F.col("n_repeat_words") / words,
        "dup_lines": F.col("n_dup_lines") / lines,
    }[measure]
    return F.least(F.lit(STEPS - 1), F.floor(value * SCALE)).cast("int")


def log_tail(k: str, n: str, p: float) -> str:
    """SQL for ln P(Bin(n, p) <= k), summed exactly, term by term, in logarithms."""
    one = f"ln(1 - {p!r}D)"  # doubles: a decimal would round
    odds = f"(ln({p!r}D) - {one})"
    return (
        f"aggregate(sequence(1, greatest(cast({k} as int), 1)), "
        f"struct({n} * {one} as t, {n} * {one} as s, 0 as i), (a, i) -> "
        f"if(i > {k}, a, transform(array(a.t + ln(greatest({n} - i + 1, 1) / i) + {odds}), t -> "
        f"struct(t as t, greatest(a.s, t) + ln(1 + exp(-abs(a.s - t))) as s, i as i))[0])).s"
    )


def cutoffs(
    labelled: DataFrame,
    stratum: str = "stratum",
    good: str = "good",
    risk: float = RISK,
    error: float = ERROR,
    penalty: float = PENALTY,
) -> DataFrame:
    """(stratum, measure, cutoff) of the admitted rules; the rows are bounded by
    strata x measures.  ``labelled`` has the counts, a stratum and a boolean."""
    steps = F.array(*[step_of(m) for m in MEASURES])
    known = labelled.where(F.col(good).isNotNull()).select(F.col(stratum).alias("stratum"), steps.alias("steps"), F.col(good).alias("good"))
    # Labels summed by their steps: few rows, as most documents stand at 0.
    cells = materialise(
        known.groupBy("stratum", "steps").agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b")),
        "quality-cells",
    )
    # One row per stratum; those with few good labels share a pool.
    strata = cells.groupBy("stratum").agg(F.sum("g").alias("n")).join(F.broadcast(cells.agg(F.count_distinct("stratum").alias("n_strata"))))
    few = F.col("n") * F.log1p(F.lit(-risk)) > F.log(F.lit(error) / F.col("n_strata"))
    member = strata.select("stratum", F.when(few, F.lit("\0pool")).otherwise(F.concat(F.lit("="), "stratum")).alias("pool"))
    pooled = cells.join(member, "stratum").groupBy("pool", "steps").agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
    pools = pooled.groupBy("pool").agg(F.sum("g").alias("n_good"), F.sum("b").alias("n_bad"))
    tests = pools.agg(F.count(F.lit(1)).alias("n_tests"))
    # One row per pool and measure: at most STEPS counts each, from here on independent of the corpus' size.
    rows = (
        pooled.select("pool", "g", "b", F.posexplode("steps").alias("measure", "step"))
        .groupBy("pool", "measure", "step")
        .agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
        .groupBy("pool", "measure")
        .agg(F.collect_list(F.struct("step", "g", "b")).alias("hist"))
    )
    every = F.expr(
        f"transform(sequence(1, {STEPS - 1}), c -> struct(c as cut, "
        "aggregate(filter(hist, h -> h.step >= c), 0L, (s, h) -> s + h.g) as k, "
        "aggregate(filter(hist, h -> h.step >= c), 0L, (s, h) -> s + h.b) as hits, "
        "aggregate(filter(hist, h -> h.step = c), 0L, (s, h) -> s + h.b) as own))"
    )
    cuts = rows.withColumn("cuts", F.explode(every)).select("pool", "measure", "cuts.*")
    order = Window.partitionBy("pool").orderBy("elsewhere", F.desc("reach"), "measure", F.desc("cut"))
    chain = (
        cuts.withColumn("elsewhere", F.sum("k").over(Window.partitionBy("measure", "cut")) - F.col("k"))
        .withColumn("reach", F.max("hits").over(Window.partitionBy("pool", "measure")))
        .where("own > 0")  # a cut-off that no bad document stands at gains nothing over the next
        .withColumn("rank", F.row_number().over(order))
    )
    # For each measure and step the first rule of the order that rejects it.
    first = chain.groupBy("pool").agg(F.collect_list(F.struct("measure", "cut", "rank")).alias("_c")).select(
        "pool",
        F.expr(
            f"transform(sequence(0, {len(MEASURES) * STEPS - 1}), x -> "
            f"array_min(transform(filter(_c, e -> e.measure = x div {STEPS} and e.cut <= x % {STEPS}), e -> e.rank)))"
        ).alias("_first"),
    )
    level = F.array_min(F.transform("steps", lambda x, m: F.get("_first", m * STEPS + x)))
    levels = pooled.join(first, "pool").groupBy("pool", level.alias("rank")).agg(F.sum("g").alias("g"))
    hist = levels.where("rank is not null").groupBy("pool").agg(F.collect_list(F.struct("rank", "g")).alias("hist"))
    tested = (
        chain.select("pool", "rank")
        .join(hist, "pool")
        .join(pools, "pool")
        .join(F.broadcast(tests))  # one row
        .withColumn("k", F.expr("aggregate(filter(hist, h -> h.rank <= rank), 0L, (s, h) -> s + h.g)"))
        .withColumn(
            "admitted",
            F.when(F.col("k") > risk * F.col("n_good"), F.lit(False)).otherwise(
                F.expr(f"if(k = 0, n_good * ln(1 - {risk!r}D), {log_tail('k', 'n_good', risk)})") <= F.log(F.lit(error) / F.col("n_tests"))
            ),
        )
    )
    # What lies behind the first failure is never reached.
    stop = tested.groupBy("pool").agg(F.min(F.when(~F.col("admitted"), F.col("rank"))).alias("stop"))
    gain = F.col("hits") / F.greatest("n_bad", F.lit(1)) - penalty * F.col("k") / F.greatest("n_good", F.lit(1))
    best = (
        chain.join(stop, "pool")
        .where("stop is null or rank < stop")
        .join(pools, "pool")
        .select("pool", "measure", F.struct(gain.alias("gain"), "cut").alias("fit"))
        .where("fit.gain > 0")
        .groupBy("pool", "measure")
        .agg(F.max("fit")["cut"].alias("cutoff"))
    )
    name = F.element_at(F.array(*map(F.lit, MEASURES)), F.col("measure") + 1)
    return member.join(best, "pool").select("stratum", name.alias("measure"), "cutoff")


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **limits: float) -> DataFrame:
    """One row per document: counts, base_failed, failed rules, kept."""
    named = docs.withColumn("_stratum", F.coalesce(docs[stratum].cast("string"), F.lit("\0null")))
    facts = materialise(measured(named, ("doc_id", "_stratum", *[c for c in ("_t",) if c in docs.columns])), "quality")
    known = labels.select(F.col("doc_id"), (F.col("quality") == 1).alias("good")).where("good is not null and doc_id is not null")
    rules = cutoffs(facts.join(known, "doc_id").where(~base_failed()), "_stratum", "good", **limits)
    # One row per stratum.  Catalyst broadcasts it only if its measured size is small.
    by = rules.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("measure", "cutoff"))).alias("_cut"))
    out = facts.join(by, facts["_stratum"] == by["stratum"], "left")
    fails = F.filter(
        F.array(*[F.when(step_of(m) >= F.try_element_at("_cut", F.lit(m)), F.lit(m)) for m in MEASURES]), lambda x: x.isNotNull()
    )
    return out.withColumn("base_failed", base_failed()).withColumn("failed_rules", F.array_join(fails, ",")).withColumn(
        "kept", ~F.col("base_failed") & (F.size(fails) == 0)
    )


def base(docs: DataFrame) -> DataFrame:
    """The counts of every row and whether it fails the base rules, whatever the labels."""
    return measured(docs).withColumn("base_failed", base_failed()).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(docs, labels).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "failed_rules",
    )


def kept_documents(docs: DataFrame, labels: DataFrame, **limits: float) -> DataFrame:
    """The documents that pass, with all their columns.

    A document is told by its id and a digest of its text, so a repeated id does
    not lose a row whose own text passes."""
    digest = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    bad = judged(docs.withColumn("_t", digest), labels, **limits).where(~F.col("kept")).select(F.col("doc_id").alias("_i"), F.col("_t").alias("_h")).distinct()
    tagged = docs.withColumn("_d", digest)
    return tagged.join(bad, tagged["doc_id"].eqNullSafe(bad["_i"]) & (tagged["_d"] == bad["_h"]), "left_anti").drop("_d")
