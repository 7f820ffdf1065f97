"""Personal data: fixed patterns, and what their contexts lead to (DataFrame
functions only).

The base spans of four kinds are the leftmost non-overlapping matches of fixed
patterns.  They seed a bootstrap.  An instance is an identifier-like word (one with
a digit or an @), known by its letters and by the shape of its characters; a pattern
is a lexical context: the two words before it, or the one before and the one after.
Patterns and instances form a graph with counts, scored again and again:

* a pattern is worth the share of its occurrences that are known (base spans, words
  already found, anywhere in the corpus, and at their own worth those of trusted
  shapes), times a logarithm of how many are known, and never less than before;
* a shape is worth the mean of its occurrences' patterns, so that common shapes, as
  those of years, stay worthless however trusted one of their contexts is;
* words of a trusted shape in a trusted pattern are found; from then on they are
  known wherever they stand, and so induce patterns that no base span stands in.

It ends when a round finds nothing new.  Found words that overlap no base span are
added as spans of the kind most known words of their shape have, else of the kind
most known words of their pattern have.

Defined results: a null or empty text has no spans; overlapping matches of different
kinds all count, as each kind is matched by itself; rows are judged one by one, so
repeated rows get equal spans; between kinds with equal counts the later one listed
is taken; an empty table gives an empty result; a text without identifier-like words
takes no part in the graph.  All patterns take time in proportion to the text, and
places are summed by blocks of BLOCK matches, so long words and many matches do no
harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanrank.llm.common import materialise, text_of

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, made linear: atoms don't give back what can't help,
#: and a match starts where a run of its first class does or the last one ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a kind's pattern to be tried at all.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
#: An identifier-like word: no white space, with a digit or an @; a match starts where a word does.
WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Signs around a word, not its own.
LEADING, TRAILING = r"^[^\p{L}\p{N}]++", r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$"
TRUST, SUPPORT, SEEDS = 0.5, 4, 2
#: What a shape must be worth.  Half of TRUST: contexts not reached yet count against it.
FORM = 0.25
#: Matches whose places are summed together.
BLOCK = 256
SPAN = "array<struct<s:int,e:int,m:string>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.lit(0),
        lambda s, i: s
        + F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(sum(divmod(2 * d, 10))) for d in range(10)]), F.substring(digits, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return total % 10 == 0


def passes(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return match.rlike(OCTETS)
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def passing(kind: str):
    return lambda x: passes(kind, x["m"])


def tagged(kind: str):
    return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("k"))


def of_kind(kind: str):
    return lambda x: x["k"] == kind


def let(value: Column, use) -> Column:
    """``use(value)``, the value being worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_blocks(each: Column) -> Column:
    """An array cut into arrays of BLOCK."""
    count = F.floor((F.size(each) + BLOCK - 1) / BLOCK).cast("int")
    return F.transform(F.filter(F.sequence(F.lit(0), count), lambda k: k < count), lambda k: F.slice(each, k * BLOCK + 1, F.lit(BLOCK)))


def located(text: Column, pattern: str) -> Column:
    """[(start, end, match)] of a pattern's matches, in code points, from the pieces
    between them.

    Places are running sums: of whole blocks first, then inside each block, so that
    no array grows one by one beyond a block's length."""
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    each = F.filter(F.zip_with(between, matches, lambda b, m: F.struct(F.length(b).alias("b"), m.alias("m"))), lambda x: x["m"].isNotNull())
    step = lambda x: x["b"] + F.length(x["m"])
    heads = lambda blocks: F.aggregate(
        F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda n, y: n + step(y))),
        F.struct(F.array().cast("array<int>").alias("o"), F.lit(0).alias("n")),
        lambda a, n: F.struct(F.array_append(a["o"], a["n"]).alias("o"), (a["n"] + n).alias("n")),
        lambda a: a["o"],
    )
    within = lambda x, at: F.aggregate(
        x,
        F.struct(F.array().cast(SPAN).alias("out"), at.alias("at")),
        lambda a, y: F.struct(
            F.array_append(a["out"], F.struct((a["at"] + y["b"]).alias("s"), (a["at"] + step(y)).alias("e"), y["m"].alias("m"))).alias("out"),
            (a["at"] + step(y)).alias("at"),
        ),
        lambda a: a["out"],
    )
    return let(let(each, in_blocks), lambda blocks: F.flatten(F.zip_with(blocks, heads(blocks), within)))


def base_spans(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """The carried columns, ``_text``, and for each kind an array of (s, e, m)."""
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    out = docs.select(*carry, text_of(docs).alias("_text"))
    for kind in KINDS:
        found = F.when(F.col("_text").rlike(NEEDS[kind]), located(F.col("_text"), PATTERNS[kind])).otherwise(none)
        out = out.withColumn(f"_{kind}_all", found)
    for kind in KINDS:
        out = out.withColumn(f"_{kind}", F.filter(f"_{kind}_all", passing(kind))).drop(f"_{kind}_all")
    return out


def shape(word: Column) -> Column:
    """Runs of letters, each digit, and the rest, as in "a99-9999", as one number."""
    x = F.regexp_replace(F.regexp_replace(word, r"\p{Lu}+", "A"), r"\p{Ll}+", "a")
    return F.xxhash64(F.regexp_replace(x, r"[0-9]", "9"))


def judged_words(text: Column, spans: Column) -> Column:
    """The identifier-like words of a text: where the word without the signs around it
    starts and ends, its letters, the patterns it stands in, the kind of the base span
    it overlaps.  Spans are compared a block of words at a time."""
    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    end = lambda x: x["s"] + F.length(x["w"])

    def placed(tokens: Column) -> Column:
        """In the order of the words: what stands around them, digits all alike."""
        at = F.filter(F.transform(tokens, lambda w, i: F.when(w.rlike("[0-9@]"), i)), lambda i: i.isNotNull())
        said = lambda i: F.regexp_replace(F.lower(F.get(tokens, i)), "[0-9]", "9")
        word = lambda x, i: F.struct(
            (x["s"] + F.length(F.regexp_extract(x["m"], LEADING, 0))).alias("s"),
            F.regexp_replace(F.regexp_replace(x["m"], LEADING, ""), TRAILING, "").alias("w"),
            # A context has words: the start of a text is none.
            F.when(i >= 2, F.xxhash64(F.lit("<"), said(i - 2), said(i - 1))).alias("p"),
            F.when((i >= 1) & (i + 1 < F.size(tokens)), F.xxhash64(F.lit("="), said(i - 1), said(i + 1))).alias("q"),
        )
        return F.filter(F.zip_with(located(text, WORD), at, word), lambda x: x["w"] != "")

    def told(block: Column) -> Column:
        near = F.filter(spans, lambda z: (z["e"] > F.get(block, F.lit(0))["s"]) & (z["s"] < end(F.element_at(block, -1))))
        kind = lambda x, zs: F.get(F.filter(zs, lambda z: (z["s"] < end(x)) & (z["e"] > x["s"])), F.lit(0))["k"]
        full = lambda x, zs: F.struct(x["s"].alias("s"), end(x).alias("e"), x["w"].alias("w"), x["p"].alias("p"), x["q"].alias("q"), kind(x, zs).alias("kind"))
        return let(near, lambda zs: F.transform(block, lambda x: full(x, zs)))

    return F.flatten(F.transform(let(let(split, placed), in_blocks), told))


def read_once(docs: DataFrame) -> DataFrame:
    """A row per document, written: id, digest of the text, base spans by kind, identifier-like words."""
    based = base_spans(docs, ("doc_id",))
    spans = F.concat(*[F.transform(f"_{k}", tagged(k)) for k in KINDS])
    told = based.withColumn("_spans", spans)
    none = F.array().cast("array<struct<s:int,e:int,w:string,p:bigint,q:bigint,kind:string>>")
    words = F.when(F.col("_text").rlike("[0-9@]"), judged_words(F.col("_text"), F.col("_spans"))).otherwise(none)
    bare = [F.transform(f"_{k}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(f"_{k}") for k in KINDS]
    return materialise(told.select("doc_id", F.xxhash64("_text").alias("_digest"), *bare, words.alias("_words")), "pii-read")


def believed(words: DataFrame, trust: float = TRUST, support: int = SUPPORT, seeds: int = SEEDS, form: float = FORM) -> DataFrame:
    """(p, q, shape, word, kind) of the instances to believe in.

    ``words`` has p, q, shape, word and kind (null: no base span).  Equal rows are
    summed first.  Patterns with less than ``support`` occurrences can never be
    trusted, so the rounds run over the instances of the others alone; what a shape
    has beside them counts against it."""
    every = materialise(words.groupBy("p", "q", "shape", "word", "kind").agg(F.count(F.lit(1)).alias("n")), "pii-cells")
    cells = every
    both = F.array_distinct(F.filter(F.array("p", "q"), lambda x: x.isNotNull()))
    often = materialise(cells.select(F.explode(both).alias("pattern"), "n").groupBy("pattern").agg(F.sum("n").alias("all")).where(F.col("all") >= support), "pii-patterns")
    for c in ("p", "q"):
        name = often.select(F.col("pattern").alias(c), F.lit(True).alias(f"_{c}"))
        cells = cells.join(name, c, "left")
    live = cells.select(*[F.when(F.col(f"_{c}"), F.col(c)).alias(c) for c in ("p", "q")], "shape", "word", "kind", "n")
    live = materialise(live.where("p is not null or q is not null"), "pii-cells")
    whole = every.groupBy("shape").agg(F.sum("n").alias("whole")).join(live.select("shape").distinct(), "shape", "left_semi")
    whole = materialise(whole, "pii-shapes")
    votes = [f"_v{k}" for k in range(len(KINDS))]
    index = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    state = live.select("p", "q", "shape", "word", "kind", "n", F.coalesce(index, F.lit(-1)).alias("as_kind"), F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0).alias("belief"), F.lit(False).alias("by_p"), F.lit(False).alias("by_q"))
    scores = often.where("false").select("pattern", F.lit(0.0).alias("was"))
    before = -1
    while True:
        # Patterns: the share that is known, by a logarithm of how many.
        by = state.select(F.explode(both).alias("pattern"), "n", "belief", "as_kind").groupBy("pattern").agg(
            F.sum("n").alias("all"),
            F.sum(F.col("n") * F.col("belief")).alias("known"),
            *[F.sum(F.when(F.col("as_kind") == k, F.col("n") * F.col("belief")).otherwise(0.0)).alias(v) for k, v in enumerate(votes)],
        )
        weight = F.least(F.lit(1.0), F.log1p("known") / F.log1p(F.lit(float(seeds))))
        now = by.join(scores, "pattern", "left").select("pattern", F.greatest(F.col("known") / F.col("all") * weight, F.coalesce("was", F.lit(0.0))).alias("score"), *votes)
        now = materialise(now.where("score > 0"), "pii-scores")
        joined = state
        for c in ("p", "q"):
            side = now.select(F.col("pattern").alias(c), F.struct("score", *votes).alias(f"_{c}"))
            joined = joined.join(side, c, "left")
        joined = joined.withColumn("_best", F.greatest("_p", "_q")).withColumn("score", F.coalesce(F.col("_best.score"), F.lit(0.0)))
        for c in ("p", "q"):
            joined = joined.withColumn(f"by_{c}", F.col(f"by_{c}") | F.coalesce(F.col(f"_{c}.score") >= trust, F.lit(False)))
        joined = materialise(joined.drop("_p", "_q"), "pii-joined")
        # Shapes: the mean over all their occurrences, those in rare patterns as nothing.
        shapes = joined.groupBy("shape").agg(
            F.sum(F.col("n") * F.col("score")).alias("_sum"), *[F.sum(F.when(F.col("as_kind") == k, F.col("n") * F.col("belief")).otherwise(0.0)).alias(f"_s{k}") for k in range(len(KINDS))]
        )
        shapes = shapes.join(whole, "shape").select("shape", (F.col("_sum") / F.col("whole")).alias("worth"), *[f"_s{k}" for k in range(len(KINDS))])
        most = lambda names: F.greatest(*[F.struct(F.coalesce(n, F.lit(0.0)).alias("n"), F.lit(k).alias("k")) for k, n in names])
        of_shape, of_pattern = most([(k, F.col(f"_s{k}")) for k in range(len(KINDS))]), most([(k, F.col(f"_best.{v}")) for k, v in enumerate(votes)])
        told = joined.join(shapes.where(F.col("worth") >= form), "shape", "left").withColumn("worth", F.coalesce("worth", F.lit(0.0)))
        hit = F.col("kind").isNull() & (F.col("worth") >= form)
        guess = F.when(of_shape["n"] > 0, of_shape["k"]).otherwise(of_pattern["k"])
        told = materialise(
            told.select("p", "q", "shape", "word", "kind", "n", "as_kind", "belief", "worth", *[(F.col(f"by_{c}") & hit).alias(f"by_{c}") for c in ("p", "q")], guess.alias("guess")), "pii-told"
        )
        # A word found once is known wherever it stands.
        known = told.where("by_p or by_q or kind is not null").groupBy("word").agg(F.max("guess").alias("_guess"), F.lit(True).alias("_known"))
        state = told.join(known, "word", "left").select(
            "p", "q", "shape", "word", "kind", "n", "by_p", "by_q",
            F.when(F.col("kind").isNotNull(), F.col("as_kind")).when(F.col("_known"), F.coalesce("_guess", F.lit(-1))).when(F.col("worth") > 0, F.col("guess")).otherwise(-1).alias("as_kind"),
            F.when(F.col("kind").isNotNull() | F.col("_known"), 1.0).otherwise(F.greatest("belief", F.col("worth"))).alias("belief"),
        )
        state = materialise(state, "pii-state")
        scores = now.select("pattern", F.col("score").alias("was"))
        count = state.where("by_p or by_q").count()
        if count == before or count == 0:
            break
        before = count
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.greatest(F.col("as_kind"), F.lit(0)) + 1)
    return state.where("by_p or by_q").select(*[F.when(F.col(f"by_{c}"), F.col(c)).alias(c) for c in ("p", "q")], "shape", "word", name.alias("k")).distinct()


def found_spans(docs: DataFrame, **limits) -> DataFrame:
    """Every row with its base spans by kind and the array ``_found`` of (s, e, k)."""
    based = read_once(docs)
    each = based.select("doc_id", "_digest", F.explode("_words").alias("x"))
    words = each.select("doc_id", "_digest", "x.s", "x.e", "x.p", "x.q", shape(F.col("x.w")).alias("shape"), F.xxhash64(F.lower("x.w")).alias("word"), "x.kind")
    words = materialise(words.where("p is not null or q is not null"), "pii-words")
    sure = believed(words, **limits)
    # The rounds know an instance by its frequent patterns alone, so a word is found by either.
    hits = None
    for c in ("p", "q"):
        own = sure.where(F.col(c).isNotNull()).groupBy(c, "shape", "word").agg(F.max("k").alias("k"))
        one = words.where("kind is null").join(own, [c, "shape", "word"]).select("doc_id", "_digest", "s", "e", "k")
        hits = one if hits is None else hits.unionByName(one)
    hits = hits.groupBy("doc_id", "_digest", "s", "e").agg(F.max("k").alias("k"))
    by = hits.groupBy(F.col("doc_id").alias("_doc"), F.col("_digest").alias("_dig")).agg(F.sort_array(F.collect_list(F.struct("s", "e", "k"))).alias("_found"))
    short = based.drop("_words")
    return short.join(by, short["doc_id"].eqNullSafe(by["_doc"]) & (short["_digest"] == by["_dig"]), "left")


def name(kind: str):
    return lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string"))


def told() -> list[Column]:
    """The counts of base spans, and the digest of their list."""
    base = F.concat(*[F.transform(f"_{k}", name(k)) for k in KINDS])
    return [*[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.encode(F.array_join(base, ","), "UTF-8"), 256).alias("base_sha256")]


def based(docs: DataFrame) -> DataFrame:
    """The base spans of every row, counted and digested."""
    return base_spans(docs, ("doc_id",)).select("doc_id", *told())


def op10(docs: DataFrame) -> DataFrame:
    out = found_spans(docs)
    more = F.transform(F.coalesce("_found", F.array().cast("array<struct<s:int,e:int,k:string>>")), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    # All spans: by kind as listed, then start; a found span stands among its kind.
    per_kind = [
        F.transform(
            F.sort_array(F.concat(
                F.transform(f"_{k}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))),
                F.transform(F.filter(more, of_kind(k)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))),
            )),
            name(k),
        )
        for k in KINDS
    ]
    return out.select(
        "doc_id",
        *told(),
        F.array_join(F.concat(*per_kind), ",").alias("spans"),
        F.coalesce(F.size("_found"), F.lit(0)).cast("long").alias("n_found"),
    )
