"""URL filters: rules first, then logistic regression on hashed n-grams
(DataFrame functions only).

The model learns from a table of labelled urls (url, label: 1 to block), the caller's
or this module's small one, which was made up for it: hosts built from general English
words to allow and from words of the spam trade to block; none is taken from any
table it judges.  ``held_out`` measures it on hosts whose words it hasn't seen.

Defined results: a null url, or one without ``://``, has an empty host and an
empty path, meets no rule, and is allowed; an empty table of labels gives a model
that allows everything; repeated urls get equal verdicts, and repeated labels count
once a row; rules of equal length go by their text; the whole of a very long url is
read; columns beside the named ones take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, rule) -- fixed values of the contract.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Words of the small labelled table: what hosts to block and to allow are made of.
BLOCK_WORDS = (
    "casino", "poker", "bets", "betting", "jackpot", "lottery", "slots", "pills", "pharma", "viagra", "cialis", "meds", "payday", "loans",
    "replica", "watches", "xxx", "adult", "porn", "sexy", "singles", "escort", "cams", "spam", "seo", "backlinks", "linkfarm", "clickads",
    "ads", "adtrack", "popups", "warez", "torrent", "cracked", "keygen", "crypto", "giveaway", "prizes", "moneyfast", "weightloss",
)
ALLOW_WORDS = (
    "weather", "theatre", "northern", "gathering", "together", "brother", "mother", "rhythm", "thesis", "thinking", "earth", "health",
    "nation", "station", "education", "library", "fashion", "edition", "action", "relation", "fiction", "vision", "portion", "lotion",
    "museum", "history", "garden", "recipes", "hospital", "school", "college", "council", "city", "village", "music", "painting",
    "science", "physics", "biology", "research", "journal", "daily", "evening", "morning", "courier", "letters", "reading", "writing",
    "cycling", "running", "hiking", "river", "mountain", "harbour", "bridge", "railway", "airport", "travel", "kitchen", "bakery",
    "farmers", "orchard", "forest", "animals", "birds", "planets", "climate", "energy", "software", "support", "status", "docs",
    "forum", "wiki", "parish", "charity", "community", "family", "children", "teacher", "theory", "method", "otherwise", "number",
)
#: What stands around them: the same for both.
AROUND = ("{}.test", "www.{}.test", "my-{}.test", "{}-online.test", "blog.{}.test", "m.the-{}.test", "{}24.test", "free-{}.test")
PATHS = ("/en/145", "/fr/72.html", "/de/980/", "/es/3?page=2&ref=x", "/en/511#top")
BUCKETS, SIZES, MAX_LABELLED, ROUNDS, RATE, DECAY = 1 << 16, (3, 4, 5), 2000, 400, 4.0, 1e-4


def host_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(url, pattern, 1), upper, lower), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; ``rules`` is a list of the caller's, not a table."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def features(df: DataFrame, host: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``_f``: the distinct hashed character n-grams of host and path."""
    chars = df.withColumn("_c", F.split(F.concat(F.lit("^"), F.col(host), F.lit("$"), F.col(path)), ""))
    grams = ", ".join(
        f"if(size(_c) < {k}, cast(array() as array<int>), transform(sequence(1, size(_c) - {k - 1}), "
        f"i -> cast(pmod(xxhash64(array_join(slice(_c, i, {k}), '')), {buckets}) as int)))"
        for k in SIZES
    )
    return chars.withColumn("_f", F.expr(f"array_distinct(flatten(array({grams})))")).drop("_c")


def seed_table(spark: SparkSession) -> DataFrame:
    """url, label, word, host: the small labelled table."""
    made = [(w, y, k) for y, words in ((1, BLOCK_WORDS), (0, ALLOW_WORDS)) for k, w in enumerate(words)]
    hosts = [(AROUND[(k + j) % len(AROUND)].format(w), PATHS[(k + 2 * j) % len(PATHS)], y, w) for w, y, k in made for j in range(2)]
    return spark.createDataFrame([(f"https://{h}{p}", y, w, h) for h, p, y, w in hosts], "url string, label int, word string, host string")


def held_out(labelled: DataFrame, group: str = "word", folds: int = 5, threshold: float = 0.5) -> DataFrame:
    """One row: how many labelled urls were judged, with the precision and recall of
    "block", each by a model that saw no url of the same ``group``."""
    out, fold = None, F.pmod(F.xxhash64(group), F.lit(folds))
    for k in range(folds):
        weights = fit(labelled.where(fold != k).select("url", "label"))
        host, path = host_path(F.col("url"))
        rest = features(labelled.where(fold == k).select("label", host.alias("_h"), path.alias("_q")), "_h", "_q")
        told = rest.select("label", (score("_f", weights) >= threshold).cast("int").alias("said"))
        out = told if out is None else out.unionByName(told)
    hits = F.sum(F.col("label") * F.col("said"))
    return out.agg(F.count(F.lit(1)).alias("n"), (hits / F.sum("said")).alias("precision"), (hits / F.sum("label")).alias("recall"))


def fit(labelled: DataFrame, max_labelled: int = MAX_LABELLED, buckets: int = BUCKETS, rounds: int = ROUNDS) -> list[float]:
    """Weights, the last one the intercept; ``buckets + 1`` numbers, whatever the data.

    At most ``max_labelled`` rows are used, taken by a digest of the url, so the
    one-row training table is bounded.  Full-batch gradient descent runs inside
    one expression over it."""
    host, path = host_path(F.col("url"))
    few = (
        labelled.where("label is not null")
        .orderBy(F.md5(F.coalesce("url", F.lit(""))), "url", "label")
        .limit(max_labelled)
        .select(F.col("label").cast("double").alias("y"), host.alias("_h"), path.alias("_q"))
    )
    one = features(few, "_h", "_q", buckets).agg(F.array_sort(F.collect_list(F.struct("y", F.col("_f").alias("f")))).alias("d"))
    # Each as a lambda's variable, worked out once: a column's expression the optimiser would
    # put into the rounds, and each weight of each round would work it out anew.
    bound = lambda name, made, body: f"transform(array({made}), {name} -> {body})[0]"
    step = (
        f"aggregate(sequence(1, {rounds}), array_repeat(0D, size(seen) + 1), (w, t) -> transform(array(transform(rows, r -> "
        "(r.y - 1 / (1 + exp(-(w[size(seen)] + aggregate(r.f, 0D, (s, j) -> s + w[j]) / sqrt(size(r.f) + 1D))))) / sqrt(size(r.f) + 1D))), "
        f"e -> zip_with(w, post, (x, p) -> x + {RATE} * (aggregate(p, 0D, (s, i) -> s + e[i]) / greatest(size(rows), 1) - {DECAY} * x)))[0])"
    )
    # Only buckets that some row has get a weight; by their place among those.
    post = (
        "concat(transform(seen, (b, j) -> filter(transform(rows, (r, i) -> if(array_contains(r.f, j), i, -1)), i -> i >= 0)), "
        "array(transform(rows, (r, i) -> i)))"
    )
    rows = "transform(d, r -> named_struct('y', r.y, 'f', transform(r.f, b -> cast(array_position(seen, b) - 1 as int))))"
    learnt = bound("seen", "array_sort(array_distinct(flatten(transform(d, r -> r.f))))", f"named_struct('b', seen, 'w', {bound('rows', rows, bound('post', post, step))})")
    got = one.where("size(d) > 0").select(F.expr(learnt).alias("x")).collect()  # one row at most
    if not got:
        return [0.0] * buckets + [-30.0]  # without labels nothing is blocked
    weights = [0.0] * buckets + [got[0]["x"]["w"][-1]]
    for b, w in zip(got[0]["x"]["b"], got[0]["x"]["w"]):
        weights[b] = w
    return weights


def score(features_col: str, weights: list[float]) -> Column:
    """Probability of "block"."""
    held = F.from_json(F.lit("[" + ",".join(repr(float(x)) for x in weights) + "]"), "array<double>")
    total = F.aggregate(features_col, F.lit(0.0), lambda s, j: s + F.get(held, j))
    return 1 / (1 + F.exp(-(F.lit(float(weights[-1])) + total / F.sqrt(F.size(features_col) + 1.0))))


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score for every row."""
    weights = fit(labelled.select("url", "label"))
    host, path = host_path(pages["url"])
    parsed = features(pages.select(pages["page_id"], host.alias("host"), path.alias("path")), "host", "path")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    model = F.when((F.col("score") >= threshold) & (F.col("host") != ""), "block").otherwise("allow")
    return (
        parsed.withColumn("score", F.round(score("_f", weights), 6))
        .withColumn("rule", rule)
        .select("page_id", "host", "path", "rule", F.coalesce(verdict, model).alias("verdict"), "score")
    )


def ruled(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, the rule that fits, and its verdict: null where the model decides."""
    host, path = host_path(pages["url"])
    parsed = pages.select(pages["page_id"], host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parsed.withColumn("rule", rule).withColumn("verdict", verdict)


def op8(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    return judge_urls(pages, seed_table(pages.sparkSession) if labelled is None else labelled)
