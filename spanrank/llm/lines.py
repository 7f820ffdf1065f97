"""Line dedup by winnowing over line hashes (DataFrame functions only).

Lines with a word count; blank ones are always kept and stand for nothing.  Of each
WINDOW consecutive line hashes the least one (the rightmost of equals) is selected as
a fingerprint; so is every line of LONG words or more.  A document contributes one row
for each place so selected, whichever windows selected it, with the digests of its
neighbours.  A run of WINDOW lines, or a shorter one with a long line, selects the same
place in every copy, so copies share fingerprints.  Fingerprints that stand in more
than one place are joined back to their positions, and there the match is extended
both ways, as far as the run's length allows, by comparing the neighbours' digests (128
bits of each line's text) with those of the earliest place that has the same.  A run
whose lines also start at an earlier place (smaller doc_id, or earlier in the same
document) is deleted.  Runs that overlap add up, so longer repeats go as a whole.

Defined results: a null text is empty and stays null; ties go to the earlier place;
rows repeated with their id and text are one document; a null id counts as the
largest; an empty table gives an empty result; other columns pass through; a text of
very many lines is one row until its fingerprints leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanrank.llm.common import LAST, materialise, sha256_hex, text_of

#: Lines in the shortest run that is deleted whatever its lines.
WINDOW = 3
#: Words of a line that is worth deleting by itself, or in a shorter run.
LONG = 13
HAS_WORD = r"[^\x20\x09-\x0D]"


def doc_key(docs: DataFrame) -> tuple[Column, Column]:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)), F.xxhash64(text_of(docs))


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row per selected place: doc, digest, print, and the lines around it.

    These are the WINDOW - 1 lines before, the line itself and as many after it: ``near``
    has twice their numbers, and one more for long ones, null beyond the text's ends;
    ``told`` has their digests end to end."""
    doc, digest = doc_key(docs)
    line = lambda x, i: F.struct(
        i.alias("i"),
        F.when(x.rlike(HAS_WORD), F.xxhash64(x)).alias("h"),
        F.unhex(F.md5(F.encode(x, "UTF-8"))).alias("m"),
        x.rlike(rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){{{LONG}}}").alias("long"),
    )
    told = docs.select(doc.alias("doc"), digest.alias("digest"), F.filter(F.transform(F.split(text_of(docs), "\n"), line), lambda x: x["h"].isNotNull()).alias("c"))
    # The selected place of each window: the last of the least, by (hash, -place).
    least = f"array_min(transform(slice(c, k, {WINDOW}), (x, j) -> struct(x.h as h, -(k + j) as at)))"
    windows = f"transform(filter(sequence(1, greatest(size(c) - {WINDOW - 1}, 1)), k -> size(c) >= {WINDOW}), k -> -{least}.at)"
    long = "transform(filter(transform(c, (x, j) -> if(x.long, j + 1, 0)), k -> k > 0), k -> k)"
    # No condition on it: pushed down, it would work the lines out anew for every window.
    chosen = told.withColumn("_at", F.expr(f"array_distinct(concat({windows}, {long}))"))
    around = [f"get(c, k - 1 + {d})" for d in range(1 - WINDOW, WINDOW)]
    near = ", ".join(f"cast({x}.i * 2 + if({x}.long, 1, 0) as int)" for x in around)
    told = ", ".join(f"coalesce({x}.m, X'{'00' * 16}')" for x in around)
    return chosen.select("doc", "digest", F.expr(f"inline(transform(_at, k -> struct(c[k - 1].h as print, array({near}) as near, concat({told}) as told)))"))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc, digest, lines): the runs that start earlier too, by the numbers of their lines."""
    chosen = materialise(fingerprints(docs), "line-prints")
    # Counted before the shuffle: a line that every document has sends one row a task.
    often = chosen.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print")
    near = chosen.join(often, "print", "left_semi")  # positions of repeated fingerprints
    # Extended: the runs of up to WINDOW lines that hold the fingerprint's line.
    runs = [(lo, n) for n in range(1, WINDOW + 1) for lo in range(WINDOW - n, WINDOW)]
    each = ", ".join(f"struct(slice(near, {lo + 1}, {n}) as x, substring(told, {16 * lo + 1}, {16 * n}) as run)" for lo, n in runs)
    whole = f"r -> not exists(r.x, y -> y is null) and (size(r.x) = {WINDOW} or exists(r.x, y -> y % 2 = 1))"
    extended = near.select("doc", "digest", F.explode(F.expr(f"filter(array({each}), {whole})")).alias("r"))
    extended = extended.select("doc", "digest", F.expr("transform(r.x, y -> shiftright(y, 1))").alias("lines"), F.unhex(F.md5("r.run")).alias("run"))
    place = F.struct("doc", "digest", F.expr("lines[0]").alias("at"))
    first = extended.groupBy("run").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    return extended.join(first, "run").where(place > F.col("first")).select("doc", "digest", "lines")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with ``text`` replaced; n_lines (those with a word) and
    n_removed beside it."""
    doc, digest = doc_key(docs)
    gone = repeated_runs(docs).groupBy(F.col("doc").alias("_doc"), F.col("digest").alias("_digest")).agg(
        F.array_distinct(F.flatten(F.collect_list("lines"))).alias("_gone")
    )
    tagged = docs.withColumn("_k", doc).withColumn("_g", digest)
    both = tagged.join(gone, (F.col("_k") == F.col("_doc")) & (F.col("_g") == F.col("_digest")), "left")
    split = both.withColumn("_l", F.split(text_of(both), "\n"))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(_l) - 1), _gone), i -> _l[i]), '\n')")
    return (
        split.withColumn("n_lines", F.size(F.filter("_l", lambda x: x.rlike(HAS_WORD))).cast("long"))
        .withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept))
        .drop("_k", "_g", "_doc", "_digest", "_gone", "_l")
    )


def op1(docs: DataFrame) -> DataFrame:
    out = deduplicated(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", sha256_hex(text_of(out)).alias("kept_sha256"))
