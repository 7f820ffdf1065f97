"""The library's operators as queries over the driver's tables, each with its twin in DuckDB's SQL."""

from __future__ import annotations

from functools import wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanrank.functions import text as T
from spanrank.functions import vectors as V
from spanrank.operators import evaluate, frontmatter, graph, merge, rank, snapshots, units
from spanrank.operators import predicates as P
from spanrank.session import ship
from spanrank.sources import corpus

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


#: Names that are words of SQL, as results give them.
SHOWN = {"start": "first_line", "end": "last_line", "at": "line_no"}


def query(sql: str | None = None):
    def keep(f):
        @wraps(f)
        def run(spark, sf):
            ship(spark)
            return f(spark, sf).withColumnsRenamed(SHOWN)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vector(spark, sf, key: int = 0) -> list[float]:
    """One row's vector."""
    rows = table(spark, sf, "embeddings").where(F.col("vec_id") == key).select("embedding").take(1)
    return list(rows[0][0]) if rows else []


# ---------------------------------------------------------------- vectors
DOT = "list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def vec_rows(spark, sf):
    """Embeddings as units: a file per label, units of five lines, a gap after every fourth."""
    e = table(spark, sf, "embeddings")
    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    start = (F.col("n") - 1) * 5 + F.floor((F.col("n") - 1) / 4).cast("int") + 1
    return e.withColumn("n", n).select(
        F.lit(0).alias("owner"), F.col("vec_id").alias("slot"), F.concat(F.lit("L"), "label").alias("path"), start.alias("start"), (start + 4).alias("end"),
        F.concat(F.lit("L"), "label", F.lit(" > "), F.col("n") % 3).alias("trail"), "label", "embedding",
    )


VEC_ROWS = """vr AS (SELECT vec_id AS slot, 'L' || label AS path, label, embedding, n,
  ((n - 1) * 5 + (n - 1) // 4 + 1)::INT AS s, ((n - 1) * 5 + (n - 1) // 4 + 5)::INT AS t FROM
  (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings)),
top AS (SELECT * FROM (SELECT vr.*, list_inner_product(vr.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score,
  row_number() OVER (ORDER BY list_inner_product(vr.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, slot) AS rank
  FROM vr, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE rank <= 128),
isl AS (SELECT *, sum(apart) OVER (PARTITION BY path ORDER BY s) AS island FROM
  (SELECT *, CASE WHEN lag(t) OVER (PARTITION BY path ORDER BY s) + 1 = s THEN 0 ELSE 1 END AS apart FROM top))"""


def window(spark, sf):
    return rank.ranked(vec_rows(spark, sf), vector(spark, sf), rank.hydration_window(5))


@query(f"SELECT vec_id, round(score, 6) AS score, rank FROM (SELECT e.vec_id, {DOT} AS score, row_number() OVER (ORDER BY {DOT} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE rank <= 10")
def vec_topk(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.lit(0).alias("owner"), F.col("vec_id").alias("slot"), "embedding")
    return rank.ranked(rows, vector(spark, sf), 10).select(F.col("slot").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS size, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: 2 * x) AS v FROM embeddings)")
def vec_normalize(spark, sf):
    twice = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 2).alias("v"))
    return twice.select("vec_id", F.round(V.norm("v"), 6).alias("size"), F.round(F.get(V.normalize("v"), F.lit(0)), 6).alias("first"))


@query(f"SELECT e.vec_id, CASE WHEN len(e.embedding) <> len(q.embedding) OR len(q.embedding) = 0 THEN 0 ELSE round({DOT}, 6) END AS same, 0.0::DOUBLE AS other FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def vec_same_space(spark, sf):
    e = table(spark, sf, "embeddings")
    short = F.slice("embedding", 1, 3)
    return e.select("vec_id", F.round(V.same_space(F.col("embedding"), F.lit(vector(spark, sf)).cast("array<float>")), 6).alias("same"), V.same_space(F.col("embedding"), short).alias("other"))


MULTI = """mq AS (SELECT q.vec_id AS query, e.vec_id, e.label, q.label AS qlabel, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q),
mr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) AS rank FROM mq)"""


def multi(spark, sf, k):
    """The stated query set (every row whose id is divisible by 20) against all rows, in blocks."""
    e = table(spark, sf, "embeddings")
    asked = e.where("vec_id % 20 = 0").select("vec_id", "embedding", "label").orderBy("vec_id").collect()
    got = V.score_batches(e, "vec_id", "embedding", np.array([r[1] for r in asked]).reshape(len(asked), -1), k)
    names = spark.createDataFrame([(i, r[0], r[2]) for i, r in enumerate(asked)], "query int, qid long, qlabel int")
    out = got.join(names, "query").join(e.select("vec_id", "label"), "vec_id")
    return out.select(F.col("qid").alias("query"), "vec_id", "label", "qlabel", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {MULTI} SELECT query, vec_id, round(score, 6) AS score, rank FROM mr WHERE rank <= 5")
def vec_topk_multi(spark, sf):
    return multi(spark, sf, 5).select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


# ---------------------------------------------------------------- filters
FM = "fd AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def fm_docs(spark, sf):
    d, lab = table(spark, sf, "documents").select("doc_id", "lang", "source"), table(spark, sf, "labels")
    both = d.join(lab, "doc_id", "left")
    return both.select("doc_id", P.fm_of(lang=F.col("lang"), source=F.col("source"), quality=F.col("quality"), toxic=F.col("toxic")).alias("fm"))


def filtered(name: str, where: list[str], sql: str):
    def run(spark, sf):
        return fm_docs(spark, sf).where(P.keeps(P.parse(where)[0])).select("doc_id")

    run.__name__ = name
    return query(f"WITH {FM} SELECT doc_id FROM fd WHERE {sql}")(run)


filtered("where_eq", ["lang=fr"], "lang = 'fr'")
filtered("where_ne_absent", ["quality!=0"], "quality IS DISTINCT FROM 0")
filtered("where_has", ["toxic"], "toxic IS NOT NULL")
filtered("where_lacks", ["!toxic"], "toxic IS NULL")
filtered("where_or_and", ["lang=fr|lang=de", "quality=1|!quality"], "lang IN ('fr', 'de') AND (quality = 1 OR quality IS NULL)")


@query("SELECT conv_id FROM (SELECT conv_id, list(DISTINCT role) AS roles FROM conversations GROUP BY conv_id) WHERE list_contains(roles, 'system')")
def where_membership(spark, sf):
    roles = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    fm = F.create_map(F.lit("roles"), F.struct(F.lit(True).alias("is_list"), F.col("roles").alias("vals")))
    return roles.select("conv_id", fm.alias("fm")).where(P.keeps(P.parse(["roles=system"])[0])).select("conv_id")


@query(f"WITH {FM} SELECT predicate FROM (SELECT 'lang=xx' AS predicate, count(*) FILTER (lang = 'xx') AS n FROM fd UNION ALL SELECT 'lang=en', count(*) FILTER (lang = 'en') FROM fd UNION ALL SELECT 'nothing', 0) WHERE n = 0")
def where_blames(spark, sf):
    return P.blames(fm_docs(spark, sf), P.parse(["lang=xx", "lang=en", "nothing"])[0])


# ---------------------------------------------------------------- anti-join
EV = "ev AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events)"


def fm_events(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", "event_type", P.fm_of(id=F.col("event_id"), k=F.get_json_object("props", "$.k"), type=F.col("event_type")).alias("fm"))


@query(f"WITH {EV} SELECT event_id FROM ev WHERE event_type = 'click' AND event_id::VARCHAR NOT IN (SELECT k FROM ev WHERE k IS NOT NULL AND k <> '')")
def exclude_pointed_by(spark, sf):
    every = fm_events(spark, sf)
    return P.exclude_pointed_at(every.where(P.keeps(P.parse(["type=click"])[0])), every, ["k"]).select("event_id")


@query(f"WITH {EV} SELECT count(*) AS dropped FROM ev WHERE event_type = 'click' AND event_id::VARCHAR IN (SELECT k FROM ev WHERE k IS NOT NULL AND k <> '')")
def exclude_dropped_count(spark, sf):
    every = fm_events(spark, sf)
    return P.exclude_pointed_at(every.where(P.keeps(P.parse(["type=click"])[0])), every, ["k"], anti=False).agg(F.count(F.lit(1)).alias("dropped"))


@query("WITH c AS (SELECT conv_id, list(turn::VARCHAR) AS turns FROM conversations GROUP BY conv_id) SELECT conv_id FROM c WHERE conv_id::VARCHAR NOT IN (SELECT unnest(turns) FROM c)")
def exclude_list_pointer(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.col("turn").cast("string")).alias("turns"))
    lists = F.struct(F.lit(True).alias("is_list"), F.col("turns").alias("vals"))
    own = P.scalar(F.col("conv_id"))
    fm = F.map_from_arrays(F.array(F.lit("id"), F.lit("turns")), F.array(own, lists))
    rows = c.select("conv_id", fm.alias("fm"))
    return P.exclude_pointed_at(rows, rows, ["turns"]).select("conv_id")


@query("SELECT DISTINCT json_extract_string(props, '$.k') AS target FROM events WHERE json_extract_string(props, '$.k') <> ''")
def pointer_set(spark, sf):
    return P.pointed_at(fm_events(spark, sf), ["k"])


# ---------------------------------------------------------------- merging
RUNS = """arr AS (SELECT path, island, list(score ORDER BY s) AS sc, list(s ORDER BY s) AS ss, list(t ORDER BY s) AS ts, list(n % 3 ORDER BY s) AS ns FROM isl GROUP BY path, island),
med AS (SELECT {ground} AS ground FROM top),
st AS (SELECT *, 1 AS lo, len(sc) AS hi FROM arr
  UNION ALL
  SELECT path, island, sc, ss, ts, ns, unnest([lo, rhi + 1]) AS lo, unnest([rlo - 1, hi]) AS hi FROM (
    SELECT *, coalesce(list_max(list_filter(range(lo, b), lambda i: sc[i] < fl)) + 1, lo) AS rlo,
      coalesce(list_min(list_filter(range(b + 1, hi + 1), lambda i: sc[i] < fl)) - 1, hi) AS rhi FROM (
      SELECT *, {floor} AS fl FROM (SELECT st.*, list_max(list_filter(range(lo, hi + 1), lambda i: sc[i] = list_max(list_slice(sc, lo, hi)))) AS b FROM st WHERE lo <= hi), med))),
run AS (SELECT *, coalesce(list_max(list_filter(range(lo, b), lambda i: sc[i] < fl)) + 1, lo) AS rlo,
      coalesce(list_min(list_filter(range(b + 1, hi + 1), lambda i: sc[i] < fl)) - 1, hi) AS rhi FROM (
      SELECT *, {floor} AS fl FROM (SELECT st.*, list_max(list_filter(range(lo, hi + 1), lambda i: sc[i] = list_max(list_slice(sc, lo, hi)))) AS b FROM st WHERE lo <= hi), med))
SELECT path, ss[rlo] AS first_line, ts[rhi] AS last_line, round(list_sum(list_transform(range(rlo, rhi + 1), lambda i: sc[i] * (ts[i] - ss[i] + 1))) / list_sum(list_transform(range(rlo, rhi + 1), lambda i: ts[i] - ss[i] + 1)), 6) AS score, (rhi - rlo + 1)::INT AS pieces FROM run"""
MEDIAN = dict(ground="CASE WHEN count(*) >= 128 THEN median(score) END", floor="sc[b] - 0.25 * greatest(sc[b] - ground, 0)")
RATIO = dict(ground="max(NULL::DOUBLE)", floor="0.95 * sc[b]")


@query(f"WITH {VEC_ROWS} SELECT path, island::BIGINT AS island, min(s) AS first_line, max(t) AS last_line, count(*) AS n FROM isl GROUP BY path, island")
def touching_islands(spark, sf):
    return merge.islands(window(spark, sf)).groupBy("path", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


def shown(df):
    return df.select("path", "start", "end", F.round("score", 6).alias("score"), "pieces")


@query(f"WITH RECURSIVE {VEC_ROWS}, {RUNS.format(**MEDIAN)}")
def merge_runs_median(spark, sf):
    top = window(spark, sf)
    return shown(merge.merged(top, rank.background(top)))


@query(f"WITH RECURSIVE {VEC_ROWS}, {RUNS.format(**RATIO)}")
def merge_runs_fallback(spark, sf):
    return shown(merge.merged(window(spark, sf), spark.range(1).select(F.lit(None).cast("double").alias("background"))))


#: The rules that are replayed: fixed values.
REPLAYED = {"r.90": (None, 0.90), "r.93": (None, 0.93), "r.95": (None, 0.95), "r.97": (None, 0.97), "r1": (None, 1.0), "k.25": (0.25, 0.95), "k.50": (0.5, 0.95)}


def replayed(name: str, keep: float | None, ratio: float) -> str:
    runs = RUNS.format(ground=RATIO["ground"], floor=f"{ratio} * sc[b]") if keep is None else RUNS.format(ground=MEDIAN["ground"], floor=f"CASE WHEN ground IS NULL THEN {ratio} * sc[b] ELSE sc[b] - {keep} * greatest(sc[b] - ground, 0) END")
    return f"SELECT '{name}' AS rule, count(*) AS runs, sum(pieces)::BIGINT AS pieces FROM (WITH RECURSIVE {VEC_ROWS}, {runs})"


@query(" UNION ALL ".join(replayed(name, *rule) for name, rule in REPLAYED.items()))
def merge_replay_rules(spark, sf):
    """The numbers of runs and of pieces in them under each rule."""
    top = window(spark, sf)
    out = None
    for name, rule in REPLAYED.items():
        one = merge.merged(top, rank.background(top), merge.Rule(*rule)).agg(F.count(F.lit(1)).alias("runs"), F.sum("pieces").alias("pieces")).select(F.lit(name).alias("rule"), "runs", "pieces")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {VEC_ROWS} SELECT path, island::BIGINT AS island, CASE WHEN min(n % 3) = max(n % 3) THEN path || ' > ' || min(n % 3) ELSE path END AS trail FROM isl GROUP BY path, island")
def shared_trail(spark, sf):
    """Headings an island's pieces have in common."""
    rows = merge.islands(window(spark, sf)).groupBy("path", "island").agg(F.collect_list("trail").alias("t"))
    common = F.udf(lambda t: merge.shared_trail(list(t)), "string", useArrow=True)
    return rows.select("path", "island", common("t").alias("trail"))


@query(f"WITH {VEC_ROWS} SELECT round(CASE WHEN count(*) >= 128 THEN median(score) END, 6) AS background FROM top")
def window_background(spark, sf):
    return rank.background(window(spark, sf)).select(F.round("background", 6).alias("background"))


# ---------------------------------------------------------------- text units
def md_docs(spark, sf):
    """Documents as markdown: front matter, a title, the text's lines, a fence, a nested part."""
    d = table(spark, sf, "documents")
    t = F.concat(
        F.lit("---\nlang: "), "lang", F.lit("\nsource: "), "source", F.lit("\n---\nintro "), "lang", F.lit("\n# Top "), "source", F.lit("\n"), "text",
        F.lit("\n```\n# no heading\n```\n## Part "), F.col("doc_id").cast("string"), F.lit("\n\nlast line\n### Deep\nend\n## Second\nx"),
    )
    return d.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), t.alias("text"))


MD = r"""md AS (SELECT 'd/' || doc_id || '.md' AS path, '---' || chr(10) || 'lang: ' || lang || chr(10) || 'source: ' || source || chr(10) || '---' || chr(10) || 'intro ' || lang || chr(10) || '# Top ' || source || chr(10) || text || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || '## Part ' || doc_id || chr(10) || chr(10) || 'last line' || chr(10) || '### Deep' || chr(10) || 'end' || chr(10) || '## Second' || chr(10) || 'x' AS text FROM documents),
ln AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM md),
fe AS (SELECT *, sum(CASE WHEN n > 4 AND (ltrim(line) LIKE '```%' OR ltrim(line) LIKE '~~~%') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY n) AS fences FROM ln),
hd AS (SELECT path, n, length(regexp_extract(line, '^(#{1,6}) (.*)$', 1)) AS level, trim(regexp_extract(line, '^(#{1,6}) (.*)$', 2)) AS title FROM fe WHERE n > 4 AND fences % 2 = 0 AND regexp_matches(line, '^#{1,6} ')),
cnt AS (SELECT path, count(*) AS total FROM ln GROUP BY path),
sec AS (SELECT path, n AS s, coalesce(lead(n) OVER (PARTITION BY path ORDER BY n) - 1, total) AS t, title AS heading FROM
  (SELECT path, n, title FROM hd UNION ALL SELECT path, 5, NULL FROM md) JOIN cnt USING (path))"""


@query(f"WITH {MD} SELECT path, (n - 1)::INT AS line_no, level::INT AS level, title FROM hd")
def md_headings(spark, sf):
    return units.headings(md_docs(spark, sf)).select("path", F.inline("_heads"))


@query(f"WITH {MD} SELECT path, max(fences)::BIGINT AS fences FROM fe GROUP BY path")
def md_fences(spark, sf):
    lined = units.with_lines(md_docs(spark, sf))
    marks = F.filter("_lines", lambda x, i: (i >= F.col("_body")) & T.trim_start(x).rlike(units.FENCE))
    return lined.select("path", F.size(marks).cast("long").alias("fences"))


@query(f"WITH {MD} SELECT sec.path, s::INT AS first_line, t::INT AS last_line, heading, md5(string_agg(line, chr(10) ORDER BY n)) AS body FROM sec JOIN ln ON ln.path = sec.path AND n BETWEEN s AND t GROUP BY ALL")
def md_sections(spark, sf):
    return units.sections(md_docs(spark, sf)).select("path", "start", "end", "heading", F.md5(F.col("text").cast("binary")).alias("body"))


@query(f"WITH {MD} SELECT h.path, h.n::INT AS first_line, coalesce(string_agg(a.title, ' > ' ORDER BY a.n), '') AS breadcrumb FROM hd h LEFT JOIN hd a ON a.path = h.path AND a.n < h.n AND a.level < h.level AND NOT EXISTS (SELECT 1 FROM hd b WHERE b.path = h.path AND b.n > a.n AND b.n < h.n AND b.level <= a.level) GROUP BY h.path, h.n")
def md_breadcrumbs(spark, sf):
    return units.sections(md_docs(spark, sf)).where("heading is not null").select("path", "start", F.array_join("breadcrumb", " > ").alias("breadcrumb"))


PIECES = r"""d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE length(text) > 500),
p AS (SELECT doc_id, ls, len(ls) AS n, list_transform(range(0, len(ls) + 1), lambda k: CASE WHEN k = 0 THEN 0 ELSE list_sum(list_transform(ls[1:k], lambda x: length(x) + 1)) END) AS ps FROM d),
w AS (SELECT doc_id, ls, n, ps, 0::BIGINT AS f FROM p
  UNION ALL SELECT doc_id, ls, n, ps, u + 1 FROM (SELECT *, greatest(f, coalesce(list_max(list_filter(range(f, n), lambda u: ps[u + 2] - ps[f + 1] <= 500)), f)) AS u FROM w) WHERE u + 1 < n),
c AS (SELECT doc_id, f, greatest(f, coalesce(list_max(list_filter(range(f, n), lambda u: ps[u + 2] - ps[f + 1] <= 500)), f)) AS u, ls FROM w),
x AS (SELECT doc_id, f, u, array_to_string(ls[f + 1:u + 1], chr(10)) AS body FROM c
  UNION ALL SELECT doc_id, 0, len(string_split(text, chr(10))) - 1, text FROM documents WHERE length(text) <= 500)"""


def budgeted(spark, sf):
    d = table(spark, sf, "documents")
    one = d.select("doc_id", F.lit(1).alias("start"), F.size(F.split("text", "\n")).alias("end"), F.lit(False).alias("truncated"), "text")
    return units.divided(one, 500)


@query(f"WITH RECURSIVE {PIECES} SELECT doc_id, (f + 1)::INT AS first_line, (u + 1)::INT AS last_line, length(body) > 500 AS truncated, md5(substr(body, 1, 500)) AS body FROM x")
def budget_pieces(spark, sf):
    return budgeted(spark, sf).select("doc_id", "start", "end", "truncated", F.md5(F.col("text").cast("binary")).alias("body"))


@query(f"WITH RECURSIVE {PIECES} SELECT doc_id, count(*) AS cut, sum(length(body) - 500)::BIGINT AS lost FROM x WHERE length(body) > 500 GROUP BY doc_id")
def budget_truncated(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    cut = budgeted(spark, sf).where("truncated").join(d, "doc_id")
    full = F.length(F.array_join(F.slice("ls", F.col("start"), F.col("end") - F.col("start") + 1), "\n"))
    return cut.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cut"), F.sum(full - 500).alias("lost"))


@query("SELECT doc_id, md5(CASE WHEN doc_id < 500 THEN 'passage: ' || text ELSE 'in f' || doc_id || '.py: ' || text END) AS sent FROM documents")
def embedded_text(spark, sf):
    d = table(spark, sf, "documents")
    path = F.when(F.col("doc_id") < 500, F.lit("a/x.md")).otherwise(F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit(".py")))
    return d.select("doc_id", F.md5(T.embedded_text(path, F.col("text"), "passage: ", "in {file}: ").cast("binary")).alias("sent"))


@query("SELECT doc_id, s::INT AS first_line, least(s + 39, n)::INT AS last_line FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n, unnest(range(1, greatest(1, len(string_split(text, chr(10))) - 20) + 1, 20)) AS s FROM documents) WHERE s <= n")
def line_windows(spark, sf):
    return units.line_windows(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "start", "end")


@query(f"WITH {MD}, bd AS (SELECT sec.path, s, length(string_agg(line, chr(10) ORDER BY n)) AS size FROM sec JOIN ln ON ln.path = sec.path AND n BETWEEN s AND t GROUP BY sec.path, s) SELECT max(size)::BIGINT AS longest, least(max(size), 8000)::BIGINT AS sent FROM bd")
def longest_section(spark, sf):
    """The longest section, and how much of it the budget lets through."""
    text = units.longest(units.sections(md_docs(spark, sf)), 8000)
    return text.select("longest", F.length("text").cast("long").alias("sent"))


@query("""WITH RECURSIVE o AS (SELECT doc_id, n_chars AS n, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
r AS (SELECT i, doc_id, n, n AS held, 0 AS batch FROM o WHERE i = 1 UNION ALL
  SELECT o.i, o.doc_id, o.n, CASE WHEN held > 0 AND held + o.n > 40000 THEN o.n ELSE held + o.n END, batch + CASE WHEN held > 0 AND held + o.n > 40000 THEN 1 ELSE 0 END FROM r JOIN o ON o.i = r.i + 1)
SELECT doc_id, n AS n_chars, batch::INT AS batch FROM r""")
def char_batches(spark, sf):
    return units.char_batches(table(spark, sf, "documents"), "doc_id", "n_chars")


@query(f"WITH {MD}, f AS (SELECT path, min(n) AS a FROM hd WHERE level = 1 GROUP BY path) SELECT sec.path, min(s)::INT AS first_line, max(t)::INT AS last_line, max_by(heading, -s) AS heading FROM sec JOIN f USING (path) GROUP BY sec.path, s >= a")
def parent_units(spark, sf):
    """Sections of one first heading as one unit."""
    return units.parents(units.sections(md_docs(spark, sf)))


@query(f"WITH {MD}, m AS (SELECT ln.path, n, trim(line) AS heading, total FROM ln JOIN cnt USING (path) WHERE regexp_matches(line, '^#+ ')) SELECT path, n::INT AS first_line, (coalesce(lead(n) OVER (PARTITION BY path ORDER BY n), total + 1) - 1)::INT AS last_line, heading FROM m")
def pattern_units(spark, sf):
    return units.pattern_units(md_docs(spark, sf), r"^#+ ")


# ---------------------------------------------------------------- front matter
@query("SELECT 'd/' || doc_id || '.md' AS path, unnest(['lang', 'source']) AS key, unnest([lang, source]) AS value FROM documents")
def fm_flatten(spark, sf):
    lined = units.with_lines(md_docs(spark, sf)).select("path", frontmatter.fm(F.col("_lines"), F.col("_body")).alias("fm"))
    return lined.select("path", F.explode("fm").alias("key", "v")).select("path", "key", F.array_join("v.vals", ",").alias("value"))


@query("""SELECT 'd/' || doc_id || '.md' AS path, unnest(['who.by', 'who.tags', 'steps[0].n', 'steps[1].n', 'steps[1].of', 'flag']) AS key,
unnest(['human:' || source, lang || ',x y', doc_id::VARCHAR, '2', lang, 'true']) AS value, unnest([false, true, false, false, false, false]) AS is_list FROM documents""")
def fm_flatten_nested(spark, sf):
    """Maps, lists of scalars and lists of maps in front matter."""
    d = table(spark, sf, "documents")
    head = F.concat(
        F.lit("---\nwho:\n  by: human:"), "source", F.lit("\n  tags: ["), "lang", F.lit(", x y]\nsteps:\n  - n: "), F.col("doc_id").cast("string"), F.lit("\n  - n: 2\n    of: "), "lang", F.lit("\nflag: true\nnone: {}\n---\ntext"),
    )
    lined = units.with_lines(d.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), head.alias("text")))
    return lined.select("path", F.explode(frontmatter.fm(F.col("_lines"), F.col("_body"))).alias("key", "v")).select("path", "key", F.array_join("v.vals", ",").alias("value"), "v.is_list")


@query("SELECT unnest(['lang', 'source']) AS key FROM (SELECT 1 FROM documents LIMIT 1)")
def fm_keys(spark, sf):
    lined = units.with_lines(md_docs(spark, sf)).select(frontmatter.fm(F.col("_lines"), F.col("_body")).alias("fm"))
    return snapshots.fm_keys(lined)


@query("SELECT 'd/' || doc_id || '.md' AS path, 4::INT AS body FROM documents")
def fm_body_start(spark, sf):
    return units.with_lines(md_docs(spark, sf)).select("path", F.col("_body").alias("body"))


# ---------------------------------------------------------------- keeping current
def two_listings(spark, sf):
    """Two states of a folder: a third of the files renamed, some edited, some gone, some new."""
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"), F.col("n_chars").alias("len"), "lang", "source")
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string"))
    old = d.where("lang <> 'es'").select(path.alias("path"), "hash", "len", F.col("doc_id").alias("mtime"))
    name = F.when(F.col("source") == "src1", F.concat(F.lit("e/"), F.col("doc_id").cast("string"))).otherwise(path)
    edited = F.when(F.col("source") == "src2", F.md5(F.concat("hash", F.lit("x")))).otherwise(F.col("hash"))
    new = d.where("source <> 'src3'").select(name.alias("path"), edited.alias("hash"), "len", F.when(F.col("source") == "src4", F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("mtime"))
    return old, new


LISTINGS = """h AS (SELECT doc_id, md5(text) AS hash, n_chars AS len, lang, source FROM documents),
a AS (SELECT 'd/' || doc_id AS path, hash, len, doc_id AS mtime, doc_id FROM h WHERE lang <> 'es'),
b AS (SELECT CASE WHEN source = 'src1' THEN 'e/' ELSE 'd/' END || doc_id AS path, CASE WHEN source = 'src2' THEN md5(hash || 'x') ELSE hash END AS hash, len, CASE WHEN source = 'src4' THEN doc_id + 1 ELSE doc_id END AS mtime FROM h WHERE source <> 'src3'),
df AS (SELECT coalesce(a.path, b.path) AS path, a.hash AS oh, b.hash AS nh, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'gone' WHEN a.hash = b.hash THEN 'unchanged' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.path = b.path),
g AS (SELECT oh, path, row_number() OVER (PARTITION BY oh ORDER BY path) AS n FROM df WHERE state = 'gone'),
w AS (SELECT nh, path, row_number() OVER (PARTITION BY nh ORDER BY path) AS n FROM df WHERE state = 'new'),
mv AS (SELECT g.path AS source, w.path AS target FROM g JOIN w ON oh = nh AND g.n = w.n)"""


@query(f"WITH {LISTINGS} SELECT path, state FROM df")
def snapshot_diff(spark, sf):
    return snapshots.diff(*two_listings(spark, sf)).select("path", "state")


@query(f"WITH {LISTINGS} SELECT source, target FROM mv")
def rename_pairs(spark, sf):
    return snapshots.moves(snapshots.diff(*two_listings(spark, sf)))


@query(f"WITH {LISTINGS} SELECT coalesce(target, a.path) AS path, mtime AS slot FROM a LEFT JOIN mv ON a.path = source WHERE target IS NOT NULL OR a.path NOT IN (SELECT path FROM df WHERE state IN ('changed', 'gone'))")
def retire_and_rename(spark, sf):
    old, new = two_listings(spark, sf)
    difference = snapshots.diff(old, new)
    pairs = snapshots.moves(difference)
    records = old.select("path", F.col("mtime").alias("slot"))
    return snapshots.renamed(snapshots.retired(records, difference, pairs), pairs)


@query(f"WITH {LISTINGS} SELECT path, row_number() OVER (ORDER BY mtime) - 1 AS slot FROM a")
def compact_renumber(spark, sf):
    old, _ = two_listings(spark, sf)
    records = old.select("path", F.col("mtime").alias("slot"))
    return snapshots.compacted(records, records.select("slot"))[0].select("path", "slot")


@query(f"WITH {LISTINGS} SELECT a.path FROM a LEFT JOIN b ON a.path = b.path WHERE b.path IS NULL OR a.len <> b.len OR a.mtime <> b.mtime")
def stale_rows(spark, sf):
    old, new = two_listings(spark, sf)
    return snapshots.stale(old.select("path"), old, new).select("path")


@query(f"WITH {MD} SELECT count(DISTINCT path) AS files, count(*) AS sections, 0::BIGINT AS functions, 0::BIGINT AS truncated FROM sec")
def index_counts(spark, sf):
    return snapshots.counts(units.sections(md_docs(spark, sf)))


@query("SELECT max(doc_id) + 1 AS high_water, max(doc_id) + 1 - count(*) AS dead FROM documents WHERE source <> 'src3'")
def dead_rows(spark, sf):
    live = table(spark, sf, "documents").where("source <> 'src3'").select(F.col("doc_id").alias("slot"))
    return snapshots.high_water(live).join(live.agg(F.count(F.lit(1)).alias("n"))).select("high_water", (F.col("high_water") - F.col("n")).alias("dead"))


@query("WITH RECURSIVE f AS (SELECT path, n, row_number() OVER (ORDER BY path) AS k FROM (SELECT 'd/' || doc_id AS path, len(string_split(text, chr(10)))::BIGINT AS n FROM documents)), r AS (SELECT path, n, k, 0 AS batch, n AS held FROM f WHERE k = 1 UNION ALL SELECT f.path, f.n, f.k, CASE WHEN r.held >= 64 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.held >= 64 THEN f.n ELSE r.held + f.n END FROM r JOIN f ON f.k = r.k + 1) SELECT path, n, batch FROM r")
def commit_batches(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.size(F.split("text", "\n")).alias("n"))
    return units.commit_batches(d, 64)


@query("SELECT doc_id || '.md' AS path, row_number() OVER (ORDER BY doc_id) - 1 AS slot FROM documents WHERE lang = 'fr'")
def extract_slice(spark, sf):
    d = table(spark, sf, "documents").select(F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("doc_id").alias("slot"))
    s = snapshots.sliced(d, "/fr/")
    return snapshots.compacted(s, s.select("slot"))[0].select("path", "slot")


@query(f"WITH {LISTINGS} SELECT a.path, CASE WHEN b.path IS NULL THEN 'missing' ELSE 'different text' END AS reason FROM a LEFT JOIN b ON a.path = b.path WHERE b.path IS NULL OR a.hash <> b.hash")
def extract_mismatch(spark, sf):
    return snapshots.mismatches(*two_listings(spark, sf))


# ---------------------------------------------------------------- several roots
@query("SELECT path, s AS first_line, owner FROM (SELECT 'd/' || doc_id AS path, 1 AS s, 0 AS owner FROM documents WHERE lang <> 'es' UNION ALL SELECT 'd/' || doc_id, 1, 1 FROM documents WHERE lang = 'es' OR source = 'src1') QUALIFY row_number() OVER (PARTITION BY path, s ORDER BY owner) = 1")
def multi_root_dedup(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.lit(1).alias("start"), "lang", "source")
    both = rank.union_roots([d.where("lang <> 'es'"), d.where("lang = 'es' or source = 'src1'")]).withColumn("rank", F.col("owner"))
    return rank.deduplicated(both, ["path", "start"]).select("path", "start", "owner")


@query(f"SELECT owner, vec_id, round(score, 6) AS score, rank FROM (SELECT e.owner, e.vec_id, {DOT} AS score, row_number() OVER (ORDER BY {DOT} DESC, e.owner, e.vec_id) AS rank FROM (SELECT *, CASE WHEN label < 5 THEN 0 ELSE 1 END AS owner FROM embeddings) e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE rank <= 20")
def multi_root_rank(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("slot"), "embedding", "label")
    every = rank.union_roots([e.where("label < 5"), e.where("label >= 5")])
    return rank.ranked(every, vector(spark, sf), 20).select("owner", F.col("slot").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT 'as they are' AS roots, count(DISTINCT len(embedding)) <= 1 AS compatible FROM embeddings UNION ALL SELECT 'other budget', count(DISTINCT label % 2) <= 1 FROM embeddings
UNION ALL SELECT 'other vectors', count(DISTINCT len(embedding) + label % 2) <= 1 FROM embeddings""")
def roots_compatible(spark, sf):
    """Whether roots share a space: as they are, with two budgets, with vectors of two lengths."""
    e, odd = table(spark, sf, "embeddings"), F.col("label") % 2
    cases = {"as they are": (F.size("embedding"), F.lit(8000)), "other budget": (F.size("embedding"), 8000 + odd), "other vectors": (F.size("embedding") + odd, F.lit(8000))}
    out = None
    for name, (dim, budget) in cases.items():
        one = snapshots.compatible(e.select(dim.alias("dim"), budget.alias("max_chars"), F.lit("").alias("prefixes"), F.lit("x").alias("fingerprint")))
        one = one.select(F.lit(name).alias("roots"), "compatible")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- evaluation
FIRST = f"{MULTI}, fh AS (SELECT query, any_value(qlabel) AS label, min(rank) FILTER (WHERE label = qlabel AND vec_id <> query) AS first FROM mr WHERE rank <= 20 GROUP BY query)"
SUMMARY = "count(*) AS n, count(*) FILTER (first <= 1) AS top1, count(*) FILTER (first <= 5) AS top5, count(*) FILTER (first <= 10) AS top10, count(*) FILTER (first <= 20) AS top20, round(coalesce(sum(1.0 / first), 0) / count(*), 6) AS mrr"


def firsts(spark, sf):
    r = multi(spark, sf, 20)
    hit = (F.col("label") == F.col("qlabel")) & (F.col("vec_id") != F.col("query"))
    return evaluate.first_hits(r, "query", hit).join(r.select("query", F.col("qlabel").alias("label")).distinct(), "query")


@query(f"WITH {FIRST} SELECT label, {SUMMARY} FROM fh GROUP BY label")
def mrr_by_label(spark, sf):
    return evaluate.summary(firsts(spark, sf), ("label",))


@query(f"WITH {FIRST} SELECT {SUMMARY} FROM fh")
def topk_summary(spark, sf):
    return evaluate.summary(firsts(spark, sf))


@query("""WITH a AS (SELECT user_id AS query, event_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
b AS (SELECT user_id AS query, event_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events),
f AS (SELECT query, item, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY query, item)
SELECT query, item, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS rank FROM f""")
def rrf_fusion(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("item"), "value", "ts")
    arm = lambda *o: e.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*o, "item")))
    return evaluate.fused([arm(F.col("value").desc()), arm("ts")], "query", "item").select("query", "item", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(r"""WITH uw AS (SELECT doc_id AS id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]{3,}')) AS word FROM documents) GROUP BY 1, 2),
qw AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]{3,}')) AS word FROM benchmark),
s AS (SELECT query, id, count(*) AS words, sum(n)::BIGINT AS matches FROM uw JOIN qw USING (word) GROUP BY 1, 2)
SELECT * FROM (SELECT query, id, words, matches, row_number() OVER (PARTITION BY query ORDER BY words DESC, matches DESC, id) AS rank FROM s) WHERE rank <= 10""")
def lexical_rank(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("q"))
    return evaluate.lexical(d, b).where("rank <= 10").select("query", "id", "words", "matches", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {MULTI}, bst AS (SELECT query, label, max(score) AS score FROM mr GROUP BY query, label) SELECT query, label, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, label) AS rank FROM bst")
def chunk_rollup(spark, sf):
    """An owner's score is its best chunk's; chunks meet the queries where they are read."""
    e = table(spark, sf, "embeddings")
    asked = e.where("vec_id % 20 = 0").select("vec_id", "embedding").orderBy("vec_id").collect()
    names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(asked)], "query int, qid long")
    best = V.best_by_owner(e, "label", "embedding", np.array([r[1] for r in asked]).reshape(len(asked), -1)).join(names, "query")
    ranked = evaluate.rolled_up(best.select(F.col("qid").alias("query"), "label", "score"), "query", "label")
    return ranked.select("query", "label", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


CONV = "c AS (SELECT conv_id::VARCHAR AS file, turn AS id, (turn * 4 + 1)::INT AS s, (turn * 4 + 3 + length(text) % 7)::INT AS t FROM conversations)"


def conv_spans(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("id"), (F.col("turn") * 4 + 1).cast("int").alias("start"), (F.col("turn") * 4 + 3 + F.length("text") % 7).cast("int").alias("end"))


@query(f"WITH {CONV} SELECT a.file, a.id AS a_id, b.id AS b_id, (least(a.t, b.t) - greatest(a.s, b.s) + 1)::INT AS overlap FROM c a JOIN c b ON a.file = b.file WHERE least(a.t, b.t) - greatest(a.s, b.s) + 1 >= 0.5 * (least(a.t - a.s, b.t - b.s) + 1)")
def interval_overlap(spark, sf):
    c = conv_spans(spark, sf)
    return evaluate.overlapping(c, c).select("file", "a_id", "b_id", "overlap")


@query(f"WITH {CONV} SELECT file, id, line FROM c JOIN (SELECT file, (id * 4 + 5)::INT AS line FROM c) p USING (file) WHERE s <= line AND line <= t")
def point_in_interval(spark, sf):
    c = conv_spans(spark, sf)
    return evaluate.containing(c, c.select("file", (F.col("id") * 4 + 5).cast("int").alias("line"))).select("file", "id", "line")


@query(f"WITH {CONV}, p AS (SELECT DISTINCT file, (id * 4 + 5)::INT AS line FROM c) SELECT p.file, p.line, max_by(id, struct_pack(a := s, b := id)) AS span FROM p LEFT JOIN c ON c.file = p.file AND s <= line AND line <= t GROUP BY p.file, p.line")
def innermost_span(spark, sf):
    c = conv_spans(spark, sf)
    return evaluate.innermost(c.select("file", (F.col("id") * 4 + 5).cast("int").alias("line")).distinct(), c)


@query(f"WITH {FM}, hits AS (SELECT doc_id FROM documents WHERE lang = 'en') SELECT count(*) AS hits, count(b.doc_id) AS flagged, round(100.0 * count(b.doc_id) / count(*), 6) AS percent FROM hits h LEFT JOIN (SELECT DISTINCT doc_id FROM fd WHERE quality = 0) b ON h.doc_id = b.doc_id")
def contamination_rate(spark, sf):
    rows = fm_docs(spark, sf)
    return evaluate.contamination(rows.where(P.keeps(P.parse(["lang=en"])[0])), rows.where(P.keeps(P.parse(["quality=0"])[0])), ["doc_id"])


@query(r"""WITH g AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS ws FROM documents),
x AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS gram FROM g),
h AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS ws FROM benchmark),
y AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS gram FROM h)
SELECT doc_id, item_id, count(*) AS shared FROM x JOIN y USING (gram) GROUP BY 1, 2""")
def ngram_copy(spark, sf):
    return evaluate.copies(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "item_id")


@query("""WITH r AS (SELECT conv_id AS query, conv_id::VARCHAR AS file, (turn + 1)::INT AS s, (turn + 3)::INT AS t, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank, role = 'assistant' AS hit FROM conversations),
f AS (SELECT query, min(rank) FILTER (hit) AS stop FROM r GROUP BY query)
SELECT query, count(DISTINCT line) AS lines FROM (SELECT r.query, unnest(range(s, t + 1)) AS line FROM r JOIN f ON r.query = f.query WHERE rank <= stop) GROUP BY query""")
def reading_cost(spark, sf):
    c = table(spark, sf, "conversations")
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.length("text").desc(), "turn"))
    rows = c.select(F.col("conv_id").alias("query"), F.col("conv_id").cast("string").alias("file"), (F.col("turn") + 1).alias("start"), (F.col("turn") + 3).alias("end"), r.alias("rank"), (F.col("role") == "assistant").alias("hit"))
    return evaluate.reading_cost(rows, "query")


@query("SELECT doc_id, CASE WHEN quality < 1 THEN 'bad query' WHEN toxic + 1 >= 2 THEN 'false miss' WHEN toxic + 1 >= 1 THEN 'ambiguous' ELSE 'true miss' END AS kind FROM labels")
def verdict_kinds(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("target_score"), (F.col("toxic") + 1).alias("best_above"))
    return evaluate.verdicts(lab).select("doc_id", "kind")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('s' || doc_id), doc_id) <= 5")
def stratified_sample(spark, sf):
    return evaluate.stratified(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 5, "s")


@query(r"""WITH t AS (SELECT DISTINCT trim(regexp_replace(text, '\s+', ' ', 'g')) AS title FROM (SELECT string_split(text, '.')[1] AS text FROM documents))
SELECT title FROM t WHERE contains(title, ' ') ORDER BY md5('s' || title), title LIMIT 8""")
def title_sample(spark, sf):
    """A document's first sentence stands for its title."""
    first = table(spark, sf, "documents").select(F.get(F.split("text", r"\."), F.lit(0)).alias("title"))
    return evaluate.title_sample(first, "title", 8, "s")


@query("SELECT lang, source, grouping(source)::INT AS level, count(*) AS n, round(avg(n_chars), 6) AS chars FROM documents GROUP BY ROLLUP (lang, source) HAVING grouping(lang) = 0")
def grouped_summary(spark, sf):
    d = table(spark, sf, "documents")
    return d.rollup("lang", "source").agg(F.grouping("lang").alias("g"), F.grouping("source").cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("chars")).where("g = 0").drop("g")


@query("""SELECT source, count(*) AS n, round(avg((s = 2)::INT), 6) AS share_2, round(avg((s = 1)::INT), 6) AS share_1, round(avg((s = 0)::INT), 6) AS share_0, round(avg(s), 6) AS mean
FROM (SELECT source, quality + toxic AS s FROM labels JOIN documents USING (doc_id)) GROUP BY source""")
def verdict_tally(spark, sf):
    said = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").select("source", (F.col("quality") + F.col("toxic")).alias("score"))
    return evaluate.tallies(said, "source")


@query("""WITH v AS (SELECT doc_id AS c, quality AS target FROM labels), o AS (SELECT doc_id AS c, toxic + 1 AS best FROM labels WHERE doc_id % 3 <> 0)
SELECT d.doc_id AS "case", lang, CASE WHEN target < 1 THEN 'bad query' WHEN coalesce(best, 0) >= 2 THEN 'false miss' WHEN coalesce(best, 0) >= 1 THEN 'ambiguous' ELSE 'true miss' END AS kind
FROM documents d JOIN v ON v.c = d.doc_id LEFT JOIN o ON o.c = d.doc_id""")
def judged_cases(spark, sf):
    """Cases, what was said of their targets and of the best above, and labels, joined."""
    d, lab = table(spark, sf, "documents").select(F.col("doc_id").alias("case"), "lang"), table(spark, sf, "labels")
    said = lab.select(F.col("doc_id").alias("case"), F.lit(True).alias("target"), F.col("quality").alias("score")).unionByName(
        lab.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("case"), F.lit(False).alias("target"), (F.col("toxic") + 1).alias("score"))
    )
    return evaluate.judged(d.select("case"), said, d).select("case", "lang", "kind")


@query("SELECT conv_id AS query, min(turn + 1) FILTER (length(text) % 3 >= 2)::INT AS strict, min(turn + 1) FILTER (length(text) % 3 >= 1)::INT AS lenient FROM conversations GROUP BY conv_id")
def lenient_ranks(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("query"), (F.col("turn") + 1).cast("int").alias("rank"), (F.length("text") % 3).alias("score"))
    return evaluate.lenient(c, "query")


@query("""WITH q AS (SELECT label, vec_id FROM embeddings WHERE vec_id % 20 = 0), e AS (SELECT q.vec_id AS query, e.vec_id, e.label, list_inner_product(e.embedding::DOUBLE[], f.embedding::DOUBLE[]) AS score
  FROM embeddings e, q JOIN embeddings f ON f.vec_id = q.vec_id),
a AS (SELECT 'all' AS arm, query, vec_id, score FROM e UNION ALL SELECT 'filtered', query, vec_id, score FROM e WHERE label <> 9),
t AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY arm, query ORDER BY score DESC, vec_id) <= 10),
r AS (SELECT arm, query, count(*) AS n, count(*) FILTER (vec_id % 7 = 0 OR label = 9) AS bad FROM t JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) GROUP BY arm, query)
SELECT arm, count(*) AS queries, sum(n)::BIGINT AS hits, round(avg(100.0 * bad / n), 6) AS percent FROM r GROUP BY arm""")
def contamination_arms(spark, sf):
    """Flagged hits among the ten best of every query, with and without a filter."""
    e = table(spark, sf, "embeddings")
    asked = e.where("vec_id % 20 = 0").select("vec_id", "embedding").orderBy("vec_id").collect()
    vectors = np.array([r[1] for r in asked]).reshape(len(asked), -1)
    arms = [V.score_batches(rows, "vec_id", "embedding", vectors, 10).withColumn("arm", F.lit(n)) for n, rows in (("all", e), ("filtered", e.where("label <> 9")))]
    return evaluate.rates(arms[0].unionByName(arms[1]), e.where("vec_id % 7 = 0 or label = 9"), "query", ["vec_id"], "arm")


SCORED = f"""{MULTI}, vr AS (SELECT vec_id, 'L' || label AS file, ((n - 1) * 5 + (n - 1) // 4 + 1)::INT AS s, ((n - 1) * 5 + (n - 1) // 4 + 5)::INT AS t FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings)),
pr AS (SELECT vec_id AS query, file, s + 7 AS line FROM vr WHERE vec_id % 20 = 0),
fh AS (SELECT pr.query, any_value(file) AS file, min(rank) FILTER (vfile = file AND s <= line AND line <= t) AS first FROM pr LEFT JOIN (SELECT query, rank, file AS vfile, s, t FROM mr JOIN vr USING (vec_id) WHERE rank <= 20) m USING (query) GROUP BY pr.query)"""


@query(f"WITH {SCORED} SELECT file, {SUMMARY} FROM fh GROUP BY file")
def score_query_set(spark, sf):
    """A query set through ranking, range lookup, first hits and their summary by file."""
    units_ = vec_rows(spark, sf).select(F.col("slot").alias("vec_id"), F.col("path").alias("file"), "start", "end")
    pairs = units_.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "file", (F.col("start") + 7).alias("line"))
    results = multi(spark, sf, 20).select("query", "vec_id", "rank").join(units_, "vec_id").drop("vec_id")
    return evaluate.scored(results, pairs, ("file",))


@query(f"WITH {MULTI} SELECT kind, count(*) AS queries FROM (SELECT query, CASE WHEN label % 2 = 0 THEN 'section' ELSE 'function' END AS kind FROM mr WHERE rank = 1) GROUP BY kind")
def mixed_first_kinds(spark, sf):
    """Sections and functions ranked together: what kind comes first."""
    both = multi(spark, sf, 5).withColumn("kind", F.when(F.col("label") % 2 == 0, "section").otherwise("function"))
    return evaluate.first_kinds(both, "query", "kind")


@query(f"""WITH {MULTI}, pf AS (SELECT query, 'on' AS prefix, min(rank) FILTER (label = qlabel AND vec_id <> query) AS first FROM mr WHERE rank <= 20 GROUP BY query
UNION ALL SELECT query, 'off', min(rank) FILTER (label = qlabel AND vec_id <> query) FROM mr WHERE rank <= 5 GROUP BY query) SELECT prefix, {SUMMARY} FROM pf GROUP BY prefix""")
def section_arms(spark, sf):
    """Two arms of one query set (as with a prefix and without), summed up side by side."""
    hit = (F.col("label") == F.col("qlabel")) & (F.col("vec_id") != F.col("query"))
    arms = [evaluate.first_hits(multi(spark, sf, k), "query", hit).withColumn("prefix", F.lit(n)) for n, k in (("on", 20), ("off", 5))]
    return evaluate.summary(arms[0].unionByName(arms[1]), ("prefix",))


@query("""WITH d AS (SELECT toxic, r, ('0x' || substr(md5('0:' || doc_id || ':' || r), 1, 8))::BIGINT / 4294967296.0 AS u FROM labels, range(1, 201) t(r) WHERE toxic IS NOT NULL),
k AS (SELECT r, toxic, CASE WHEN u < 0.367879 THEN 0 WHEN u < 0.735759 THEN 1 WHEN u < 0.919699 THEN 2 WHEN u < 0.981012 THEN 3 WHEN u < 0.996340 THEN 4 ELSE 5 END AS k FROM d),
m AS (SELECT r, sum(toxic * k)::DOUBLE / sum(k) AS m FROM k GROUP BY r)
SELECT round(avg(m), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m""")
def bootstrap_interval(spark, sf):
    got = evaluate.bootstrap(table(spark, sf, "labels"), "toxic", "doc_id")
    return got.select(*[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


# ---------------------------------------------------------------- graphs
KNN = "kn AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), ke AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM kn WHERE score > 0) WHERE rank <= 5)"


def near(spark, sf):
    return graph.knn(table(spark, sf, "embeddings"), "vec_id", "embedding", 5)


@query(f"WITH {KNN} SELECT src, dst, round(score, 6) AS score, rank FROM ke")
def knn_graph(spark, sf):
    return near(spark, sf).select("src", "dst", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


BAGS = """tm AS (SELECT conv_id AS id, unnest(string_split(lower(text), ' ')) AS term FROM conversations), c0 AS (SELECT id, term, count(*) AS c FROM tm GROUP BY 1, 2),
nn AS (SELECT count(DISTINCT id) AS n FROM tm), dt AS (SELECT term, count(*) AS df FROM c0 GROUP BY term), rw AS (SELECT id, term, (1 + ln(c)) * ln(n / df) AS w FROM c0 JOIN dt USING (term), nn WHERE df >= 2 AND df <= 0.2 * n),
sz AS (SELECT id, sqrt(sum(w * w)) AS size FROM rw GROUP BY id), wt AS (SELECT id, term, w / size AS weight FROM rw JOIN sz USING (id) WHERE size > 0)"""


def bag_terms(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.explode(F.split(F.lower("text"), " ")).alias("term"))


@query(f"WITH {BAGS}, ps AS (SELECT a.id AS src, b.id AS dst, round(sum(a.weight * b.weight), 9) AS score FROM wt a JOIN wt b ON a.term = b.term AND a.id <> b.id GROUP BY 1, 2) SELECT src, dst, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM ps WHERE score > 0) WHERE rank <= 5")
def tfidf_graph(spark, sf):
    return graph.bag_graph(bag_terms(spark, sf), 5).select("src", "dst", F.round("score", 6).alias("score"))


@query(f"WITH {BAGS} SELECT id, term, round(weight, 6) AS weight FROM wt")
def tfidf_weights(spark, sf):
    return graph.tfidf(bag_terms(spark, sf)).select("id", "term", F.round("weight", 6).alias("weight"))


UND = "u1 AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ke), u2 AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ke WHERE rank <= 2)"


@query(f"WITH {KNN}, {UND} SELECT count(u1.a) FILTER (u2.a IS NOT NULL) AS common, count(*) AS either, round(count(u1.a) FILTER (u2.a IS NOT NULL) / count(*), 6) AS jaccard FROM u1 FULL JOIN u2 ON u1.a = u2.a AND u1.b = u2.b")
def graph_jaccard(spark, sf):
    e = near(spark, sf)
    return graph.jaccard(e, e.where("rank <= 2"))


@query(f"WITH {KNN}, {UND}, tr AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT (SELECT count(*) FROM u1) AS edges, (SELECT count(*) FROM tr) AS links, count(*) AS met, round(count(*) / (SELECT count(*) FROM u1), 6) AS precision, round(count(*) / (SELECT count(*) FROM tr), 6) AS recall FROM u1 JOIN tr ON u1.a = tr.a AND u1.b = tr.b")
def graph_precision_recall(spark, sf):
    groups = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("group"))
    return graph.group_truth(near(spark, sf), groups)


@query(f"WITH {KNN} SELECT dst, count(*) AS indegree FROM ke GROUP BY dst ORDER BY 2 DESC, 1 LIMIT 3")
def graph_hubs(spark, sf):
    return graph.hubs(near(spark, sf))


@query("SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages")
def author_links(spark, sf):
    return graph.links(table(spark, sf, "pages"), "page_id", "html", 'href="([^"]*)"')


# ---------------------------------------------------------------- code units, digests
@query("SELECT substr(sha1(regexp_replace(trim(text), '\\s+', ' ', 'g')), 1, 16) AS hash, count(*) AS n FROM conversations GROUP BY 1")
def norm_hash_dups(spark, sf):
    return table(spark, sf, "conversations").groupBy(T.norm_hash(F.col("text")).alias("hash")).agg(F.count(F.lit(1)).alias("n"))


SOURCES = {
    "py": "import os\n\n# {0}\n@{1}\ndef f{1}(x):\n    def inner():\n        return '}}'\n    return inner\n\nclass A:\n    def g(self): pass\n",
    "rs": "use x;\n\n/// {0}\n#[inline]\npub fn f{1}(a: &str) -> char {{\n    '}}' // }}\n}}\n\nfn open() {{\n",
    "go": "package a\n\n// {0}\nfunc (s *S) F{1}() error {{\n\treturn nil\n}}\n",
    "js": "const a = 1\nexport async function f{1}(x) {{\n  if (x) {{ return `}}` }}\n}}\n",
    "c": "#include <{1}.h>\n/* {0} */\nstatic int f{1}(void) {{\n  return '{{';\n}}\nint none(void);\n",
}
#: What the functions of each are: (first line, last line, name); the open one of "rs" never closes.
FOUND = {"py": [(3, 8, "f{}"), (6, 7, "inner"), (11, 11, "g")], "rs": [(3, 7, "f{}")], "go": [(3, 6, "F{}")], "js": [(2, 4, "f{}")], "c": [(2, 5, "f{}")]}


@query(" UNION ALL ".join(f"SELECT 'f' || c_custkey || '.{x}' AS path, {a}::INT AS first_line, {b}::INT AS last_line, replace('{n}', '{{}}', c_custkey::VARCHAR) AS heading FROM customer" for x, every in FOUND.items() for a, b, n in every))
def function_units(spark, sf):
    """Functions of five languages, with attachments, nesting, braces in literals, and errors."""
    from spanrank.operators import code

    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_mktsegment").alias("m"))
    files = None
    for x, source in SOURCES.items():
        text = F.replace(F.replace(F.lit(source.replace("{0}", "\1").replace("{1}", "\2").replace("{{", "{").replace("}}", "}")), F.lit("\1"), "m"), F.lit("\2"), "k")
        one = c.select(F.concat(F.lit("f"), "k", F.lit(f".{x}")).alias("path"), text.alias("text"))
        files = one if files is None else files.unionByName(one)
    return code.functions(files).select("path", "start", "end", "heading")


@query("""WITH k AS (SELECT c_custkey AS key, 20 + c_custkey % 13 AS n FROM customer), c AS (SELECT key, n, unnest(range(0, (n + 6) // 7)) AS chunk FROM k)
SELECT 'f' || key || '.py' AS path, (2 + 7 * chunk)::INT AS first_line, least(8 + 7 * chunk, n + 1)::INT AS last_line, ('f' || key) AS heading,
  md5('def f' || lpad(key::VARCHAR, 9, '0') || '(x):' || chr(10) || array_to_string(list_transform(range(7 * chunk, least(7 * chunk + 7, n)), lambda i: '    x += ' || lpad(i::VARCHAR, 3, '0')), chr(10))) AS body FROM c""")
def chunked_functions(spark, sf):
    """Long functions cut between statements into chunks under a budget, each with the header."""
    from spanrank.operators import code

    c = table(spark, sf, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("k"))
    body = F.transform(F.sequence(F.lit(0), (19 + F.col("c_custkey") % 13).cast("int")), lambda i: F.concat(F.lit("    x += "), F.lpad(i.cast("string"), 3, "0")))
    text = F.concat(F.lit("def f"), "k", F.lit("(x):\n"), F.array_join(body, "\n"), F.lit("\n"))
    files = c.select(F.concat(F.lit("f"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("heading"), text.alias("text"))
    return code.chunked(files, 110).select("path", "start", "end", "heading", F.md5(F.col("text").cast("binary")).alias("body"))


# ---------------------------------------------------------------- smaller operators
@query(f"WITH {LISTINGS} SELECT b.path FROM b LEFT JOIN a ON a.path = b.path WHERE a.path IS NULL OR a.len <> b.len OR a.mtime <> b.mtime")
def stat_prefilter(spark, sf):
    """Files that must be opened: no stamp of the same length and time."""
    old, new = two_listings(spark, sf)
    return corpus.changed(new.select("path", "len", "mtime"), old).select("path")


@query(f"WITH {LISTINGS} SELECT path, mtime FROM b UNION ALL SELECT path, mtime FROM a WHERE path NOT IN (SELECT path FROM b)")
def upsert_stamps(spark, sf):
    old, new = two_listings(spark, sf)
    return snapshots.upserted(old, new).select("path", "mtime")


@query(f"WITH {LISTINGS} SELECT path FROM a WHERE path NOT IN (SELECT path FROM df WHERE state = 'gone')")
def forget_stamps(spark, sf):
    old, new = two_listings(spark, sf)
    return snapshots.forgotten(old, snapshots.diff(old, new)).select("path")


@query("SELECT count(*) - count(DISTINCT conv_id) AS held FROM conversations")
def held_duplicates(spark, sf):
    return snapshots.held_duplicates(table(spark, sf, "conversations"), ["conv_id"])


@query("SELECT role, -quantile_disc(-length(text), 0.5)::BIGINT AS median FROM conversations GROUP BY role")
def unit_size_median(spark, sf):
    c = table(spark, sf, "conversations").select("role", F.length("text").cast("long").alias("n"))
    return evaluate.upper_median(c, "n", "role").select("role", F.col("median").cast("long").alias("median"))


@query(r"SELECT doc_id, list_aggregate(list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda w: length(w) >= 5), lambda w: starts_with(lower('Thention'), substr(w, 1, 5))::INT), 'max') IS NOT DISTINCT FROM 1 AS leaks FROM documents")
def question_name_leak(spark, sf):
    return table(spark, sf, "documents").select("doc_id", evaluate.leaks_name(F.col("text"), F.lit("Thention")).alias("leaks"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def untranslated(spark, sf):
    """Ids of one set that a second one has nothing for."""
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query(r"SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '`[^`\s]+`|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+')) AS name FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)) GROUP BY name")
def entity_names(spark, sf):
    both = table(spark, sf, "documents").select("text").unionByName(table(spark, sf, "conversations").select("text"))
    names = both.select(F.explode(graph.names_of(F.col("text"))).alias("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH t AS (SELECT lower(trim(regexp_replace(' ' || lang || '  Doc ', '\s+', ' ', 'g'))) AS subject, 'is from' AS relation, lower(trim(regexp_replace(upper(source), '\s+', ' ', 'g'))) AS object FROM documents
UNION ALL SELECT lang, 'is', lang FROM documents) SELECT DISTINCT subject, relation, object FROM t WHERE subject <> object""")
def entity_triples(spark, sf):
    d = table(spark, sf, "documents")
    raw = d.select(F.concat(F.lit(" "), "lang", F.lit("  Doc ")).alias("subject"), F.lit("is  FROM").alias("relation"), F.upper("source").alias("object"))
    return graph.normal_triples(raw.unionByName(d.select(F.col("lang").alias("subject"), F.lit("Is").alias("relation"), F.initcap("lang").alias("object"))))


@query(r"""WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages), f AS (SELECT page_id, '/' || string_split(url, '/')[4] AS path FROM pages),
k AS (SELECT page_id AS src, 'p' || (length(target) * 7 % 50) || '#x' AS target FROM l) SELECT DISTINCT least(src, id) AS a, greatest(src, id) AS b FROM k JOIN (SELECT page_id AS id FROM pages WHERE page_id < 50) p ON regexp_replace(target, '#.*$', '') = 'p' || id WHERE src <> id""")
def link_truth(spark, sf):
    """Links that lead to a known page, as unordered pairs."""
    pages = table(spark, sf, "pages")
    found = graph.links(pages, "page_id", "html", 'href="/([^"]*)"').select("page_id", F.concat(F.lit("p"), F.length("target") * 7 % 50, F.lit("#x")).alias("target")).distinct()
    files = pages.where("page_id < 50").select(F.col("page_id").alias("id"), F.concat(F.lit("p"), "page_id").alias("path"))
    return graph.link_truth(found, files, "page_id")


@query(f"WITH {KNN} SELECT count(*) AS edges, round(100.0 * count(*) FILTER (a.label = b.label) / count(*), 6) AS within FROM ke JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst")
def graph_shares(spark, sf):
    g = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("group"))
    return graph.shares(near(spark, sf), g)


@query(f"WITH {KNN}, {UND} SELECT a, b, 'only first' AS side FROM (SELECT * FROM u1 EXCEPT SELECT * FROM u2) UNION ALL SELECT a, b, 'both' FROM (SELECT * FROM u1 INTERSECT SELECT * FROM u2)")
def graph_set_algebra(spark, sf):
    e = near(spark, sf)
    one, two = graph.undirected(e), graph.undirected(e.where("rank <= 2"))
    return one.exceptAll(two).withColumn("side", F.lit("only first")).unionByName(one.intersect(two).withColumn("side", F.lit("both")))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('j' || doc_id), doc_id) <= 3")
def control_sample(spark, sf):
    d, lab = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels")
    return evaluate.group_sample(d, "lang", "doc_id", 3, "j", lab)


@query(f"""WITH {KNN}, r AS (SELECT vec_id AS id, lead(vec_id) OVER (ORDER BY md5('c' || vec_id), vec_id) AS next FROM (SELECT vec_id FROM embeddings ORDER BY md5('c' || vec_id), vec_id LIMIT 40)),
p AS (SELECT least(id, next) AS a, greatest(id, next) AS b FROM r WHERE next IS NOT NULL)
SELECT a, b FROM p WHERE (a, b) NOT IN (SELECT (least(src, dst), greatest(src, dst)) FROM ke) ORDER BY md5('c' || a || '-' || b), a, b LIMIT 10""")
def control_pairs(spark, sf):
    """Random pairs that the graph does not propose."""
    return graph_controls(near(spark, sf), table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")))


def graph_controls(edges, ids):
    return evaluate.control_pairs(edges, ids, 10, "c")


@query("SELECT path, 'fr' AS folder FROM (SELECT lang || '/' || doc_id AS path FROM documents UNION ALL SELECT lang || 'x/' || doc_id FROM documents) WHERE starts_with(path, 'fr/')")
def path_prefix(spark, sf):
    d = table(spark, sf, "documents")
    sides = d.select("lang", "doc_id", F.explode(F.array(F.lit("/"), F.lit("x/"))).alias("side"))
    names = sides.select(F.concat("lang", "side", F.col("doc_id").cast("string")).alias("path"))
    return names.where(T.under(F.col("path"), "/fr/")).select("path", F.lit("fr").alias("folder"))


# ---------------------------------------------------------------- end to end
END_TO_END = """WITH RECURSIVE vr AS (SELECT vec_id AS slot, 'L' || label AS path, label, embedding, n,
  ((n - 1) * 5 + (n - 1) // 4 + 1)::INT AS s, ((n - 1) * 5 + (n - 1) // 4 + 5)::INT AS t FROM
  (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings)),
ch AS (SELECT vr.*, list_inner_product(vr.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM vr, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
  WHERE label <> 9 AND slot NOT IN (SELECT slot + 1 FROM vr WHERE slot % 10 = 0)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, slot) AS rank FROM ch) WHERE rank <= 128),
isl AS (SELECT *, sum(apart) OVER (PARTITION BY path ORDER BY s) AS island FROM
  (SELECT *, CASE WHEN lag(t) OVER (PARTITION BY path ORDER BY s) + 1 = s THEN 0 ELSE 1 END AS apart FROM top)),
""" + RUNS.format(ground=MEDIAN["ground"], floor="CASE WHEN ground IS NULL THEN 0.95 * sc[b] ELSE sc[b] - 0.25 * greatest(sc[b] - ground, 0) END").replace(
    "SELECT path, ss[rlo] AS first_line", "SELECT 0 AS owner, path, CASE WHEN list_min(ns[rlo:rhi]) = list_max(ns[rlo:rhi]) THEN path || ' > ' || ns[rlo] ELSE path END AS trail, ss[rlo] AS first_line"
) + " ORDER BY score DESC, path, first_line LIMIT 5"


@query(END_TO_END)
def query_end_to_end(spark, sf):
    """Filter, anti-join, exact ranking of narrow rows, window, hydration, merging, top ranges."""
    rows = vec_rows(spark, sf)
    rows = rows.withColumn("fm", P.fm_of(id=F.col("slot"), label=F.col("label"), supersedes=F.when(F.col("slot") % 10 == 0, F.col("slot") + 1)))
    chosen = rank.select(rows, ["label!=9"], ["supersedes"])
    window_ = rank.hydration_window(5)
    top = rank.ranked(chosen.select("owner", "slot", "path", "start", "end", "trail", "embedding"), vector(spark, sf), window_)
    return shown_all(merge.results(rank.deduplicated(top, ["owner", "path", "start", "end"]), rank.background(top), 5))


def shown_all(df):
    return df.withColumn("score", F.round("score", 6))
