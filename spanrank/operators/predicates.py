"""``where`` predicates on front matter: a small grammar, compiled to columns.

A predicate is alternatives joined by "|"; several predicates must all hold.  An
alternative is ``key=value``, ``key!=value`` (true where the key is absent),
``!key`` (absent) or ``key`` (present).  On a list ``=`` means membership.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAMMAR = "a predicate is key=value, key!=value, !key or key, with | between alternatives"
#: Signs that may not stand in a key.
FORBIDDEN = set("<>|!=~&")


@dataclass(frozen=True)
class Term:
    kind: str  # eq, ne, has or lacks
    key: str
    value: str = ""

    def column(self, fm: Column) -> Column:
        entry = F.try_element_at(fm, F.lit(self.key))
        if self.kind in ("has", "lacks"):
            present = F.coalesce(F.map_contains_key(fm, self.key), F.lit(False))
            return present if self.kind == "has" else ~present
        # Never null: an absent key simply isn't equal.
        equal = F.coalesce(F.array_contains(entry["vals"], self.value), F.lit(False))
        return equal if self.kind == "eq" else ~equal


@dataclass(frozen=True)
class Predicate:
    text: str
    terms: tuple[Term, ...]

    def column(self, fm: Column) -> Column:
        return reduce(lambda a, b: a | b, [t.column(fm) for t in self.terms])


def parse_term(piece: str) -> Term:
    for kind, sign in (("ne", "!="), ("eq", "=")):
        if sign in piece:
            key, _, value = piece.partition(sign)
            term = Term(kind, key.strip(), value.strip())
            break
    else:
        bare = piece.strip()
        term = Term("lacks", bare[1:].strip()) if bare.startswith("!") else Term("has", bare)
    if not term.key or FORBIDDEN & set(term.key):
        raise ValueError(f"{piece!r}: {GRAMMAR}")
    return term


def parse(where: list[str]) -> tuple[list[Predicate], list[str]]:
    """The predicates, and hints about alternatives that may not mean what they look like."""
    out, hints = [], []
    for text in where:
        terms = tuple(parse_term(p) for p in text.split("|"))
        out.append(Predicate(text, terms))
        if len(terms) > 1:
            hints += [f"{text}: {t.key!r} asks whether that key is present; a value needs its key" for t in terms if t.kind == "has"]
    return out, hints


def keeps(predicates: list[Predicate], fm: Column | str = "fm") -> Column:
    fm = F.col(fm) if isinstance(fm, str) else fm
    return reduce(lambda a, b: a & b, [p.column(fm) for p in predicates], F.lit(True))


def blames(rows: DataFrame, predicates: list[Predicate], fm: str = "fm") -> DataFrame:
    """The predicates that no row meets by itself, found in one pass."""
    if not predicates:
        return rows.sparkSession.createDataFrame([], "predicate string")
    met = rows.agg(*[F.coalesce(F.max(p.column(F.col(fm)).cast("int")), F.lit(0)).alias(f"p{k}") for k, p in enumerate(predicates)])
    each = F.array(*[F.struct(F.lit(p.text).alias("predicate"), F.col(f"p{k}").alias("met")) for k, p in enumerate(predicates)])
    return met.select(F.inline(each)).where("met = 0").select("predicate")


def scalar(value: Column) -> Column:
    """A plain column as a front-matter value (null: absent, see :func:`fm_of`)."""
    return F.struct(F.lit(False).alias("is_list"), F.array(value.cast("string")).alias("vals"))


def fm_of(**columns: Column) -> Column:
    """A front-matter map from plain columns; a null one is an absent key."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.when(v.isNotNull(), scalar(v)).alias("value")) for k, v in columns.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def pointed_at(rows: DataFrame, keys: list[str], fm: str = "fm") -> DataFrame:
    """Every text some row's ``keys`` name, lists flattened, the empty one left out."""
    values = F.flatten(F.array(*[F.coalesce(F.try_element_at(fm, F.lit(k))["vals"], F.array().cast("array<string>")) for k in keys]))
    return rows.select(F.explode(values).alias("target")).where("target <> '' and target is not null").distinct()


def exclude_pointed_at(rows: DataFrame, all_rows: DataFrame, keys: list[str], identity: str = "id", fm: str = "fm", anti: bool = True) -> DataFrame:
    """``rows`` without those whose identity any of ``all_rows`` (unfiltered, of all
    indexes) points at; with ``anti`` false, only those."""
    entry = F.try_element_at(F.col(fm), F.lit(identity))
    text = F.when(entry["is_list"], F.to_json(entry["vals"])).otherwise(F.get(entry["vals"], F.lit(0)))
    targets = pointed_at(all_rows, keys, fm)
    return rows.withColumn("_identity", text).join(targets, F.col("_identity") == F.col("target"), "left_anti" if anti else "left_semi").drop("_identity")
