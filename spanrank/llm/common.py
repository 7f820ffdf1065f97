"""What the corpus operators share: session settings, table reading, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrank.session import materialise, shared_dir, ship

__all__ = ["KEPT", "LAST", "SPACE", "let_go", "materialise", "only", "sha256_hex", "shared_dir", "ship", "table", "text_of", "words_of"]
#: What separates words everywhere in this subpackage (fixed by the contracts).
SPACE = r"\x20\x09-\x0D"
#: Stands for a null id, so that such a row comes last in every order.
LAST = 2**63 - 1


#: What operators keep in a worker beyond a task, to be let go of by others.
KEPT: list[dict] = []


def let_go() -> None:
    """Empty what earlier stages of a pipeline have kept in this worker."""
    for kept in KEPT:
        kept.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame) -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that clashing extra columns do no harm."""
    return df.select(*[df[n] for n in names])


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)
