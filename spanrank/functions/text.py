"""Scalar text functions with the semantics the operators need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, for Java's patterns.
BLANKS = r"[\s\x{85}\p{Z}]"


def trim(x: Column) -> Column:
    return F.regexp_replace(x, f"^{BLANKS}+|{BLANKS}+$", "")


def trim_start(x: Column) -> Column:
    return F.regexp_replace(x, f"^{BLANKS}+", "")


def trim_end(x: Column) -> Column:
    return F.regexp_replace(x, f"{BLANKS}+$", "")


def lines(x: Column) -> Column:
    """Lines without their ends: "\\n" or "\\r\\n" ends one, and none is empty at the end."""
    # A carriage return goes only from lines that a newline ends.
    raw = F.split(F.replace(x, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return F.when(F.element_at(raw, -1) == "", F.slice(raw, 1, F.size(raw) - 1)).otherwise(raw)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def under(path: Column, prefix: str) -> Column:
    """Whether a path lies in the folder ``prefix``, not merely begins like it."""
    return F.startswith(path, F.lit(prefix.strip("/") + "/"))


def embedded_text(path: Column, text: Column, document: str = "", function: str = "") -> Column:
    """What is sent to an embedder: a prefix by kind of file, "{file}" its name."""
    code = F.replace(F.lit(function), F.lit("{file}"), basename(path))
    return F.concat(F.when(F.endswith(path, F.lit(".md")), F.lit(document)).otherwise(code), text)


def norm_hash(text: Column) -> Column:
    """A short digest in which white space doesn't count."""
    return F.substring(F.sha1(F.regexp_replace(F.trim(text), r"\s+", " ").cast("binary")), 1, 16)
