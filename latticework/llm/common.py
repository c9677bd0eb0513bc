"""Helpers that several operators share: word patterns, the held-out fold, windows of arrays."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import Scratch, materialize

__all__ = ["Scratch", "documents", "held_out", "let", "materialize", "parts_for", "schema_with", "shielded", "windows", "words_of"]

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

HELD_OUT_FOLD = 2
FOLDS = 4


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str) -> Column:
    """True where crc32 of the id's text leaves the remainder of the test fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: lambdas otherwise evaluate an outer expression again for each element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """array<string> of the words; empty for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def windows(hashes: Column, width: int) -> Column:
    """Hashes of the windows of so many neighbours, from shifted copies of the array; not for shorter arrays."""
    n = F.size(hashes) - (width - 1)
    out = F.slice(hashes, 1, n)
    for k in range(1, width):
        out = F.zip_with(out, F.slice(hashes, k + 1, n), lambda x, y: F.xxhash64(x, y))
    return out


def parts_for(rows: int, per_part: int, least: int = 1, most: int = 1 << 16) -> int:
    return int(max(least, min(most, -(-rows // per_part))))


def schema_with(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in fields)])


def shielded(docs: DataFrame, used: set[str], made: set[str], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """operator(docs), the columns that it does not use being renamed meanwhile, so that none of its own names can clash with
    one of the input's. Columns named as those that are made are replaced; all others keep their names and order."""
    tag = uuid.uuid4().hex[:8]
    others = {c: f"other_{k}_{tag}" for k, c in enumerate(docs.columns) if c not in used and c not in made}
    inside = [c for c in docs.columns if c in used and c not in made]
    out = operator(docs.select(*inside, *(F.col(f"`{c}`").alias(n) for c, n in others.items())))
    first = [c for c in docs.columns if c in others or c in inside and c in out.columns]
    return out.select(*(F.col(others.get(c, c)).alias(c) for c in first), *(c for c in out.columns if c not in inside and c not in others.values()))
