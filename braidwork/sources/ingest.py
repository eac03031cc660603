"""Taking in sources and items of several kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunks, content_hash, embed
from ..operators.memory import CORE
from .upsert import replace_children, upsert_versioned


def source_type(c: Column) -> Column:
    """Lower case; characters other than letters, digits, ``_`` and ``-`` become ``_``."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9_-]", "_")


def memory_kind(c: Column) -> Column:
    """A known memory type, else FACT."""
    up = F.upper(F.trim(c))
    return F.when(up.isin(*CORE), up).otherwise(F.lit("FACT"))


def add_sources(old: DataFrame, old_chunks: DataFrame, new: DataFrame, dims: int = 64) -> tuple[DataFrame, DataFrame]:
    """Sources and chunks with new sources taken in: types made alike, contents hashed and chunked, versions raised.

    Where the chunks have an ``embedding``, new ones are embedded, with ``dims`` numbers.
    """
    made = new.withColumns({"source_type": source_type(F.col("source_type")), "content_hash": content_hash(F.col("content"))})
    parts = chunks(made, "id", "content")
    if "embedding" in old_chunks.columns:
        parts = embed(parts, "content", dims)
    return upsert_versioned(old, made, ["id"]), replace_children(old_chunks, parts, "source_id")
