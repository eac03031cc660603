"""Functional updates of tables, for storage without MERGE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new``: one row for each key, a new one before an old one, the highest version first.

    Among rows that are still even, that with the greater hash of all its columns stays, so the result doesn't depend on
    how rows are spread.
    """
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    whole = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))
    order = [F.desc("__new")] + ([F.desc_nulls_last(version)] if version else []) + [whole]
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__first", first).where("__first = 1").drop("__new", "__first")


def upsert_versioned(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """As ``upsert``; each row that replaces another has its version plus one."""
    was = old.groupBy(*key).agg(F.max("version").alias("__was"))
    raised = new.join(was, key, "left").withColumn("version", F.coalesce(F.col("__was") + 1, F.lit(1))).drop("__was")
    return upsert(old, raised.select(*[c for c in old.columns if c in raised.columns]), key)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """``old`` without the children of all parents in ``new``, and the rows of ``new``."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


KINDS = {"memory", "source", "entity", "relationship", "event", "vector"}


def route(items: DataFrame, item: str = "item") -> tuple[dict[str, DataFrame], DataFrame]:
    """Heterogeneous JSON items by their ``kind``, and the rows that can't be read or have no known kind."""
    kind = F.lower(F.get_json_object(item, "$.kind"))
    rows = items.withColumn("kind", F.when(kind.isin(*KINDS), kind))
    return {k: rows.where(F.col("kind") == k) for k in sorted(KINDS)}, rows.where(F.col("kind").isNull())


def route_counts(items: DataFrame, item: str = "item") -> DataFrame:
    """One row: ingested, errors, total."""
    kind = F.lower(F.get_json_object(item, "$.kind"))
    ok = F.coalesce(kind.isin(*KINDS), F.lit(False))
    return items.agg(F.count_if(ok).alias("ingested"), F.count_if(~ok).alias("errors"), F.count(F.lit(1)).alias("total"))
