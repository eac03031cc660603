"""Queries of an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(log: DataFrame, new: DataFrame) -> DataFrame:
    return log.unionByName(new, allowMissingColumns=True)


def by_user(log: DataFrame, user: int | str, n: int, ts: str = "ts", key: str = "event_id") -> DataFrame:
    return log.where(F.col("user_id") == user).orderBy(F.desc(ts), key).limit(n)


def by_type(log: DataFrame, kind: str, n: int, ts: str = "ts", key: str = "event_id") -> DataFrame:
    return log.where(F.col("event_type") == kind).orderBy(F.desc(ts), key).limit(n)


def in_range(log: DataFrame, start: Column, end: Column, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """Both ends belong to the range."""
    return log.where(F.col(ts).between(start, end)).orderBy(ts, key)


def type_counts(log: DataFrame, user: int | str) -> DataFrame:
    return log.where(F.col("user_id") == user).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
