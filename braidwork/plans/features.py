"""Queries of the per-entity feature table, with their SQL."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession

from ..operators.entity_features import EntityFeatures
from ..session import shared_dir, table


def _store(spark: SparkSession, d: str) -> EntityFeatures:
    name = hashlib.sha256(d.encode()).hexdigest()[:16]
    store = EntityFeatures(spark, f"{shared_dir(spark)}/entity_features/{name}")
    store.refresh(table(spark, d, "behavior_events"), table(spark, d, "event_types"))
    return store


def _features(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).features()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).select("user_id", "event_type", "n_events")


def p1_entity_totals(spark: SparkSession, d: str) -> DataFrame:
    return EntityFeatures.by_entity(_features(spark, d)).select("user_id", "n_events", "n_types", "last_ts", "total_tokens")


def p1_entity_features(spark: SparkSession, d: str) -> DataFrame:
    return EntityFeatures.by_entity(_features(spark, d))


def p1_window(spark: SparkSession, d: str) -> DataFrame:
    """Features over a range that begins and ends within buckets: kept partials merged with boundary events."""
    return _store(spark, d).features(table(spark, d, "behavior_events"), table(spark, d, "event_types"), *WINDOW)


#: A range whose ends lie within weeks.
WINDOW = (dt.datetime(2024, 3, 13, 7, 30), dt.datetime(2024, 5, 10, 19, 45))
QUERIES = {"p1_found": p1_found, "p1_entity_totals": p1_entity_totals, "p1_entity_features": p1_entity_features, "p1_window": p1_window}

_EVENTS = """
WITH known AS (
  SELECT upper(regexp_replace(event_type, '[^\\p{L}\\p{N}]', '', 'g')) AS k, min(event_type) AS known_type
  FROM event_types WHERE event_type IS NOT NULL GROUP BY 1),
typed AS (
  SELECT e.id, e.user_id, known.known_type, e.ts, coalesce(try_cast(json_extract_string(e.properties, '$.tokens') AS BIGINT), 0) AS tokens, CAST(coalesce(e.action, '') <> '' AS INT) AS acted
  FROM behavior_events e JOIN known ON upper(regexp_replace(e.event_type, '[^\\p{L}\\p{N}]', '', 'g')) = known.k
  WHERE e.user_id <> '' AND e.ts IS NOT NULL AND e.id IS NOT NULL AND known.k <> ''),
once AS (
  SELECT user_id, known_type AS event_type, ts, tokens, acted
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, user_id, known_type, tokens, acted) AS rn FROM typed) WHERE rn = 1)
"""

ORACLE = {
    "p1_found": _EVENTS + "SELECT user_id, event_type, count(*) AS n_events FROM once GROUP BY 1, 2",
    "p1_entity_totals": _EVENTS
    + "SELECT user_id, count(*) AS n_events, count(DISTINCT event_type) AS n_types, max(ts) AS last_ts, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM once GROUP BY 1",
    "p1_window": _EVENTS
    + f"SELECT user_id, event_type, count(*) AS n_events, max(ts) AS last_ts, CAST(sum(tokens) AS BIGINT) AS total_tokens, CAST(sum(acted) AS BIGINT) AS n_with_action FROM once WHERE ts >= TIMESTAMP '{WINDOW[0]}' AND ts < TIMESTAMP '{WINDOW[1]}' GROUP BY 1, 2",
}
