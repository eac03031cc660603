"""Per-entity feature table from events, by persisted time-bucketed partial aggregates.

Events fall into time buckets. For each bucket the partial aggregates by entity and type are kept in a
table partitioned by bucket, beside a manifest that tells up to which time of arrival events were taken in.
``refresh`` reads the events that arrived since, and recomputes only their buckets; ``features`` merges the
buckets that lie whole within the wanted time range with the events of the two buckets at its ends.

An event that is delivered again counts once, at its earliest copy. Copies mostly share their time and so
their bucket; ids with copies in several buckets are kept in a small table of strays, with the bucket that
counts them.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checked_broadcast

#: One row for each bucket: events that arrived at the mark, fingerprint if there was an audit; and of all: the mark, the
#: hash of the types, number and hash of the arrivals before.
_MANIFEST = "bucket date, at bigint, n bigint, h bigint, mark timestamp_ntz, stamp bigint, past_n bigint, past_h bigint"
#: No bucket is longer.
_LONGEST = dt.timedelta(days=367)


def _less(t: dt.datetime) -> dt.datetime:
    return t - _LONGEST if t > dt.datetime(3, 1, 1) else dt.datetime(1, 1, 1)


def _more(t: dt.datetime) -> dt.datetime:
    return t + _LONGEST if t < dt.datetime(9990, 1, 1) else dt.datetime(9999, 1, 1)


def spelling_key(c: Column) -> Column:
    """Letters and digits alone, case aside: spellings with one key are one type."""
    return F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def known_types(event_types: DataFrame) -> DataFrame:
    """``event_type`` by spelling key; where two known types share a key, the smallest stands for both."""
    return (
        event_types.where(F.col("event_type").isNotNull())
        .groupBy(spelling_key(F.col("event_type")).alias("type_key"))
        .agg(F.min("event_type").alias("known_type"))
        .where("type_key <> ''")
    )


#: What a bucket may be: units that begin at midnight.
BUCKETS = ("day", "week", "month", "quarter", "year")


@dataclass
class EntityFeatures:
    """Incremental feature table.

    spark, path: the session, and the folder in which partials, strays and manifest are kept (reachable from
    all executors). bucket: one of ``BUCKETS``; others are refused. arrival: the column with the time at which
    an event was taken in; later arrivals have later times. Where events have no such column, each refresh
    compares fingerprints of all buckets. copy_span_days: by how many days the times of copies of one event may
    differ at most; None for any. With a bound, a refresh looks for copies of new events in near buckets only.

    Defined results: rows with null id, null time, null or empty entity, or an unknown type are no events.
    Rows repeated under one id count once, wherever they lie: the earliest copy stands for all, among equal
    times that with the smallest entity, type and properties. Null or unreadable properties add no tokens,
    null and empty actions count as none. Empty tables give empty features. Further columns of the input are
    ignored, whatever their names.
    """

    spark: SparkSession
    path: str
    bucket: str = "week"
    arrival: str = "ingested_at"
    copy_span_days: int | None = None

    def __post_init__(self) -> None:
        if self.bucket not in BUCKETS:
            raise ValueError(f"bucket must be one of {', '.join(BUCKETS)}, not {self.bucket!r}")

    # -- events ---------------------------------------------------------------------------------------
    def _events(self, events: DataFrame) -> DataFrame:
        arrived = F.col(self.arrival).cast("timestamp_ntz") if self.arrival in events.columns else F.lit(None).cast("timestamp_ntz")
        return events.select(
            F.col("id"),
            F.col("user_id"),
            F.col("event_type"),
            F.col("action"),
            F.col("properties"),
            F.col("ts").cast("timestamp_ntz").alias("ts"),
            arrived.alias("arrived"),
            F.to_date(F.date_trunc(self.bucket, F.col("ts").cast("timestamp"))).alias("bucket"),
        ).where("ts IS NOT NULL AND id IS NOT NULL")

    def _typed(self, rows: DataFrame, event_types: DataFrame) -> DataFrame:
        """Rows that are events, with their known type; copies not yet put together."""
        types, _ = checked_broadcast(known_types(event_types))
        tokens = F.coalesce(F.expr("try_cast(get_json_object(properties, '$.tokens') AS BIGINT)"), F.lit(0).cast("bigint"))
        return (
            rows.where("user_id <> '' AND event_type IS NOT NULL")
            .withColumn("type_key", spelling_key(F.col("event_type")))
            .join(types, "type_key")
            .select("bucket", "id", "user_id", "known_type", "ts", tokens.alias("tokens"), (F.coalesce(F.col("action"), F.lit("")) != "").cast("int").alias("acted"))
        )

    @staticmethod
    def _once(typed: DataFrame, strays: DataFrame | None = None) -> DataFrame:
        """Each event once, at its earliest copy. ``strays``: ids that another bucket than theirs may count."""
        if strays is not None:
            owner, _ = checked_broadcast(strays.select("id", "owner"))
            typed = typed.join(owner, "id", "left").where("owner IS NULL OR owner = bucket").drop("owner")
        return typed.groupBy("id").agg(F.min(F.struct("ts", "user_id", "known_type", "tokens", "acted", "bucket")).alias("e")).select("e.*")

    @staticmethod
    def _aggregate(counted: DataFrame, *by: str) -> DataFrame:
        return counted.groupBy(*by, "user_id", F.col("known_type").alias("event_type")).agg(
            F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("last_ts"), F.sum("tokens").alias("total_tokens"), F.sum("acted").alias("n_with_action")
        )

    # -- the kept tables ------------------------------------------------------------------------------
    def _kept(self) -> list:
        """The rows of the manifest, one for each bucket; none if there is none of this form."""
        try:
            found = self.spark.read.parquet(f"{self.path}/manifest")
        except AnalysisException:
            return []
        return found.collect() if found.columns == [c.split()[0] for c in _MANIFEST.split(", ")] else []

    def _past(self, events: DataFrame, mark: dt.datetime | None) -> tuple[int, int]:
        """Number and hash of the times of arrival before the mark, from that column alone: another table under the same
        name has others."""
        if mark is None or self.arrival not in events.columns:
            return 0, 0
        rows = events.select(F.col(self.arrival).cast("timestamp_ntz").alias("arrived")).where(F.col("arrived") < F.lit(mark))
        r = rows.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("arrived"), 20))).first()
        return r[0], r[1] or 0

    def fingerprints(self, events: DataFrame) -> dict[dt.date, tuple[int, int]]:
        """Number of rows and an order-independent hash of them by bucket; as many entries as buckets."""
        h = F.xxhash64("id", "user_id", "event_type", "action", "properties", "ts")
        rows = self._events(events).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(h, 20)).alias("h"))
        return {r.bucket: (r.n, r.h) for r in rows.collect()}

    def _arrivals(self, events: DataFrame, mark: dt.datetime | None) -> dict[dt.date, tuple[int, int, dt.datetime | None]]:
        """By bucket: events that arrived after ``mark``, at it or at an unknown time, and the latest arrival.

        The condition on the time of arrival reaches the scan, so files and row groups of older arrivals aren't read.
        """
        rows = self._events(events)
        if mark is not None:
            rows = rows.where(F.col("arrived").isNull() | (F.col("arrived") >= F.lit(mark)))
        later = F.lit(True) if mark is None else F.col("arrived") > F.lit(mark)
        by = rows.groupBy("bucket").agg(F.count_if(F.coalesce(later, F.lit(False))).alias("new"), F.count_if(~F.coalesce(later, F.lit(False))).alias("at"), F.max("arrived").alias("last"))
        return {r.bucket: (r["new"], r["at"], r["last"]) for r in by.collect()}

    def _near(self, rows: DataFrame, buckets: list[dt.date]) -> DataFrame:
        """Rows of all buckets in which copies of events of these buckets may lie."""
        if self.copy_span_days is None or not buckets:
            return rows
        span = dt.timedelta(days=self.copy_span_days)
        lo, hi = buckets[0] - span, buckets[-1] + _LONGEST + span
        return rows.where(F.col("ts").between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz")))

    @staticmethod
    def _spread_ids(typed: DataFrame) -> DataFrame:
        """(id, owner, buckets) of the ids with copies in several buckets."""
        by = typed.select("id", "bucket").groupBy("id").agg(F.min("bucket").alias("owner"), F.max("bucket").alias("__last")).where("owner <> __last").select("id", "owner")
        few, _ = checked_broadcast(by)
        return typed.select("id", "bucket").join(few, "id").groupBy("id", "owner").agg(F.collect_set("bucket").alias("buckets"))

    def _strays(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/strays")
        except AnalysisException:
            return None

    def _keep_strays(self, strays: DataFrame) -> DataFrame:
        """Written beside the old ones and read from there, as a table can't replace what it is made from."""
        made = strays.checkpoint()
        made.write.mode("overwrite").parquet(f"{self.path}/strays")
        return made

    def _keep_manifest(self, events: DataFrame, buckets: dict[dt.date, tuple[int, int | None, int | None]], mark: dt.datetime | None, stamp: int) -> None:
        past = self._past(events, mark)
        state = [(b, *v, mark, stamp, *past) for b, v in sorted(buckets.items())]
        self.spark.createDataFrame(state, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest")

    def refresh(self, events: DataFrame, event_types: DataFrame, audit: bool = False) -> list[dt.date]:
        """Bring the kept partials up to date; the buckets that were recomputed.

        Events that arrived since the last refresh are found by their time of arrival. ``audit`` compares
        fingerprints of all rows instead, which also finds rows that were changed or taken away in place; if it
        finds any, all is computed anew. So it is if the known types have changed, or the times of arrival up to the last
        refresh, which are read as a column alone.
        """
        audit = audit or self.arrival not in events.columns
        kept = {r.bucket: r for r in self._kept()}
        stamp = event_types.select(F.sum(F.shiftright(F.xxhash64("event_type"), 20))).first()[0] or 0
        known = next(iter(kept.values()), None)
        prints = self.fingerprints(events) if audit else {}
        if known is None or known.stamp != stamp or (known.past_n, known.past_h) != self._past(events, known.mark):
            return self._build(events, event_types, prints, stamp)
        new = self._arrivals(events, known.mark)
        changed = sorted(b for b, (n, at, _) in new.items() if n or at != (kept[b].at if b in kept else 0))
        if audit and any(b not in prints or (r.n, r.h) != prints[b] for b, r in kept.items() if b not in changed):
            return self._build(events, event_types, prints, stamp)
        if audit and known.mark is None:
            changed = sorted(b for b, p in prints.items() if b not in kept or (kept[b].n, kept[b].h) != p)
        if not changed:
            return []
        rows = self._events(events)
        fresh = rows.where(F.col("bucket").isin(changed))
        if known.mark is not None:
            fresh = fresh.where(F.col("arrived").isNull() | (F.col("arrived") >= F.lit(known.mark)))
        strays = self._strays()
        if strays is None:
            strays = self._spread_ids(self._typed(rows, event_types))
        else:
            ids, _ = checked_broadcast(fresh.select("id").distinct())
            found = self._spread_ids(self._typed(self._near(rows, changed).join(ids, "id", "left_semi"), event_types))
            strays = strays.join(found.select("id"), "id", "left_anti").unionByName(found)
        strays = self._keep_strays(strays)
        # a new copy may be earlier than the one that a later bucket has counted
        ids, _ = checked_broadcast(fresh.select("id").distinct())
        also = strays.join(ids, "id", "left_semi").select(F.explode("buckets").alias("bucket"), "owner").where("bucket > owner").select("bucket").distinct()
        changed = sorted({*changed, *(r.bucket for r in also.collect())})
        rows = rows.where(F.col("ts").between(F.lit(changed[0]).cast("timestamp_ntz"), F.lit(changed[-1] + _LONGEST).cast("timestamp_ntz"))).where(F.col("bucket").isin(changed))
        part = self._aggregate(self._once(self._typed(rows, event_types), strays), "bucket")
        # buckets whose events all fell away must lose their old rows as well
        part = part.unionByName(self.spark.createDataFrame([(b,) for b in changed], "bucket date"), allowMissingColumns=True)
        self._write(part, "dynamic")
        mark = max((x for x in (known.mark, *(v[2] for v in new.values())) if x is not None), default=None)
        at = self._at(events, mark)
        buckets = {b: (at.get(b, 0), *(prints.get(b) or ((r.n, r.h) if b not in changed else (None, None)))) for b, r in kept.items()}
        buckets |= {b: (at.get(b, 0), *(prints.get(b) or (None, None))) for b in changed}
        self._keep_manifest(events, buckets, mark, stamp)
        return changed

    def _at(self, events: DataFrame, mark: dt.datetime | None) -> dict[dt.date, int]:
        """How many events of each bucket arrived just at the mark or at an unknown time: more of them would be new."""
        rows = self._events(events).where(F.col("arrived").isNull() if mark is None else F.col("arrived").isNull() | (F.col("arrived") == F.lit(mark)))
        return {r.bucket: r["n"] for r in rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}

    def _build(self, events: DataFrame, event_types: DataFrame, prints: dict, stamp: int) -> list[dt.date]:
        new = self._arrivals(events, None)
        self._write(self._aggregate(self._once(self._typed(self._events(events), event_types)), "bucket"), "static")
        if (strays := self._strays()) is not None:
            self._keep_strays(self._spread_ids(self._typed(self._events(events), event_types)) if new else strays.limit(0))
        mark = max((v[2] for v in new.values() if v[2] is not None), default=None)
        at = self._at(events, mark)
        self._keep_manifest(events, {b: (at.get(b, 0), *prints.get(b, (None, None))) for b in new}, mark, stamp)
        return sorted(new)

    def _write(self, part: DataFrame, how: str) -> None:
        part.hint("rebalance", "bucket").write.option("partitionOverwriteMode", how).partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/partials")

    def partials(self) -> DataFrame:
        """The kept partials of the buckets that the manifest names."""
        live = sorted(r.bucket for r in self._kept())
        schema = "user_id string, event_type string, n_events bigint, last_ts timestamp_ntz, total_tokens bigint, n_with_action bigint, bucket date"
        if not live:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/partials")
        return rows.where(F.col("bucket").isin(live)).where("user_id IS NOT NULL")

    # -- results --------------------------------------------------------------------------------------
    def _bucket_range(self, start: dt.datetime, end: dt.datetime) -> tuple[dt.date, dt.date]:
        """The first bucket that begins at ``start`` or later, and the one that holds ``end``."""
        row = self.spark.sql(
            f"SELECT to_date(date_trunc('{self.bucket}', t)) b, date_trunc('{self.bucket}', t) = t e FROM VALUES (timestamp '{start}'), (timestamp '{end}') AS v(t)"
        ).collect()
        first = row[0].b if row[0].e else self.spark.sql(f"SELECT to_date(date_trunc('{self.bucket}', timestamp '{start}') + interval 1 {self.bucket}) b").first().b
        return first, row[1].b

    def features(self, events: DataFrame | None = None, event_types: DataFrame | None = None, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
        """One row by entity and type over ``start <= ts < end``, or over all kept buckets.

        Bounds need ``events`` and ``event_types``: the events of buckets that lie only partly in the
        range are read again, all others come from the kept partials. An event lies where its earliest copy does.
        """
        parts = self.partials()
        if start is None and end is None:
            merged = parts
        else:
            lo, hi = start or dt.datetime(1, 1, 1), end or dt.datetime(9999, 1, 1)
            first, last = self._bucket_range(lo, hi)
            whole = parts.where((F.col("bucket") >= F.lit(first)) & (F.col("bucket") < F.lit(last)))
            rows = self._events(events)
            strays = self._strays()
            if strays is None:
                strays = self._keep_strays(self._spread_ids(self._typed(rows, event_types)))
            # the two buckets at the ends, whole, so that copies meet; their bounds reach the scan
            ends = (F.col("ts") >= F.lit(_less(lo)).cast("timestamp_ntz")) & (F.col("ts") < F.lit(_more(hi)).cast("timestamp_ntz"))
            edge = rows.where(ends).where(~((F.col("bucket") >= F.lit(first)) & (F.col("bucket") < F.lit(last))))
            edge = self._once(self._typed(edge, event_types), strays).where((F.col("ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("ts") < F.lit(hi).cast("timestamp_ntz")))
            merged = whole.unionByName(self._aggregate(edge, "bucket"))
        return merged.groupBy("user_id", "event_type").agg(
            F.sum("n_events").alias("n_events"), F.max("last_ts").alias("last_ts"), F.sum("total_tokens").alias("total_tokens"), F.sum("n_with_action").alias("n_with_action")
        )

    @staticmethod
    def by_entity(features: DataFrame) -> DataFrame:
        """One row by entity: sums over all types, and a map from type to its count, recency and totals.

        A map holds at most as many entries as there are known types, so no entity's row is unbounded.
        """
        entry = F.struct("event_type", F.struct("n_events", "last_ts", "total_tokens", "n_with_action").alias("f"))
        return features.groupBy("user_id").agg(
            F.sum("n_events").alias("n_events"),
            F.count(F.lit(1)).alias("n_types"),
            F.max("last_ts").alias("last_ts"),
            F.sum("total_tokens").alias("total_tokens"),
            F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("features"),
        )
