import datetime as dt
import random
from collections import defaultdict

import pytest

from braidwork.operators.entity_features import EntityFeatures

SCHEMA = "id string, user_id string, event_type string, action string, properties string, session_id string, ts timestamp_ntz, ingested_at timestamp_ntz, event string, bucket string, tokens string"
T0 = dt.datetime(2024, 1, 1)


def row(i, user, kind, ts, props=None, action="x", arrived=None):
    return (i, user, kind, action, props, None, ts, arrived or ts, "clash", "clash", "clash")


@pytest.fixture(scope="module")
def types(spark):
    return spark.createDataFrame([("A_ONE", "c", False), ("B_TWO", "c", True), (None, "c", False), ("!!", "c", False)], "event_type string, category string, retired boolean")


def brute(rows, lo=None, hi=None):
    known = {"AONE": "A_ONE", "BTWO": "B_TWO"}
    out, seen = defaultdict(lambda: [0, None]), set()
    for r in sorted(rows, key=lambda r: r[6] or T0):
        k = known.get("".join(c for c in (r[2] or "") if c.isalnum()).upper())
        if r[0] is None or not r[1] or k is None or r[6] is None or r[0] in seen:
            continue
        seen.add(r[0])
        if (lo and r[6] < lo) or (hi and r[6] >= hi):
            continue
        o = out[r[1], k]
        o[0] += 1
        o[1] = max(o[1] or r[6], r[6])
    return {k: tuple(v) for k, v in out.items()}


def got(df):
    return {(r.user_id, r.event_type): (r.n_events, r.last_ts) for r in df.collect()}


def test_counts_dirty_rows_and_bounds(spark, types, tmp_path):
    rng = random.Random(3)
    rows = [row(f"e{i}", "hot" if rng.random() < 0.4 else f"u{rng.randint(0, 9)}", rng.choice(["A_ONE", "a-one", "b two", "BTwo ", "C", None]), T0 + dt.timedelta(hours=rng.randint(0, 1500)), '{"tokens": 3}') for i in range(600)]
    rows += rows[:80]
    rows += [row("n1", None, "A_ONE", T0), row("n2", "", "A_ONE", T0), row(None, "u1", "A_ONE", T0), row("n3", "u1", "A_ONE", None), row("n4", "u1", "A_ONE", T0, "not json", None)]
    events = spark.createDataFrame(rows, SCHEMA)
    store = EntityFeatures(spark, str(tmp_path / "s"))
    assert store.refresh(events, types)
    assert got(store.features()) == brute(rows)
    lo, hi = T0 + dt.timedelta(hours=77), T0 + dt.timedelta(hours=1101)
    assert got(store.features(events, types, lo, hi)) == brute(rows, lo, hi)
    one = {r.user_id: r for r in EntityFeatures.by_entity(store.features()).collect()}
    assert one["hot"].n_events == sum(v[0] for k, v in brute(rows).items() if k[0] == "hot")
    assert set(one["hot"].features) <= {"A_ONE", "B_TWO"}


def test_only_changed_buckets_are_recomputed(spark, types, tmp_path):
    rows = [row(f"e{i}", "u", "A_ONE", T0 + dt.timedelta(days=i)) for i in range(60)]
    store = EntityFeatures(spark, str(tmp_path / "s"))
    assert len(store.refresh(spark.createDataFrame(rows, SCHEMA), types)) == 9
    assert store.refresh(spark.createDataFrame(rows, SCHEMA), types) == []
    more = [*rows, row("late", "v", "B_TWO", T0 + dt.timedelta(days=30), arrived=T0 + dt.timedelta(days=61))]
    assert len(store.refresh(spark.createDataFrame(more, SCHEMA), types)) == 1
    assert got(store.features()) == brute(more)
    more.append(row("same time", "v", "B_TWO", T0 + dt.timedelta(days=3), arrived=T0 + dt.timedelta(days=61)))
    assert store.refresh(spark.createDataFrame(more, SCHEMA), types) == [dt.date(2024, 1, 1)]
    assert got(store.features()) == brute(more)
    assert store.refresh(spark.createDataFrame(rows[:-8], SCHEMA), types, audit=True)
    assert got(store.features()) == brute(rows[:-8])


def test_copies_in_several_buckets_count_once(spark, types, tmp_path):
    rows = [row(f"e{i}", "u", "A_ONE", T0 + dt.timedelta(days=3 * i)) for i in range(20)]
    twice = [*rows, row("e4", "u", "A_ONE", T0 + dt.timedelta(days=40))]
    store = EntityFeatures(spark, str(tmp_path / "a"))
    store.refresh(spark.createDataFrame(twice, SCHEMA), types)
    assert got(store.features()) == brute(twice)
    # a copy that arrives later, and lies before the one that was counted
    late = dt.timedelta(days=100)
    for i, (k, day) in enumerate([(19, 1), (3, 50), (10, 29)]):
        twice = [*twice, row(f"e{k}", "u", "A_ONE", T0 + dt.timedelta(days=day), arrived=T0 + late + dt.timedelta(days=i))]
        assert 0 < len(store.refresh(spark.createDataFrame(twice, SCHEMA), types)) < 9
        assert got(store.features()) == brute(twice)
    lo, hi = T0 + dt.timedelta(days=2, hours=5), T0 + dt.timedelta(days=33, hours=8)
    events = spark.createDataFrame(twice, SCHEMA)
    assert got(store.features(events, types, lo, hi)) == brute(twice, lo, hi)


@pytest.mark.parametrize("bucket", ["day", "month"])
def test_ranges_by_bucket(spark, types, tmp_path, bucket):
    rows = [row(f"e{i}", "u", "A_ONE", T0 + dt.timedelta(hours=i)) for i in range(60)]
    store = EntityFeatures(spark, str(tmp_path / "s"), bucket)
    events = spark.createDataFrame(rows, SCHEMA)
    store.refresh(events, types)
    lo, hi = T0 + dt.timedelta(hours=5), T0 + dt.timedelta(hours=32)
    assert got(store.features(events, types, lo, hi)) == brute(rows, lo, hi)


def test_short_buckets_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        EntityFeatures(spark, str(tmp_path / "s"), "hour")


def test_empty(spark, types, tmp_path):
    store = EntityFeatures(spark, str(tmp_path / "s"))
    assert store.refresh(spark.createDataFrame([], SCHEMA), types) == []
    assert store.features().count() == 0
    assert EntityFeatures.by_entity(store.features()).count() == 0


def test_another_table_under_the_same_name(spark, types, tmp_path):
    a = [row(f"e{i}", "u", "A_ONE", T0 + dt.timedelta(days=i)) for i in range(30)]
    b = [row(f"x{i}", "v", "B_TWO", T0 + dt.timedelta(days=i), arrived=T0 + dt.timedelta(days=min(29, i + 1))) for i in range(30)]
    store = EntityFeatures(spark, str(tmp_path / "s"))
    store.refresh(spark.createDataFrame(a, SCHEMA), types)
    assert store.refresh(spark.createDataFrame(b, SCHEMA), types) and got(store.features()) == brute(b)
    spark.createDataFrame([(dt.date(2024, 1, 1), 3)], "bucket date, n bigint").write.mode("overwrite").parquet(str(tmp_path / "s" / "manifest"))
    assert store.refresh(spark.createDataFrame(a, SCHEMA), types) and got(store.features()) == brute(a)
