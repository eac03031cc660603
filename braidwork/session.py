"""Session defaults, table access and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("braidwork")
    for k, v in (DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false"} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors can reach, from ``spark.checkpoint.dir``.

    On one machine, where the setting is absent, a temporary folder takes its place and becomes the
    checkpoint folder. On a cluster without the setting this raises: a machine-local folder would lose
    data there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not at and sc.getCheckpointDir():
        at = sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="braidwork-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; workers of one machine may have been started
    from another folder and need it as well."""
    sc = spark.sparkContext
    if getattr(sc, "_braidwork_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(prefix="braidwork-"), "braidwork_package.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(to)
    sc._braidwork_shipped = True


def spread(scan: DataFrame) -> DataFrame:
    """A scan for work in Python, with at least a task for each core.

    Small tables in one file come as one partition; only those are shuffled. ``scan`` must hold no shuffle of
    its own, as its partitions are counted here.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


#: A table is broadcast if its rows take at most so many bytes.
BROADCAST_BYTES = 48 << 20


def _width(name: str, kind: str) -> Column:
    """About the bytes of a value in memory."""
    c = F.col(f"`{name}`")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 24
    return F.coalesce(F.size(c), F.lit(0)) * 8 + 32 if kind.startswith(("array", "map")) else F.lit(16)


def size_in_memory(df: DataFrame) -> int:
    """About the bytes that all rows take in memory, by one aggregate over them."""
    width = F.lit(16)
    for name, kind in df.dtypes:
        width = width + _width(name, kind)
    return df.agg(F.sum(width.cast("bigint"))).first()[0] or 0


def checked_broadcast(small: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``small`` with a broadcast hint if its rows take at most ``limit_bytes``, else without one, for a join by shuffle.

    The check is an aggregate over the small side alone, so it never reads the large one. It is made at each call,
    as a side that is small today may have grown.
    """
    few = size_in_memory(small) <= limit_bytes
    return (F.broadcast(small) if few else small), few


def _repeated(rows: DataFrame, key: list[str], value: str, limit_bytes: int) -> DataFrame:
    """The keys that stand more than once, with the smallest hash of their values; broadcast if they are few enough."""
    shared_dir(rows.sparkSession)
    by = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.min(F.xxhash64(value)).alias("__h")).where("__n > 1").drop("__n")
    return checked_broadcast(by.checkpoint(), limit_bytes)[0]


def settled(rows: DataFrame, key: list[str], value: str, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``key`` and ``value``, of rows repeated under one key those with one value: that with the smallest hash.

    Rows that are the same altogether may still be repeated. Only keys and hashes are shuffled, and rows pass through
    where they are, as long as the repeated keys fit a broadcast.
    """
    rows = rows.select(*key, value)
    again = _repeated(rows, key, value, limit_bytes)
    return rows.join(again, key, "left").where(F.col("__h").isNull() | (F.col("__h") == F.xxhash64(value))).select(*key, value)


def once(rows: DataFrame, key: list[str], value: str, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``key`` and ``value`` with one row for each key: that with the smallest value where a key is repeated.

    Only the keys are shuffled, to see which are repeated. Values of repeated keys alone meet in an aggregate that
    combines before its shuffle; all others pass through where they are, as long as the repeated keys fit a broadcast.
    """
    rows = rows.select(*key, value)
    again = _repeated(rows, key, value, limit_bytes).drop("__h")
    single = rows.join(again, key, "left_anti").select(*key, value)
    return single.unionByName(rows.join(again, key, "left_semi").groupBy(*key).agg(F.min(value).alias(value)).select(*key, value))
