"""Memories: scored recall, validity, decay, as-of reading, conflicts and summaries. The clock is an argument."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checked_broadcast
from .vectors import cosine, search

# Types and the core pattern each belongs to, and the decay rates of the patterns by hour; fixed values.
CORE = {
    "WORKING": "WORKING", "CONVERSATION": "WORKING", "SEMANTIC": "SEMANTIC", "FACT": "SEMANTIC", "DOCUMENT": "SEMANTIC", "SUMMARY": "SEMANTIC",
    "EPISODIC": "EPISODIC", "BEHAVIOR_EVENT": "EPISODIC", "DECISION": "EPISODIC", "FEEDBACK": "EPISODIC",
    "PROCEDURAL": "PROCEDURAL", "AGENT_ACTION": "PROCEDURAL", "USER_PROFILE": "PROCEDURAL", "PREFERENCE": "PROCEDURAL",
}
RATES = {"WORKING": 0.1, "SEMANTIC": 0.001, "EPISODIC": 0.005, "PROCEDURAL": 0.002}
RECALL_WEIGHTS = {"similarity": 0.4, "importance": 0.3, "recency": 0.2, "confidence": 0.1}


def core_pattern(kind: Column) -> Column:
    return F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in CORE.items())), kind)


def with_defaults(df: DataFrame) -> DataFrame:
    """Negative importance becomes .5, negative confidence and recency 1, a null namespace 'default', a null start the time of creation."""
    fix = lambda c, d: F.when(F.col(c).isNull() | (F.col(c) < 0), F.lit(d)).otherwise(F.col(c))
    return df.withColumns({"importance": fix("importance", 0.5), "confidence": fix("confidence", 1.0), "recency": fix("recency", 1.0), "namespace": F.coalesce("namespace", F.lit("default")), "valid_from": F.coalesce("valid_from", "created_at")})


def relevance(similarity: Column, w: dict[str, float] = RECALL_WEIGHTS) -> Column:
    return F.lit(w["similarity"]) * similarity + F.lit(w["importance"]) * F.col("importance") + F.lit(w["recency"]) * F.col("recency") + F.lit(w["confidence"]) * F.col("confidence")


def recall_similar(df: DataFrame, query: list[float], k: int, namespace: str | None = None, kind: str | None = None) -> DataFrame:
    """The 2k most similar memories, ranked again by relevance; k of them."""
    where = F.lit(True)
    if namespace is not None:
        where = where & (F.col("namespace") == namespace)
    if kind is not None:
        where = where & (F.col("memory_type") == kind)
    near = search(df, query, 2 * k, "cosine", where).withColumnRenamed("score", "similarity")
    return near.withColumn("relevance", relevance(F.col("similarity"))).orderBy(F.desc("relevance"), "id").limit(k)


def explanation() -> Column:
    return F.format_string("similarity=%.3f importance=%.2f recency=%.2f confidence=%.2f", "similarity", "importance", "recency", "confidence")


def valid(now: Column) -> Column:
    return F.col("expired_at").isNull() & (F.col("valid_until").isNull() | (F.col("valid_until") > now))


def as_of(df: DataFrame, t: Column) -> DataFrame:
    """What was known at a time: created by then, and neither expired nor out of validity then."""
    return df.where((F.col("created_at") <= t) & (F.col("expired_at").isNull() | (F.col("expired_at") > t)) & (F.col("valid_until").isNull() | (F.col("valid_until") > t)))


def visible_to(user: str | int) -> Column:
    """A user's own memories, and those of agents."""
    return (F.col("user_id") == user) | (F.col("scope") == "agent")


def visible(df: DataFrame, now: Column, namespace: str | None = None, kind: str | None = None, user: str | int | None = None, scope: str | None = None, as_of_time: Column | None = None) -> DataFrame:
    """Memories that may answer: valid now, of a namespace, type and scope, a user's own or an agent's.

    With ``as_of_time`` those that were known at that time take the place of those that are valid now. Scope "agent" is
    for every user.
    """
    rows = df.where(valid(now)) if as_of_time is None else as_of(df, as_of_time)
    for name, value in (("namespace", namespace), ("memory_type", kind), ("scope", scope)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows if user is None or scope == "agent" else rows.where(visible_to(user))


def search_scoped(df: DataFrame, query: list[float], k: int, now: Column, **who: object) -> DataFrame:
    """The k visible memories most like the query, with ``similarity``; ``who`` as in ``visible``."""
    return search(visible(df, now, **who), query, k).withColumnRenamed("score", "similarity")  # type: ignore[arg-type]


def count_active(df: DataFrame, user: str | int | None = None) -> DataFrame:
    """One row: how many memories, perhaps of a user, aren't expired."""
    rows = df.where("expired_at IS NULL")
    return (rows if user is None else rows.where(F.col("user_id") == user)).agg(F.count(F.lit(1)).alias("n"))


def update(df: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """``df`` with the columns of ``changes`` (id and others; importance alone, say) where they aren't null.

    An id that is changed twice takes the row with the greatest values. Ids that ``df`` lacks change nothing.
    """
    names = [c for c in changes.columns if c != "id" and c in df.columns]
    one = changes.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct(*names)).alias("__to"))
    rows = df.join(one, "id", "left")
    out = {n: F.coalesce(F.col(f"__to.{n}"), F.col(n)) for n in names}
    if "updated_at" in df.columns and "updated_at" not in names:
        out["updated_at"] = F.when(F.col("__to").isNotNull(), now).otherwise(F.col("updated_at"))
    return rows.withColumns(out).select(*df.columns)


def user_context(df: DataFrame, user: str, n: int) -> DataFrame:
    return df.where(F.col("user_id") == user).orderBy(F.desc("importance"), F.desc("updated_at"), "id").limit(n)


def by_type(df: DataFrame, kind: str, n: int | None = None) -> DataFrame:
    rows = df.where(F.col("memory_type") == kind).orderBy(F.desc("importance"), "id")
    return rows if n is None else rows.limit(n)


def summary(df: DataFrame, user: str) -> DataFrame:
    """Numbers of a user's memories by type."""
    return df.where(F.col("user_id") == user).groupBy("memory_type").agg(F.count(F.lit(1)).alias("n"))


def top_lines(df: DataFrame, user: str, n: int = 5, width: int = 80) -> DataFrame:
    """A user's most important memories, each cut to a width."""
    short = F.when(F.length("content") > width, F.concat(F.substring("content", 1, width), F.lit("..."))).otherwise(F.col("content"))
    return df.where(F.col("user_id") == user).orderBy(F.desc("importance"), "id").limit(n).select("id", short.alias("line"))


def decayed_step(hours: Column, rate: float = 0.995) -> Column:
    """Recency after so many hours, by a factor for each."""
    return F.col("recency") * F.pow(F.lit(rate), hours)


def decay(df: DataFrame, now: Column, rates: dict[str, float] = RATES) -> DataFrame:
    """Recency e^(-rate * hours since the last update), the rate by core pattern."""
    hours = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("updated_at").cast("timestamp"))) / F.lit(3600.0)
    rate = F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in rates.items())), core_pattern(F.col("memory_type")))
    return df.withColumn("recency", F.exp(-rate * F.greatest(hours, F.lit(0.0))))


#: Memories of one user, namespace and type are compared in so many blocks at least, and in more where there are many.
BLOCKS, BLOCK_ROWS = 4, 20_000


def conflicts(new: DataFrame, kept: DataFrame, threshold: float = 0.85, most: int = 5) -> DataFrame:
    """For each new memory, up to ``most`` kept ones of its namespace, type and user that are more similar than the threshold.

    ``new`` is a stated set of queries. The kept memories of a group lie in blocks by a hash of their id, each small
    enough for a task; a new memory meets each block of its group, and only the best of each block are ranked together.
    Memories with a null in namespace, type, user or embedding have no conflicts.
    """
    by = ["namespace", "memory_type", "user_id"]
    # one number for a group: how many blocks it has
    blocks = kept.groupBy(*by).agg(F.greatest(F.lit(BLOCKS), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int")).alias("__blocks"))
    blocks, _ = checked_broadcast(blocks)
    n = new.select(F.col("id").alias("new_id"), *by, F.col("embedding").alias("new_embedding")).join(blocks, by)
    n = n.withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    k = kept.select("id", *by, "embedding").join(blocks, by).withColumn("__block", F.pmod(F.xxhash64("id"), F.col("__blocks")).cast("int")).drop("__blocks")
    pairs = n.join(k, [*by, "__block"]).where(F.col("id") != F.col("new_id"))
    pairs = pairs.withColumn("similarity", cosine(F.col("new_embedding"), F.col("embedding"))).where(F.col("similarity") > threshold)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "id"))), 1, most)
    # pairs of a block are ranked where they are made, so at most ``most`` of a block go on
    inner = F.row_number().over(Window.partitionBy("new_id", "__block").orderBy(F.desc("similarity"), "id"))
    pairs = pairs.withColumn("__inner", inner).where(F.col("__inner") <= most)
    top = pairs.groupBy("new_id").agg(best.alias("b")).select("new_id", F.posexplode("b").alias("p", "r"))
    return top.select("new_id", F.col("r.id").alias("superseded_id"), (-F.col("r.s")).alias("similarity"), (F.col("p") + 1).alias("rank"))


def expire(df: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """``df`` with the named memories expired; the others as they are."""
    named = ids.select("id").distinct().withColumn("__named", F.lit(True))
    return df.join(named, "id", "left").withColumn("expired_at", F.when(F.col("__named"), F.coalesce("expired_at", now)).otherwise(F.col("expired_at"))).drop("__named")


def delete(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_anti")


def reinforce(df: DataFrame, touched: DataFrame, now: Column) -> DataFrame:
    """One access more for each touched memory."""
    named = touched.select("id").distinct().withColumn("__named", F.lit(True))
    hit = F.coalesce("__named", F.lit(False))
    return df.join(named, "id", "left").withColumns({"access_count": F.coalesce("access_count", F.lit(0)) + hit.cast("int"), "accessed_at": F.when(hit, now).otherwise(F.col("accessed_at"))}).drop("__named")


def session_end(now: Column, hours: int = 24) -> Column:
    """Until when memories of a session hold; null for other scopes."""
    return F.when(F.col("scope") == "session", now + F.expr(f"INTERVAL {hours} HOURS"))
