"""Context for a query from all stores: fused recall of ranked lists, and scored retrieval of candidates.

A store is a table or None. Columns that are read:

memories: id, user_id, namespace, memory_type, content, embedding, importance, confidence, recency, scope, created_at,
updated_at, valid_until, expired_at. chunks: id, source_id, content, embedding. sources: id, source_type, source_name,
status, updated_at. entities: id, user_id, entity_type, name, description, embedding, confidence, updated_at.
relationships: id, source_id, target_id, relationship_type, description, confidence, weight, created_at.
events: id, user_id, event_type, action, ts. vectors: id, namespace, content, embedding.

All lists end after a number of items that follows from the number of results asked for, by a heap in each partition.
Null texts have no lexical score, rows without a vector no vector score; such rows can still be found by the other one.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fulltext_rank, lexical_score, token_estimate
from . import graph, memory
from .retrieval import FUSION_WEIGHTS, Rule, ceiling, diversify, final_score, freshness, fuse, limits, quality, reason
from .vectors import search


@dataclass
class Stores:
    memories: DataFrame | None = None
    chunks: DataFrame | None = None
    sources: DataFrame | None = None
    entities: DataFrame | None = None
    relationships: DataFrame | None = None
    events: DataFrame | None = None
    vectors: DataFrame | None = None


@dataclass
class Request:
    """What is asked: a text, its vector, for whom, and which rows may answer.

    Memories are those of a namespace, perhaps of a type and scope; a user sees own memories and those of agents.
    ``now`` decides what is still valid, ``as_of`` asks for what was known at a time.
    """

    query: str
    vector: list[float] | None
    now: Column
    user: str | int | None = None
    namespace: str = "default"
    memory_type: str | None = None
    scope: str | None = None
    as_of: Column | None = None
    source_types: list[str] = field(default_factory=list)


def _memories(s: Stores, r: Request) -> DataFrame:
    return memory.visible(s.memories, r.now, r.namespace, r.memory_type, r.user, r.scope, r.as_of)


def _by_vector(rows: DataFrame, r: Request, n: int) -> DataFrame:
    """The n rows most like the query, with ``vector_score``; none without a vector."""
    if r.vector is None:
        return rows.limit(0).withColumn("vector_score", F.lit(0.0))
    return search(rows, r.vector, n).withColumnRenamed("score", "vector_score")


def _by_text(rows: DataFrame, r: Request, n: int, content: str = "content") -> DataFrame:
    """The n rows with all terms of the query that rank best, with ``text_score``."""
    match, rank = fulltext_rank(r.query, F.col(content))
    return rows.where(match).withColumn("text_score", rank.cast("double")).orderBy(F.desc("text_score"), "id").limit(n)


def _either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both lists by id, the higher of each score; 0 for a score that a list doesn't give."""
    rows = a.unionByName(b, allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = rows.withColumns({c: zero(c) if c in rows.columns else F.lit(0.0) for c in ("vector_score", "text_score")})
    others = [c for c in rows.columns if c not in ("id", "vector_score", "text_score")]
    best = rows.groupBy("id").agg(F.max("vector_score").alias("vector_score"), F.max("text_score").alias("text_score"), F.min_by(F.struct(*others), F.col("vector_score")).alias("r"))
    return best.select("id", "r.*", "vector_score", "text_score")


def chunk_search(s: Stores, r: Request, n: int) -> DataFrame:
    """The n chunks of active sources, perhaps of some types, with the highest sum of vector and text score."""
    of = s.sources.where("status = 'ACTIVE'")
    if r.source_types:
        of = of.where(F.lower("source_type").isin([t.lower() for t in r.source_types]))
    rows = s.chunks.select("id", "source_id", "content", "embedding").join(of.select(F.col("id").alias("source_id"), "source_type", "source_name", "updated_at"), "source_id")
    both = _either(_by_vector(rows, r, 2 * n), _by_text(rows, r, 2 * n))
    return both.orderBy(F.desc(F.greatest(F.col("vector_score"), F.lit(0.0)) + F.col("text_score")), "id").limit(n)


def _result(rows: DataFrame, kind: str, label: str, content: Column, source_type: Column, source_name: Column, updated: Column, importance: Column, text: Column, r: Request, rules: tuple[list[Rule], list[Rule]]) -> DataFrame:
    """Candidates with their scores. ``rows`` has id and vector_score."""
    rows = rows.select(
        F.col("id").cast("string").alias("id"), F.lit(kind).alias("type"), content.alias("content"), source_type.alias("source_type"), source_name.alias("source_name"),
        F.col("vector_score"), text.alias("text_score"), freshness(updated, r.now).alias("freshness"), F.coalesce(importance, F.lit(0.0)).alias("importance"),
    )
    c = F.col
    score = final_score(c("vector_score"), c("text_score"), c("freshness"), c("importance"), quality(c("type"), c("content"), rules[0]), ceiling(c("type"), c("content"), rules[1]))
    return rows.withColumns({"token_estimate": token_estimate(c("content")), "final_score": score, "reason": reason(F.lit(label), c("vector_score"), c("text_score"), c("freshness"), c("importance"))})


def candidates(s: Stores, r: Request, n: int, quality_rules: list[Rule] | None = None, ceiling_rules: list[Rule] | None = None) -> DataFrame:
    """Up to n candidates of each kind, scored: id, type, content, source_type, source_name, vector_score, text_score,
    freshness, importance, token_estimate, final_score, reason.

    Memories and chunks are found by vector or text, entities by vector or any term, relationships and events by any term.
    """
    rules = (quality_rules or [], ceiling_rules or [])
    c, none = F.col, F.lit(None).cast("string")
    lexical = lambda content: lexical_score(r.query, content)
    out = []
    if s.memories is not None:
        seen = _memories(s, r).drop("vector_score", "text_score")
        rows = _either(_by_vector(seen, r, n), _by_text(seen, r, n))
        out.append(_result(rows, "MEMORY", "memory", c("content"), c("memory_type"), F.lit("Memory"), c("updated_at"), c("importance"), F.greatest(c("text_score"), lexical(c("content"))), r, rules))
    if s.chunks is not None and s.sources is not None:
        rows = chunk_search(s, r, n)
        out.append(_result(rows, "SOURCE_CHUNK", "source chunk", c("content"), c("source_type"), c("source_name"), c("updated_at"), F.lit(0.75), F.greatest(c("text_score"), lexical(c("content"))), r, rules))
    if s.entities is not None:
        content = F.concat(F.coalesce("name", F.lit("")), F.lit(" ("), F.coalesce("entity_type", F.lit("")), F.lit("): "), F.coalesce("description", F.lit("")))
        every = s.entities.withColumn("content", content)
        every = every if "embedding" in every.columns else every.withColumn("embedding", F.lit(None).cast("array<float>"))
        named = every.withColumn("text_score", lexical(c("content"))).where("text_score > 0").orderBy(F.desc("text_score"), "id").limit(n)
        rows = _either(_by_vector(every, r, n), named)
        out.append(_result(rows, "ENTITY", "entity", c("content"), c("entity_type"), F.lit("Graph"), c("updated_at"), c("confidence"), lexical(c("content")), r, rules))
    if s.relationships is not None:
        more = F.when(F.trim("description") != "", F.concat(F.lit(": "), "description")).otherwise("") if "description" in s.relationships.columns else F.lit("")
        rows = s.relationships.withColumn("content", F.concat(F.concat_ws(" ", "source_id", "relationship_type", "target_id"), F.coalesce(more, F.lit(""))))
        rows = rows.withColumns({"text_score": lexical(c("content")), "vector_score": F.lit(0.0)}).where("text_score > 0").orderBy(F.desc("text_score"), "id").limit(n)
        out.append(_result(rows, "RELATIONSHIP", "relationship", c("content"), c("relationship_type"), F.lit("Graph"), c("created_at"), F.greatest("confidence", "weight"), c("text_score"), r, rules))
    if s.events is not None:
        own = s.events if r.user is None else s.events.where(c("user_id") == r.user)
        rows = own.orderBy(F.desc("ts"), "id").limit(3 * n).withColumn("content", F.concat(F.coalesce("event_type", F.lit("")), F.lit(": "), F.coalesce("action", F.lit(""))))
        rows = rows.withColumns({"text_score": lexical(c("content")), "vector_score": F.lit(0.0)}).where("text_score > 0")
        out.append(_result(rows, "EVENT", "event", c("content"), c("event_type"), F.lit("Events"), c("ts"), F.lit(0.7), c("text_score"), r, rules))
    if not out:
        raise ValueError("no store to retrieve from")
    return reduce(DataFrame.unionByName, out).withColumn("source_type", F.coalesce("source_type", none))


def retrieve(s: Stores, r: Request, top_k: int = 10, quality_rules: list[Rule] | None = None, ceiling_rules: list[Rule] | None = None) -> DataFrame:
    """The best results of all kinds, ``top_k`` of them but 1 to 50, diversified: the columns of ``candidates`` and ``position``."""
    if not (r.query or "").strip():
        raise ValueError("a query is needed")
    k, n = limits(top_k)
    rows = candidates(s, r, n, quality_rules, ceiling_rules)
    chosen = diversify(rows, k, r.query)
    return chosen.join(rows, ["id", "type"]).orderBy("position")


def recall(s: Stores, r: Request, k: int = 10, related_depth: int = 0, weights: dict[str, float] = memory.RECALL_WEIGHTS, lists: tuple[str, ...] = tuple(FUSION_WEIGHTS)) -> DataFrame:
    """Up to five ranked lists fused (id, source, type, content, score, fused): memories by relevance, memories by full
    text, vectors, entities with what is related to them, and a user's latest events.

    Lists are those of ``lists`` whose store is given. Relevance weighs similarity, importance, recency and confidence
    by ``weights``. ``related_depth`` hops from the entities found, 0 for none.
    """
    if r.vector is None:
        raise ValueError("a vector is needed")
    c = F.col
    pick = lambda df, source, kind, content, score: df.select(F.lit(source).alias("source"), c("id").cast("string").alias("id"), kind.alias("type"), content.alias("content"), score.cast("double").alias("score"))
    out = []
    if s.memories is not None:
        seen = _memories(s, r)
        if "memory" in lists:
            near = search(seen, r.vector, 2 * k).withColumnRenamed("score", "similarity")
            out.append(pick(near.withColumn("s", memory.relevance(c("similarity"), weights)), "memory", c("memory_type"), c("content"), c("s")))
        if {"memory", "fulltext"} & set(lists) and r.query:
            out.append(pick(_by_text(seen, r, k), "fulltext", c("memory_type"), c("content"), c("text_score")))
    if s.vectors is not None and "vector" in lists:
        near = search(s.vectors.where(c("namespace") == r.namespace), r.vector, k)
        out.append(pick(near, "vector", F.lit("VECTOR"), c("content"), c("score")))
    if s.entities is not None and "semantic" in lists:
        own = s.entities if r.user is None else s.entities.where(c("user_id").isNull() | (c("user_id") == r.user))
        text = F.coalesce("description", "name")
        near = search(s.entities, r.vector, k)
        near = near if r.user is None else near.where(c("user_id").isNull() | (c("user_id") == r.user))
        found = pick(near, "semantic", c("entity_type"), text, c("score"))
        if related_depth and s.relationships is not None:
            more = graph.related(s.relationships, near.select(c("id").alias("node")), related_depth)
            more = own.join(more.select(c("node").alias("id")), "id", "left_semi")
            found = found.unionByName(pick(more, "semantic", c("entity_type"), text, F.lit(max(0.1, 0.65 / related_depth))))
        out.append(found.groupBy("source", "id").agg(F.max_by(F.struct("type", "content", "score"), "score").alias("r")).select("source", "id", "r.*"))
    if s.events is not None and "events" in lists and r.user is not None:
        latest = s.events.where(c("user_id") == r.user).orderBy(F.desc("ts"), "id").limit(min(k, 25))
        out.append(pick(latest, "events", F.coalesce("event_type", F.lit("EVENT")), F.coalesce("action", F.lit("")), F.lit(0.45)))
    if not out:
        raise ValueError("no store to recall from")
    return fuse(reduce(DataFrame.unionByName, out), r.query, k)
