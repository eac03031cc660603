"""A graph of entities and directed relationships, and bounded traversal by frontier joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .vectors import search


def entities_by_type(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.lower("entity_type") == kind.lower())


def out_edges(edges: DataFrame, node: str | int) -> DataFrame:
    return edges.where(F.col("source_id") == node)


def in_edges(edges: DataFrame, node: str | int) -> DataFrame:
    return edges.where(F.col("target_id") == node)


def valid_edges(edges: DataFrame, now: Column) -> DataFrame:
    return edges.where((F.col("valid_from").isNull() | (F.col("valid_from") <= now)) & (F.col("valid_until").isNull() | (F.col("valid_until") > now)))


def related(edges: DataFrame, start: DataFrame, depth: int, kind: str | None = None) -> DataFrame:
    """(node, depth): what is reached in up to ``depth`` hops from the nodes of ``start`` (column ``node``), each with
    its least number of hops; the start nodes themselves are left out.

    Each hop joins the frontier to the edges and drops what was reached before. The frontier is cut off by a
    checkpoint in the shared folder, so the plan doesn't grow with the hops and a lost executor costs one hop.
    """
    shared_dir(edges.sparkSession)
    e = edges.where(F.col("relationship_type") == kind) if kind else edges
    # the edges are made once, and lie partitioned by what each hop joins on; edges of a hub are spread by AQE
    e = e.select(F.col("source_id").alias("node"), F.col("target_id").alias("next")).where("node IS NOT NULL AND next IS NOT NULL").distinct().repartition("node").checkpoint()
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.select("node").join(e, "node").select(F.col("next").alias("node")).distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)).checkpoint()
        seen = seen.unionByName(frontier)
        if not frontier.limit(1).count():
            break
    return seen.where("depth > 0")


def entity_search(nodes: DataFrame, query: list[float], k: int, kind: str | None = None) -> DataFrame:
    """The k entities, perhaps of a type, whose vectors are most like the query, with ``score``."""
    return search(nodes if kind is None else entities_by_type(nodes, kind), query, k)


def remove_entities(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the named nodes and all edges at them."""
    gone = ids.select("id").distinct()
    kept = edges.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return nodes.join(gone, "id", "left_anti"), kept.select(*edges.columns)


def relate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The new edges of which both ends exist and belong to the edge's user."""
    n = nodes.select("id", "user_id")
    ok = edges.join(n.select(F.col("id").alias("source_id"), "user_id"), ["source_id", "user_id"], "left_semi")
    return ok.join(n.select(F.col("id").alias("target_id"), "user_id"), ["target_id", "user_id"], "left_semi").select(*edges.columns)


def latest_entities(nodes: DataFrame, n: int = 200) -> DataFrame:
    return nodes.orderBy(F.desc("updated_at"), "id").limit(n)


def latest_relationships(edges: DataFrame, n: int = 200) -> DataFrame:
    return edges.orderBy(F.desc("created_at"), "id").limit(n)
