"""Exact vector search: metrics, top-k with filters before ranking, hybrid keyword search, and an LSH index.

Scores are expressions, so a search is one scan with a bounded heap in each partition
(``TakeOrderedAndProject``), whatever the size of the table. Ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _dot(a, b)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(_dot(a, b) / n)


def euclidean(a: Column, b: Column) -> Column:
    """A similarity: 1 / (1 + distance)."""
    d = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    return F.lit(1.0) / (F.lit(1.0) + d)


METRICS = {"cosine": cosine, "dot": dot, "euclidean": euclidean}


def as_vector(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def search(df: DataFrame, query: list[float], k: int, metric: str = "cosine", where: Column | None = None, embedding: str = "embedding", key: str = "id") -> DataFrame:
    """The k rows most like the query, with ``score``. Rows without a vector are left out; one of another length than the
    query's is an error when the search runs, as its score would mean nothing."""
    rows = df if where is None else df.where(where)
    told = F.raise_error(F.concat(F.lit(f"a vector of length {len(query)} is wanted, not "), F.size(embedding).cast("string"))).cast("boolean")
    rows = rows.where(F.when(F.col(embedding).isNull(), F.lit(False)).when(F.size(embedding) == len(query), F.lit(True)).otherwise(told))
    return rows.withColumn("score", METRICS[metric](F.col(embedding), as_vector(query))).orderBy(F.desc("score"), key).limit(k)


def hybrid(df: DataFrame, query: list[float], k: int, keyword: str, where: Column | None = None, content: str = "content", embedding: str = "embedding", key: str = "id") -> DataFrame:
    """As ``search``, among rows whose content has the keyword, case aside."""
    has = F.lower(F.col(content)).contains(keyword.lower())
    return search(df, query, k, "cosine", has if where is None else has & where, embedding, key)


def namespaces(df: DataFrame, namespace: str = "namespace") -> DataFrame:
    return df.groupBy(namespace).agg(F.count(F.lit(1)).alias("n"))


def lsh_join_candidates(df: DataFrame, key: str, embedding: str, dims: int, bits: int = 12, tables: int = 6, seed: int = 7) -> DataFrame:
    """Random-hyperplane buckets (``key``, ``table_no``, ``bucket``) for approximate search on large tables."""
    import numpy as np

    planes = np.random.default_rng(seed).normal(size=(tables, bits, dims))
    out = []
    for t in range(tables):
        b = F.lit(0)
        for i in range(bits):
            b = b * 2 + (_dot(F.col(embedding), as_vector(planes[t, i].tolist())) > 0).cast("int")
        out.append(F.struct(F.lit(t).alias("table_no"), b.alias("bucket")))
    return df.select(key, F.explode(F.array(*out)).alias("b")).select(key, "b.*")


def fetch(df: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows of some keys."""
    return df.where(F.col(key).isin(ids))


def size(df: DataFrame) -> DataFrame:
    """One row: how many vectors there are."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def remove(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*df.columns)


def change(df: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``df`` with the columns of ``changes`` where they aren't null; of two changes of a key the one with the greatest values."""
    names = [c for c in changes.columns if c != key and c in df.columns]
    one = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*names)).alias("__to"))
    return df.join(one, key, "left").withColumns({n: F.coalesce(F.col(f"__to.{n}"), F.col(n)) for n in names}).select(*df.columns)


def approximate_search(df: DataFrame, queries: DataFrame, k: int, dims: int, bits: int = 6, tables: int = 12, key: str = "id", embedding: str = "embedding", seed: int = 7) -> DataFrame:
    """The k rows most like each query (``query_id``, ``query``) by cosine, among those that share a bucket with it:
    ``query_id``, key, ``score``, ``rank``.

    Random hyperplanes sort all rows into buckets, in several tables; a query is compared with the rows of its buckets
    and of those one plane away. Buckets are joined by shuffle in hashed slices, so one with very many rows is shared by
    several tasks. Rows without a vector of ``dims`` numbers are not indexed; a zero vector has score 0.
    """
    slices = 8
    rows = df.where(F.size(embedding) == dims)
    index = lsh_join_candidates(rows, key, embedding, dims, bits, tables, seed).withColumn("__slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int"))
    asked = queries.where(F.size("query") == dims)
    at = lsh_join_candidates(asked, "query_id", "query", dims, bits, tables, seed)
    near = F.array(F.col("bucket"), *[F.col("bucket").bitwiseXOR(F.lit(1 << b)) for b in range(bits)])
    at = at.select("query_id", "table_no", F.explode(near).alias("bucket")).withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    pairs = at.join(index, ["table_no", "bucket", "__slice"]).select("query_id", key).distinct()
    scored = pairs.join(asked.select("query_id", "query"), "query_id").join(rows.select(key, embedding), key).withColumn("score", cosine(F.col(embedding), F.col("query")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", key, "score", "rank")
