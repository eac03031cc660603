"""All queries of the core, by name, and the SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import context, features, relational


def flagship_segment_revenue(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return (
        c.join(o, c.c_custkey == o.o_custkey)
        .groupBy("c_mktsegment")
        .agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))
        .orderBy(F.desc_nulls_last("revenue"), "c_mktsegment")
    )


QUERIES = {"flagship_segment_revenue": flagship_segment_revenue} | relational.QUERIES | context.QUERIES | features.QUERIES
ORACLE = {
    "flagship_segment_revenue": """
SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1 ORDER BY revenue DESC, c_mktsegment"""
} | relational.ORACLE | context.ORACLE | features.ORACLE
