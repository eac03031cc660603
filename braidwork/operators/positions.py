"""Exact positions in a total order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_dir


def positions(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``rows`` with the place of each in the order given, from 1.

    Rows are partitioned by range and written once to the shared folder, as sampled ranges may differ between runs. A
    place is that within its slice and the number of rows in the slices before, of which there are as many as tasks.
    Rows that are even in the order share slices in any order; a total order gives one result.
    """
    shared_dir(rows.sparkSession)
    slices = rows.repartitionByRange(*order).withColumn("__slice", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each slice
    counts = slices.groupBy("__slice").agg(F.count(F.lit(1)).alias("n")).select("__slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__slice").orderBy(*order))
    return slices.withColumn("__in", within).join(F.broadcast(counts), "__slice").withColumn(name, F.col("__before") + F.col("__in")).select(*rows.columns, name)
