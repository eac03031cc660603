"""Named tables: registering, inserting, dropping, statistics, listing, printing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from .csv import read_csv


class Catalog:
    """Tables by name, case aside, as temporary views; registering again replaces."""

    #: After so many inserts into a table its rows are written to the shared folder, and read from there.
    CUT_AFTER = 16

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._tables: dict[str, DataFrame] = {}
        self._inserts: dict[str, int] = {}

    def register(self, name: str, df: DataFrame) -> DataFrame:
        self._tables[name.lower()] = df
        df.createOrReplaceTempView(name.lower())
        return df

    def create(self, name: str, schema: str | T.StructType, if_not_exists: bool = False) -> None:
        if name.lower() in self._tables:
            if if_not_exists:
                return
            raise ValueError(f"table {name} exists")
        self.register(name, self.spark.createDataFrame([], schema))

    def drop(self, name: str, if_exists: bool = False) -> bool:
        if self._tables.pop(name.lower(), None) is None:
            if if_exists:
                return False
            raise KeyError(f"no table {name}")
        self.spark.catalog.dropTempView(name.lower())
        return True

    def exists(self, name: str) -> bool:
        return name.lower() in self._tables

    def table(self, name: str) -> DataFrame:
        if name.lower() not in self._tables:
            raise KeyError(f"no table {name}")
        return self._tables[name.lower()]

    def names(self) -> list[str]:
        return sorted(self._tables)

    def insert(self, name: str, rows: DataFrame | list) -> None:
        old = self.table(name)
        new = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, old.schema)
        if list(new.columns) == list(old.columns):
            new = new.select(*[F.col(f.name).cast(f.dataType) for f in old.schema])
        rows = old.unionByName(new, allowMissingColumns=True).select(*old.columns)
        n = self._inserts[name.lower()] = self._inserts.get(name.lower(), 0) + 1
        if n % self.CUT_AFTER == 0:  # else the plan would grow by a union with each insert
            shared_dir(self.spark)
            rows = rows.checkpoint()
        self.register(name, rows)

    def clear(self, name: str) -> None:
        self.register(name, self.table(name).limit(0))

    def load_csv(self, path: str, name: str) -> DataFrame:
        return self.register(name, read_csv(self.spark, path))

    def load_parquet(self, path: str, name: str) -> DataFrame:
        return self.register(name, self.spark.read.parquet(path))

    def statistics(self, name: str) -> DataFrame:
        return statistics(self.table(name))

    def show(self, name: str, n: int = 20) -> None:
        self.table(name).show(n, truncate=50)

    def schema(self, name: str) -> str:
        return self.table(name).schema.treeString()


def statistics(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row for each column: rows, distinct values and nulls. The counts of all columns come from one pass."""
    distinct = (lambda c: F.count_distinct(c)) if exact else (lambda c: F.approx_count_distinct(c))
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        aggs += [distinct(F.col(f"`{c}`")).alias(f"d{i}"), F.count_if(F.col(f"`{c}`").isNull()).alias(f"z{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"d{i}").alias("n_distinct"), F.col(f"z{i}").alias("n_null")) for i, c in enumerate(df.columns)])
    return one.select(F.explode(rows).alias("r")).select("r.*")
