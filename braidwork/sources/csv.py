"""CSV files and strings, with the dialect's own type inference."""

from __future__ import annotations


import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _typed(raw: DataFrame) -> DataFrame:
    """Columns as BOOLEAN, BIGINT, DOUBLE or STRING, whichever first fits all values; the empty text and ``null`` are null.

    One aggregation over all rows decides for all columns. A column without any value is BOOLEAN.
    """
    def value(c: str):
        t = F.trim(F.col(f"`{c}`"))
        return F.when((t == "") | (F.lower(t) == "null"), F.lit(None)).otherwise(t)

    clean = raw.select(*[value(c).alias(c) for c in raw.columns])
    fits = lambda c, ok: F.coalesce(F.bool_and(F.col(f"`{c}`").isNull() | ok), F.lit(True))
    checks = []
    for i, c in enumerate(clean.columns):
        v = F.col(f"`{c}`")
        checks += [
            fits(c, F.lower(v).isin("true", "false")).alias(f"b{i}"),
            fits(c, v.rlike(r"^[+-]?\d+$") & v.try_cast("bigint").isNotNull()).alias(f"l{i}"),
            fits(c, v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")).alias(f"d{i}"),
        ]
    r = clean.agg(*checks).first()
    kind = lambda i: "boolean" if r[f"b{i}"] else "bigint" if r[f"l{i}"] else "double" if r[f"d{i}"] else "string"
    return clean.select(*[F.col(f"`{c}`").cast(kind(i)).alias(c) for i, c in enumerate(clean.columns)])


def _options(reader):
    return reader.option("header", True).option("inferSchema", False).option("quote", '"').option("escape", '"').option("multiLine", False).option("mode", "PERMISSIVE").option("enforceSchema", False)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines are skipped, short rows filled with nulls, further fields dropped, all fields trimmed."""
    raw = _options(spark.read).csv(path)
    return _typed(raw.select(*[F.col(f"`{c}`").alias(c.strip()) for c in raw.columns]))


def read_csv_string(spark: SparkSession, content: str) -> DataFrame:
    """As ``read_csv``, from a text that the caller holds."""
    lines = [x for x in content.splitlines() if x.strip()]
    if not lines:
        return spark.createDataFrame([], "value string").limit(0)
    head = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").coalesce(1)
    names = [n.strip() for n in next(csv.reader([lines[0]]))]
    schema = ", ".join(f"`{n}` string" for n in names)
    parsed = head.where("i > 0").select(F.from_csv("line", schema, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return _typed(parsed)


