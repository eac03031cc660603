"""Type names of the SQL dialect, their promotion, and casts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import types as T

# Type names and what they stand for; fixed values.
NAMES = {
    "int": "int", "integer": "int", "bigint": "bigint", "double": "double", "double precision": "double", "float": "double", "real": "double",
    "decimal": "decimal(38,18)", "numeric": "decimal(38,18)", "varchar": "string", "text": "string", "string": "string", "char": "string",
    "boolean": "boolean", "bool": "boolean", "date": "date", "timestamp": "timestamp_ntz",
}
_ORDER = ["int", "bigint", "decimal", "double", "string"]


def spark_type(name: str) -> str:
    """The Spark type of a dialect type name; precision and scale are kept, lengths dropped."""
    m = re.fullmatch(r"\s*([a-z]+(?:\s+precision)?)\s*(\([\d\s,]+\))?\s*", name.lower())
    base = NAMES.get(re.sub(r"\s+", " ", m[1])) if m else None
    if base is None:
        raise ValueError(f"unknown type {name!r}")
    return f"decimal{m[2].replace(' ', '')}" if base.startswith("decimal") and m[2] else base  # type: ignore[index]


def promote(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type of an expression over both: numbers widen, anything else meets as text; the null type yields."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    rank = lambda t: _ORDER.index(t.typeName() if t.typeName() in _ORDER else {"integer": "int", "long": "bigint"}.get(t.typeName(), "string"))
    return a if rank(a) >= rank(b) else b


def cast(c: Column, name: str, strict: bool = True) -> Column:
    """Cast to a dialect type; a value that doesn't fit is an error, or null if not ``strict``."""
    return c.cast(spark_type(name)) if strict else c.try_cast(spark_type(name))
