"""Different texts of a table, without a shuffle of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checked_broadcast


def different(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """Each different text once, in the column ``text``: that of the smallest key. Null texts are left out.

    Hashes of 64 bits and lengths are grouped, and the few that stand more than once are broadcast if they are few enough.
    Texts of one hash and length are taken for equal. ``key`` tells rows apart.
    """
    at = rows.select(F.struct(*key).alias("__k"), F.col(text), F.xxhash64(text).alias("__h"), F.length(text).alias("__l")).where(F.col(text).isNotNull())
    again = at.groupBy("__h", "__l").agg(F.min("__k").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return at.join(checked_broadcast(again)[0], ["__h", "__l"], "left").where("__first IS NULL OR __first = __k").select(text)
