"""Filling containers of fixed capacity, best fit decreasing over all items at once.

Sizes are whole numbers from 1 to the capacity, so items of one size are alike and so are containers with
the same room. Best fit decreasing is therefore run once over the number of items of each size (at most
``capacity`` numbers, however large the corpus), with a segment tree over the possible rooms that finds
the tightest open one in logarithmic time. What comes out are runs: "items r .. r+n-1 of size s go to the
containers from b on, k in each". The runs, whose number depends on the capacity alone, are joined to the
items, which are numbered within their size without any global sort. The result is the one that the
sequential algorithm gives for all items together.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class RoomTree:
    """A segment tree over rooms 0..capacity: how many open containers have each room."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << (capacity + 1).bit_length()
        self.total = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.total[i] += n
            i >>= 1

    def tightest(self, size: int) -> int:
        """The smallest room of at least ``size`` that a container has, or -1."""
        i = size + self.leaves
        if self.total[i]:
            return size
        while i > 1:  # up, until there is something to the right
            if not i & 1 and self.total[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return -1
        while i < self.leaves:  # down, leftmost first
            i = 2 * i if self.total[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_runs(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (size, first rank, number of items, first container, items in each) and the number of containers.

    ``counts`` has the number of items of each size from 1 to ``capacity``.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first container, number), all alike
    tree, opened = RoomTree(capacity), 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            open_bins[room].append((first, n))
            tree.add(room, n)

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0

        def fill(first: int, n: int, room: int) -> None:
            """Put what is left into n containers that have this room, each as full as it gets."""
            nonlocal left, rank
            each = room // size
            whole = min(n, left // each)
            if whole:
                runs.append((size, rank, whole * each, first, each))
                rank, left = rank + whole * each, left - whole * each
                put(room - each * size, first, whole)
            if whole < n:
                if left:
                    runs.append((size, rank, left, first + whole, left))
                    put(room - left * size, first + whole, 1)
                    rank, left, whole = rank + left, 0, whole + 1
                put(room, first + whole, n - whole)

        while left:
            room = tree.tightest(size)
            if room < 0:
                need = -(-left // (capacity // size))
                fill(opened, need, capacity)
                opened += need
            else:
                first, n = open_bins[room].pop()
                tree.add(room, -n)
                fill(first, n, room)
    return runs, opened


#: Items of one size are numbered in groups of about so many, each within one task.
RANKED_TOGETHER = 250_000


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Assign items to containers: ``key``, ``piece``, ``start``, ``n_tokens``, ``container``.

    An item larger than the capacity is split into full pieces and one rest, numbered from 0, ``start``
    being the offset of each within its item; no other item is split. Items with null, zero or negative
    size need no room: they stand with 0 tokens in container 0. Items with the same key and size are taken
    as repetitions of one row and count once. An empty table gives no rows. Ties between items of a size
    are broken by a hash of the key and the key itself, so the result doesn't depend on partitioning.

    Only the number of pieces by size is collected, at most ``capacity`` rows. The table of runs has at
    most a few for each pair of size and room, and is joined by size; hot sizes are numbered in several
    tasks.
    """
    cap = F.lit(capacity).cast("bigint")
    n = F.greatest(F.coalesce(F.col("__n"), F.lit(0)).cast("bigint"), F.lit(0).cast("bigint"))
    # sizes are kept: they are read for the counts and again for the assignment, and may be dear to make
    rows = items.select(F.col(key).alias(key), F.col(size).alias("__n")).dropDuplicates([key, "__n"]).withColumn("__n", n).checkpoint()
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("__n") - 1, F.lit(0).cast("bigint")), cap)
    pieces = rows.select(key, "__n", F.posexplode(starts).alias("piece", "start")).select(
        key, "piece", "start", F.least(F.col("__n") - F.col("start"), cap).alias("n_tokens"), F.xxhash64(key, "piece").alias("__h")
    )
    counts = {r.n_tokens: r["n"] for r in pieces.where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = best_fit_runs(counts, capacity)
    spark = items.sparkSession
    table = spark.createDataFrame(runs or [(0, 0, 0, 0, 1)], "size bigint, first_rank bigint, n_items bigint, first_container bigint, each bigint")
    groups = max(1, -(-max(counts.values(), default=0) // RANKED_TOGETHER))

    # what needs no room is not ranked: all of it would meet in one task
    nothing = pieces.where("n_tokens = 0").select(key, "piece", "start", "n_tokens", F.lit(0).cast("bigint").alias("container"))
    pieces = pieces.where("n_tokens > 0").withColumn("__g", F.pmod(F.col("__h"), F.lit(groups)).cast("int"))
    if groups == 1:
        ranked = pieces.withColumn("__r", F.row_number().over(Window.partitionBy("n_tokens").orderBy("__h", key, "piece")) - 1)
    else:
        before = Window.partitionBy("n_tokens").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
        offsets = (
            pieces.groupBy("n_tokens", "__g").agg(F.count(F.lit(1)).alias("n")).withColumn("__o", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
        )
        within = F.row_number().over(Window.partitionBy("n_tokens", "__g").orderBy("__h", key, "piece")) - 1
        ranked = pieces.withColumn("__r", within).join(offsets, ["n_tokens", "__g"]).withColumn("__r", F.col("__r") + F.col("__o"))
    placed = ranked.join(
        F.broadcast(table), (F.col("n_tokens") == F.col("size")) & (F.col("__r") >= F.col("first_rank")) & (F.col("__r") < F.col("first_rank") + F.col("n_items")), "left"
    )
    at = F.col("first_container") + F.floor((F.col("__r") - F.col("first_rank")) / F.col("each"))
    return placed.select(key, "piece", "start", "n_tokens", at.cast("bigint").alias("container")).unionByName(nothing)
