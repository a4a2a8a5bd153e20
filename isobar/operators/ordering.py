"""Row positions in unbounded groups without sending a whole group to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.session import materialize


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    *,
    name: str = "ordinal",
    total: str | None = None,
) -> DataFrame:
    """Number rows 1..n per key; rows equal in keys and order are numbered in any order.

    Rows are dealt by ranges of (key, order), so the ranges are even whatever a key owns or how its values lie. The sorted
    rows are written once, which fixes their places; a place is the one inside its range plus the rows of the key in the
    ranges before, and only those counts, one row per key and range, are put in order per key.
    """
    keys = list(keys)
    marked = df.select("*", *[F.col(c).alias(f"_k{i}") if isinstance(c, str) else c.alias(f"_k{i}") for i, c in enumerate(order)])
    by = [*keys, *[f"_k{i}" for i in range(len(order))]]
    ranged = marked.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id())
    placed = materialize(ranged.drop(*by[len(keys):]), "ordinal").withColumn("_range", F.shiftright("_place", 33))
    counts = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    over = Window.partitionBy(*keys)
    earlier = over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)],
        F.col("_range").alias("_r"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        *([F.sum("_rows").over(over).alias(total)] if total else []),
    )
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_o{i}"))
    numbered = placed.join(offsets, same).withColumn(name, F.col("_place") + F.col("_shift"))
    return numbered.drop("_place", "_range", "_r", "_shift", *[f"_o{i}" for i in range(len(keys))])


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, *, name: str = "rank"
) -> DataFrame:
    """Best ``k`` rows per key; the limit is applied before the shuffle as well as after it."""
    if k < 0:
        raise ValueError("k must not be negative")
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, position).filter(F.col(name) <= k)
