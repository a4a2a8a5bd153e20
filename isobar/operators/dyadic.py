"""Intervals under the cells of a binary hierarchy, for joins with points.

Time is cut into units, and units into cells of 1, 2, 4, ... of them, aligned to their size. An interval is stored under the
largest cells that it covers, at most two of a level, so its rows grow with the logarithm of its length. A point lies in one
cell of each level and probes those levels only that some interval uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL, CELL = "_level", "_cell"


def cover(first: Column, last: Column) -> Column:
    """Array of (level, cell): the aligned cells that together are the units ``first`` to ``last``, none inside another."""
    top = F.floor(F.log2((last - first + 1).cast("double"))).cast("int")

    def at(level: Column) -> Column:
        one = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low = F.call_function("shiftright", first + one - 1, level)  # cells of the level inside: low to high
        high = F.call_function("shiftright", last + 1, level) - 1
        # A cell counts where its parent reaches outside: an odd lowest and an even highest one.
        inside = low <= high
        return F.array(
            F.when(inside & (low.bitwiseAND(F.lit(1)) == 1), F.struct(level.alias("level"), low.alias("cell"))),
            F.when(inside & (high.bitwiseAND(F.lit(1)) == 0), F.struct(level.alias("level"), high.alias("cell"))),
        )

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), top), at)), lambda c: c.isNotNull())


def store(intervals: DataFrame, first: Column, last: Column) -> DataFrame:
    """Intervals with the columns of their cells, one row per cell; ``last`` must not lie before ``first``."""
    cells = intervals.select("*", F.explode(cover(first, last)).alias("_c"))
    return cells.withColumn(LEVEL, F.col("_c.level")).withColumn(CELL, F.col("_c.cell")).drop("_c")


def levels_of(stored: DataFrame) -> list[int]:
    """The levels in use, at most 63."""
    return sorted(r[0] for r in stored.select(LEVEL).distinct().collect())


def probe(points: DataFrame, unit: Column, levels: list[int]) -> DataFrame:
    """Points with the cell they lie in on each of ``levels``."""
    cells = [F.struct(F.lit(n).alias("level"), F.call_function("shiftright", unit, F.lit(n)).alias("cell")) for n in levels]
    cells = F.array(*cells) if cells else F.array().cast("array<struct<level:int,cell:bigint>>")
    return points.select("*", F.explode(cells).alias("_c")).withColumn(LEVEL, F.col("_c.level")).withColumn(CELL, F.col("_c.cell")).drop("_c")
