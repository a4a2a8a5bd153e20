"""Exact order statistics of many columns at once by refining histograms.

A round counts rows per bin; the bin that holds a wanted rank becomes the interval of the next round, as narrow as its own
least and greatest value, and only rows inside such bins go on. Bins are even on the values in one round and on their
logarithms, with the sign, in the next, so neither far outliers nor wide ranges of magnitude need many rounds. A bin of one
value is done: equal values, however many, are one count, and nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.session import materialize

BINS = 1024
_LARGEST = 1.7976931348623157e308


def _bin(value: Column, lo: Column, hi: Column, bins: int, bent: bool) -> Column:
    """Number of the bin between ``lo`` and ``hi``; the ends always lie in different bins."""

    def scaled(x: Column) -> Column:
        x = F.greatest(F.least(x, F.lit(_LARGEST)), F.lit(-_LARGEST))
        if not bent:
            return x / 4
        return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1075))  # 2^-1074 is the least number

    width = scaled(hi) - scaled(lo)
    inside = F.least(F.floor((scaled(value) - scaled(lo)) / F.when(width > 0, width) * bins), F.lit(bins - 1))
    return F.when(value <= lo, 0).when(value >= hi, bins - 1).otherwise(F.coalesce(inside, F.lit(bins - 1))).cast("int")


def order_statistics(values: DataFrame, wanted: DataFrame, bins: int = BINS) -> DataFrame:
    """(feature, rank, value) of the wanted (feature, rank), ranks from 1, among rows (feature, value).

    Null and NaN values count as no rows; a rank beyond the rows of its feature has no result. ``values`` is read twice,
    later rounds read only what is still open.
    """
    rows = values.select(F.col("feature").cast("string").alias("g"), F.col("value").cast("double").alias("value")).where("value IS NOT NULL AND NOT isnan(value)")
    spans = materialize(rows.groupBy("g").agg(F.min("value").alias("lo"), F.max("value").alias("hi")), "quantile-spans")
    open_ranks = wanted.select(F.col("feature").cast("string").alias("g"), F.col("rank").alias("place"), "feature", "rank").distinct()
    done, bent = None, False
    while True:
        placed = rows.join(spans, "g").withColumn("bin", _bin(F.col("value"), F.col("lo"), F.col("hi"), bins, bent))
        counts = placed.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        after = F.sum("n").over(Window.partitionBy("g").orderBy("bin"))
        counts = counts.withColumn("after", after).withColumn("before", F.col("after") - F.col("n"))
        hit = counts.join(open_ranks, "g").where("place > before AND place <= after")
        hit = materialize(hit.select("g", "bin", "lo", "hi", (F.col("place") - F.col("before")).alias("place"), "feature", "rank"), "quantile-bins")
        settled = hit.where("lo = hi").select("feature", "rank", F.col("lo").alias("value"))
        done = settled if done is None else done.unionByName(settled)
        hit = hit.where("lo < hi")
        if hit.isEmpty():
            return done
        inner = F.concat_ws("/", "g", "bin")
        rows = materialize(placed.join(hit.select("g", "bin").distinct(), ["g", "bin"]).select(inner.alias("g"), "value"), "quantile-rows")
        open_ranks = hit.select(inner.alias("g"), "place", "feature", "rank")
        spans = materialize(hit.select(inner.alias("g"), "lo", "hi").distinct(), "quantile-spans")
        bent = not bent


def long_values(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(feature, value) of wide rows; nulls are left out."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), c.cast("double").alias("value")) for n, c in columns.items()])
    return df.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL")


def medians(values: DataFrame) -> DataFrame:
    """(feature, median): the mean of the two middle values."""
    sizes = values.where("NOT isnan(value)").groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    middle = F.explode(F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2))))
    wanted = materialize(sizes.select("feature", middle.alias("rank")), "median-ranks")
    return order_statistics(values, wanted).groupBy("feature").agg(F.avg("value").alias("median"))


def quantile_edges(values: DataFrame, bins: int) -> DataFrame:
    """(feature, edges): the distinct values that end all of ``bins`` equally full bins but the last, ascending."""
    sizes = values.where("NOT isnan(value)").groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    ends = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.ceil(i * F.col("n") / bins))))
    wanted = materialize(sizes.select("feature", ends.alias("rank")), "quantile-ranks")
    return order_statistics(values, wanted).groupBy("feature").agg(F.array_sort(F.collect_set("value")).alias("edges"))
