"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Every source has a weight and shares the total number of words by it. A target stops at ``max_epochs`` times the
source's size; the excess goes to the other sources by weight until no target is above. Whole epochs come first.
What then is left of a target is filled in the order of exponential keys, ``-ln(u) / quality``, whose prefix sums
reach the rest; the document at the edge is taken in part, so a target is met to the word.

Keys come from a hash of the id, so reruns agree. No source is sorted as a whole: sums per key interval show in which
of the ``INTERVALS`` the budget ends, and only that interval is put in order.

Nulls: a null source is a source of its own; a null, negative or NaN size counts 0, a null or non-positive quality the
least quality. Equal keys go by id, and rows equal in both are interchangeable. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isobar.operators.ordering import ordinal
from isobar.session import materialize

INTERVALS = 4096
LEAST_QUALITY = 1e-3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_quality(text: Column, words: Column) -> Column:
    """Share of words among words and runs of marks that prose seldom has."""
    marks = F.coalesce(F.regexp_count(text, F.lit(r"[!?#*|<>{}=]+")), F.lit(0))
    return (words + 1) / (words + 1 + marks)


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """Weights dealt to the sources in code point order, null last. ``sources`` has one row per source."""
    placed = ordinal(sources.select("source"), [], [F.col("source").isNull(), F.col("source")], name="place")
    place = F.col("place") - 1
    return placed.select("source", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")).alias("weight"))


def fill_targets(sources: DataFrame, max_epochs: float, share: float = 1.0) -> DataFrame:
    """Targets of (source, source_size, weight): the level at which capped and open sources use up the total.

    Each round fetches two sums and a count; a round that caps no further source is the last, and a capped source
    stays capped, because the level only rises.
    """
    cap = F.col("source_size") * float(max_epochs)
    total = float(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double")).first()[0]) * share
    level, capped = 0.0, -1
    while True:
        full = F.lit(capped >= 0) & (F.col("weight") * level >= cap)
        sums = sources.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight").cast("double"))), F.lit(0.0)),
            F.count(F.when(full, 1)),
        ).first()
        if sums[2] == capped or sums[1] <= 0:
            break
        capped, level = sums[2], max(level, (total - sums[0]) / sums[1])
    return sources.withColumn("target", F.least(F.col("weight") * level, cap))


def mix_sources(
    docs: DataFrame,
    source: Column,
    size: Column,
    quality: Column,
    order_id: Column,
    weights=cyclic_weights,
    max_epochs: float = 3.0,
    share: float = 1.0,
    seed: int = 11,
) -> DataFrame:
    """Rows (row, source, size, source_size, target, taken); ``row`` is the struct of all input columns.

    ``weights`` maps the table of sources (source, source_size) to (source, weight).
    """
    spark = docs.sparkSession
    count = F.when(F.isnan(size.cast("double")) | (size < 0), 0).otherwise(F.coalesce(size.cast("long"), F.lit(0)))
    good = F.when(quality > 0, quality.cast("double")).otherwise(LEAST_QUALITY)
    uniform = (F.shiftrightunsigned(F.xxhash64(order_id, F.lit(seed)), 11) + 0.5) / float(1 << 53)
    rows = docs.select(
        F.struct("*").alias("row"), source.alias("source"), count.alias("size"), good.alias("quality"),
        order_id.alias("order_id"), uniform.alias("uniform"),
    )
    totals = materialize(
        rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("quality").alias("mean_quality")), "mix-sources"
    )
    weighted = materialize(
        totals.alias("t").join(weights(totals.select("source", "source_size")).alias("w"), F.expr("t.source <=> w.source"))
        .select("t.*", "w.weight"), "mix-weights",
    )
    size_of = F.col("source_size")
    plan = fill_targets(weighted, max_epochs, share).withColumn(
        "epochs", F.when(size_of > 0, F.floor(F.col("target") / size_of)).otherwise(0)
    ).withColumn("rest", F.round("target").cast("long") - F.col("epochs") * size_of)
    plan = materialize(plan, "mix-plan")

    # The mean quality only spreads the keys evenly over the intervals; it is the same for all rows of a source.
    key = -F.log("uniform") / F.col("quality")
    interval = F.least(F.floor((1 - F.exp(-key * F.col("mean_quality"))) * INTERVALS), F.lit(INTERVALS - 1))

    def keyed(plan: DataFrame) -> DataFrame:
        return (
            rows.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source"))
            .select("d.*", *[F.col(f"p.{c}") for c in plan.columns if c != "source"])
            .withColumn("key", key).withColumn("interval", interval)
        )

    sums = keyed(plan).groupBy("source", "interval").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("interval"))
    edges = (
        sums.withColumn("before", running - F.col("words")).withColumn("after", running)
        .join(plan.select(F.col("source").alias("s"), "rest"), F.expr("source <=> s"))
        .where("before < rest and rest <= after")
        .select("source", F.col("interval").alias("edge"), F.col("before").alias("edge_before"))
    )
    plan = materialize(
        plan.alias("p").join(edges.alias("e"), F.expr("p.source <=> e.source"), "left")
        .select("p.*", F.coalesce("edge", F.lit(-1)).alias("edge"), F.coalesce("edge_before", F.lit(0)).alias("edge_before")),
        "mix-edges",
    )
    placed = keyed(plan)
    inside = F.sum("size").over(
        Window.partitionBy("source").orderBy("key", "order_id").rowsBetween(Window.unboundedPreceding, -1)
    )
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("edge_before") - F.coalesce(inside, F.lit(0))))
    out = ["row", "source", "size", "source_size", "target"]
    whole = F.col("epochs") * F.col("size")
    clear = placed.where("interval != edge").select(
        *out, (whole + F.when(F.col("interval") < F.col("edge"), F.col("size")).otherwise(0)).alias("taken")
    )
    edge = placed.where("interval = edge").select(*out, (whole + part).alias("taken"))
    return clear.unionByName(edge)
