"""Ground truth independent of retrieval: nearest events in a standardised track-summary space."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.operators.knn import VectorIndex

# The nine summary dimensions.
SUMMARY = (
    "lat_mean",
    "lat_span",
    "lon_mean",
    "lon_span",
    "point_count",
    "pres_min",
    "pres_mean",
    "wnd_max",
    "wnd_mean",
)
DEPTH = 20


def track_summaries(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.avg("lat").alias("lat_mean"),
        (F.max("lat") - F.min("lat")).alias("lat_span"),
        F.avg("lon").alias("lon_mean"),
        (F.max("lon") - F.min("lon")).alias("lon_span"),
        F.count(F.lit(1)).cast("double").alias("point_count"),
        F.min("pres").alias("pres_min"),
        F.avg("pres").alias("pres_mean"),
        F.max("wnd").alias("wnd_max"),
        F.avg("wnd").alias("wnd_mean"),
    )


def standardised(summaries: DataFrame, columns: Sequence[str] = SUMMARY) -> DataFrame:
    """Add ``vector``: every summary column scaled by its mean and population deviation."""
    stats = summaries.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()  # two numbers per column
    scaled = [
        (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] if stats[f"s_{c}"] > 1e-9 else 1.0)
        for c in columns
    ]
    return summaries.withColumn("vector", F.array(*scaled))


def ground_truth(
    summaries: DataFrame,
    *,
    event: str = "event_id",
    cyclone: str = "tc_id",
    k: int = DEPTH,
    columns: Sequence[str] = SUMMARY,
) -> DataFrame:
    """The ``k`` eligible events nearest to each event, never from the same cyclone."""
    table = standardised(summaries, columns)
    index = VectorIndex.fit(table, id_col=event, group_col=cyclone, check_ids=False)
    return index.search(table, k, id_col=event, group_col=cyclone, provenance="ground_truth")
