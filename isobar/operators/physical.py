"""Physical consistency of retrieved events: tracks, resampling, landfall and error metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.functions.scalars import MICROS_PER_HOUR, haversine_km, micros, number, parse_time
from isobar.operators.ordering import ordinal
from isobar.session import materialize
from isobar.operators.pooling import interval_join

# Coast anchor points (latitude, longitude).
COAST_ANCHORS = (
    (18.2, 109.5),
    (22.3, 114.2),
    (24.0, 118.3),
    (25.0, 121.5),
    (28.0, 121.0),
    (31.2, 121.5),
    (35.0, 139.7),
)
VARIABLES = ("lat", "lon", "pres", "wnd")
SAMPLES = 16
NOT_MEASURED = "NOT_MEASURED_CURRENT"
# Report label per error column.
ERROR_LABELS = {
    "track_rmse_km": "Track RMSE/km",
    "pressure_mae": "PRES MAE/hPa",
    "wind_mae": "WND MAE/m/s",
    "landfall_dist_km": "Landfall dist/km",
    "landfall_time_err_h": "Landfall time err/h",
}


def event_track_points(descriptor: DataFrame, mapping: DataFrame, best_track: DataFrame) -> DataFrame:
    """Track points of each event: inside its closed window, or the whole track if none are.

    Events reach their track through the tracklet mapping (first entry per tracklet). In-window
    points come from a time-sliced interval join; only events without any fall back to the plain
    join on the track id.
    """
    order = F.col("row_order") if "row_order" in mapping.columns else F.col("tc_id")
    tracklets = (
        mapping.groupBy(F.col("tracklet_id").cast("string").alias("tracklet_id"))
        .agg(F.min_by(F.col("tc_id").cast("string"), order).alias("tc_id"))
    )
    windows = descriptor.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("tc_id").cast("string").alias("tracklet_id"),
        parse_time("window_start").alias("window_start"),
        parse_time("window_end").alias("window_end"),
    ).join(tracklets, "tracklet_id")
    points = best_track.select(
        F.col("tc_id").cast("string").alias("tc_id"),
        parse_time("time_utc").alias("time_utc"),
        *[number(v).alias(v) for v in VARIABLES],
    ).na.drop(subset=["tc_id", "time_utc"])
    columns = ["event_id", "time_utc", *VARIABLES]
    inside = interval_join(
        points, windows, time="time_utc", start="window_start", end="window_end", keys=["tc_id"],
        bucket_hours=24, closed=True,
    ).select(*columns)
    bare = windows.join(inside.select("event_id").distinct(), "event_id", "left_anti")
    return inside.unionByName(bare.join(points, "tc_id").select(*columns))


def resample_tracks(points: DataFrame, *, samples: int = SAMPLES, keys: Sequence[str] = ("event_id",)) -> DataFrame:
    """Linear resampling of every variable to ``samples`` evenly spaced index positions.

    Position ``j`` of a series with ``m`` values lies at index ``j * (m - 1) / (samples - 1)``, and each
    value feeds only the positions less than one index away, with the hat weight. So the series is
    never collected: values are numbered, most feed nothing, and the rest are summed.
    """
    keys = list(keys)
    long = points.select(
        *keys,
        "time_utc",
        F.explode(
            F.array(*[F.struct(F.lit(v).alias("variable"), number(v).alias("value")) for v in VARIABLES])
        ).alias("p"),
    ).select(*keys, "time_utc", "p.variable", "p.value").filter("value IS NOT NULL")
    placed = ordinal(long, [*keys, "variable"], ["time_utc", "value"], name="place", total="m")
    index = (F.col("place") - 1).cast("double")
    step = (F.col("m") - 1).cast("double") / F.lit(float(samples - 1))
    low = F.when(F.col("m") == 1, F.lit(0)).otherwise(F.greatest(F.ceil((index - 1.0) / step), F.lit(0)))
    high = F.when(F.col("m") == 1, F.lit(samples - 1)).otherwise(
        F.least(F.floor((index + 1.0) / step), F.lit(samples - 1))
    )
    weight = F.when(F.col("m") == 1, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.col("sample") * step - index))
    )
    fed = (
        placed.withColumn("_low", low.cast("int"))
        .withColumn("_high", high.cast("int"))
        .filter("_low <= _high")
        .withColumn("sample", F.explode(F.sequence("_low", "_high")))
        .withColumn("part", weight * F.col("value"))
    )
    return fed.groupBy(*keys, "sample").agg(
        *[F.sum(F.when(F.col("variable") == v, F.col("part"))).alias(v) for v in VARIABLES]
    )


def coast_distance(lat: Column | str, lon: Column | str, anchors=COAST_ANCHORS) -> Column:
    distances = [haversine_km(lat, lon, F.lit(a), F.lit(b)) for a, b in anchors]
    return F.least(*distances) if len(distances) > 1 else distances[0]


def landfall_points(points: DataFrame, *, anchors=COAST_ANCHORS, keys: Sequence[str] = ("event_id",)) -> DataFrame:
    """Track point closest to any anchor (earliest on ties) and its hours since the first point."""
    measured = points.withColumn("_d", coast_distance("lat", "lon", anchors))
    best = F.min_by(
        F.struct("lat", "lon", "time_utc", "_d"),
        F.when(F.col("_d").isNotNull(), F.struct("_d", "time_utc", "lat", "lon")),
    )
    folded = measured.groupBy(*keys).agg(best.alias("b"), F.min("time_utc").alias("first"))
    return folded.select(
        *keys,
        F.col("b.lat").alias("landfall_lat"),
        F.col("b.lon").alias("landfall_lon"),
        F.col("b._d").alias("landfall_coast_km"),
        ((micros("b.time_utc") - micros("first")) / F.lit(float(MICROS_PER_HOUR))).alias("landfall_offset_h"),
    )


def top_one(ranked: DataFrame) -> DataFrame:
    return ranked.filter("rank = 1").select(
        F.col("query_id").cast("string").alias("query_id"), F.col("candidate_id").cast("string").alias("candidate_id")
    )


def pair_errors(pairs: DataFrame, points: DataFrame, *, anchors=COAST_ANCHORS) -> DataFrame:
    """Per (query, candidate) errors; NULL where a quantity cannot be measured."""
    asked = pairs.select(F.col("query_id").alias("event_id")).unionByName(pairs.select(F.col("candidate_id").alias("event_id"))).distinct()
    points = materialize(points.join(asked, "event_id", "left_semi"), "pair-tracks")
    series = materialize(resample_tracks(points), "pair-samples")  # read for either side of a pair
    mine = series.select(F.col("event_id").alias("query_id"), "sample", *[F.col(v).alias(f"q_{v}") for v in VARIABLES])
    theirs = series.select(F.col("event_id").alias("candidate_id"), "sample", *[F.col(v).alias(f"c_{v}") for v in VARIABLES])
    gap = haversine_km("q_lat", "q_lon", "c_lat", "c_lon")
    errors = (
        pairs.join(mine, "query_id")
        .join(theirs, ["candidate_id", "sample"])
        .groupBy("query_id", "candidate_id")
        .agg(
            F.sqrt(F.avg(gap * gap)).alias("track_rmse_km"),
            F.avg(F.abs(F.col("q_pres") - F.col("c_pres"))).alias("pressure_mae"),
            F.avg(F.abs(F.col("q_wnd") - F.col("c_wnd"))).alias("wind_mae"),
        )
    )
    coast = landfall_points(points, anchors=anchors)
    names = ("landfall_lat", "landfall_lon", "landfall_offset_h")
    q_coast = coast.select(F.col("event_id").alias("query_id"), *[F.col(n).alias(f"q_{n}") for n in names])
    c_coast = coast.select(F.col("event_id").alias("candidate_id"), *[F.col(n).alias(f"c_{n}") for n in names])
    return (
        errors.join(q_coast, "query_id", "left")
        .join(c_coast, "candidate_id", "left")
        .select(
            "query_id",
            "candidate_id",
            "track_rmse_km",
            "pressure_mae",
            "wind_mae",
            haversine_km("q_landfall_lat", "q_landfall_lon", "c_landfall_lat", "c_landfall_lon").alias("landfall_dist_km"),
            F.abs(F.col("q_landfall_offset_h") - F.col("c_landfall_offset_h")).alias("landfall_time_err_h"),
        )
    )


def mean_errors(per_pair: DataFrame) -> DataFrame:
    return per_pair.agg(*[F.avg(c).alias(c) for c in ERROR_LABELS])


def error_report(means: DataFrame) -> dict[str, float | str]:
    """Labelled means; what could not be measured carries the marker text."""
    row = means.first()
    return {label: NOT_MEASURED if row[c] is None else row[c] for c, label in ERROR_LABELS.items()}
