"""Derived ranking features, standardisation and the model matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.functions.scalars import number, reciprocal_rank, safe_reciprocal
from isobar.operators.quantiles import long_values, medians

DEVIATION_FLOOR = 1e-9


def _standardised(value: Column, mean: Column, deviation: Column) -> Column:
    scale = F.when(deviation > DEVIATION_FLOOR, deviation).otherwise(F.lit(1.0))
    return ((value - mean) / scale).cast("float")


def query_z(value: Column | str, keys: Sequence[str] = ("query_id",)) -> Column:
    """Per-query z-score (population deviation) as float32; for pools whose size is bounded."""
    over = Window.partitionBy(*keys)
    value = F.col(value) if isinstance(value, str) else value
    return _standardised(value, F.avg(value).over(over), F.stddev_pop(value).over(over))


def column_z(columns: Sequence[str], name: str, keys: Sequence[str] = ("query_id",)) -> Column:
    """z-score of a column with missing values as zero; an absent column scores zero."""
    if name not in columns:
        return F.lit(0.0).cast("float")
    return query_z(F.coalesce(number(name), F.lit(0.0)), keys)


def group_z(df: DataFrame, values: Mapping[str, Column | str], keys: Sequence[str]) -> DataFrame:
    """z-scores in groups of any size: statistics by partial aggregation, then joined back.

    The statistics hold one row per group, so adaptive execution broadcasts them when they are
    measured to be small and otherwise splits a skewed group across tasks.
    """
    keys = list(keys)
    values = {n: F.col(v) if isinstance(v, str) else v for n, v in values.items()}
    filled = {f"_v_{n}": F.coalesce(number(v), F.lit(0.0)) for n, v in values.items()}
    stats = (
        df.select(*keys, *[e.alias(n) for n, e in filled.items()])
        .groupBy(*keys)
        .agg(
            *[F.avg(f"_v_{n}").alias(f"_m_{n}") for n in values],
            *[F.stddev_pop(f"_v_{n}").alias(f"_s_{n}") for n in values],
        )
    )
    scored = df.join(stats, keys).withColumns(
        {n: _standardised(filled[f"_v_{n}"], F.col(f"_m_{n}"), F.col(f"_s_{n}")) for n in values}
    )
    return scored.drop(*[f"{p}{n}" for n in values for p in ("_m_", "_s_")])


def add_reciprocal_ranks(df: DataFrame) -> DataFrame:
    """``*_inv`` columns of a candidate table for whichever rank columns it has."""
    names = ("rank", "source_event_rank", "source_sequence_rank", "source_min_rank")
    return df.withColumns({f"{n}_inv": reciprocal_rank(n) for n in names if n in df.columns})


def add_derived_features(df: DataFrame) -> DataFrame:
    """``*_inv_safe`` columns and the sum and difference of the two upstream scores."""
    names = ("source_event_rank", "source_sequence_rank", "source_min_rank", "source_rank_gap")
    added = {f"{n}_inv_safe": safe_reciprocal(n) for n in names if n in df.columns}
    if {"score_final", "score_calibrated"} <= set(df.columns):
        final = F.coalesce(number("score_final"), F.lit(0.0))
        calibrated = F.coalesce(number("score_calibrated"), F.lit(0.0))
        added["score_final_minus_calibrated"] = final - calibrated
        added["score_final_plus_calibrated"] = final + calibrated
    return df.withColumns(added)


def with_default_scores(df: DataFrame) -> DataFrame:
    missing = [c for c in ("score_final", "score_calibrated") if c not in df.columns]
    return df.withColumns({c: F.lit(0.0) for c in missing}) if missing else df


def labels(df: DataFrame, mode: str = "binary", *, positive: str = "is_gt_top20", grade: str = "grade") -> Column:
    """0/1 relevance, or with ``graded`` the grade of positives clipped to 1..10."""
    relevant = F.coalesce(F.col(positive).cast("boolean"), F.lit(False))
    if mode == "graded" and grade in df.columns:
        clipped = F.least(F.greatest(F.coalesce(number(grade), F.lit(0.0)), F.lit(0.0)), F.lit(10.0))
        return F.when(relevant, F.greatest(clipped.cast("int"), F.lit(1))).otherwise(F.lit(0))
    return relevant.cast("int")


def train_medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median per column over the training rows, 0 where a column is empty.

    Histograms are refined until a bin has one value, so no column is sorted and a value that fills one is one count.
    """
    found = {r["feature"]: r["median"] for r in medians(long_values(train, {c: number(c) for c in columns})).collect()}
    return {c: float(found.get(c, 0.0)) for c in columns}


def filled_columns(
    columns: Sequence[str], fill: Mapping[str, float], *, scrub_infinite: bool = True
) -> dict[str, Column]:
    """Float32 model inputs: missing values take the fill, and offline infinities become zero."""
    out = {}
    for c in columns:
        value = F.coalesce(number(c), F.lit(float(fill.get(c, 0.0)))).cast("float")
        if scrub_infinite:
            value = F.when(F.abs(value) == F.lit(float("inf")), F.lit(0.0).cast("float")).otherwise(value)
        out[c] = value
    return out


def model_matrix(
    df: DataFrame,
    columns: Sequence[str],
    fill: Mapping[str, float],
    *,
    scrub_infinite: bool = True,
    name: str = "features",
) -> DataFrame:
    filled = filled_columns(columns, fill, scrub_infinite=scrub_infinite)
    return df.withColumn(name, F.array(*[filled[c] for c in columns]))


def group_sizes(df: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"))


def sort_for_groups(df: DataFrame) -> DataFrame:
    """Rows ordered by query (as text) and best source rank, as far as those columns exist."""
    present = [c for c in ("query_id", "source_min_rank") if c in df.columns]
    keys = [F.col(c).cast("string") if c == "query_id" else F.col(c) for c in present]
    ties = [F.col("candidate_id")] if "candidate_id" in df.columns else []
    return df.orderBy(*keys, *ties) if keys else df
