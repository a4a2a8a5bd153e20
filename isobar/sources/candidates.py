"""CSV scans of candidate rows, rankings and evaluation tables.

Columns are read as text and coerced by name, so an unparsable number becomes NULL instead of
failing or silently dropping its row; nothing is inferred from the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.functions.scalars import flag, number
from isobar.operators.features import add_reciprocal_ranks
from isobar.plans.contract import FEATURE_NAMES

TEXT = ("query_id", "candidate_id", "event_id", "group_id", "event_type", "tc_id", "tracklet_id", "fold")


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=False)


def read_candidate_rows(
    spark: SparkSession, path: str, *, numeric: Sequence[str] = (), keep_text: Sequence[str] = ()
) -> DataFrame:
    """Candidate rows with text ids, a strict boolean label, numeric features and ``*_inv`` ranks."""
    raw = _raw(spark, path)
    wanted = {*FEATURE_NAMES, "rank", "grade", *numeric} - {*TEXT, *keep_text}
    casts = {c: number(c) for c in raw.columns if c in wanted}
    casts.update({c: F.col(c) for c in raw.columns if c in TEXT})
    if "is_gt_top20" in raw.columns:
        casts["is_gt_top20"] = flag("is_gt_top20")
    return add_reciprocal_ranks(raw.withColumns(casts))


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """Retained ranking used as anchors."""
    return _raw(spark, path).withColumn("rank", number("rank").cast("int"))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Tracklet mapping with the file order, since the first entry of a tracklet counts.

    Files are in order of their paths and blocks in order of their place; inside a block, ids ascend with the rows.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return _raw(spark, path).select("tracklet_id", "tc_id", place.alias("row_order"))


def read_best_track(spark: SparkSession, path: str) -> DataFrame:
    return _raw(spark, path).select(
        "tc_id", "time_utc", *[number(c).alias(c) for c in ("lat", "lon", "pres", "wnd")]
    )


def read_descriptor(spark: SparkSession, path: str) -> DataFrame:
    return _raw(spark, path).select("event_id", "tc_id", "window_start", "window_end")


def rows_frame(spark: SparkSession, rows: Sequence[dict], schema) -> DataFrame:
    """Small in-memory rows under an explicit schema."""
    return spark.createDataFrame(list(rows), schema)
