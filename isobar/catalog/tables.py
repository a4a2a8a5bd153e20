"""Shared inputs of the registered queries, derived from the given tables.

Vectors stand for events with fingerprints: three vector channels make a candidate pool, a fourth
disjoint part of the vector makes an independent ground truth. Event rows stand for tracks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.functions.scalars import plus_hours
from isobar.operators.blend import FROZEN_BLEND, blend_score, score_terms
from isobar.operators.features import add_derived_features
from isobar.operators.fusion import fuse_candidate_channels
from isobar.operators.graph import add_graph_features, label_graph_edges
from isobar.operators.knn import VectorIndex
from isobar.operators.pooling import event_vectors
from isobar.plans.contract import FEATURE_NAMES
from isobar.session import materialize, tune

POOL_LIMIT = 60
CHANNEL_K = {"event": 40, "context": 40, "metadata": 20}
# Vector parts: (first value, number of values).
PARTS = {"event": (1, 32), "context": (1, 64), "metadata": (33, 16), "truth": (33, 32)}
TRUTH_K = 20
EPOCH = "2024-01-01 00:00:00"

_cache: dict[tuple, object] = {}


def folder_state(spark: SparkSession, folder: str) -> tuple:
    """Name, length and time of every file below a folder, by the file system Spark reads it with."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while files.hasNext():
        file = files.next()
        out.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return tuple(sorted(out))


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    """What ``build`` returns, made once per application and state of the data folder: changed files are read anew."""
    key = (spark.sparkContext.applicationId, name, folder_state(spark, sf_dir))
    if key not in _cache:
        _cache[key] = build()
    return _cache[key]


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Intermediate table of several queries, written once."""
    return once(spark, sf_dir, name, lambda: materialize(build(), name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str, part: str = "context") -> DataFrame:
    first, width = PARTS[part]
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("candidate_id"),
        F.slice("embedding", first, width).alias("vector") if part != "context" else F.col("embedding").alias("vector"),
        F.col("label").cast("string").alias("group_id"),
        "vec_id",
    )


def neighbours(spark: SparkSession, sf_dir: str, part: str, k: int) -> DataFrame:
    def build() -> DataFrame:
        rows = vectors(spark, sf_dir, part)
        index = VectorIndex.fit(rows)
        return index.search(rows, k, id_col="candidate_id", provenance=f"{part}_channel")

    return shared(spark, sf_dir, f"neighbours-{part}-{k}", build)


def channels(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    found = {n: neighbours(spark, sf_dir, n, k) for n, k in CHANNEL_K.items()}
    score = F.lit(1.0) / (F.col("distance") + 1.0)
    return {
        "event": found["event"].withColumn("score_final", score),
        "context": found["context"].withColumn("score_calibrated", score),
        "metadata": found["metadata"],
    }


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir, "truth", TRUTH_K)


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retained ranking: the first 20 of the context channel."""
    return neighbours(spark, sf_dir, "context", CHANNEL_K["context"]).filter("rank <= 20").select(
        "query_id", "candidate_id", "rank"
    )


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused candidate rows with split, label and grade."""

    def build() -> DataFrame:
        fused = fuse_candidate_channels(channels(spark, sf_dir), limit=POOL_LIMIT)
        graded = truth(spark, sf_dir).select(
            "query_id", "candidate_id", (F.lit(10) - F.floor((F.col("rank") - 1) / 2)).cast("int").alias("grade")
        )
        last = table(spark, sf_dir, "embeddings").agg(F.max("vec_id").alias("m")).first()["m"]
        share = F.col("query_id").cast("long") / F.lit(float(last + 1))
        split = F.when(share < 0.8, "train").when(share < 0.9, "validation").otherwise("test")
        return (
            fused.join(graded, ["query_id", "candidate_id"], "left")
            .withColumn("is_gt_top20", F.col("grade").isNotNull())
            .withColumn("split", split)
        )

    return shared(spark, sf_dir, "pool", build)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(
        spark, sf_dir, "edges", lambda: label_graph_edges(pool(spark, sf_dir).filter("split = 'train'"))
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(
        spark,
        sf_dir,
        "features",
        lambda: add_graph_features(add_derived_features(pool(spark, sf_dir)), edges(spark, sf_dir)),
    )


class ContextPriorModel:
    """Stand-in for a frozen scorer: the context rank prior itself."""

    audit_sha256 = "stand-in-context-prior"
    audit_num_feature = len(FEATURE_NAMES)
    audit_context_split_count = 1
    audit_context_gain = 1.0

    @staticmethod
    def score_column():
        return F.col("score_context_rank_prior")


class MixedPriorModel(ContextPriorModel):
    """Stand-in that weighs the event prior against the mean graph score."""

    audit_sha256 = "stand-in-mixed-prior"

    @staticmethod
    def score_column():
        return F.col("score_event_rank_prior") * 0.75 + F.col("graph_mean").cast("double") * 0.25


MODELS = {"context_prior": ContextPriorModel, "mixed_prior": MixedPriorModel}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with the frozen blend of the context-prior stand-in as ``score``."""
    rows = features(spark, sf_dir).withColumn("model_score", ContextPriorModel.score_column())
    return score_terms(rows).withColumn("score", blend_score(FROZEN_BLEND))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as windows of 6 to 47 hours."""
    rows = table(spark, sf_dir, "events")
    start = F.col("ts").cast("timestamp")
    return rows.withColumns(
        {"start_ts": start, "end_ts": plus_hours(start, (6 + F.pmod("event_id", F.lit(42))).cast("double"))}
    )


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as an hourly archive of 24-hour windows."""
    start = plus_hours(F.lit(EPOCH).cast("timestamp"), F.col("vec_id").cast("double"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        start.alias("start_ts"),
        plus_hours(start, F.lit(24.0)).alias("end_ts"),
        F.col("embedding").alias("vector"),
    )


def vector_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One weather event per vector: a window of 6 to 47 hours that starts on a six-hour step."""
    step = F.col("vec_id") - F.pmod("vec_id", F.lit(6))
    start = plus_hours(F.lit(EPOCH).cast("timestamp"), step.cast("double"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("candidate_id"),
        F.col("vec_id").cast("string").alias("event_id"),
        F.col("label").cast("string").alias("group_id"),
        F.when(F.col("label") < 5, "warm").otherwise("cold").alias("event_type"),
        start.alias("time_coverage_start"),
        plus_hours(start, (6 + F.pmod("vec_id", F.lit(42))).cast("double")).alias("time_coverage_end"),
    )


def pooled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_vectors(
        event_windows(spark, sf_dir), archive(spark, sf_dir), start="start_ts", end="end_ts", strict=False
    )


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as track points; each (user, type) is an event and each user a cyclone."""
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("event_id"),
        F.col("user_id").cast("string").alias("tc_id"),
        F.col("ts").cast("timestamp").alias("time_utc"),
        (F.lit(10.0) + value % 30.0).alias("lat"),
        (F.lit(100.0) + F.pmod("event_id", F.lit(50))).alias("lon"),
        (F.lit(900.0) + value % 100.0).alias("pres"),
        (value % 70.0).alias("wnd"),
    )
