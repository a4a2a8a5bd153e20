"""Ranking metrics; every list is cut at its depth before it is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the selection score (they sum to 0.95 on purpose).
COMPOSITE_WEIGHTS = {"ndcg_at_10": 0.30, "map_at_10": 0.30, "recall_at_20": 0.25, "recall_at_10": 0.10}
# Promotion targets.
HARD_TARGETS = {
    "ndcg_at_10": 0.82,
    "map_at_10": 0.72,
    "recall_at_10": 0.40,
    "recall_at_20": 0.64,
    "track_rmse_km": 850.0,
    "landfall_dist_km": 750.0,
}
# Metrics of the retained anchor ranking.
RETAINED_BASELINE = {
    "ndcg_at_10": 0.8695522108335824,
    "map_at_10": 0.8023448773448774,
    "recall_at_10": 0.4227272727272727,
    "recall_at_20": 0.6218181818181817,
    "track_rmse_km": 770.0902883244523,
    "landfall_dist_km": 671.8737125003018,
}
METRICS = ("recall_at_10", "recall_at_20", "ndcg_at_10", "map_at_10")


def discount(rank: Column | str) -> Column:
    rank = F.col(rank) if isinstance(rank, str) else rank
    return F.lit(1.0) / F.log2(rank + 1.0)


def ideal_dcg(relevant: Column, k: int) -> Column:
    """Discount sum of the first ``min(k, relevant)`` places, from a table of ``k`` constants."""
    steps = F.array(*[discount(F.lit(float(r))) for r in range(1, k + 1)])
    return F.aggregate(
        F.slice(steps, F.lit(1), F.least(F.lit(k), relevant.cast("int"))), F.lit(0.0), lambda t, x: t + x
    )


def relevance_pairs(rows: DataFrame, positive: str = "is_gt_top20") -> DataFrame:
    """Distinct relevant (query, candidate) pairs."""
    return (
        rows.filter(F.col(positive).cast("boolean"))
        .select(F.col("query_id").cast("string").alias("query_id"), F.col("candidate_id").cast("string").alias("candidate_id"))
        .distinct()
    )


def query_metrics(
    ranked: DataFrame,
    relevant: DataFrame,
    *,
    keys: Sequence[str] = ("query_id",),
    denominator: str = "pool",
    fixed_size: int = 20,
) -> DataFrame:
    """Recall, nDCG and AP per ranked list; lists of queries without relevance are skipped.

    ``keys`` contains ``query_id`` and whatever else tells lists apart. ``denominator='fixed'`` divides
    recall by ``fixed_size`` instead of the number of relevant candidates.
    """
    keys = list(keys)
    counts = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    marked = (
        ranked.filter(F.col("rank") <= 20)
        .select(*keys, F.col("candidate_id").cast("string").alias("candidate_id"), "rank")
        .join(counts, "query_id")
        .join(relevant.withColumn("hit", F.lit(True)), ["query_id", "candidate_id"], "left")
        .withColumn("hit", F.coalesce("hit", F.lit(False)))
    )
    return list_metrics(marked, keys=keys, denominator=denominator, fixed_size=fixed_size)


def list_metrics(
    marked: DataFrame, *, keys: Sequence[str], denominator: str = "pool", fixed_size: int = 20
) -> DataFrame:
    """Metrics of lists whose rows already carry ``hit`` and ``n_relevant``."""
    if denominator not in {"pool", "fixed"}:
        raise ValueError("denominator must be 'pool' or 'fixed'")
    hit10 = F.col("hit") & (F.col("rank") <= 10)
    hit20 = F.col("hit") & (F.col("rank") <= 20)
    folded = marked.groupBy(*keys).agg(
        F.max("n_relevant").alias("n_relevant"),
        F.size(F.collect_set(F.when(hit10, F.col("candidate_id")))).alias("hits_10"),  # at most ten
        F.size(F.collect_set(F.when(hit20, F.col("candidate_id")))).alias("hits_20"),  # at most twenty
        F.sort_array(F.collect_list(F.when(hit10, F.col("rank")))).alias("hit_ranks"),  # at most ten
    )
    size = F.col("n_relevant") if denominator == "pool" else F.lit(fixed_size)
    gains = F.aggregate("hit_ranks", F.lit(0.0), lambda t, r: t + F.lit(1.0) / F.log2(r + 1.0))
    precision = F.aggregate(
        F.transform("hit_ranks", lambda r, i: (i + 1) / r), F.lit(0.0), lambda t, x: t + x
    )
    return folded.filter("n_relevant > 0").select(
        *keys,
        (F.col("hits_10") / size).alias("recall_at_10"),
        (F.col("hits_20") / size).alias("recall_at_20"),
        (gains / ideal_dcg(F.col("n_relevant"), 10)).alias("ndcg_at_10"),
        (precision / F.least(F.lit(10), F.col("n_relevant"))).alias("map_at_10"),
    )


def hit_metrics(hits: Column, count: Column) -> dict[str, Column]:
    """The same metrics for a ranked array of hit flags of distinct ids and the number of relevant ids."""
    places = F.filter(
        F.transform(F.slice(hits, 1, 10), lambda hit, i: F.when(hit, i + 1)), lambda p: p.isNotNull()
    )

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda t, x: t + x)

    return {
        "recall_at_10": F.size(places) / count,
        "recall_at_20": F.size(F.filter(F.slice(hits, 1, 20), lambda hit: hit)) / count,
        "ndcg_at_10": total(F.transform(places, lambda p: F.lit(1.0) / F.log2(p + 1.0))) / ideal_dcg(count, 10),
        "map_at_10": total(F.transform(places, lambda p, i: (i + 1) / p)) / F.least(F.lit(10), count),
    }


def macro_metrics(per_query: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return per_query.groupBy(*keys).agg(
        *[F.avg(m).alias(m) for m in METRICS], F.count(F.lit(1)).alias("query_count")
    )


def composite() -> Column:
    return sum((F.lit(w) * F.col(m) for m, w in list(COMPOSITE_WEIGHTS.items())[1:]), F.lit(0.30) * F.col("ndcg_at_10"))


def promotion_gates(reference: dict[str, float] | None = None, targets: dict[str, float] | None = None) -> dict[str, Column]:
    """Strict and hard gate columns over one metrics row; a missing physical error never passes."""
    reference, targets = reference or RETAINED_BASELINE, targets or HARD_TARGETS

    def gate(limits: dict[str, float], strict: bool) -> Column:
        passed = F.lit(True)
        for name in METRICS:
            passed = passed & (F.col(name) >= limits[name])
        for name in ("track_rmse_km", "landfall_dist_km"):
            passed = passed & ((F.col(name) <= limits[name]) if strict else (F.col(name) < limits[name]))
        return F.coalesce(passed, F.lit(False))

    return {"strict_promotion_pass": gate(reference, True), "hard_target_pass": gate(targets, False)}


def continuous_ndcg(
    rows: DataFrame,
    *,
    k: int = 10,
    keys: Sequence[str] = ("query_id",),
    score: str = "score",
    relevance: str = "relevance",
    position: str = "position",
) -> DataFrame:
    """nDCG with gains ``2^relevance - 1``; equal scores keep their input position.

    The first ``k`` rows by score and by relevance are the only ones shuffled.
    """
    if k < 1:
        raise ValueError("k must be positive")
    keys = list(keys)

    def gains(order: str, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), position))
        return (
            rows.withColumn("_r", place)
            .filter(F.col("_r") <= k)
            .groupBy(*keys)
            .agg(F.sum((F.pow(F.lit(2.0), F.col(relevance)) - 1.0) * discount("_r")).alias(name))
        )

    scored = gains(score, "dcg").join(gains(relevance, "ideal"), keys)
    return scored.select(
        *keys, F.when(F.col("ideal") > 0.0, F.col("dcg") / F.col("ideal")).otherwise(F.lit(0.0)).alias("ndcg")
    )


def ranked_binary_metrics(
    rows: DataFrame,
    relevant: DataFrame,
    *,
    ndcg_k: int = 10,
    count_k: int = 20,
    keys: Sequence[str] = ("query_id",),
    score: str = "score",
) -> DataFrame:
    """Binary nDCG and the count of distinct relevant rows, ordered by (score desc, id)."""
    keys = list(keys)
    depth = max(ndcg_k, count_k)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), "candidate_id"))
    counts = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    top = rows.withColumn("rank", place).filter(F.col("rank") <= depth)
    marked = top.join(counts, "query_id").join(
        relevant.withColumn("hit", F.lit(True)), ["query_id", "candidate_id"], "left"
    )
    hit = F.coalesce("hit", F.lit(False))
    return marked.groupBy(*keys).agg(
        (
            F.coalesce(F.sum(F.when(hit & (F.col("rank") <= ndcg_k), discount("rank"))), F.lit(0.0))
            / ideal_dcg(F.max("n_relevant"), ndcg_k)
        ).alias("ndcg"),
        F.size(F.collect_set(F.when(hit & (F.col("rank") <= count_k), F.col("candidate_id")))).alias("relevant_at_k"),
    )
