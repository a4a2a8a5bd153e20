"""Development studies: payload contracts checked in the cluster, then paired comparisons."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.functions.scalars import parse_time
from isobar.operators.bootstrap import fold_deltas, paired_bootstrap
from isobar.operators.metrics import continuous_ndcg, ranked_binary_metrics
from isobar.schemas import FOLD
from isobar.session import materialize

FULL_POOL = 1_000
RELEVANT = 20


def portability_schema(control: str = "control_scores", system: str = "system_scores") -> T.StructType:
    numbers = T.ArrayType(T.DoubleType())
    seeds = T.StructType().add("seed", T.StringType()).add(control, numbers).add(system, numbers)
    query = (
        T.StructType()
        .add("query_id", T.StringType())
        .add("timestamp", T.StringType())
        .add("fold", T.StringType())
        .add("continuous_relevance", numbers)
        .add("seed_scores", T.ArrayType(seeds))
    )
    return (
        T.StructType()
        .add("study_scope", T.StringType())
        .add("formal_test_opened", T.BooleanType())
        .add("scores_sealed_before_relevance", T.BooleanType())
        .add("input_and_evaluation_annotations_disjoint", T.BooleanType())
        .add("object_count", T.LongType())
        .add("model_seed_count", T.IntegerType())
        .add("expected_temporal_folds", T.IntegerType())
        .add("temporal_folds", T.ArrayType(FOLD))
        .add("queries", T.ArrayType(query))
    )


def matched_schema(backend: str = "backend", full_system: str = "full") -> T.StructType:
    ids = T.ArrayType(T.StringType())
    score = T.StructType().add("candidate_id", T.StringType()).add("score", T.DoubleType())
    query = (
        T.StructType()
        .add("query_id", T.StringType())
        .add("ground_truth_ids", ids)
        .add("sealed_scores", T.ArrayType(score))
        .add("systems", T.StructType().add(backend, ids).add(full_system, ids))
    )
    return (
        T.StructType()
        .add("study_scope", T.StringType())
        .add("scorer_sealed_before_labels", T.BooleanType())
        .add("scorer_seal", T.StringType())
        .add("full_pool_size", T.LongType())
        .add("queries", T.ArrayType(query))
    )


def physical_schema(prefix_control: str = "baseline", prefix_system: str = "system") -> T.StructType:
    query = T.StructType().add("query_id", T.StringType()).add("timestamp", T.StringType()).add("fold", T.StringType())
    for prefix in (prefix_control, prefix_system):
        query = query.add(f"{prefix}_ndcg10", T.DoubleType()).add(f"{prefix}_top1_track_error_km", T.DoubleType())
    return (
        T.StructType()
        .add("study_scope", T.StringType())
        .add("expected_temporal_folds", T.IntegerType())
        .add("temporal_folds", T.ArrayType(FOLD))
        .add("queries", T.ArrayType(query))
    )


def read_payload(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One-row frame of a study file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def payload_frame(spark: SparkSession, payload: Mapping[str, Any], schema: T.StructType) -> DataFrame:
    text = json.dumps(payload)
    return spark.createDataFrame([(text,)], "value string").select(
        F.from_json("value", schema).alias("p")
    ).select("p.*")


def require(df: DataFrame, rules: Mapping[str, Column]) -> None:
    """Raise for the first rule that any row breaks; all rules are counted in one job."""
    broken = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"r{i}") for i, rule in enumerate(rules.values())]).first()
    for i, message in enumerate(rules):
        if broken[i]:
            raise ValueError(message)


def _true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _fold_table(payload: DataFrame) -> DataFrame:
    folds = payload.select(F.explode("temporal_folds").alias("f")).select(
        "f.fold",
        parse_time("f.train_end").alias("train_end"),
        parse_time("f.evaluation_start").alias("evaluation_start"),
        parse_time("f.evaluation_end").alias("evaluation_end"),
    )
    require(
        folds,
        {
            "fold timestamps must be ISO-8601": F.col("train_end").isNotNull()
            & F.col("evaluation_start").isNotNull()
            & F.col("evaluation_end").isNotNull(),
            "each fold must evaluate strictly after training": (F.col("train_end") < F.col("evaluation_start"))
            & (F.col("evaluation_start") <= F.col("evaluation_end")),
        },
    )
    if not folds.groupBy("fold").count().filter("count > 1").isEmpty():
        raise ValueError("fold names must be unique")
    return folds


def fold_contract(folds: DataFrame) -> DataFrame:
    """Counters of the temporal fold contract, as one row."""
    return folds.agg(
        F.count(F.lit(1)).alias("fold_count"),
        F.count_distinct("fold").alias("fold_names"),
        F.count_if(~(F.col("train_end") < F.col("evaluation_start"))).alias("train_overlaps"),
        F.count_if(~(F.col("evaluation_start") <= F.col("evaluation_end"))).alias("empty_folds"),
    )


def _queries(payload: DataFrame) -> DataFrame:
    rows = materialize(payload.select(F.explode("queries").alias("q")).select("q.*"), "study")
    if rows.isEmpty():
        raise ValueError("queries must be a non-empty list")
    if not rows.groupBy("query_id").count().filter("count > 1").isEmpty():
        raise ValueError("query ids must be unique")
    return rows


def _check_folds(queries: DataFrame, folds: DataFrame, expected: int) -> None:
    placed = queries.select("query_id", "fold", parse_time("timestamp").alias("t")).join(folds, "fold", "left")
    require(
        placed,
        {
            "each query must name a declared fold": F.col("evaluation_start").isNotNull(),
            "a query lies outside the evaluation period of its fold": F.col("t").between(
                F.col("evaluation_start"), F.col("evaluation_end")
            ),
        },
    )
    used = queries.select("fold").distinct().count()
    if used != expected or folds.count() != expected:
        raise ValueError(f"expected {expected} non-empty folds")


def _paired_summary(pairs: DataFrame, baseline: str, proposed: str, *, resamples: int, seed: int) -> dict[str, Any]:
    interval = paired_bootstrap(
        pairs, baseline=baseline, proposed=proposed, order="position" if "position" in pairs.columns else "query_id",
        resamples=resamples, seed=seed,
    ).first().asDict()
    means = pairs.agg(F.avg(baseline).alias("b"), F.avg(proposed).alias("p")).first()
    return {"baseline_mean": means["b"], "proposed_mean": means["p"], "paired_bootstrap": interval}


def _fold_summary(pairs: DataFrame, baseline: str, proposed: str) -> dict[str, Any]:
    rows = fold_deltas(pairs, baseline=baseline, proposed=proposed).orderBy("fold").collect()  # one row per fold
    deltas = {r["fold"]: r["mean_delta"] for r in rows}
    return {
        "temporal_fold_count": len(deltas),
        "fold_deltas": deltas,
        "all_temporal_folds_positive": all(d > 0.0 for d in deltas.values()),
    }


def evaluate_portability(
    payload: DataFrame,
    *,
    control: str = "control_scores",
    system: str = "system_scores",
    resamples: int = 10_000,
    seed: int = 308000,
) -> dict[str, Any]:
    """Continuous nDCG@10 of two sealed score vectors per query and model seed, over temporal folds."""
    require(
        payload,
        {
            "only development studies are accepted": F.col("study_scope") == "development",
            "the formal test must not be opened": ~F.coalesce("formal_test_opened", F.lit(True)),
            "scores must be sealed before relevance is read": _true("scores_sealed_before_relevance"),
            "input and evaluation annotations must be disjoint": _true("input_and_evaluation_annotations_disjoint"),
        },
    )
    head = payload.select("object_count", "model_seed_count", "expected_temporal_folds").first()
    seeds = head["model_seed_count"] or 5
    folds, queries = _fold_table(payload), _queries(payload)
    _check_folds(queries, folds, head["expected_temporal_folds"] or 3)

    def finite(values: str, x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    aligned = F.forall(
        "seed_scores",
        lambda s: (F.size(s[control]) == F.size("continuous_relevance"))
        & (F.size(s[system]) == F.size("continuous_relevance"))
        & F.forall(s[control], lambda x: finite(control, x))
        & F.forall(s[system], lambda x: finite(system, x)),
    )
    require(
        queries,
        {
            f"each query must bring {seeds} seed score pairs": F.size("seed_scores") == seeds,
            "seeds must be unique per query": F.size(F.array_distinct("seed_scores.seed")) == F.size("seed_scores"),
            "relevance must be present, finite and not negative": (F.size("continuous_relevance") > 0)
            & F.forall("continuous_relevance", lambda x: finite("r", x) & (x >= 0.0)),
            "scores must be finite and aligned with relevance": aligned,
        },
    )
    per_seed = queries.select("query_id", "fold", "continuous_relevance", F.explode("seed_scores").alias("s"))
    triples = F.arrays_zip(F.col(f"s.{control}").alias("c"), F.col(f"s.{system}").alias("y"), F.col("continuous_relevance").alias("r"))
    rows = per_seed.select("query_id", "fold", F.col("s.seed").alias("seed"), F.posexplode(triples).alias("position", "v")).select(
        "query_id", "fold", "seed", "position", F.col("v.r").alias("relevance"), F.col("v.c").alias(control), F.col("v.y").alias(system)
    )
    found = portability(rows, control=control, system=system, resamples=resamples, seed=seed)
    return {"study_scope": "development", "object_count": head["object_count"], **found}


def portability(rows: DataFrame, *, control: str, system: str, resamples: int = 10_000, seed: int = 308000) -> dict[str, Any]:
    """The study on a table: one row per query, model seed and position, with relevance and both scores.

    Contract: relevance is finite and not negative, scores are finite, every query has as many seeds as any other, and
    positions are unique in each of them.
    """
    def finite(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) != float("inf"))

    require(
        rows,
        {
            "relevance must be present, finite and not negative": finite("relevance") & (F.col("relevance") >= 0),
            "scores must be finite and aligned with relevance": finite(control) & finite(system),
        },
    )
    shapes = rows.groupBy("query_id", "fold", "seed").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("position").alias("d")
    ).groupBy("query_id", "fold").agg(
        F.count(F.lit(1)).alias("seeds"), F.min(F.col("n") == F.col("d")).alias("unique")
    )
    seeds = shapes.agg(F.max("seeds").alias("s")).first()["s"]
    require(shapes, {"each query must bring every seed, with unique positions": (F.col("seeds") == seeds) & F.col("unique")})
    arms = [
        continuous_ndcg(rows.select("query_id", "fold", "seed", "position", "relevance", F.col(arm).alias("score")), keys=["query_id", "fold", "seed"])
        .groupBy("query_id", "fold").agg(F.avg("ndcg").alias(arm))
        for arm in (control, system)
    ]
    pairs = materialize(arms[0].join(arms[1], ["query_id", "fold"]), "study")
    summary = _paired_summary(pairs, control, system, resamples=resamples, seed=seed)
    return {
        "metric": "continuous_nDCG@10",
        "model_seed_count": seeds,
        "query_count": pairs.count(),
        "control_mean": summary["baseline_mean"],
        "system_mean": summary["proposed_mean"],
        "paired_bootstrap": summary["paired_bootstrap"],
        **_fold_summary(pairs, control, system),
    }


def evaluate_matched_scoring(
    payload: DataFrame,
    *,
    backend: str = "backend",
    full_system: str = "full",
    resamples: int = 10_000,
    seed: int = 20262202,
) -> dict[str, Any]:
    """Two candidate pools under one sealed score map."""
    require(
        payload,
        {
            "only development controls are accepted": F.col("study_scope") == "development",
            "the scorer must be sealed before labels are read": _true("scorer_sealed_before_labels"),
            "a scorer seal is required": F.length(F.trim("scorer_seal")) > 0,
            "the full pool must be declared as 1000": F.col("full_pool_size") == FULL_POOL,
        },
    )
    queries = _queries(payload)
    short, full = F.col(f"systems.{backend}"), F.col(f"systems.{full_system}")
    scored = F.col("sealed_scores.candidate_id")

    def unique(ids: Column) -> Column:
        return (F.size(ids) > 0) & (F.size(F.array_distinct(ids)) == F.size(ids))

    require(
        queries,
        {
            "each query needs 20 distinct relevant events": F.size(F.array_distinct("ground_truth_ids")) == RELEVANT,
            "sealed score ids must be unique": unique(scored),
            "sealed scores must be finite": F.forall(
                "sealed_scores", lambda s: s["score"].isNotNull() & ~F.isnan(s["score"]) & (F.abs(s["score"]) != float("inf"))
            ),
            "pool ids must be present and unique": unique(short) & unique(full),
            "the backend pool must be part of the full pool": F.size(F.array_except(short, full)) == 0,
            "the full pool must hold 1000 candidates": F.size(full) == FULL_POOL,
            "sealed scores must cover exactly the full pool": (F.size(F.array_except(scored, full)) == 0)
            & (F.size(F.array_except(full, scored)) == 0),
        },
    )
    relevant = queries.select("query_id", F.explode(F.array_distinct("ground_truth_ids")).alias("candidate_id"))
    scores = queries.select("query_id", F.explode("sealed_scores").alias("s")).select("query_id", "s.candidate_id", "s.score")
    members = queries.select("query_id", F.explode(full).alias("candidate_id"), short.alias("short"))
    pool = members.select("query_id", "candidate_id", F.array_contains("short", F.col("candidate_id")).alias("in_backend")).join(
        scores, ["query_id", "candidate_id"]
    )
    found = matched_scoring(pool, relevant, backend=backend, full_system=full_system, resamples=resamples, seed=seed)
    return {"study_scope": "development", **found}


def matched_scoring(
    pool: DataFrame, relevant: DataFrame, *, backend: str = "backend", full_system: str = "full", full_size: int = FULL_POOL,
    relevant_size: int = RELEVANT, resamples: int = 10_000, seed: int = 20262202,
) -> dict[str, Any]:
    """The study on tables: the full pool (query_id, candidate_id, score, in_backend) and the relevant pairs.

    Contract: candidates are unique and ``full_size`` per query, some of them of the backend, with finite scores, and every
    query of the pool has ``relevant_size`` distinct relevant candidates.
    """
    sizes = pool.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("candidate_id").alias("d"), F.count_if("in_backend").alias("b"),
        F.count_if(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))).alias("bad"),
    ).join(relevant.groupBy("query_id").agg(F.count_distinct("candidate_id").alias("r")), "query_id", "left")
    require(
        sizes,
        {
            f"each query needs {relevant_size} distinct relevant events": F.col("r") == relevant_size,
            "pool ids must be present and unique": (F.col("n") == F.col("d")) & (F.col("b") > 0),
            "sealed scores must be finite": F.col("bad") == 0,
            f"the full pool must hold {full_size} candidates": F.col("n") == full_size,
        },
    )
    results = [
        ranked_binary_metrics(rows.select("query_id", "candidate_id", "score"), relevant)
        .withColumnRenamed("ndcg", f"{arm}_ndcg").withColumnRenamed("relevant_at_k", f"{arm}_relevant")
        for arm, rows in ((backend, pool.filter("in_backend")), (full_system, pool))
    ]
    pairs = materialize(results[0].join(results[1], "query_id"), "study")
    summary = _paired_summary(pairs, f"{backend}_ndcg", f"{full_system}_ndcg", resamples=resamples, seed=seed)
    counts = pairs.agg(F.avg(f"{backend}_relevant").alias("b"), F.avg(f"{full_system}_relevant").alias("f")).first()
    return {
        "metric": "nDCG@10",
        "query_count": pairs.count(),
        "backend": backend,
        "full_system": full_system,
        "backend_mean": summary["baseline_mean"],
        "full_system_mean": summary["proposed_mean"],
        "backend_relevant_at_20": counts["b"],
        "full_system_relevant_at_20": counts["f"],
        "paired_bootstrap": summary["paired_bootstrap"],
    }


def evaluate_physical_ablation(
    payload: DataFrame,
    *,
    control: str = "baseline",
    system: str = "system",
    resamples: int = 10_000,
    seed: int = 20262202,
) -> dict[str, Any]:
    """Ranking and top-1 track error of two systems, over temporal folds."""
    require(payload, {"only development ablations are accepted": F.col("study_scope") == "development"})
    head = payload.select("expected_temporal_folds").first()
    found = physical_ablation(
        _queries(payload), _fold_table(payload), expected_folds=head["expected_temporal_folds"] or 3, control=control, system=system,
        resamples=resamples, seed=seed,
    )
    return {"study_scope": "development", **found}


def physical_ablation(
    queries: DataFrame, folds: DataFrame, *, expected_folds: int = 3, control: str = "baseline", system: str = "system",
    resamples: int = 10_000, seed: int = 20262202,
) -> dict[str, Any]:
    """The study on tables: (query_id, timestamp, fold, ndcg and track error of both arms) and the temporal folds."""
    _check_folds(queries, folds, expected_folds)
    ndcg = [f"{arm}_ndcg10" for arm in (control, system)]
    errors = [f"{arm}_top1_track_error_km" for arm in (control, system)]

    def valid(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0.0) & (F.col(c) != float("inf"))

    require(
        queries,
        {
            "query metrics must be finite and not negative": reduce(lambda a, b: a & b, [valid(c) for c in ndcg + errors]),
            "nDCG must not exceed one": (F.col(ndcg[0]) <= 1.0) & (F.col(ndcg[1]) <= 1.0),
        },
    )
    summary = _paired_summary(queries, *ndcg, resamples=resamples, seed=seed)
    means = queries.agg(F.avg(errors[0]).alias("b"), F.avg(errors[1]).alias("s")).first()
    return {
        "ranking_metric": "nDCG@10",
        "query_count": queries.count(),
        "baseline_mean": summary["baseline_mean"],
        "system_mean": summary["proposed_mean"],
        "paired_bootstrap": summary["paired_bootstrap"],
        "baseline_top1_track_rmse_km": means["b"],
        "system_top1_track_rmse_km": means["s"],
        "top1_track_rmse_reduction_km": means["b"] - means["s"],
        **_fold_summary(queries, *ndcg),
    }


def _evidence(
    spark: SparkSession, root: Path, name: str, columns: tuple[str, ...]
) -> tuple[DataFrame, dict[str, Any]]:
    meta = json.loads((root / f"{name}_metadata.json").read_text(encoding="utf-8"))
    if int(meta["bootstrap_resamples"]) < 100:
        raise ValueError("bootstrap_resamples must be at least 100")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).csv(str(root / f"{name}_per_query.csv"), header=True, enforceSchema=False)
    rows = rows.withColumns({c: F.col(c).cast("double") for c in columns if c not in {"query_id", "fold"}})
    rows = materialize(rows, "evidence")
    if rows.count() != int(meta["query_count"]):
        raise ValueError(f"{name}: the query count differs from its metadata")
    return rows, meta


def _diversity(rows: DataFrame) -> dict[str, Any]:
    """Row count, and mean, least and largest value of every numeric column, over all rows."""
    names = [f.name for f in rows.schema if isinstance(f.dataType, T.NumericType)]
    found = rows.agg(F.count(F.lit(1)).alias("row_count"), *[f(F.col(f"`{n}`")).alias(f"{n}_{label}") for n in names for label, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])
    return found.first().asDict()


def verify_evidence(
    spark: SparkSession,
    directory: str | Path,
    *,
    portability: tuple[str, str, str],
    matched: tuple[str, str, str, str, str],
    physical: tuple[str, str, str, str, str],
    seeds: str,
    diversity: str = "candidate_diversity_summary.csv",
    audit: str = "audit_export_summary.json",
) -> dict[str, Any]:
    """Recompute study summaries from anonymous per-query rows.

    Each study is named by (file stem, columns...): control and system metric, then for matched scoring
    the two relevant counts and for the physical study the two track errors.
    """
    root = Path(directory)

    def result(rows: DataFrame, meta: Mapping[str, Any], control: str, system: str) -> dict[str, Any]:
        summary = _paired_summary(
            rows, control, system, resamples=int(meta["bootstrap_resamples"]), seed=int(meta["bootstrap_seed"]),
        )
        interval = summary["paired_bootstrap"]
        return {
            "control_mean": summary["baseline_mean"],
            "system_mean": summary["proposed_mean"],
            "gain": interval["estimate"],
            "ci95": [interval["lower"], interval["upper"]],
            "query_count": interval["query_count"],
        }

    stem, control, system = portability
    rows, meta = _evidence(spark, root, stem, ("query_id", "fold", control, system))
    values = spark.createDataFrame(
        [(float(v),) for v in json.loads((root / seeds).read_text(encoding="utf-8"))["seed_values"].values()], "v double"
    )
    spread = values.agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).first()
    if spread["n"] != int(meta["model_seed_count"]):
        raise ValueError("the seed count differs from its metadata")
    first = {
        **result(rows, meta, control, system),
        **_fold_summary(rows, control, system),
        "object_count": int(meta["object_count"]),
        "seed_mean": spread["m"],
        "seed_sd": spread["s"],
    }

    stem, control, system, b_count, s_count = matched
    rows, meta = _evidence(spark, root, stem, ("query_id", control, system, b_count, s_count))
    counts = rows.agg(F.avg(b_count).alias("b"), F.avg(s_count).alias("s")).first()
    second = {
        **result(rows, meta, control, system),
        "control_relevant_at20": counts["b"],
        "system_relevant_at20": counts["s"],
        "full_pool_size": int(meta["full_pool_size"]),
    }

    stem, control, system, c_error, s_error = physical
    rows, meta = _evidence(spark, root, stem, ("query_id", "fold", control, system, c_error, s_error))
    errors = rows.agg((F.avg(c_error) - F.avg(s_error)).alias("d")).first()
    third = {
        **result(rows, meta, control, system),
        **_fold_summary(rows, control, system),
        "track_rmse_reduction_km": errors["d"],
    }
    return {
        "portability": first,
        "matched_scoring": second,
        "physical_ablation": third,
        "candidate_diversity": _diversity(spark.read.csv(str(root / diversity), header=True, inferSchema=True)),
        "audit_export": json.loads((root / audit).read_text(encoding="utf-8")),
    }
