"""Offline search: profile ledger, validation-only selection and the report on the test split."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isobar.operators.boosting import fit_ranker
from isobar.operators.anchor import anchor_merge
from isobar.operators.blend import ANCHOR_KEEPS, Blend, blend_score, profile_grid, rank_proposals, score_terms
from isobar.operators.features import (
    add_derived_features,
    labels,
    model_matrix,
    query_z,
    train_medians,
)
from isobar.operators.graph import add_graph_features, label_graph_edges
from isobar.operators.metrics import (
    METRICS,
    RETAINED_BASELINE,
    composite,
    hit_metrics,
    macro_metrics,
    promotion_gates,
    query_metrics,
    relevance_pairs,
)
from isobar.operators.physical import event_track_points, mean_errors, pair_errors, top_one
from isobar.operators.ranker import MODEL_SPECS, RankerSpec
from isobar.plans.contract import (
    FEATURE_NAMES,
    build_manifest,
    graph_sha256,
    input_receipt,
    model_identity,
    validate_features,
)
from isobar.plans.online import METHOD_DEFINITION, METHOD_NAME, policy_columns, score_model
from isobar.session import materialize
from isobar.sources import sinks

# Floors a profile has to reach on validation, and the fewest anchors it keeps.
VALIDATION_FLOORS = {"ndcg_at_10": 0.86, "map_at_10": 0.80, "recall_at_10": 0.41, "recall_at_20": 0.735}
MIN_KEEP = 1


GRID = (
    "array<struct<model_name:string,model:int,blend_name:string,"
    "wb:float,wm:float,wg:float,wc:float,ws:float>>"
)


#: Pool rows that are ranked inside one row; a wider pool is several such rows, whose best are merged.
CHUNK_ROWS = 1_000
#: Partial rankings of a profile that one merge takes.
FAN_IN = 50
#: Places of a ranking.
DEPTH = 20


def ledger(
    scored: DataFrame,
    anchors: DataFrame,
    relevant: DataFrame,
    *,
    models: Mapping[str, str],
    blends: Sequence[Blend] | None = None,
    keeps: Sequence[int] = ANCHOR_KEEPS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Validation metrics of every model, blend and anchor count, as one plan.

    ``scored`` carries one score column per model (``models`` maps name to column). A pool becomes one row for each
    ``chunk_rows`` of its rows; profiles are expanded and ranked inside such a row, and what travels on is the best 20 of
    each profile. These partial rankings merge in steps of ``FAN_IN``, as many as the widest pool needs (none for pools
    of one chunk), so a pool of any width is ranked exactly. Relevance is a flag on pool rows and anchors, and a count
    per query, so the relevant ids of a query are never gathered either.
    """
    blends = list(blends if blends is not None else profile_grid())
    names = list(models)
    widest = scored.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    parts = -(-widest // chunk_rows)
    pairs = relevant.where("candidate_id IS NOT NULL").select("query_id", "candidate_id").distinct()
    hits = pairs.withColumn("hit", F.lit(True))
    flagged = scored.join(hits, ["query_id", "candidate_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    terms = score_terms(flagged, models[names[0]]).drop("z_model")
    terms = terms.withColumns({f"z_model_{i}": query_z(F.coalesce(F.col(models[n]).cast("double"), F.lit(0.0))) for i, n in enumerate(names)})
    width = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    terms = terms.withColumn("chunk", F.pmod(F.xxhash64("candidate_id"), F.ceil(width / F.lit(chunk_rows))))
    if parts > 1:
        terms = terms.select(
            "query_id", "chunk", "candidate_id", "hit", "z_base", "z_graph", "z_calibrated", "z_source",
            *[f"z_model_{i}" for i in range(len(names))],
        ).repartition("query_id", "chunk")
    pools = terms.groupBy("query_id", "chunk").agg(
        F.collect_list(
            F.struct(
                "candidate_id", "hit", "z_base", "z_graph", "z_calibrated", "z_source",
                F.array(*[F.col(f"z_model_{i}") for i in range(len(names))]).alias("z_models"),
            )
        ).alias("pool")
    )
    heads = (
        anchors.select("query_id", F.col("candidate_id").cast("string").alias("candidate_id"), F.col("rank").cast("int").alias("rank"))
        .withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "candidate_id")))
        .filter(F.col("place") <= max(keeps))
        .join(hits, ["query_id", "candidate_id"], "left")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", "candidate_id", F.coalesce("hit", F.lit(False)).alias("hit")))).alias("heads"))
        .withColumn("heads", F.transform("heads", _item))
    )
    wanted = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    rows = [
        {
            "model_name": n, "model": i, "blend_name": b.name,
            "wb": b.base, "wm": b.model, "wg": b.graph, "wc": b.calibrated, "ws": b.source,
        }
        for i, n in enumerate(names)
        for b in blends
    ]
    grid = F.from_json(F.lit(json.dumps(rows)), GRID)  # one constant, folded by the optimizer
    profiles = pools.join(wanted.select("query_id"), "query_id", "left_semi").withColumn("g", F.explode(grid))

    def blended(r: Column) -> Column:
        """Sort key of a pool row: descending score, then candidate id."""
        score = (
            F.col("g.wb") * r["z_base"]
            + F.col("g.wm") * r["z_models"][F.col("g.model")]
            + F.col("g.wg") * r["z_graph"]
            + F.col("g.wc") * r["z_calibrated"]
            + F.col("g.ws") * r["z_source"]
        )
        return F.struct((-score).alias("s"), r["candidate_id"].alias("candidate_id"), r["hit"].alias("hit"))

    best = profiles.select(
        "query_id", "chunk", "g.model_name", "g.blend_name",
        F.slice(F.array_sort(F.transform("pool", blended)), 1, DEPTH).alias("best"),
    )
    while parts > 1:
        parts = -(-parts // FAN_IN)
        best = (
            best.withColumn("chunk", F.floor(F.col("chunk") / F.lit(FAN_IN)))
            .groupBy("query_id", "chunk", "model_name", "blend_name")
            .agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, DEPTH).alias("best"))
        )
    ranked = (
        best.join(wanted, "query_id")
        .join(heads, "query_id", "left")
        .select(
            "query_id", "n_relevant", "model_name", "blend_name", F.transform("best", _item).alias("items"),
            F.coalesce("heads", F.array().cast("array<struct<candidate_id:string,hit:boolean>>")).alias("heads"),
        )
        .withColumn("keep_top", F.explode(F.array(*[F.lit(k) for k in keeps])))
    )
    kept = F.array_distinct(F.slice("heads", F.lit(1), F.col("keep_top")))
    merged = ranked.withColumn("items", F.slice(F.concat(kept, F.array_except("items", kept)), 1, DEPTH))
    per_query = merged.select(
        "query_id", "model_name", "blend_name", "keep_top",
        *[m.alias(n) for n, m in hit_metrics(F.col("items")["hit"], F.col("n_relevant")).items()],
    )
    return (
        macro_metrics(per_query, ["model_name", "blend_name", "keep_top"])
        .withColumn("composite", composite())
        .withColumn(
            "profile",
            F.concat_ws("|", "model_name", "blend_name", F.concat(F.lit("anchor_keep"), F.col("keep_top").cast("string"))),
        )
    )


def _item(r: Column) -> Column:
    return F.struct(r["candidate_id"].alias("candidate_id"), r["hit"].alias("hit"))


def ledger_order() -> list[Column]:
    return [F.desc("composite"), F.desc("recall_at_20"), F.col("profile")]


def select_profile(
    table: DataFrame, *, floors: Mapping[str, float] = VALIDATION_FLOORS, min_keep: int = MIN_KEEP
) -> DataFrame:
    """The single chosen ledger row.

    Rows above all floors come first; if none passes, all rows that keep enough anchors compete.
    """
    passes = F.lit(True)
    for name, floor in floors.items():
        passes = passes & F.coalesce(F.col(name) >= floor, F.lit(False))
    return (
        table.filter(F.col("keep_top") >= min_keep)
        .withColumn("passes_floors", passes)
        .orderBy(
            F.desc("passes_floors"), F.desc("recall_at_20"), F.desc("composite"), F.desc("map_at_10"), "profile"
        )
        .limit(1)
    )


def offline_features(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Derived and graph features of a candidate table, seeded by the table's reciprocal rank."""
    return add_graph_features(add_derived_features(rows), edges, source_feature="source_min_rank_inv")


@dataclass
class OfflineResult:
    ledger: DataFrame
    selected: dict[str, Any]
    model: Any
    edges: DataFrame
    manifest: dict[str, Any]
    fill: dict[str, float]
    validation_ranking: DataFrame
    test_ranking: DataFrame
    summary: dict[str, Any]


def run_offline(
    spark: SparkSession,
    *,
    train: DataFrame,
    validation: DataFrame,
    test: DataFrame,
    validation_anchors: DataFrame,
    test_anchors: DataFrame,
    output: str,
    specs: Sequence[RankerSpec] = MODEL_SPECS,
    trees: int | None = None,
    models: Mapping[str, Any] | None = None,
    descriptor: DataFrame | None = None,
    mapping: DataFrame | None = None,
    best_track: DataFrame | None = None,
    manifest: Mapping[str, Any] | None = None,
) -> OfflineResult:
    """Train on train, choose on validation, then rank and report test once.

    ``models`` replaces fitting by ready scorers. Without a ``manifest`` the chosen assets are frozen into
    a new one before the test split is scored.
    """
    run_id = f"{METHOD_DEFINITION}_{datetime.now():%Y%m%d_%H%M%S}"
    log = sinks.RunLog(spark, os.path.join(output, "progress"), run_id)
    sinks.write_json({"run_id": run_id, "primary": sinks.storage_state(output)}, f"{output}/storage_registry.json")
    log.stage("start")
    log.event("start")

    edges = materialize(label_graph_edges(train), "edges")
    graph_counts = edges.agg(
        F.count_distinct("candidate_id").alias("train_positive_seed_count"),
        F.count_distinct("train_query").alias("train_positive_query_count"),
    ).first().asDict()
    sinks.write_json(graph_counts, f"{output}/train_label_graph_manifest.json")
    featured = {}
    for split, rows in (("train", train), ("validation", validation), ("test", test)):
        log.stage("add_graph_features", split=split)
        featured[split] = materialize(offline_features(rows, edges), f"features-{split}")
        validate_features(featured[split].schema, warn=False)
    receipts = {s: input_receipt(df.schema, FEATURE_NAMES, warn=False) for s, df in featured.items()}
    fill = train_medians(featured["train"], FEATURE_NAMES)
    matrices = {s: model_matrix(df, FEATURE_NAMES, fill) for s, df in featured.items()}
    sinks.write_feature_list(FEATURE_NAMES, f"{output}/feature_names.csv")

    fitted: dict[str, Any] = dict(models or {})
    modes = {n: "given" for n in fitted}
    if not fitted:
        for spec in specs:
            log.stage("fit_model", model=spec.name, label_mode=spec.label_mode)
            mode = "graded" if spec.label_mode == "graded" else "binary"
            labelled = matrices["train"].withColumn("label", labels(featured["train"], mode))
            fitted[spec.name] = fit_ranker(labelled, FEATURE_NAMES, spec, trees=trees)
            modes[spec.name] = spec.label_mode
    scored = matrices["validation"]
    columns = {}
    for i, (name, model) in enumerate(fitted.items()):
        columns[name] = f"model_score_{i}"
        scored = materialize(score_model(scored, model, name=columns[name]), "validation-scores")
    relevant = {s: relevance_pairs(featured[s]) for s in ("validation", "test")}
    table = materialize(
        ledger(scored, validation_anchors, relevant["validation"], models=columns).withColumns(policy_columns(scored.columns)),
        "ledger",
    )
    sinks.write_csv(table.orderBy(*ledger_order()), f"{output}/search_ledger")
    chosen = select_profile(table).first()
    if chosen is None:
        raise ValueError("no validation profile can be selected")
    selected = chosen.asDict()
    selected["label_mode"] = modes[selected["model_name"]]
    log.stage("selected_validation_profile", selected=selected)

    # Everything below is frozen; the test split is scored only now.
    model = fitted[selected["model_name"]]
    frozen = dict(manifest) if manifest is not None else build_manifest(model, edges)
    audit = input_receipt(featured["test"].schema, FEATURE_NAMES, model=model, edges=edges, manifest=frozen, warn=False)
    sinks.write_json(frozen, f"{output}/asset_manifest.json")
    sinks.write_json({**receipts, "frozen_asset_verification": audit}, f"{output}/feature_audit.json")
    blend = next(b for b in profile_grid() if b.name == selected["blend_name"])
    rankings = {}
    for split, anchors in (("validation", validation_anchors), ("test", test_anchors)):
        values = score_terms(score_model(matrices[split], model)).withColumn("score", blend_score(blend))
        proposal = rank_proposals(values)
        merged = anchor_merge(anchors, proposal, keep_top=selected["keep_top"])
        full = merged.join(values.drop("features", "rank"), ["query_id", "candidate_id"], "left").withColumns(
            {**policy_columns(values.columns), "anchor_profile": F.lit(selected["profile"])}
        )
        rankings[split] = materialize(full, f"ranking-{split}")
        flat = [f.name for f in full.schema if f.dataType.typeName() not in {"array", "map", "struct"}]
        sinks.write_csv(rankings[split].select(*flat), f"{output}/{split}_ranking_detail")
    report = report_test(rankings["test"], relevant["test"], descriptor, mapping, best_track)
    summary = {
        "run_id": run_id,
        "method_name": METHOD_NAME,
        "method_definition": METHOD_DEFINITION,
        "selected_profile": selected["profile"],
        "selected_by_validation": True,
        **{f"validation_{m}": selected[m] for m in METRICS},
        "validation_composite": selected["composite"],
        **{f"test_{m}_report_only": report[m] for m in METRICS},
        **{k: v for k, v in report.items() if k not in METRICS},
        **{f"retained_anchor_{m}": RETAINED_BASELINE[m] for m in METRICS},
        "feature_count": len(FEATURE_NAMES),
        "feature_list_sha256": audit["feature_list_sha256"],
        "model_sha256": model_identity(model)["sha256"],
        "graph_asset_sha256": graph_sha256(edges),
        "graph_manifest": graph_counts,
        "test_grid_policy": "test is ranked only with the profile chosen on validation",
        "uses_test_for_tuning": False,
    }
    sinks.write_json(summary, f"{output}/selected_summary.json")
    log.stage("complete", summary=summary)
    log.event("complete", summary=summary)
    return OfflineResult(
        table, selected, model, edges, frozen, fill, rankings["validation"], rankings["test"], summary
    )


def report_test(
    ranking: DataFrame,
    relevant: DataFrame,
    descriptor: DataFrame | None = None,
    mapping: DataFrame | None = None,
    best_track: DataFrame | None = None,
) -> dict[str, Any]:
    """Retrieval metrics, top-1 physical errors and gates of a ranking."""
    metrics = macro_metrics(query_metrics(ranking, relevant))
    physical = ("track_rmse_km", "pressure_mae", "wind_mae", "landfall_dist_km", "landfall_time_err_h")
    if descriptor is not None and mapping is not None and best_track is not None:
        pairs = top_one(ranking)
        ids = pairs.select(F.explode(F.array("query_id", "candidate_id")).alias("event_id")).distinct()
        wanted = descriptor.withColumn("event_id", F.col("event_id").cast("string")).join(ids, "event_id", "left_semi")
        points = materialize(event_track_points(wanted, mapping, best_track), "track-points")
        row = mean_errors(pair_errors(pairs, points)).first()
        errors = {n: row[n] for n in physical}
    else:
        errors = dict.fromkeys(physical)
    gated = metrics.withColumns({n: F.lit(v).cast("double") for n, v in errors.items()}).withColumns(promotion_gates())
    return gated.first().asDict()
