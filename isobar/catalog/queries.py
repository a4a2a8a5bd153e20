"""Registered queries: each runs operators of the package over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.catalog import tables as t
from isobar.functions import scalars as s
from isobar.functions.vectors import block, l2_norm, squared_l2
from isobar.operators import (
    boosting,
    anchor,
    blend,
    bootstrap,
    features,
    fusion,
    graph,
    groundtruth,
    knn,
    metrics,
    ordering,
    physical,
    pooling,
    ranker,
    temporal,
)
from isobar.plans import contract, offline, online, retrieval, studies
from isobar.session import materialize
from isobar.sources import archive as archives

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(value: Column | str, digits: int = 6) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    rounded = F.round(value.cast("double"), digits)
    return F.when(rounded == 0.0, F.lit(0.0)).otherwise(rounded)  # zero without a sign


def steady(value: Column | str, digits: int = 5) -> Column:
    """Rounded away from exact halves, which averages of two-decimal values often hit."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value + F.lit(1e-9), digits)


def big(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("long")


# --- vectors and nearest neighbours -------------------------------------------------------------


@query
def knn_topk_excl_group(spark, sf):
    rows = t.vectors(spark, sf)
    hits = knn.VectorIndex.fit(rows).search(rows, 20, id_col="candidate_id")
    return hits.select("query_id", "candidate_id", big("rank").alias("rank"), r6("distance").alias("distance"))


@query
def knn_topk_shuffled(spark, sf):
    """Sixteen cells, pruned by the bound, and an index that is shuffled and not broadcast."""
    rows = t.vectors(spark, sf)
    hits = knn.VectorIndex.fit(rows, cells=16, block_rows=64).search(rows, 20, id_col="candidate_id", broadcast_bytes=0)
    return hits.select("query_id", "candidate_id", big("rank").alias("rank"), r6("distance").alias("distance"))


@query
def knn_distance_profile(spark, sf):
    """Distances of the neighbours, measured again by the column expression."""
    v = t.vectors(spark, sf).select("candidate_id", "vector")
    hits = t.neighbours(spark, sf, "context", t.CHANNEL_K["context"])
    pairs = hits.join(v, "candidate_id").join(
        v.select(F.col("candidate_id").alias("query_id"), F.col("vector").alias("query_vector")), "query_id"
    )
    d = squared_l2("query_vector", "vector")
    return pairs.groupBy("query_id").agg(
        r6(F.min(d)).alias("min_distance"),
        r6(F.avg(d)).alias("avg_distance"),
        r6(F.max(d)).alias("max_distance"),
        big(F.count(F.lit(1))).alias("neighbours"),
    )


@query
def knn_ivf(spark, sf):
    """Approximate mode: only the nearest cells are visited."""
    rows = t.vectors(spark, sf)
    index = knn.VectorIndex.fit(rows, backend="ivf", cells=16, nprobe=6)
    hits = index.search(rows, 20, id_col="candidate_id")
    return hits.select("query_id", "candidate_id", big("rank").alias("rank"), r6("distance").alias("distance"))


@query
def vector_block_norms(spark, sf):
    rows = t.vectors(spark, sf)
    blocks = F.array(*[F.struct(F.lit(i).alias("b"), l2_norm(block("vector", i, 16)).alias("n")) for i in range(4)])
    return rows.select("vec_id", l2_norm("vector").alias("whole"), F.explode(blocks).alias("x")).select(
        "vec_id", big("x.b").alias("block"), r6("x.n").alias("block_norm"), r6("whole").alias("vector_norm")
    )


@query
def vector_mean_pool_by_group(spark, sf):
    pooled = pooling.mean_vectors(t.vectors(spark, sf), ["group_id"])
    return pooled.select("group_id", "pooled_rows", F.posexplode("vector").alias("position", "v")).select(
        "group_id", big("pooled_rows").alias("pooled_rows"), big("position").alias("position"), r6("v").alias("value")
    )


@query
def vector_contract_check(spark, sf):
    report = archives.contract_report(t.archive(spark, sf), expected_dim=64, bucket_rows=100)
    epoch = lambda c: big(s.micros(c) / 1_000_000)
    return report.select(
        *[big(c).alias(c) for c in report.columns if not c.startswith("time_")],
        epoch("time_coverage_start").alias("first_start"),
        epoch("time_coverage_end").alias("last_end"),
    )


# --- archive views, intervals and pooling -------------------------------------------------------


def _hourly(spark, sf):
    return t.table(spark, sf, "events").select(
        "event_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("start_ts")
    )


@query
def cadence_view_6h(spark, sf):
    return archives.view(_hourly(spark, sf), "6h").select("event_id", "slot")


@query
def cadence_view_24h(spark, sf):
    return archives.view(_hourly(spark, sf), "daily").select("event_id", "slot")


@query
def event_interval_join(spark, sf):
    joined = pooling.interval_join(
        t.archive(spark, sf).select("row_id", F.col("start_ts").alias("at")),
        t.event_windows(spark, sf).select("event_id", "start_ts", "end_ts"),
        time="at", start="start_ts", end="end_ts",
    )
    return joined.groupBy("event_id").agg(
        big(F.count(F.lit(1))).alias("rows_covered"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row")
    )


@query
def event_vectors_pooled(spark, sf):
    rows = t.pooled_events(spark, sf)
    return rows.select(
        "event_id",
        big("pooled_rows").alias("pooled_rows"),
        r6(F.col("vector")[0], 5).alias("v0"),
        r6(F.col("vector")[31], 5).alias("v31"),
        r6(F.col("vector")[63], 5).alias("v63"),
        r6(l2_norm("vector"), 5).alias("norm"),
        # Every value counts, at its place.
        r6(F.aggregate(F.transform("vector", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x), 3).alias("weighted_sum"),
    )


# --- temporal operators -------------------------------------------------------------------------


def _pool_windows(spark, sf):
    w = t.vector_windows(spark, sf).drop("group_id")
    return t.pool(spark, sf).select("query_id", "candidate_id", "pool_rank").join(w, "candidate_id")


@query
def temporal_overlap_pairs(spark, sf):
    mine = t.vector_windows(spark, sf).select(
        F.col("candidate_id").alias("query_id"),
        F.col("time_coverage_start").alias("qs"),
        F.col("time_coverage_end").alias("qe"),
    )
    rows = _pool_windows(spark, sf).join(mine, "query_id")
    ratio = s.temporal_overlap("qs", "qe", "time_coverage_start", "time_coverage_end")
    return rows.select("query_id", "candidate_id", ratio.alias("o")).select(
        "query_id",
        "candidate_id",
        r6("o.intersection_hours").alias("intersection_hours"),
        r6("o.overlap_ratio_min").alias("overlap_ratio_min"),
        r6("o.overlap_ratio_union").alias("overlap_ratio_union"),
    )


FLAGS = ("kept", "overlap_suppressed", "start_proximity_suppressed")


@query
def early_temporal_nms_pool(spark, sf):
    marked = temporal.early_temporal_nms(
        _pool_windows(spark, sf), start_time_delta_hours=12.0, group_limit=t.POOL_LIMIT
    )
    return marked.select("query_id", "candidate_id", *[F.col(f).cast("int").alias(f) for f in FLAGS])


def _event_ranks(spark, sf):
    return t.event_windows(spark, sf).withColumn("rank", F.round(F.col("value") * -100).cast("long"))


def _suppressed(spark, sf, keys, delta, threshold=0.5):
    return temporal.early_temporal_nms(
        _event_ranks(spark, sf), overlap_threshold=threshold, start_time_delta_hours=delta, keys=keys, rank="rank",
        candidate="event_id", start="start_ts", end="end_ts",
    )


@query
def early_temporal_nms_events(spark, sf):
    marked = _suppressed(spark, sf, ["user_id"], 12.0)
    return marked.select("event_id", *[F.col(f).cast("int").alias(f) for f in FLAGS])


@query
def early_temporal_nms_overlap_only(spark, sf):
    marked = _suppressed(spark, sf, ["user_id"], None, 0.75)
    return marked.select("event_id", *[F.col(f).cast("int").alias(f) for f in FLAGS])


@query
def early_temporal_nms_scope(spark, sf):
    """One group per event type over the whole table."""
    marked = _suppressed(spark, sf, [], 12.0)
    return marked.select("event_id", *[F.col(f).cast("int").alias(f) for f in FLAGS])


@query
def nms_suppression_reasons(spark, sf):
    summary = temporal.suppression_summary(_suppressed(spark, sf, ["user_id"], 12.0), ["user_id"], event_key="event_type")
    return summary.select(
        "user_id",
        *[big(c).alias(c) for c in ("pre_count", "post_count", "overlap_suppressed", "start_proximity_suppressed")],
        r6("reduction_ratio").alias("reduction_ratio"),
        r6("unique_event_ratio").alias("unique_event_ratio"),
    )


def _event_order(spark, sf):
    return _event_ranks(spark, sf).select("user_id", "event_id", "event_type", "rank")


DEDUP = {"keys": ["user_id"], "order": ("rank", "event_id"), "event_key": "event_type"}


@query
def event_dedup_topk(spark, sf):
    kept = temporal.deduplicate_events(_event_order(spark, sf), top_k=3, **DEDUP)
    return kept.select("user_id", "event_id", big("dedup_rank").alias("dedup_rank"))


@query
def event_dedup_removed(spark, sf):
    return temporal.removed_duplicates(_event_order(spark, sf), top_k=3, **DEDUP).select("user_id", "event_id")


@query
def unique_event_ratio(spark, sf):
    ratio = temporal.unique_event_ratio(t.table(spark, sf, "events"), ["user_id"], event_key="event_type")
    return ratio.select("user_id", r6("unique_event_ratio").alias("unique_event_ratio"))


@query
def diversity_summary(spark, sf):
    """Suppression and unique-event ratio averaged over all query pools."""
    marked = temporal.early_temporal_nms(
        _pool_windows(spark, sf), start_time_delta_hours=12.0, group_limit=t.POOL_LIMIT
    )
    per_query = temporal.suppression_summary(marked, ["query_id"])
    return per_query.agg(
        big(F.count(F.lit(1))).alias("queries"),
        r6(F.avg("reduction_ratio")).alias("early_nms_reduction"),
        r6(F.avg("unique_event_ratio")).alias("unique_event_ratio"),
    )


# --- fusion and exclusions ----------------------------------------------------------------------


@query
def fuse_channels(spark, sf):
    return t.pool(spark, sf).select(
        "query_id",
        "candidate_id",
        *[
            big(c).alias(c)
            for c in (
                "pool_rank", "source_min_rank", "source_rank_gap", "source_event_rank", "source_context_rank",
                "source_metadata_rank", "source_sequence_rank",
            )
        ],
        F.concat_ws("+", "source_membership").alias("membership"),
        r6(F.col("source_distances")["context"]).alias("context_distance"),
        F.col("source_provenance")["event"].alias("event_provenance"),
    )


@query
def fuse_channels_rankless(spark, sf):
    """Three channels of events per user: ranks that are often missing, and candidates that repeat in a channel."""
    rows = t.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("query_id"), F.pmod("event_id", F.lit(20)).cast("string").alias("candidate_id"),
        F.pmod("event_id", F.lit(3)).alias("channel"), "event_id", F.col("value").alias("distance"),
    )
    order = Window.partitionBy("query_id", "channel").orderBy("event_id")
    placed = rows.withColumn("ordinal", F.row_number().over(order)).withColumn(
        "rank", F.when(F.pmod("event_id", F.lit(5)) != 0, F.col("ordinal") + F.pmod("event_id", F.lit(4))).cast("int")
    )
    channels = {n: placed.filter(F.col("channel") == i).drop("channel", "event_id") for i, n in enumerate(("event", "context", "metadata"))}
    fused = fusion.fuse_candidate_channels(channels, limit=15)

    def text(column, cast):
        return F.concat_ws("|", *[F.coalesce(cast(F.col(column)[n]).cast("string"), F.lit("-")) for n in channels])

    return fused.select(
        "query_id", "candidate_id", *[big(c).alias(c) for c in ("pool_rank", "source_min_rank", "source_rank_gap")],
        F.concat_ws("+", "source_membership").alias("membership"), text("source_ranks", lambda c: c).alias("ranks"),
        text("source_distances", lambda c: F.floor(c * 100)).alias("distances"), text("source_provenance", lambda c: c).alias("provenance"),
    )


@query
def fusion_priors(spark, sf):
    names = (
        "rank_inv", "source_event_rank_inv", "source_sequence_rank_inv", "source_min_rank_inv",
        "score_event_rank_prior", "score_pool_rank_prior", "score_context_rank_prior",
    )
    return t.pool(spark, sf).select(
        "query_id",
        "candidate_id",
        *[r6(c).alias(c) for c in names],
        F.col("context_candidate").cast("int").alias("context_candidate"),
        F.coalesce(big("context_rank"), F.lit(0)).alias("context_rank"),
    )


@query
def exclusion_audit(spark, sf):
    rows = t.vectors(spark, sf)
    hits = knn.VectorIndex.fit(rows, group_col="group_id").search(
        rows, 20, id_col="candidate_id", group_col=None, exclude_self=False
    )
    groups = rows.select(F.col("candidate_id").alias("query_id"), F.col("group_id").alias("query_group_id"))
    marked = hits.join(groups, "query_id")
    marked = marked.withColumn("out", fusion.excluded(marked))
    return marked.groupBy("query_id").agg(
        big(F.count_if("out")).alias("excluded"),
        big(F.count_if(~F.col("out"))).alias("eligible"),
        big(F.sum(F.when(F.col("out"), F.col("candidate_id").cast("long")))).alias("excluded_id_sum"),
    )


@query
def metadata_enrichment(spark, sf):
    """Channel rows joined with archive metadata; values already present win."""
    hits = t.neighbours(spark, sf, "event", t.CHANNEL_K["event"]).withColumn(
        "group_id", F.when(F.col("rank") <= 5, F.lit("own")).otherwise(F.lit(None).cast("string"))
    )
    meta = t.vector_windows(spark, sf).select("candidate_id", "group_id", "event_type")
    return fusion.enrich(hits, meta).select("query_id", "candidate_id", "group_id", "event_type")


# --- ranks, features and standardisation --------------------------------------------------------


def _messy_ranks(spark, sf):
    k = F.get_json_object("props", "$.k")
    e = F.col("event_id")
    text = F.when(F.pmod(e, F.lit(7)) == 0, F.lit("n/a")).when(F.pmod(e, F.lit(11)) == 0, F.lit("-3")).otherwise(k)
    return t.table(spark, sf, "events").select("event_id", text.alias("source_min_rank"))


@query
def rank_reciprocals(spark, sf):
    rows = features.add_derived_features(features.add_reciprocal_ranks(_messy_ranks(spark, sf)))
    return rows.select(
        "event_id",
        r6(s.number("source_min_rank")).alias("source_min_rank"),
        r6("source_min_rank_inv").alias("source_min_rank_inv"),
        r6("source_min_rank_inv_safe").alias("source_min_rank_inv_safe"),
    )


@query
def score_sum_diff(spark, sf):
    rows = features.add_derived_features(t.pool(spark, sf))
    return rows.select(
        "query_id", "candidate_id",
        r6("score_final_minus_calibrated").alias("score_diff"), r6("score_final_plus_calibrated").alias("score_sum"),
    )


@query
def query_zscore(spark, sf):
    rows = t.table(spark, sf, "events").withColumn("flat", F.lit(3.0))
    scored = features.group_z(rows, {"value_z": "value", "flat_z": "flat"}, ["user_id"])
    return scored.select("event_id", r6("value_z", 4).alias("value_z"), r6("flat_z", 4).alias("flat_z"))


@query
def train_median_fill(spark, sf):
    """Training medians and the number of cells they fill, per model input."""
    rows = t.features(spark, sf)
    fill = features.train_medians(rows.filter("split = 'train'"), contract.FEATURE_NAMES)
    filled = features.filled_columns(contract.FEATURE_NAMES, fill)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), F.lit(fill[c]).alias("median"),
                s.number(c).isNull().alias("missing"), filled[c].cast("double").alias("v"),
            )
            for c in contract.FEATURE_NAMES
        ]
    )
    return (
        rows.select(F.explode(cells).alias("c"))
        .select("c.*")
        .groupBy("feature", "median")
        .agg(big(F.count_if("missing")).alias("filled"), r6(F.avg("v"), 5).alias("mean_input"))
        .select("feature", r6("median", 5).alias("median"), "filled", "mean_input")
    )


@query
def feature_table(spark, sf):
    """All model inputs of every candidate row."""
    return t.features(spark, sf).select(
        "query_id", "candidate_id", *[r6(s.number(c), 4).alias(c) for c in contract.FEATURE_NAMES]
    )


@query
def candidate_group_sizes(spark, sf):
    rows = t.pool(spark, sf)
    sizes = features.group_sizes(rows)
    positives = metrics.relevance_pairs(rows).groupBy("query_id").agg(big(F.count(F.lit(1))).alias("positives"))
    return sizes.join(positives, "query_id", "left").select(
        "query_id", big("group_size").alias("group_size"), F.coalesce("positives", F.lit(0).cast("long")).alias("positives")
    )


@query
def graded_labels(spark, sf):
    rows = t.pool(spark, sf)
    return rows.select(
        "query_id", "candidate_id",
        big(features.labels(rows, "binary")).alias("binary_label"), big(features.labels(rows, "graded")).alias("graded_label"),
    )


# --- label graph --------------------------------------------------------------------------------


@query
def label_graph_edges(spark, sf):
    return t.edges(spark, sf).select(
        "train_query", "candidate_id", r6("weight").alias("weight"), r6("seed_weight").alias("seed_weight")
    )


@query
def label_graph_counts(spark, sf):
    counts = graph.graph_counts(t.edges(spark, sf))
    return counts.select(*[big(c).alias(c) for c in counts.columns])


@query
def label_graph_scores(spark, sf):
    rows = graph.add_graph_features(features.add_derived_features(t.pool(spark, sf)), t.edges(spark, sf))
    names = [n for n, _, _ in graph.GRAPH_CONFIGS]
    return rows.select(
        "query_id", "candidate_id", *[r6(n, 5).alias(n) for n in (*names, "graph_max", "graph_mean")]
    )


@query
def label_graph_digest(spark, sf):
    return contract.graph_digest(t.edges(spark, sf))


# --- blending and anchors -----------------------------------------------------------------------


@query
def blend_top20(spark, sf):
    top = blend.rank_proposals(t.scored(spark, sf).drop("rank"))
    return top.select("query_id", "candidate_id", big("rank").alias("rank"), r6("score", 4).alias("score"))


def _merged(spark, sf, keep, tail=21):
    proposal = blend.rank_proposals(t.scored(spark, sf).drop("rank"))
    merged = anchor.anchor_merge(t.anchors(spark, sf), proposal, keep_top=keep, tail_from=tail)
    return merged.select("query_id", "candidate_id", big("rank").alias("rank"), "anchor_source")


@query
def anchor_merge_keep0(spark, sf):
    return _merged(spark, sf, 0)


@query
def anchor_merge_keep1(spark, sf):
    return _merged(spark, sf, 1)


@query
def anchor_merge_keep3(spark, sf):
    return _merged(spark, sf, 3)


@query
def anchor_merge_keep5(spark, sf):
    return _merged(spark, sf, 5)


@query
def anchor_merge_tail11(spark, sf):
    return _merged(spark, sf, 3, 11)


def _online(spark, sf):
    model, edges = t.ContextPriorModel, t.edges(spark, sf)
    ranked, _ = online.rank_online(
        t.pool(spark, sf).drop("rank"), t.anchors(spark, sf), model, edges,
        feature_columns=contract.FEATURE_NAMES, fill=dict.fromkeys(contract.FEATURE_NAMES, 0.0),
        manifest=contract.build_manifest(model, edges),
    )
    return ranked


@query
def online_top20(spark, sf):
    return _online(spark, sf).select(
        "query_id", "candidate_id", big("rank").alias("rank"), r6("score", 4).alias("score"), "anchor_source",
        F.col("uses_test_for_tuning").cast("int").alias("uses_test_for_tuning"), "selected_profile",
    )


# --- metrics and selection ----------------------------------------------------------------------


def _per_query(spark, sf):
    ranked = _merged(spark, sf, 5)
    return metrics.query_metrics(ranked, metrics.relevance_pairs(t.pool(spark, sf)))


@query
def ranking_metrics(spark, sf):
    return _per_query(spark, sf).select("query_id", *[r6(m).alias(m) for m in metrics.METRICS])


@query
def ranking_metrics_fixed_denominator(spark, sf):
    per_query = metrics.query_metrics(
        _merged(spark, sf, 5), metrics.relevance_pairs(t.pool(spark, sf)), denominator="fixed"
    )
    return per_query.select("query_id", r6("recall_at_10").alias("recall_at_10"), r6("recall_at_20").alias("recall_at_20"))


@query
def macro_ranking_metrics(spark, sf):
    macro = metrics.macro_metrics(_per_query(spark, sf)).withColumn("composite", metrics.composite())
    return macro.select(
        *[r6(m).alias(m) for m in (*metrics.METRICS, "composite")], big("query_count").alias("query_count")
    )


@query
def continuous_ndcg(spark, sf):
    rows = t.table(spark, sf, "events").select(
        "user_id", "event_id", F.pmod(F.col("event_id") * 37, F.lit(101)).cast("double").alias("score"),
        (F.col("value") % 5.0).alias("relevance"),
    )
    scored = metrics.continuous_ndcg(rows, keys=["user_id"], position="event_id")
    return scored.select("user_id", r6("ndcg").alias("ndcg"))


def _matched(spark, sf):
    rows = t.pool(spark, sf).withColumn("score", F.col("score_context_rank_prior") + F.col("rank_inv"))
    relevant = t.truth(spark, sf).select("query_id", "candidate_id")
    arms = {}
    for name, part in (("backend", rows.filter(F.array_contains("source_membership", "event"))), ("full", rows)):
        arms[name] = metrics.ranked_binary_metrics(part, relevant).select(
            "query_id", F.col("ndcg").alias(f"{name}_ndcg"), F.col("relevant_at_k").alias(f"{name}_relevant")
        )
    return arms["backend"].join(arms["full"], "query_id")


@query
def matched_scoring_pair(spark, sf):
    pairs = _matched(spark, sf)
    return pairs.select(
        "query_id",
        *[r6(f"{a}_ndcg").alias(f"{a}_ndcg") for a in ("backend", "full")],
        *[big(f"{a}_relevant").alias(f"{a}_relevant") for a in ("backend", "full")],
    )


@query
def matched_pool_contract(spark, sf):
    """Backend pool inside the full pool, counted by anti-joins."""
    full = t.pool(spark, sf).select("query_id", "candidate_id")
    short = t.neighbours(spark, sf, "event", 40).filter("rank <= 20").select("query_id", "candidate_id")
    outside = short.join(full, ["query_id", "candidate_id"], "left_anti")
    unused = full.join(short, ["query_id", "candidate_id"], "left_anti")
    return (
        outside.select(F.lit("backend_outside_full").alias("check"))
        .unionByName(unused.select(F.lit("full_not_in_backend").alias("check")))
        .groupBy("check")
        .agg(big(F.count(F.lit(1))).alias("rows"))
    )


def _ledger(spark, sf):
    def build():
        rows = t.features(spark, sf).filter("split = 'validation'").withColumns(
            {f"score_{n}": m.score_column() for n, m in t.MODELS.items()}
        )
        return offline.ledger(
            rows.drop("rank"), t.anchors(spark, sf), metrics.relevance_pairs(rows),
            models={n: f"score_{n}" for n in t.MODELS},
        )

    return t.shared(spark, sf, "ledger", build)


@query
def profile_grid_ledger(spark, sf):
    return _ledger(spark, sf).select(
        "profile", big("keep_top").alias("keep_top"), *[r6(m).alias(m) for m in (*metrics.METRICS, "composite")],
        big("query_count").alias("query_count"),
    )


@query
def profile_selection(spark, sf):
    floors = {"ndcg_at_10": 0.1, "map_at_10": 0.02, "recall_at_10": 0.05, "recall_at_20": 0.05}
    strict = offline.select_profile(_ledger(spark, sf)).withColumn("rule", F.lit("published_floors"))
    relaxed = offline.select_profile(_ledger(spark, sf), floors=floors).withColumn("rule", F.lit("relaxed_floors"))
    return strict.unionByName(relaxed).select(
        "rule", F.col("passes_floors").cast("int").alias("passes_floors"), r6("recall_at_20").alias("recall_at_20"),
        r6("composite").alias("composite"), r6("map_at_10").alias("map_at_10"),
    )


@query
def promotion_gates(spark, sf):
    """Gates of every ledger row against the published limits and against reachable ones."""
    easy = {**dict.fromkeys(metrics.METRICS, 0.08), "track_rmse_km": 900.0, "landfall_dist_km": 900.0}
    rows = _ledger(spark, sf).withColumns({"track_rmse_km": F.lit(800.0), "landfall_dist_km": F.lit(700.0)})
    easy_gates = metrics.promotion_gates(easy, easy)
    return rows.withColumns(
        {**metrics.promotion_gates(), "reachable_pass": easy_gates["strict_promotion_pass"]}
    ).select(
        "profile",
        *[F.col(c).cast("int").alias(c) for c in ("strict_promotion_pass", "hard_target_pass", "reachable_pass")],
    )


# --- physical errors and ground truth -----------------------------------------------------------


@query
def haversine_pairs(spark, sf):
    points = t.table(spark, sf, "events").select(
        "event_id", (F.lit(10.0) + F.col("value") % 30.0).alias("lat"),
        (F.lit(100.0) + F.pmod("event_id", F.lit(50))).alias("lon"),
    )
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("anchor"), s.haversine_km("lat", "lon", F.lit(a), F.lit(b)).alias("km"))
            for i, (a, b) in enumerate(physical.COAST_ANCHORS)
        ]
    )
    return points.select("event_id", F.explode(cells).alias("c")).select(
        "event_id", big("c.anchor").alias("anchor"), r6("c.km", 5).alias("km")
    )


@query
def track_resample_16(spark, sf):
    sampled = physical.resample_tracks(t.track_points(spark, sf))
    return sampled.select(
        "event_id", big("sample").alias("sample"), *[steady(v).alias(v) for v in physical.VARIABLES]
    )


@query
def landfall_argmin(spark, sf):
    best = physical.landfall_points(t.track_points(spark, sf))
    return best.select("event_id", *[steady(c).alias(c) for c in best.columns if c != "event_id"])


def _descriptor(spark, sf):
    """Windows of the (user, type) events; purchase events get one before any track point."""
    points = t.track_points(spark, sf)
    windows = points.groupBy("event_id", "tc_id").agg(
        F.min("time_utc").alias("window_start"), F.max("time_utc").alias("window_end")
    )
    early = F.col("event_id").endswith("-purchase")
    shift = F.expr("INTERVAL 1000 DAYS")
    return windows.withColumns(
        {c: F.when(early, F.col(c) - shift).otherwise(F.col(c)) for c in ("window_start", "window_end")}
    )


def _mapping(spark, sf):
    return t.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("tracklet_id"), F.col("user_id").cast("string").alias("tc_id"),
        F.col("event_id").alias("row_order"),
    )


@query
def event_track_windows(spark, sf):
    points = physical.event_track_points(
        _descriptor(spark, sf), _mapping(spark, sf), t.track_points(spark, sf).drop("event_id")
    )
    return points.groupBy("event_id").agg(
        big(F.count(F.lit(1))).alias("points"), steady(F.sum("lat")).alias("lat_sum"), steady(F.avg("pres")).alias("pres_mean")
    )


def _summaries(spark, sf):
    return groundtruth.track_summaries(t.track_points(spark, sf), ["event_id", "tc_id"])


def _g20(spark, sf):
    return t.shared(spark, sf, "g20", lambda: groundtruth.ground_truth(_summaries(spark, sf)))


@query
def g20_ground_truth(spark, sf):
    truth = groundtruth.ground_truth(_summaries(spark, sf))
    return truth.select("query_id", "candidate_id", big("rank").alias("rank"), r6("distance", 5).alias("distance"))


def _errors(spark, sf):
    return physical.pair_errors(physical.top_one(_g20(spark, sf)), t.track_points(spark, sf))


@query
def track_errors_top1(spark, sf):
    errors = _errors(spark, sf)
    return errors.select(
        "query_id", "candidate_id", *[steady(c).alias(c) for c in physical.ERROR_LABELS]
    )


@query
def mean_physical_errors(spark, sf):
    means = physical.mean_errors(_errors(spark, sf))
    return means.select(*[steady(c).alias(c) for c in physical.ERROR_LABELS])


# --- folds, seeds, bootstrap and studies --------------------------------------------------------


def _paired(spark, sf):
    """Per-user mean of views against the mean of all events, with a fold by user."""
    rows = t.table(spark, sf, "events")
    return rows.groupBy("user_id").agg(
        F.avg("value").alias("baseline"),
        F.coalesce(F.avg(F.when(F.col("event_type") == "view", F.col("value"))), F.lit(0.0)).alias("proposed"),
        F.pmod(F.first("user_id"), F.lit(3)).alias("fold"),
    )


@query
def fold_deltas(spark, sf):
    rows = bootstrap.fold_deltas(_paired(spark, sf), baseline="baseline", proposed="proposed")
    return rows.select(
        "fold", r6("mean_delta").alias("mean_delta"), big("query_count").alias("query_count"),
        (F.col("mean_delta") > 0).cast("int").alias("positive"),
    )


@query
def fold_window_contract(spark, sf):
    """Ten-day folds: train on all earlier events, evaluate inside the fold."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    offset = F.datediff(day, F.lit("2024-01-01"))
    rows = t.table(spark, sf, "events").withColumn("fold", F.floor(offset / 10).cast("long"))
    folds = rows.groupBy("fold").agg(F.min("ts").alias("evaluation_start"), F.max("ts").alias("evaluation_end"))
    previous = folds.select((F.col("fold") + 1).alias("fold"), F.col("evaluation_end").alias("train_end"))
    report = studies.fold_contract(folds.join(previous, "fold"))
    return report.select(*[big(c).alias(c) for c in report.columns])


@query
def seed_sd(spark, sf):
    """Event types as seeds: mean and population deviation of the per-seed means over users."""
    per_user = t.table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("v"))
    per_seed = per_user.groupBy("event_type").agg(F.avg("v").alias("m"))
    return per_seed.agg(
        big(F.count(F.lit(1))).alias("seeds"), r6(F.avg("m")).alias("seed_mean"), r6(F.stddev_pop("m")).alias("seed_sd")
    )


def _interval(frame: DataFrame) -> DataFrame:
    return frame.select(
        *[r6(c).alias(c) for c in ("estimate", "lower", "upper", "confidence")],
        big("query_count").alias("query_count"), big("resamples").alias("resamples"),
    )


@query
def paired_bootstrap_hash(spark, sf):
    return _interval(
        bootstrap.paired_bootstrap(
            _paired(spark, sf), baseline="baseline", proposed="proposed", order="user_id", seed=7, block_rows=32
        )
    )


@query
def bootstrap_resamples(spark, sf):
    """Every resample draws as many rows as there are, over blocks of sixteen."""
    gaps = _paired(spark, sf).select(F.col("user_id").alias("k"), (F.col("proposed") - F.col("baseline")).alias("d"))
    means = bootstrap.resample_means(gaps, 400, 7, block_rows=16)
    return means.select("resample", "draws", r6("mean").alias("mean_difference"))


def _report(spark, found: dict, names: dict[str, str]) -> DataFrame:
    """A study result as one row; interval ends and means are rounded, counts are integers."""
    values = {**found, **found["paired_bootstrap"], "folds_positive": int(found.get("all_temporal_folds_positive", 0))}
    row = {out: int(values[name]) if kind == "long" else round(float(values[name]), 6) for name, (out, kind) in names.items()}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{out} {kind}" for out, kind in names.values()))


INTERVAL = {"query_count": ("query_count", "long"), "estimate": ("estimate", "double"), "lower": ("lower", "double"), "upper": ("upper", "double"), "resamples": ("resamples", "long")}
FOLDS = {"temporal_fold_count": ("folds", "long"), "folds_positive": ("folds_positive", "long")}


@query
def study_portability(spark, sf):
    """Users as queries, event types as model seeds, events as positions."""
    rows = t.table(spark, sf, "events").withColumn("seed", F.col("event_type")).select(
        F.col("user_id").cast("string").alias("query_id"), F.pmod("user_id", F.lit(3)).alias("fold"), "seed", F.col("event_id").alias("position"),
        (F.col("value") % 3.0).alias("relevance"), F.pmod(F.col("event_id") * 37, F.lit(101)).cast("double").alias("control"),
        (F.col("value") % 7.0).alias("system"),
    )
    found = studies.portability(rows, control="control", system="system", seed=7)
    names = {**INTERVAL, **FOLDS, "control_mean": ("control_mean", "double"), "system_mean": ("system_mean", "double"), "model_seed_count": ("seeds", "long")}
    return _report(spark, found, names)


@query
def study_matched_scoring(spark, sf):
    """The event channel's part of the fused pool against the whole pool, under one score."""
    pool = t.pool(spark, sf).select(
        "query_id", "candidate_id", (F.col("score_context_rank_prior") + F.col("rank_inv")).alias("score"),
        F.array_contains("source_membership", "event").alias("in_backend"),
    )
    truth = t.truth(spark, sf).select("query_id", "candidate_id")
    found = studies.matched_scoring(pool, truth, full_size=t.POOL_LIMIT, relevant_size=t.TRUTH_K, seed=7)
    names = {**INTERVAL, "backend_mean": ("backend_mean", "double"), "full_system_mean": ("full_mean", "double"),
             "backend_relevant_at_20": ("backend_relevant", "double"), "full_system_relevant_at_20": ("full_relevant", "double")}
    return _report(spark, found, names)


@query
def study_physical_ablation(spark, sf):
    """Users as queries in three folds, each evaluated from its first event on."""
    events = t.table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    views = F.coalesce(F.avg(F.when(F.col("event_type") == "view", F.col("value"))), F.lit(0.0))
    users = events.groupBy("user_id").agg(F.avg("value").alias("a"), views.alias("v"), F.max("at").alias("at"))
    queries = users.select(
        F.col("user_id").cast("string").alias("query_id"), F.col("at").cast("string").alias("timestamp"),
        F.pmod("user_id", F.lit(3)).cast("string").alias("fold"), (F.col("a") / (F.col("a") + 100)).alias("baseline_ndcg10"),
        (F.col("v") / (F.col("v") + 100)).alias("system_ndcg10"), (F.col("a") * 10).alias("baseline_top1_track_error_km"),
        (F.col("v") * 5).alias("system_top1_track_error_km"),
    )
    folds = users.groupBy(F.pmod("user_id", F.lit(3)).cast("string").alias("fold")).agg(
        F.min("at").alias("evaluation_start"), F.max("at").alias("evaluation_end")
    ).withColumn("train_end", F.col("evaluation_start") - F.expr("INTERVAL 1 HOUR"))
    found = studies.physical_ablation(queries, folds, seed=7)
    names = {**INTERVAL, **FOLDS, "baseline_mean": ("baseline_mean", "double"), "system_mean": ("system_mean", "double"),
             "top1_track_rmse_reduction_km": ("reduction_km", "double")}
    return _report(spark, found, names)


@query
def study_json_explode(spark, sf):
    """Nested JSON built from the rows of a user, parsed under an explicit schema and exploded."""
    entry = T.ArrayType(T.StructType().add("k", T.LongType()).add("t", T.StringType()))
    rows = t.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("["), F.regexp_replace("props", r"\}$", F.concat(F.lit(', "t": "'), "event_type", F.lit('"}'))), F.lit("]")).alias("j")
    )
    parsed = rows.select("event_id", F.explode(F.from_json("j", entry)).alias("x"))
    return parsed.groupBy(F.col("x.t").alias("event_type")).agg(
        big(F.count(F.lit(1))).alias("n"), big(F.sum("x.k")).alias("k_sum")
    )


@query
def portability_pairs(spark, sf):
    """Continuous nDCG of two score vectors per user and seed, averaged over seeds."""
    rows = t.table(spark, sf, "events").select(
        "user_id", F.col("event_type").alias("seed"), "event_id", (F.col("value") % 3.0).alias("relevance"),
        F.pmod(F.col("event_id") * 37, F.lit(101)).cast("double").alias("control"),
        (F.col("value") % 7.0).alias("system"),
    )
    arms = [
        metrics.continuous_ndcg(rows, keys=["user_id", "seed"], score=a, position="event_id")
        .groupBy("user_id").agg(r6(F.avg("ndcg")).alias(a))
        for a in ("control", "system")
    ]
    return arms[0].join(arms[1], "user_id")


@query
def dense_positions(spark, sf):
    """Row numbers of whole groups without ordering a group in one task."""
    rows = t.table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    numbered = ordering.ordinal(rows, ["event_type"], ["at", "event_id"], name="place", total="group_rows")
    return numbered.select("event_id", big("place").alias("place"), big("group_rows").alias("group_rows"))


# --- learned rankers and whole plans ------------------------------------------------------------


def _gradients(spark, sf, spec_position: int, mode: str):
    """One boosting step over all pools: directions and curvatures from the pool-rank prior as the score."""
    rows = t.pool(spark, sf)
    pool = rows.select("query_id", "candidate_id", features.labels(rows, mode).alias("label"), F.col("score_pool_rank_prior").alias("score"))
    found = ranker.gradient_table(pool, ranker.MODEL_SPECS[spec_position])
    return found.select("query_id", "candidate_id", r6("step", 5).alias("step"), r6("curve", 5).alias("curve"))


@query
def lambdarank_gradients(spark, sf):
    return _gradients(spark, sf, 0, "binary")


@query
def lambdarank_gradients_graded(spark, sf):
    return _gradients(spark, sf, 1, "graded")


RANKS = ("pool_rank", "source_min_rank", "source_rank_gap", "source_event_rank", "source_context_rank", "source_metadata_rank")


@query
def classifier_first_step(spark, sf):
    """Class weights of the balanced classifier, and its first residuals, summed per split and class."""
    rows = t.pool(spark, sf)
    labelled = rows.select("split", features.labels(rows, "binary").alias("label"))
    weights = boosting.class_weights(labelled)
    weight = F.when(F.col("label") > 0, weights[1]).otherwise(weights[0])
    first = labelled.select("split", "label", weight.alias("weight"), (weight * (F.col("label") - 0.5)).alias("step"), (weight * 0.25).alias("curve"))
    return first.groupBy("split", "label").agg(
        r6(F.max("weight")).alias("weight"), r6(F.sum("step"), 4).alias("step"), r6(F.sum("curve"), 4).alias("curve"), big(F.count(F.lit(1))).alias("n")
    ).withColumn("label", big("label"))


@query
def leafwise_first_tree(spark, sf):
    """The first tree of the balanced classifier over all pools: splits with their gains, leaves with their values."""
    rows = t.pool(spark, sf)
    ranks = F.array(*[F.coalesce(F.col(c), F.lit(0)).cast("double") for c in RANKS])
    train = rows.select("query_id", "candidate_id", ranks.alias("features"), features.labels(rows, "binary").alias("label"))
    spec = ranker.MODEL_SPECS[2]
    edges = boosting.feature_edges(train, RANKS)
    state = boosting.advance(boosting.pack(train, edges), len(RANKS), boosting.objective_of(spec, train), None, 0.0)
    tree = boosting.grow(materialize(state, "boost-state"), len(RANKS), range(len(RANKS)), edges, 16, spec.min_child)
    nodes = [
        (path, RANKS[f] if f >= 0 else None, float(x) if f >= 0 else None, round(float(g), 3) if f >= 0 else None, round(float(v), 5) if f < 0 else None)
        for path, f, x, g, v in zip(tree.paths(), tree.feature, tree.threshold, tree.gain, tree.value)
    ]
    return spark.createDataFrame(nodes, "node string, feature string, threshold double, gain double, value double")


def _retrieval(spark, sf):
    return t.once(spark, sf, "retrieval", lambda: _run_retrieval(spark, sf))


def _run_retrieval(spark, sf):
    windows = t.vector_windows(spark, sf)
    events = t.channels(spark, sf)
    edges = t.edges(spark, sf)
    return retrieval.run_retrieval(
        archive=t.archive(spark, sf),
        queries=windows.withColumnRenamed("candidate_id", "query_id").drop("event_id"),
        archive_events=windows,
        event_candidates=events["event"].drop("group_id"),
        metadata_candidates=events["metadata"].drop("group_id"),
        anchors=t.anchors(spark, sf),
        model=t.ContextPriorModel,
        edges=edges,
        manifest=contract.build_manifest(t.ContextPriorModel, edges),
        fill=dict.fromkeys(contract.FEATURE_NAMES, 0.0),
        candidate_limit=t.POOL_LIMIT,
        cadence="6h",
        start_time_delta_hours=12.0,
    )


@query
def retrieval_top20(spark, sf):
    return _retrieval(spark, sf).top_k.select(
        "query_id", "candidate_id", big("rank").alias("rank"), r6("score", 4).alias("score")
    )


@query
def audit_receipt(spark, sf):
    return _retrieval(spark, sf).audit.select("query_id", "audit_json", F.col("certified").cast("int").alias("certified"))


@query
def audit_counters(spark, sf):
    """Counters read back from the audit records."""
    paths = {
        "retrieved": "$.context_stage.retrieved_count",
        "fused": "$.candidate_generation.fused_candidate_count",
        "ranker_input": "$.candidate_generation.reranker_candidate_count",
        "survivors": "$.temporal_suppression.post_tnms_count",
        "returned": "$.output.returned_count",
    }
    lists = {
        "overlap_suppressed": "$.temporal_suppression.overlap_suppressed_candidate_ids",
        "start_suppressed": "$.temporal_suppression.start_proximity_suppressed_candidate_ids",
        "excluded": "$.exclusions_and_deduplication.query_and_same_group_exclusion.excluded_candidate_ids",
    }
    rows = _retrieval(spark, sf).audit
    return rows.select(
        "query_id",
        *[F.get_json_object("audit_json", p).cast("long").alias(n) for n, p in paths.items()],
        *[big(F.json_array_length(F.get_json_object("audit_json", p))).alias(n) for n, p in lists.items()],
        F.col("certified").cast("int").alias("certified"),
    )
