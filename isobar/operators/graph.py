"""Train-label graph: edges from training positives, and propagated candidate scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isobar.functions.scalars import number
from isobar.operators.features import column_z, query_z
from isobar.session import materialize

# Fixed values: (feature name, seeds per query, activated train queries kept).
GRAPH_CONFIGS = (
    ("g18_seed20_cap200", 20, 200),
    ("g19_seed16_cap200", 16, 200),
    ("gwide_seed20_cap500", 20, 500),
    ("gdeep_seed40_cap500", 40, 500),
)
# Weights of the two z-scores that order the seeds, and the normaliser offset.
SEED_FINAL_WEIGHT, SEED_SOURCE_WEIGHT = 0.70, 0.30
NORM_OFFSET = 1e-6
#: A key is heavy if it makes more joined rows than this, and more than this part of all.
HEAVY_ROWS, HEAVY_PARTS = 1 << 17, 4096


def label_graph_edges(train: DataFrame) -> DataFrame:
    """``(train_query, candidate_id, seed_weight, weight)``, one row per positive pair.

    ``weight`` is the best grade weight of the pair, ``seed_weight`` the sum over repeated rows,
    because activation adds a repeated edge once per row.
    """
    positive = train.filter(F.col("is_gt_top20").cast("boolean"))
    grade = F.coalesce(number("grade"), F.lit(1.0)) if "grade" in train.columns else F.lit(1.0)
    graded = positive.select(
        F.col("query_id").cast("string").alias("train_query"),
        F.col("candidate_id").cast("string").alias("candidate_id"),
        grade.alias("grade"),
    )
    top = graded.agg(F.greatest(F.max("grade"), F.lit(1.0)).alias("top")).first()["top"]
    weight = F.lit(1.0) + F.col("grade") / F.lit(top if top is not None else 1.0)
    return (
        graded.withColumn("w", weight)
        .groupBy("train_query", "candidate_id")
        .agg(F.sum("w").alias("seed_weight"), F.max("w").alias("weight"), F.count(F.lit(1)).alias("edge_rows"))
    )


def graph_counts(edges: DataFrame) -> DataFrame:
    return edges.agg(
        F.count_distinct("candidate_id").alias("train_positive_seed_count"),
        F.count_distinct("train_query").alias("train_positive_query_count"),
    )


def heavy_keys(left: DataFrame, right: DataFrame, key: str, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(key, salts) of the keys that make too many rows of the join; fewer than ``HEAVY_PARTS``, whatever the input."""
    count = F.count(F.lit(1))
    load = left.groupBy(key).agg(count.alias("_l")).join(right.groupBy(key).agg(count.alias("_r")), key)
    made = F.col("_l") * F.col("_r")
    total = load.agg(F.sum(made)).first()[0] or 0
    size = max(heavy_rows, -(-total // HEAVY_PARTS))
    return load.filter(made > size).select(key, F.least(F.ceil(made / size), F.col("_l")).cast("int").alias("salts"))


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, *, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Inner join on ``key`` in which no key goes to one task with more than its part of the result.

    Degrees come first. Left rows of a heavy key are dealt over its salts by ``by``, right rows are copied to each of them;
    light keys have one salt. The table of heavy keys is broadcast: it has at most 4,096 rows by construction.
    """
    heavy = F.broadcast(heavy_keys(left, right, key, heavy_rows))
    salts = F.coalesce("salts", F.lit(1))
    dealt = left.join(heavy, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("salts")
    copied = right.join(heavy, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def add_graph_scores(
    pool: DataFrame,
    edges: DataFrame,
    *,
    configs: Sequence[tuple[str, int, int]] = GRAPH_CONFIGS,
    source_feature: str = "source_min_rank_inv_safe",
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Add one propagated score per configuration to every pool row.

    All configurations share one pass: seeds up to the deepest ``seed_k`` are joined to the edges
    once, and the activation of each depth is a conditional sum of the same aggregation. The row
    number under the cap is applied before the shuffle by the planner. Both products with the edges split their heavy
    keys, and what reaches a candidate outside the pool of its query is dropped before it is added up.
    """
    depths = sorted({k for _, k, _ in configs})
    seed_score = (
        F.lit(SEED_FINAL_WEIGHT).cast("float") * column_z(pool.columns, "score_final")
        + F.lit(SEED_SOURCE_WEIGHT).cast("float") * column_z(pool.columns, source_feature)
    )
    scored = pool.select(
        "query_id", F.col("candidate_id").cast("string").alias("candidate_id"), seed_score.alias("s")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("s"), "candidate_id")
    seeds = scored.withColumn("seed_rank", F.row_number().over(order)).filter(F.col("seed_rank") <= depths[-1])
    seeds = materialize(seeds, "seeds")
    activated = (
        spread_join(seeds, edges, "candidate_id", "query_id", heavy_rows=heavy_rows)
        .groupBy("query_id", "train_query")
        .agg(
            *[
                F.sum(
                    F.when(F.col("seed_rank") <= k, F.col("seed_weight") / F.col("seed_rank"))
                ).alias(f"a_{k}")
                for k in depths
            ],
            F.min("seed_rank").alias("first_seed"),
        )
    )
    # Ties keep the order in which train queries were first reached: by seed, then by query.
    per_depth = activated.select(
        "query_id",
        "train_query",
        "first_seed",
        F.explode(F.array(*[F.struct(F.lit(k).alias("depth"), F.col(f"a_{k}").alias("act")) for k in depths])).alias("d"),
    ).select("query_id", "train_query", "first_seed", "d.depth", "d.act").filter("act IS NOT NULL")
    widest = max(cap for _, _, cap in configs)
    best = Window.partitionBy("query_id", "depth").orderBy(F.desc("act"), "first_seed", "train_query")
    capped = per_depth.withColumn("act_rank", F.row_number().over(best)).filter(F.col("act_rank") <= widest)
    weights = {
        name: F.sum(F.when((F.col("depth") == k) & (F.col("act_rank") <= cap), F.col("act")))
        for name, k, cap in configs
    }
    per_query = capped.groupBy("query_id", "train_query").agg(*[w.alias(f"w_{n}") for n, w in weights.items()])
    # The normaliser is a sum over the same query partition, so it costs no further shuffle.
    everything = Window.partitionBy("query_id")
    shares = per_query.select(
        "query_id",
        "train_query",
        *[
            (F.col(f"w_{n}") / (F.sum(f"w_{n}").over(everything) + NORM_OFFSET)).alias(f"w_{n}")
            for n, _, _ in configs
        ],
    )
    targets = edges.select("train_query", "candidate_id", "weight")
    spread = (
        spread_join(materialize(shares, "graph-shares"), targets, "train_query", "query_id", heavy_rows=heavy_rows)
        .join(scored.select("query_id", "candidate_id"), ["query_id", "candidate_id"], "left_semi")
        .groupBy("query_id", "candidate_id")
        .agg(*[F.sum(F.col(f"w_{n}") * F.col("weight")).alias(f"p_{n}") for n, _, _ in configs])
    )
    return (
        pool.withColumn("candidate_id", F.col("candidate_id").cast("string"))
        .join(spread, ["query_id", "candidate_id"], "left")
        .withColumns({n: F.coalesce(F.col(f"p_{n}"), F.lit(0.0)).cast("float") for n, _, _ in configs})
        .drop(*[f"p_{n}" for n, _, _ in configs])
    )


def add_graph_features(
    pool: DataFrame,
    edges: DataFrame,
    *,
    configs: Sequence[tuple[str, int, int]] = GRAPH_CONFIGS,
    source_feature: str = "source_min_rank_inv_safe",
) -> DataFrame:
    """Graph scores, their z-scores, and the maximum and mean over configurations."""
    names = [n for n, _, _ in configs]
    out = add_graph_scores(pool, edges, configs=configs, source_feature=source_feature)
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    out = out.withColumns(
        {
            "graph_max": F.greatest(*names) if len(names) > 1 else F.col(names[0]),
            "graph_mean": (total / F.lit(float(len(names)))).cast("float"),
        }
    )
    return out.withColumns(
        {f"{n}_z": query_z(F.col(n).cast("double")) for n in [*names, "graph_max", "graph_mean"]}
    )
