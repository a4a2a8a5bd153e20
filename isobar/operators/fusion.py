"""Rank union of several candidate channels with full provenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Channel order, and attributes carried from the first channel that has them.
CHANNEL_PRIORITY = ("event", "context", "metadata")
CARRIED = (
    "event_id",
    "group_id",
    "event_type",
    "event_start_time",
    "event_end_time",
    "time_coverage_start",
    "time_coverage_end",
    "score_final",
    "score_calibrated",
)
# Channels whose rank columns the frozen ranker always expects.
RANKER_CHANNELS = ("event", "sequence")


def channel_order(names: Sequence[str], priority: Sequence[str] = CHANNEL_PRIORITY) -> list[str]:
    return [n for n in priority if n in names] + sorted(n for n in names if n not in priority)


def excluded(
    candidates: DataFrame, *, query_group: str = "query_group_id"
) -> Column:
    """True where a candidate is its own query or shares a known group with it."""
    same_id = F.col("candidate_id").cast("string") == F.col("query_id").cast("string")
    if query_group not in candidates.columns or "group_id" not in candidates.columns:
        return F.coalesce(same_id, F.lit(False))
    same_group = F.col("group_id").cast("string") == F.col(query_group).cast("string")
    return F.coalesce(same_id, F.lit(False)) | F.coalesce(same_group, F.lit(False))


def enrich(rows: DataFrame, metadata: DataFrame, *, overwrite: bool = False) -> DataFrame:
    """Left join of archive metadata on ``candidate_id``.

    Existing values win unless ``overwrite`` is set; columns only one side has are kept as they are.
    """
    shared = [c for c in metadata.columns if c != "candidate_id"]
    renamed = metadata.select("candidate_id", *[F.col(c).alias(f"_m_{c}") for c in shared])
    joined = rows.join(renamed, "candidate_id", "left")
    merged = {}
    for c in shared:
        if c not in rows.columns:
            merged[c] = F.col(f"_m_{c}")
        elif overwrite:
            merged[c] = F.coalesce(f"_m_{c}", c)
        else:
            merged[c] = F.coalesce(c, f"_m_{c}")
    return joined.withColumns(merged).drop(*[f"_m_{c}" for c in shared])


def fuse_candidate_channels(
    channels: Mapping[str, DataFrame],
    *,
    limit: int,
    channel_priority: Sequence[str] = CHANNEL_PRIORITY,
    context_channel: str = "context",
    keys: Sequence[str] = ("query_id",),
) -> DataFrame:
    """Fused pool per query: one row per candidate, the best ``limit`` of them.

    Each channel brings ``candidate_id`` and ``rank`` or ``ordinal`` (its row order from 1, by default the
    rank), and optionally ``distance``, ``provenance`` and carried attributes. A row without a rank has its
    ordinal for one; a row without both fails the job. Channels are stacked and
    folded by one aggregation on (query, candidate), not joined one by one.
    """
    keys = list(keys)
    names = channel_order(list(channels), channel_priority)
    if not names:
        raise ValueError("at least one channel is needed")
    carried = [c for c in CARRIED if any(c in df.columns for df in channels.values())]
    types = {c: df.schema[c].dataType for c in carried for df in channels.values() if c in df.columns}

    def stack(position: int, name: str) -> DataFrame:
        df = channels[name]
        has = df.columns

        def pick(column: str, kind, default=None):
            value = F.col(column) if column in has else F.lit(default)
            return value.cast(kind)

        who = F.coalesce(*[F.col(c).cast("string") for c in ("candidate_id", "event_id") if c in has])
        ordinal = pick("ordinal", "long")
        rank = F.coalesce(pick("rank", "int"), ordinal.cast("int"))
        checked = F.when(
            F.coalesce(rank, F.lit(0)) <= 0, F.raise_error(F.lit("a source row needs a positive rank or ordinal")).cast("int")
        ).otherwise(rank)
        return df.select(
            *keys,
            F.when(
                F.coalesce(who, F.lit("")) == "", F.raise_error(F.lit("a candidate id is required")).cast("string")
            ).otherwise(who).alias("candidate_id"),
            F.lit(position).alias("_channel"),
            checked.alias("_rank"),
            F.coalesce(ordinal, rank.cast("long")).alias("_ordinal"),
            pick("distance", "double").alias("_distance"),
            F.coalesce(pick("provenance", "string"), F.lit(f"{name}_candidate_path")).alias("_provenance"),
            *[pick(c, types[c]).alias(c) for c in carried],
        )

    stacked = reduce(DataFrame.unionByName, [stack(i, n) for i, n in enumerate(names)])
    sentinel = limit + 1

    def first_of(position: int, column: str) -> Column:
        """Value on the first row of a channel for this candidate."""
        return F.min_by(
            F.when(F.col("_channel") == position, F.col(column)),
            F.when(F.col("_channel") == position, F.col("_ordinal")),
        )

    folded = stacked.groupBy(*keys, "candidate_id").agg(
        *[first_of(i, "_rank").alias(f"_r_{n}") for i, n in enumerate(names)],
        *[first_of(i, "_distance").alias(f"_d_{n}") for i, n in enumerate(names)],
        *[first_of(i, "_provenance").alias(f"_p_{n}") for i, n in enumerate(names)],
        *[
            F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("_channel", "_ordinal"))).alias(c)
            for c in carried
        ],
    )
    present = [F.col(f"_r_{n}") for n in names]
    filled = [F.coalesce(r, F.lit(sentinel)) for r in present]

    def highest(values):
        return F.greatest(*values) if len(values) > 1 else values[0]

    def lowest(values):
        return F.least(*values) if len(values) > 1 else values[0]

    ranked = folded.withColumns(
        {
            "source_min_rank": lowest(present),
            "source_rank_gap": highest(filled) - lowest(filled),
            "_first_channel": F.coalesce(*[F.when(r.isNotNull(), F.lit(i)) for i, r in enumerate(present)]),
            **{f"source_{n}_rank": f for n, f in zip(names, filled, strict=True)},
        }
    )
    order = Window.partitionBy(*keys).orderBy(
        "source_min_rank", "_first_channel", *[f"source_{n}_rank" for n in names], "candidate_id"
    )
    pool = ranked.withColumn("pool_rank", F.row_number().over(order)).filter(F.col("pool_rank") <= limit)

    def as_map(prefix: str) -> Column:
        pairs = F.map_from_arrays(
            F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"{prefix}{n}") for n in names])
        )
        return F.map_filter(pairs, lambda _, v: v.isNotNull())

    context = F.col(f"_r_{context_channel}") if context_channel in names else F.lit(None).cast("int")
    columns = {
        "source_membership": F.filter(
            F.array(*[F.when(F.col(f"_r_{n}").isNotNull(), F.lit(n)) for n in names]), lambda x: x.isNotNull()
        ),
        "source_ranks": as_map("_r_"),
        "source_distances": as_map("_d_"),
        "source_provenance": as_map("_p_"),
        "rank": F.col("pool_rank"),
        **{f"source_{n}_rank": F.lit(sentinel) for n in RANKER_CHANNELS if n not in names},
    }
    fused = pool.withColumns(columns)
    one = F.lit(1.0)
    return fused.withColumns(
        {
            "rank_inv": one / (F.col("pool_rank") + 1),
            "source_event_rank_inv": one / (F.col("source_event_rank") + 1),
            "source_sequence_rank_inv": one / (F.col("source_sequence_rank") + 1),
            "source_min_rank_inv": one / (F.col("source_min_rank") + 1),
            "score_event_rank_prior": one / (F.col("source_event_rank") + 1),
            "score_pool_rank_prior": one / (F.col("pool_rank") + 1),
            "context_candidate": context.isNotNull(),
            "context_rank": context,
            "score_context_rank_prior": one / F.coalesce(context + 1, F.lit(limit + 2)),
            "context_candidate_path": F.lit("upstream"),
            "context_rank_prior_available": context.isNotNull(),
            "context_used_for_candidate_generation": F.lit(True),
            "standalone_direct_context_term_selected": F.lit(False),
        }
    ).drop("_first_channel", *[f"{p}{n}" for p in ("_r_", "_d_", "_p_") for n in names])
