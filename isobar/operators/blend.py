"""Linear blends of standardised scores and the profile grid."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.operators.features import column_z, query_z
from isobar.operators.ordering import top_k

# Grid of model, graph, calibrated and source weights; the base score gets the rest.
MODEL_WEIGHTS = ("0.35", "0.45", "0.55", "0.65")
GRAPH_WEIGHTS = ("0.10", "0.20", "0.30")
CALIBRATED_WEIGHTS = ("0.05", "0.15", "0.25")
SOURCE_WEIGHTS = ("0.0", "0.06")
ANCHOR_KEEPS = (0, 1, 3, 5)
MODEL_ONLY = "lambdarank_only"


@dataclass(frozen=True)
class Blend:
    name: str
    base: float
    model: float
    graph: float
    calibrated: float
    source: float


# The frozen blend and the number of anchors kept with it.
FROZEN_BLEND = Blend("blend_f0.10_m0.45_g0.30_c0.15_s0.00", 0.10, 0.45, 0.30, 0.15, 0.00)
FROZEN_ANCHOR_KEEP = 5


def profile_grid(*, exact: bool = False) -> list[Blend]:
    """Model-only plus every weight combination whose residual is not negative.

    By default the residual is the floating point one, which drops combinations whose exact
    residual is zero but rounds below it; ``exact=True`` decides in rational arithmetic.
    """
    grid = [Blend(MODEL_ONLY, 0.0, 1.0, 0.0, 0.0, 0.0)]
    for texts in product(MODEL_WEIGHTS, GRAPH_WEIGHTS, CALIBRATED_WEIGHTS, SOURCE_WEIGHTS):
        model, graph, calibrated, source = (float(t) for t in texts)
        base = 1.0 - model - graph - calibrated - source
        allowed = 1 - sum(Fraction(t) for t in texts) >= 0 if exact else base >= 0
        if allowed:
            base = max(base, 0.0) if exact else base
            name = f"blend_f{base:.2f}_m{model:.2f}_g{graph:.2f}_c{calibrated:.2f}_s{source:.2f}"
            grid.append(Blend(name, base, model, graph, calibrated, source))
    return grid


def score_terms(df: DataFrame, model_score: str = "model_score") -> DataFrame:
    """Add the five float32 z-scores a blend combines as ``z_*`` columns."""
    source = "source_min_rank_inv_safe" if "source_min_rank_inv_safe" in df.columns else "source_min_rank_inv"
    columns = df.columns
    return df.withColumns(
        {
            "z_base": column_z(columns, "score_final"),
            "z_model": query_z(F.coalesce(F.col(model_score).cast("double"), F.lit(0.0))),
            "z_graph": column_z(columns, "graph_max_z"),
            "z_calibrated": column_z(columns, "score_calibrated"),
            "z_source": column_z(columns, source),
        }
    )


def blend_score(blend: Blend) -> Column:
    """Weighted sum of the ``z_*`` columns in float32."""
    if blend.name == MODEL_ONLY:
        return F.col("z_model")
    terms = (
        ("z_base", blend.base),
        ("z_model", blend.model),
        ("z_graph", blend.graph),
        ("z_calibrated", blend.calibrated),
        ("z_source", blend.source),
    )
    parts = [F.lit(w).cast("float") * F.col(c) for c, w in terms]
    return sum(parts[1:], parts[0])


def rank_proposals(df: DataFrame, score: str = "score", *, k: int = 20, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Top ``k`` per key by descending score; equal scores go by candidate id."""
    return top_k(df, keys, [F.desc(score), F.col("candidate_id")], k)
