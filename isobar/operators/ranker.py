"""The searched rankers and the LambdaRank objective; ``boosting`` grows their trees."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class RankerSpec:
    name: str
    label_mode: str
    trees: int
    learning_rate: float
    leaves: int
    min_child: int
    feature_fraction: float
    seed: int
    label_gain: tuple[float, ...] | None = None
    truncation: int = 30


# The three searched models.
MODEL_SPECS = (
    RankerSpec("lgbm_ranker_bin_leaves31_lr04", "binary", 420, 0.04, 31, 45, 0.85, 20262201),
    RankerSpec(
        "lgbm_ranker_grade_leaves63_lr03", "graded", 520, 0.03, 63, 35, 0.90, 20262202,
        label_gain=tuple(float(g) for g in range(12)),
    ),
    RankerSpec("lgbm_binary_graph_balanced", "binary_classifier", 520, 0.035, 63, 40, 0.90, 20262203),
)


def lambda_gradients(scores: np.ndarray, gains: np.ndarray, truncation: int) -> tuple[np.ndarray, np.ndarray]:
    """LambdaRank step direction and curvature of one query.

    Every pair of different gain with at least one row in the first ``truncation`` places pushes by
    the nDCG change of swapping it.
    """
    step, curve = np.zeros(len(scores)), np.zeros(len(scores))
    ideal = np.sort(gains)[::-1][:truncation]
    best = float((ideal / np.log2(np.arange(2, len(ideal) + 2))).sum())
    if best <= 0.0:
        return step, curve
    order = np.argsort(-scores, kind="stable")
    place = np.empty(len(scores), dtype=int)
    place[order] = np.arange(len(scores))
    weight = 1.0 / np.log2(place + 2.0)
    for i in np.flatnonzero(gains > gains.min()):
        worse = np.flatnonzero((gains < gains[i]) & ((place < truncation) | (place[i] < truncation)))
        if not len(worse):
            continue
        lead = scores[i] - scores[worse]
        swing = (gains[i] - gains[worse]) * np.abs(weight[i] - weight[worse]) / best / (0.01 + np.abs(lead))
        doubt = 1.0 / (1.0 + np.exp(np.clip(lead, -50.0, 50.0)))
        push, bend = swing * doubt, swing * doubt * (1.0 - doubt)
        step[i] += push.sum()
        curve[i] += bend.sum()
        step[worse] -= push
        curve[worse] += bend
    total = np.abs(step).sum()
    if total > 0.0:
        step, curve = (v * math.log2(1.0 + total) / total for v in (step, curve))
    return step, curve


def gradient_table(pool: DataFrame, spec: RankerSpec) -> DataFrame:
    """(query_id, candidate_id, step, curve) of rows (query_id, candidate_id, label, score); ties go by candidate id.

    A query's pool has at most as many rows as the candidate limit, so it fits a task.
    """
    gains = np.array(spec.label_gain) if spec.label_gain else 2.0 ** np.arange(32) - 1.0
    truncation = spec.truncation

    def gradients(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("candidate_id")
        step, curve = lambda_gradients(rows["score"].to_numpy(float), gains[rows["label"].to_numpy(int)], truncation)
        return rows[["query_id", "candidate_id"]].assign(step=step, curve=curve)

    return pool.select("query_id", "candidate_id", "label", "score").groupBy("query_id").applyInPandas(
        gradients, "query_id string, candidate_id string, step double, curve double"
    )
