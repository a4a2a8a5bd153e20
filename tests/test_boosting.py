"""Leaf-wise trees and exact order statistics against plain Python."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.operators import boosting, quantiles
from isobar.operators.ranker import MODEL_SPECS

SPEC = MODEL_SPECS[2]


def rows_of(rng, queries=12, pool=40):
    out = []
    for q in range(queries):
        for c in range(pool):
            x = [float(rng.integers(0, 30)), float(rng.random()), float(rng.integers(0, 2))]
            out.append((f"q{q}", f"c{c:02d}", int(x[0] + 10 * x[2] + 4 * rng.random() > 25), x))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "query_id string, candidate_id string, label int, features array<double>").repartition(3)


def plain_tree(matrix, g, h, leaves, least):
    """Best-first growth with exact thresholds; {path: (feature, threshold)} and {path: value}."""

    def best(rows):
        found = None
        for f in range(matrix.shape[1]):
            for x in np.unique(matrix[rows, f])[:-1]:
                low = rows[matrix[rows, f] <= x]
                high = np.setdiff1d(rows, low)
                if min(len(low), len(high)) < least or min(h[low].sum(), h[high].sum()) < 1e-3:
                    continue
                gain = g[low].sum() ** 2 / h[low].sum() + g[high].sum() ** 2 / h[high].sum() - g[rows].sum() ** 2 / h[rows].sum()
                if found is None or gain > found[0] + 1e-9:
                    found = gain, f, x, low, high
        return found if found and found[0] > 1e-12 else None

    splits, ends, heap = {}, {"": np.arange(len(g))}, []

    def push(path):
        b = best(ends[path])
        if b:
            heapq.heappush(heap, (-b[0], path, b))

    push("")
    while heap and len(ends) < leaves:
        _, path, (_, f, x, low, high) = heapq.heappop(heap)
        splits[path] = (f, x)
        del ends[path]
        ends[path + "L"], ends[path + "R"] = low, high
        push(path + "L"), push(path + "R")
    return splits, {p: g[r].sum() / h[r].sum() for p, r in ends.items()}


@pytest.mark.parametrize("leaves", [2, 5, 31])
def test_trees_grow_best_first(spark, leaves):
    rows = rows_of(np.random.default_rng(leaves))
    train = table(spark, rows)
    edges = boosting.feature_edges(train, "abc")
    objective = boosting.objective_of(SPEC, train)
    state = boosting.advance(boosting.pack(train, edges), 3, objective, None, 0.0)
    tree = boosting.grow(state, 3, range(3), edges, leaves, 10)
    matrix, y = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    splits, ends = plain_tree(matrix, weight * (y - 0.5), weight * 0.25, leaves, 10)
    paths = tree.paths()
    assert {p: (f, x) for p, f, x in zip(paths, tree.feature, tree.threshold) if f >= 0} == splits
    assert {p: v for p, f, v in zip(paths, tree.feature, tree.value) if f < 0} == pytest.approx(ends, abs=1e-5)


def test_trees_do_not_depend_on_the_deal(spark):
    rows = rows_of(np.random.default_rng(9))
    spec = type(SPEC)(**{**MODEL_SPECS[0].__dict__, "min_child": 5})
    models = [boosting.fit_ranker(table(spark, r), "abc", spec, trees=2) for r in (rows, rows[::-1])]
    assert models[0].sha256() == models[1].sha256() and len(models[0].trees) == 2


def test_nothing_to_learn_gives_no_tree(spark):
    rows = [("q", f"c{i}", 1, [1.0, 2.0]) for i in range(60)]
    model = boosting.fit_ranker(table(spark, rows), "ab", SPEC, trees=3)
    assert model.trees == [] and model.importance("a") == (0, 0.0)
    assert {r["model_score"] for r in model.score(table(spark, rows)).collect()} == {0.5}


def test_gain_of_model_is_the_sum_of_its_splits(spark):
    model = boosting.fit_ranker(table(spark, rows_of(np.random.default_rng(2))), "abc", SPEC, trees=3)
    counted = [model.importance(c) for c in "abc"]
    assert sum(c for c, _ in counted) == sum(int((t.feature >= 0).sum()) for t in model.trees)
    assert sum(g for _, g in counted) == pytest.approx(sum(float(t.gain.sum()) for t in model.trees))


# --- order statistics -------------------------------------------------------------------------------------

COLUMNS = {
    "ties": [7.0] * 990 + [float(i) for i in range(10)],
    "wide": [math.ldexp(1.0, e) * s for e in range(-500, 500) for s in (1, -1)],
    "ends": [float("inf"), float("-inf"), 0.0, -0.0, 5e-324, 1e-323, 1.7e308, -1.7e308],
    "one": [3.5],
    "even": [float(i * i % 1009) for i in range(1000)],
}


def values_of(spark):
    rows = [(n, v) for n, column in COLUMNS.items() for v in column] + [("ties", None), ("one", float("nan")), ("none", None)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "feature string, value double").repartition(4)


@pytest.mark.parametrize("bins", [128, quantiles.BINS])
def test_order_statistics_are_exact(spark, bins):
    ranks = {n: sorted({1, len(c), (len(c) + 1) // 2, max(1, len(c) // 7)}) for n, c in COLUMNS.items()}
    wanted = spark.createDataFrame([(n, r) for n, rs in ranks.items() for r in rs] + [("one", 2), ("none", 1)], "feature string, rank long")
    got = {(r["feature"], r["rank"]): r["value"] for r in quantiles.order_statistics(values_of(spark), wanted, bins).collect()}
    assert got == {(n, r): sorted(COLUMNS[n])[r - 1] for n, rs in ranks.items() for r in rs}


def test_medians_and_edges(spark):
    got = {r["feature"]: r["median"] for r in quantiles.medians(values_of(spark)).collect()}
    assert got["ties"] == 7.0 and got["one"] == 3.5 and got["even"] == float(np.median(COLUMNS["even"])) and "none" not in got
    edges = {r["feature"]: r["edges"] for r in quantiles.quantile_edges(values_of(spark), 4).collect()}
    assert edges["ties"] == [7.0] and edges["even"] == sorted({sorted(COLUMNS["even"])[k - 1] for k in (250, 500, 750)})


def test_a_common_value_is_one_count(spark):
    """99 in 100 rows have one value: once a round has told it from its neighbours, none of them is read again."""
    seen = []
    rows = spark.range(20_000).select(F.lit("x").alias("feature"), F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(F.lit(5)).cast("double").alias("value"))
    original = quantiles.materialize

    def watched(df, label):
        out = original(df, label)
        if label == "quantile-rows":
            seen.append(out.count())
        return out

    quantiles.materialize = watched
    try:
        wanted = spark.createDataFrame([("x", 10_000), ("x", 19_990)], "feature string, rank long")
        got = {r["rank"]: r["value"] for r in quantiles.order_statistics(rows, wanted).collect()}
    finally:
        quantiles.materialize = original
    assert got == {10_000: 5.0, 19_990: 18_900.0} and len(seen) <= 3 and all(n < 100 for n in seen[1:])
