"""Leaf-wise gradient boosting on histograms.

* Features become bin numbers once: at most ``BINS`` bins per feature, cut at exact quantiles. A query's pool, which the
  candidate limit bounds, is one row with its labels, bins, scores, gradients and curvatures packed, so gradients of a
  query need no shuffle and a boosting step reads and writes one table.
* Gradients and curvatures are integers in units of ``2^-UNIT``. Their sums are exact, so a tree does not depend on how rows
  are dealt or in which order tasks end.
* A histogram holds the sums per (node, feature, bin). Tasks add up their rows as arrays; one row per cell and task is
  shuffled. Only the smaller child of a split is counted, the other is its parent less the sibling. What comes to the
  driver is bounded by leaves x features x bins, whatever the number of rows.
* Growth is best first: of all leaves the one with the largest gain is split, up to ``leaves``. A leaf's best split depends on
  its own rows alone, so the order of growth is played through with what is known, all leaves whose children are unknown
  are counted together, and the play is repeated until nothing is missing. A tree takes as many passes as it is deep.

Equal gains go to the lower feature number and then to the lower bin. Missing values have been filled before; NaN goes right.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.operators.quantiles import long_values, quantile_edges
from isobar.operators.ranker import RankerSpec, lambda_gradients
from isobar.session import materialize

BINS, UNIT = 511, 24
LEAST_CURVE, LEAST_GAIN = 1e-3, 1e-12


# --- trees ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Split:
    feature: int
    bin: int
    gain: float
    left: tuple[int, int, int]  # sums of gradient and curvature in units, and rows
    right: tuple[int, int, int]


def value_of(sums: tuple[int, int, int]) -> float:
    """Newton step of a leaf."""
    return sums[0] / sums[1] if sums[1] > 0 else 0.0


def best_split(cells: np.ndarray, features: Sequence[int], min_child: int) -> Split | None:
    """The split of largest gain of a histogram (features, bins, 3)."""
    left = cells[list(features)].cumsum(axis=1)[:, :-1]
    total = cells[features[0]].sum(axis=0)
    right = total - left
    one = float(1 << UNIT)

    def score(sums: np.ndarray) -> np.ndarray:
        g, h = sums[..., 0] / one, sums[..., 1] / one
        return np.where(h > 0, g * g / np.where(h > 0, h, 1.0), 0.0)

    allowed = (np.minimum(left[..., 2], right[..., 2]) >= min_child) & (np.minimum(left[..., 1], right[..., 1]) >= LEAST_CURVE * one)
    gain = np.where(allowed, score(left) + score(right) - score(total), -1.0)
    at = int(gain.argmax())  # the first of equal ones
    f, b = divmod(at, gain.shape[1])
    if not gain.size or gain[f, b] <= LEAST_GAIN:
        return None
    return Split(int(features[f]), b, float(gain[f, b]), tuple(map(int, left[f, b])), tuple(map(int, right[f, b])))


@dataclass
class LeafTree:
    """Nodes in the order of growth; a leaf has feature -1. Rows at or below a bin, or a threshold, go left."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaf_of(self, matrix: np.ndarray, limits: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(matrix), dtype=np.int64), np.arange(len(matrix))
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return at
            below = matrix[rows, np.maximum(feature, 0)] <= limits[at]
            at = np.where(inner, np.where(below, self.left[at], self.right[at]), at)

    def paths(self) -> list[str]:
        """``L`` and ``R`` from the root to every node."""
        out = [""] * len(self.feature)
        for i in np.flatnonzero(self.feature >= 0).tolist():  # children come after their parent
            out[self.left[i]], out[self.right[i]] = out[i] + "L", out[i] + "R"
        return out

    def predict(self, matrix: np.ndarray) -> np.ndarray:
        return self.value[self.leaf_of(matrix, self.threshold)]

    def text(self) -> str:
        rows = zip(*(x.tolist() for x in (self.feature, self.threshold, self.left, self.right, self.value)))
        return "\n".join(" ".join(map(repr, r)) for r in rows)


def tree_of(splits: dict[str, Split], leaves: dict[str, tuple[int, int, int]], edges: Sequence[np.ndarray]) -> tuple[LeafTree, list[str]]:
    """Arrays of a tree given by paths (``L`` and ``R`` from the root), and the path of every node."""
    paths = [""]
    for path in paths:
        if path in splits:
            paths += [path + "L", path + "R"]
    number = {p: i for i, p in enumerate(paths)}
    inner = [splits.get(p) for p in paths]

    def column(of, other, kind):
        return np.array([other(p) if s is None else of(p, s) for p, s in zip(paths, inner)], dtype=kind)

    return LeafTree(
        column(lambda p, s: s.feature, lambda p: -1, np.int64), column(lambda p, s: s.bin, lambda p: 0, np.int64),
        column(lambda p, s: edges[s.feature][s.bin], lambda p: 0.0, np.float64),
        column(lambda p, s: number[p + "L"], lambda p: 0, np.int64), column(lambda p, s: number[p + "R"], lambda p: 0, np.int64),
        column(lambda p, s: 0.0, lambda p: value_of(leaves[p]) if p in leaves else 0.0, np.float64),
        column(lambda p, s: s.gain, lambda p: 0.0, np.float64),
    ), paths


# --- packed rows ------------------------------------------------------------------------------------------


def feature_edges(train: DataFrame, names: Sequence[str], features: str = "features", bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of the bins of every feature but the last; at most ``bins - 1`` numbers for each."""
    found = quantile_edges(long_values(train, {str(i): F.col(features)[i] for i in range(len(names))}), bins)
    edges = {r["feature"]: np.array(r["edges"], float) for r in found.collect()}
    return [edges.get(str(i), np.zeros(1)) for i in range(len(names))]


PACKED = "query_id string, candidate_ids array<string>, labels binary, bins binary, scores binary"


def pack(train: DataFrame, edges: Sequence[np.ndarray], features: str = "features", label: str = "label") -> DataFrame:
    """One row per query: candidates in order, labels, bin numbers and zero scores, packed."""
    row = F.struct(F.col("candidate_id").cast("string").alias("id"), F.col(label).cast("int").alias("y"), F.col(features).cast("array<double>").alias("x"))
    pools = train.groupBy(F.col("query_id").cast("string").alias("query_id")).agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for query, rows in zip(batch.column("query_id").to_pylist(), batch.column("rows")):
                values = rows.values
                matrix = values.field("x").flatten().to_numpy(zero_copy_only=False).reshape(len(values), len(edges))
                bins = np.stack([np.searchsorted(e, matrix[:, i], "left") for i, e in enumerate(edges)], axis=1).astype(np.uint16)
                out.append({
                    "query_id": query, "candidate_ids": values.field("id").to_pylist(), "bins": bins.tobytes(),
                    "labels": values.field("y").fill_null(0).to_numpy().astype(np.int32).tobytes(), "scores": np.zeros(len(values)).tobytes(),
                })
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("query_id", pa.string()), ("candidate_ids", pa.list_(pa.string())), ("labels", pa.binary()), ("bins", pa.binary()), ("scores", pa.binary())
            ]))

    return pools.mapInArrow(run, PACKED)


@dataclass(frozen=True)
class Objective:
    """Gradient and curvature of a query's rows: LambdaRank, or the weighted logistic loss of the balanced classifier."""

    mode: str
    gains: tuple[float, ...] = ()
    truncation: int = 30
    weights: tuple[float, float] = (1.0, 1.0)
    start: float = 0.0

    def units(self, scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.mode == "binary_classifier":
            y = (labels > 0).astype(float)
            weight = np.where(y > 0, self.weights[1], self.weights[0])
            p = 1.0 / (1.0 + np.exp(-np.clip(scores + self.start, -50.0, 50.0)))
            step, curve = weight * (y - p), weight * p * (1.0 - p)
        else:
            step, curve = lambda_gradients(scores, np.array(self.gains)[labels], self.truncation)
        return tuple(np.rint(v * (1 << UNIT)).astype(np.int64) for v in (step, curve))


def class_weights(rows: DataFrame, label: str = "label") -> tuple[float, float]:
    """Weights of both classes that give them equal sums; a class without rows weighs 1."""
    positive = F.coalesce(F.col(label) > 0, F.lit(False))
    n = rows.agg(F.count_if(~positive).alias("no"), F.count_if(positive).alias("yes")).first()
    present = sum(1 for c in n if c)
    return tuple(sum(n) / (present * c) if c else 1.0 for c in n)


def objective_of(spec: RankerSpec, train: DataFrame, label: str = "label") -> Objective:
    if spec.label_mode == "binary_classifier":
        return Objective(spec.label_mode, weights=class_weights(train, label))
    gains = tuple(spec.label_gain) if spec.label_gain else tuple(2.0 ** k - 1.0 for k in range(32))
    return Objective(spec.label_mode, gains, spec.truncation)


STATE = PACKED + ", steps binary, curves binary"
_STATE = pa.schema([
    ("query_id", pa.string()), ("candidate_ids", pa.list_(pa.string())), *[(c, pa.binary()) for c in ("labels", "bins", "scores", "steps", "curves")]
])


def advance(state: DataFrame, width: int, objective: Objective, tree: LeafTree | None, rate: float) -> DataFrame:
    """Scores after ``tree``, and the gradients there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c) for c in ("query_id", "candidate_ids", "labels", "bins")}
            scores, steps, curves = [], [], []
            for labels, bins, old in zip(columns["labels"], columns["bins"], batch.column("scores")):
                now = np.frombuffer(old.as_py(), float)
                if tree is not None:
                    matrix = np.frombuffer(bins.as_py(), np.uint16).reshape(-1, width)
                    now = now + rate * tree.value[tree.leaf_of(matrix, tree.bin)]
                step, curve = objective.units(now, np.frombuffer(labels.as_py(), np.int32))
                scores.append(now.tobytes()), steps.append(step.tobytes()), curves.append(curve.tobytes())
            yield pa.RecordBatch.from_arrays([*columns.values(), *[pa.array(v, pa.binary()) for v in (scores, steps, curves)]], schema=_STATE)

    return state.select("query_id", "candidate_ids", "labels", "bins", "scores").mapInArrow(run, STATE)


def histograms(state: DataFrame, width: int, tree: LeafTree, wanted: Sequence[int], bins: int = BINS) -> dict[int, np.ndarray]:
    """Sums (features, bins, 3) of the rows in the ``wanted`` leaves of ``tree``."""
    schema = pa.schema([("cell", pa.int64()), ("g", pa.int64()), ("h", pa.int64()), ("n", pa.int64())])
    place = np.full(len(tree.feature), -1)
    place[list(wanted)] = np.arange(len(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(wanted) * width * bins), np.int64)
        for batch in batches:
            flat = [np.frombuffer(b"".join(batch.column(c).to_pylist()), kind) for c, kind in (("bins", np.uint16), ("steps", np.int64), ("curves", np.int64))]
            matrix = flat[0].reshape(-1, width)
            leaf = place[tree.leaf_of(matrix, tree.bin)]
            rows = np.flatnonzero(leaf >= 0)
            weights = np.stack([flat[1][rows], flat[2][rows], np.ones(len(rows), np.int64)])
            base = leaf[rows] * (width * bins)
            for f in range(width):
                for k in range(3):
                    np.add.at(sums[k], base + f * bins + matrix[rows, f], weights[k])
        full = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays([pa.array(full), *[pa.array(s[full]) for s in sums]], schema=schema)

    partial = state.select("bins", "steps", "curves").mapInArrow(run, "cell long, g long, h long, n long")
    table = partial.groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
    out = np.zeros((len(wanted) * width * bins, 3), np.int64)
    out[table.column("cell").to_numpy()] = np.stack([table.column(c).to_numpy() for c in "ghn"], axis=1)
    return {w: part for w, part in zip(wanted, out.reshape(len(wanted), width, bins, 3))}


def grow(state: DataFrame, width: int, features: Sequence[int], edges: Sequence[np.ndarray], leaves: int, min_child: int) -> LeafTree:
    """The best-first tree of up to ``leaves`` leaves over the gradients of ``state``."""
    root, _ = tree_of({}, {}, edges)
    cells = {"": histograms(state, width, root, [0])[0]}
    found = {"": best_split(cells[""], features, min_child)}
    while True:
        splits, heap, missing = {}, [], []
        if found[""] is not None:
            heap.append((-found[""].gain, ""))
        while heap and len(splits) + 1 < leaves:
            _, path = heapq.heappop(heap)
            splits[path] = found[path]
            for child in (path + "L", path + "R"):
                if child not in found:
                    missing.append(child)
                elif found[child] is not None:
                    heapq.heappush(heap, (-found[child].gain, child))
        if not missing:
            break
        tree, paths = tree_of(splits, {}, edges)
        small = {}
        for path in missing:
            split = splits[path[:-1]]
            small[path[:-1]] = path[:-1] + ("L" if split.left[2] <= split.right[2] else "R")
        counted = histograms(state, width, tree, sorted(paths.index(p) for p in small.values()))
        for parent, child in small.items():
            sibling = parent + ("R" if child[-1] == "L" else "L")
            cells[child] = counted[paths.index(child)]
            cells[sibling] = cells[parent] - cells[child]
            for p in (child, sibling):
                found[p] = best_split(cells[p], features, min_child)
    sums = {p + side: getattr(s, name) for p, s in splits.items() for side, name in (("L", "left"), ("R", "right"))}
    sums.setdefault("", tuple(map(int, cells[""][features[0]].sum(axis=0))))
    return tree_of(splits, {p: s for p, s in sums.items() if p not in splits}, edges)[0]


# --- models -----------------------------------------------------------------------------------------------


@dataclass
class LeafwiseRanker:
    """Boosted trees; ``probability`` turns the sum into the probability of the positive class."""

    spec: RankerSpec
    feature_names: tuple[str, ...]
    trees: list[LeafTree] = field(default_factory=list)
    probability: bool = False
    start: float = 0.0

    def score(self, df: DataFrame, features: str = "features", name: str = "model_score") -> DataFrame:
        """Add the model score; ``features`` is the ordered float array. All trees in one pass over flat nodes."""
        forest, rate, probability, start = self.trees, self.spec.learning_rate, self.probability, self.start

        @F.arrow_udf(T.DoubleType())
        def predict(rows: pa.Array) -> pa.Array:
            matrix = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            total = np.full(len(rows), start)
            for tree in forest:
                total += rate * tree.predict(matrix)
            return pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -50.0, 50.0))) if probability else total)

        return df.withColumn(name, predict(F.col(features).cast("array<double>")))

    def sha256(self) -> str:
        parts = [",".join(self.feature_names), repr((self.probability, self.start)), *(t.text() for t in self.trees)]
        return hashlib.sha256("\n\n".join(parts).encode()).hexdigest()

    @property
    def input_dimension(self) -> int:
        return len(self.feature_names)

    def importance(self, feature: str) -> tuple[int, float]:
        """Number of splits on a feature and the sum of their gains."""
        position = self.feature_names.index(feature)
        return sum(int((t.feature == position).sum()) for t in self.trees), math.fsum(float(t.gain[t.feature == position].sum()) for t in self.trees)


def fit_ranker(
    train: DataFrame,
    feature_names: Sequence[str],
    spec: RankerSpec,
    *,
    features: str = "features",
    label: str = "label",
    trees: int | None = None,
    bins: int = BINS,
) -> LeafwiseRanker:
    """Fit one of the searched models on rows with ``query_id``, ``candidate_id``, features and label."""
    names, rounds = tuple(feature_names), spec.trees if trees is None else trees
    edges = feature_edges(train, names, features, bins)
    objective = objective_of(spec, train, label)
    model = LeafwiseRanker(spec, names, probability=spec.label_mode == "binary_classifier", start=objective.start)
    state, tree, pick = materialize(pack(train, edges, features, label), "boost-pools"), None, random.Random(spec.seed)
    width = max(1, round(spec.feature_fraction * len(names)))
    for _ in range(rounds):
        state = materialize(advance(state, len(names), objective, tree, spec.learning_rate), "boost-state")
        tree = grow(state, len(names), sorted(pick.sample(range(len(names)), width)), edges, spec.leaves, spec.min_child)
        if len(tree.feature) == 1:
            break
        model.trees.append(tree)
    return model
