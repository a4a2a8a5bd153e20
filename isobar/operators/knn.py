"""Nearest-neighbour join under squared L2 with identity and group exclusions.

The join is exact and never forms the cross product of rows. The archive is packed once into
blocks (one row holds up to ``block_rows`` vectors of one cell), queries are packed the same way
and dealt to a bounded number of parts, near ones together. A part meets one copy of every block
that any of its queries visits, one block after the other, and keeps the best ``k`` rows of each
query. So only those leave the tasks, and the rows moved grow with queries and archive, not with
their product; the comparisons, which are quadratic by nature, are matrix products in the tasks.

Cells are Voronoi cells around a bounded sample of archive vectors. The triangle inequality lets a
query skip a cell: every member of the cell lies at least ``d(query, pivot) - radius`` away, and
the k-th nearest eligible sample vector bounds the true k-th distance from above. A cell that
cannot beat the bound is skipped, all others are visited, so results are complete.

A cell is packed from its pivot outwards, so a block is a shell: the same inequality holds for its own
two distances. Blocks arrive nearest cells first, and a query passes by every shell that cannot beat the
k-th distance it has met by then.

Parts are ranges over (home cell, hash), so the queries of a hot cell are spread over several. Blocks
stream through a part; no task ever holds a whole cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.session import materialize

MAX_PROBES = 4096
MAX_CELLS = 4096
ROWS_PER_CELL = 4096
# The bound comes from one row in so many, so asking it stays a small part of the comparisons.
ROWS_PER_PROBE = 64
# Blocks are copied to the parts by a join in which an index up to this many bytes is broadcast; with a larger one the
# list of visits is.
BROADCAST_BYTES = 64 * 1024 * 1024
SORTED_PACKING_CELLS = 64
# Queries of one part. Between the two there are PARTS_PER_CORE parts for each core, however many queries.
LEAST_PER_PART = 256
MOST_PER_PART = 65536
PARTS_PER_CORE = 3
# Queries whose distances from all probes a task holds at once.
ROUTED_ROWS = 1024


def _matrix(values: pa.ListArray, dimension: int, dtype) -> np.ndarray:
    flat = values.flatten()
    if len(flat) != len(values) * dimension or values.null_count or flat.null_count:
        raise ValueError(f"every vector must hold exactly {dimension} values")
    matrix = flat.to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, dimension)
    if not np.isfinite(matrix).all():
        raise ValueError("vectors must be finite")
    return matrix


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _gram_distance(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances through one matrix product; approximate in the last digits."""
    a, b = left.astype(np.float64), right.astype(np.float64)
    squared = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(squared, 0.0)


def _same(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairwise equality of two label arrays; a missing label equals nothing."""
    codes, _ = pd.factorize(np.concatenate([left, right]))
    mine, theirs = codes[: len(left)], codes[len(left) :]
    return (mine[:, None] == theirs[None, :]) & (mine >= 0)[:, None]


def _labels(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(object)


@dataclass
class Probes:
    """Bounded sample of archive vectors: the first ``cells`` of them are the cell pivots."""

    ids: np.ndarray
    groups: np.ndarray
    vectors: np.ndarray
    cells: int

    @property
    def pivots(self) -> np.ndarray:
        return self.vectors[: self.cells]


class VectorIndex:
    """Packed archive plus the bounded cell statistics that make exact pruning possible.

    ``backend='exact'`` visits every cell that may hold a neighbour. ``backend='ivf'`` visits only
    the ``nprobe`` nearest cells, which is the approximate mode.
    """

    def __init__(self, blocks, probes, radii, dimension, row_count, element, backend, nprobe, block_rows):
        self.blocks: DataFrame = blocks
        self.probes: Probes = probes
        self.radii: np.ndarray = radii
        self.dimension = dimension
        self.row_count = row_count
        self.element = element
        self.backend = backend
        self.nprobe = nprobe
        self.block_rows = block_rows

    @classmethod
    def fit(
        cls,
        archive: DataFrame,
        *,
        id_col: str = "candidate_id",
        vector_col: str = "vector",
        group_col: str | None = "group_id",
        dimension: int | None = None,
        backend: str = "exact",
        nprobe: int = 8,
        cells: int | None = None,
        probes: int = 512,
        block_rows: int = 1024,
        check_ids: bool = True,
    ) -> "VectorIndex":
        if backend not in {"exact", "ivf"}:
            raise ValueError("backend must be 'exact' or 'ivf'")
        if min(block_rows, probes, nprobe) <= 0 or (dimension is not None and dimension <= 0):
            raise ValueError("index parameters must be positive")
        element = archive.schema[vector_col].dataType.elementType.simpleString()
        if element not in {"float", "double"}:
            raise TypeError("vectors must be arrays of float or double")
        rows = archive.select(
            F.col(id_col).cast("string").alias("id"),
            (F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")).alias("grp"),
            F.col(vector_col).alias("vec"),
        )
        if check_ids:
            per_id = rows.groupBy("id").count()
            found = per_id.agg(
                F.sum("count").alias("rows"), F.max("count").alias("most"), F.count_if(F.col("id").isNull()).alias("nameless")
            ).first()
            row_count = found["rows"] or 0
            if row_count and (found["most"] > 1 or found["nameless"]):
                raise ValueError("candidate ids must be present and unique")
        else:
            row_count = rows.count()
        if row_count == 0:
            raise ValueError("cannot index an empty archive")
        cells = cells or max(1, min(MAX_CELLS, math.ceil(row_count / ROWS_PER_CELL)))
        probes = min(MAX_PROBES, max(probes, cells, math.ceil(row_count / ROWS_PER_PROBE)))
        # A bounded sample (at most MAX_PROBES rows): it steers pruning and never limits results.
        sample = rows.orderBy(F.md5(F.col("id").cast("binary")), "id").limit(probes).collect()
        dtype = np.float32 if element == "float" else np.float64
        width = len(sample[0]["vec"])
        if dimension is not None and width != dimension:
            raise ValueError(f"vectors must hold {dimension} values, found {width}")
        if any(len(r["vec"]) != width for r in sample):
            raise ValueError("all vectors must have the same dimension")
        chosen = Probes(
            ids=np.array([r["id"] for r in sample], dtype=object),
            groups=np.array([r["grp"] for r in sample], dtype=object),
            vectors=np.array([r["vec"] for r in sample], dtype=dtype),
            cells=min(cells, len(sample)),
        )
        located = rows.mapInArrow(
            _locate(chosen, width, dtype),
            f"id string, grp string, vec array<{element}>, cell int, gap double",
        )
        if chosen.cells > SORTED_PACKING_CELLS:
            # Range partitioning on (cell, hash) keeps cells together yet splits a hot cell.
            located = located.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell", "gap")
        packed = located.mapInArrow(
            _pack_archive(width, dtype, block_rows),
            f"cell int, n int, a_ids array<string>, a_grps array<string>, a_vecs array<{element}>, "
            "near double, far double",
        )
        blocks = materialize(packed, "vector-index")
        radii = np.full((chosen.cells, 2), np.nan)
        stats = blocks.groupBy("cell").agg(F.min("near").alias("near"), F.max("far").alias("far"))
        for row in stats.collect():  # one row per cell, at most MAX_CELLS
            radii[row["cell"]] = (row["near"], row["far"])
        return cls(blocks, chosen, radii, width, row_count, element, backend, nprobe, block_rows)

    def __len__(self) -> int:
        return self.row_count

    def configuration(self) -> dict:
        return {
            "backend": self.backend,
            "space": "l2",
            "dimension": self.dimension,
            "cells": self.probes.cells,
            "nprobe": self.nprobe if self.backend == "ivf" else self.probes.cells,
        }

    def search(
        self,
        queries: DataFrame,
        k: int,
        *,
        id_col: str = "query_id",
        vector_col: str = "vector",
        group_col: str | None = "group_id",
        exclude_self: bool = True,
        provenance: str = "background_context_index",
        broadcast_bytes: int = BROADCAST_BYTES,
    ) -> DataFrame:
        """Top ``k`` eligible archive rows per query, ordered by (distance, candidate id).

        An index of up to ``broadcast_bytes`` is broadcast to the list of visits, a larger one meets that list.
        """
        spark = queries.sparkSession
        if k <= 0:
            return spark.createDataFrame([], HITS)
        dtype = np.float32 if self.element == "float" else np.float64
        rows = queries.select(
            F.col(id_col).cast("string").alias("id"),
            (F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")).alias("grp"),
            F.col(vector_col).cast(f"array<{self.element}>").alias("vec"),
        )
        plan = {
            "ids": self.probes.ids,
            "groups": self.probes.groups,
            "vectors": self.probes.vectors,
            "cells": self.probes.cells,
            "radii": self.radii,
            "k": k,
            "exclude_self": exclude_self,
            "nprobe": self.nprobe if self.backend == "ivf" else None,
        }
        shared = spark.sparkContext.broadcast(plan)  # bounded by MAX_PROBES vectors
        routed = rows.mapInArrow(
            _route(shared, self.dimension, dtype),
            f"id string, grp string, vec array<{self.element}>, home int, bound double, cells array<int>",
        )
        routed = materialize(routed, "routed-queries")
        parts = _parts(routed.count(), spark.sparkContext.defaultParallelism)
        packed = (
            routed.repartitionByRange(parts, "home", F.xxhash64("id"))
            .sortWithinPartitions("home")
            .mapInArrow(
                _pack_queries(self.dimension, dtype, self.block_rows, self.backend == "ivf", shared),
                f"part int, ids array<string>, grps array<string>, vecs array<{self.element}>, bounds array<double>, "
                "visits array<array<int>>, cells array<int>",
            )
        )
        packed = materialize(packed, "query-blocks")
        # At most parts x cells rows.
        wanted = packed.select("part", F.posexplode("cells").alias("step", "cell")).groupBy("part", "cell").agg(F.min("step").alias("step"))
        size = self.row_count * self.dimension * np.dtype(dtype).itemsize
        if size <= broadcast_bytes:
            visits = wanted.repartition(spark.sparkContext.defaultParallelism).join(F.broadcast(self.blocks), "cell")
        else:
            visits = self.blocks.join(F.broadcast(wanted), "cell")
        nothing = F.lit(None)
        copies = visits.select(
            "part",
            (F.col("step") + 1).alias("met"),
            F.col("a_ids").alias("ids"),
            F.col("a_grps").alias("grps"),
            F.col("a_vecs").alias("vecs"),
            nothing.cast("array<double>").alias("bounds"),
            nothing.cast("array<array<int>>").alias("visits"),
            F.array("cell").alias("cells"),
            F.array("near", "far").alias("shell"),
        )
        asked = packed.select(
            "part", F.lit(0).alias("met"), "ids", "grps", "vecs", "bounds", "visits", "cells", nothing.cast("array<double>").alias("shell")
        )
        pairs = (
            asked.unionByName(copies)
            .repartitionById(parts, F.col("part"))
            .sortWithinPartitions("part", "met")
            .mapInArrow(
                _meet(self.dimension, dtype, k, exclude_self, self.probes.vectors.mean(axis=0, dtype=np.float64), shared),
                "query_id string, candidate_id string, group_id string, distance double",
            )
        )
        order = Window.partitionBy("query_id").orderBy("distance", "candidate_id")
        return (
            pairs.withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k)
            .select(
                "query_id",
                "candidate_id",
                "rank",
                "distance",
                F.lit(provenance).alias("provenance"),
                "group_id",
            )
        )


HITS = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("candidate_id", T.StringType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("distance", T.DoubleType()),
        T.StructField("provenance", T.StringType()),
        T.StructField("group_id", T.StringType()),
    ]
)


def _list_array(flat: np.ndarray, lengths, value_type: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=value_type))


def _locate(probes: Probes, dimension: int, dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            matrix = _matrix(_column(batch, "vec"), dimension, dtype)
            squared = _gram_distance(matrix, probes.pivots)
            cell = squared.argmin(axis=1)
            gap = np.sqrt(squared[np.arange(len(cell)), cell])
            yield pa.RecordBatch.from_arrays(
                [
                    _column(batch, "id"),
                    _column(batch, "grp"),
                    _column(batch, "vec"),
                    pa.array(cell.astype(np.int32)),
                    pa.array(gap),
                ],
                names=["id", "grp", "vec", "cell", "gap"],
            )

    return run


def _runs(keys: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row positions grouped by key, in pieces of at most ``limit`` rows."""
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.diff(keys[order])) + 1
    for piece in np.split(order, edges):
        for start in range(0, len(piece), limit):
            yield int(keys[piece[0]]), piece[start : start + limit]


def _pack_archive(dimension: int, dtype, block_rows: int):
    value_type = pa.float32() if dtype is np.float32 else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            matrix = _matrix(_column(batch, "vec"), dimension, dtype)
            ids, groups = _labels(_column(batch, "id")), _labels(_column(batch, "grp"))
            gaps = _column(batch, "gap").to_numpy()
            outwards = np.argsort(gaps, kind="stable")
            pieces = [(c, outwards[p]) for c, p in _runs(_column(batch, "cell").to_numpy()[outwards], block_rows)]
            order = np.concatenate([p for _, p in pieces])
            sizes = np.array([len(p) for _, p in pieces])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([c for c, _ in pieces], pa.int32()),
                    pa.array(sizes, pa.int32()),
                    _list_array(ids[order], sizes, pa.string()),
                    _list_array(groups[order], sizes, pa.string()),
                    _list_array(matrix[order].ravel(), sizes * dimension, value_type),
                    pa.array([float(gaps[p].min()) for _, p in pieces]),
                    pa.array([float(gaps[p].max()) for _, p in pieces]),
                ],
                names=["cell", "n", "a_ids", "a_grps", "a_vecs", "near", "far"],
            )

    return run


def _route(shared, dimension: int, dtype):
    """Home cell and every cell that may hold one of the k nearest, per query."""

    def route(batch: pa.RecordBatch, plan: dict, radii: np.ndarray, k: int, filled: np.ndarray) -> pa.RecordBatch:
        matrix = _matrix(_column(batch, "vec"), dimension, dtype)
        squared = _gram_distance(matrix, plan["vectors"])
        to_pivot = np.sqrt(squared[:, filled])
        blocked = _same(_labels(_column(batch, "grp")), plan["groups"])
        if plan["exclude_self"]:
            blocked |= _same(_labels(_column(batch, "id")), plan["ids"])
        squared[blocked] = np.inf
        if squared.shape[1] >= k:
            bound = np.sqrt(np.partition(squared, k - 1, axis=1)[:, k - 1])
        else:
            bound = np.full(len(matrix), np.inf)
        bound = bound * (1.0 + 1e-5) + 1e-5
        if plan["nprobe"] is None:
            closest = np.maximum(to_pivot - radii[filled, 1], radii[filled, 0] - to_pivot)
            visit = closest <= bound[:, None]
        else:
            # The best of the visited cells only, so rows elsewhere do not bound it.
            bound[:] = np.inf
            visit = np.zeros(to_pivot.shape, dtype=bool)
            nearest = np.argsort(to_pivot, axis=1, kind="stable")[:, : plan["nprobe"]]
            np.put_along_axis(visit, nearest, True, axis=1)
        picked = [filled[row] for row in visit]
        return pa.RecordBatch.from_arrays(
            [
                _column(batch, "id"),
                _column(batch, "grp"),
                _column(batch, "vec"),
                pa.array(filled[to_pivot.argmin(axis=1)].astype(np.int32)),
                pa.array(bound),
                _list_array(np.concatenate(picked).astype(np.int32), [len(p) for p in picked], pa.int32()),
            ],
            names=["id", "grp", "vec", "home", "bound", "cells"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        radii, k = plan["radii"], plan["k"]
        filled = np.flatnonzero(~np.isnan(radii[:, 0]))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for start in range(0, batch.num_rows, ROUTED_ROWS):
                yield route(batch.slice(start, ROUTED_ROWS), plan, radii, k, filled)

    return run


def _pack_queries(dimension: int, dtype, block_rows: int, own_cells: bool, shared):
    """Blocks of queries with the cells that any of them visits, those near the home cell first; ``own_cells`` keeps the
    list of each query.

    The task is the part.
    """
    value_type = pa.float32() if dtype is np.float32 else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        pivots = shared.value["vectors"][: shared.value["cells"]].astype(np.float64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            matrix = _matrix(_column(batch, "vec"), dimension, dtype)
            ids, groups = _labels(_column(batch, "id")), _labels(_column(batch, "grp"))
            bounds = _column(batch, "bound").to_numpy()
            cells = _column(batch, "cells")
            flat, offsets = cells.flatten().to_numpy(), cells.offsets.to_numpy() - cells.offsets[0].as_py()
            homes, pieces = zip(*_runs(_column(batch, "home").to_numpy(), block_rows))
            order = np.concatenate(pieces)
            sizes = np.array([len(p) for p in pieces])
            wanted = [np.unique(np.concatenate([flat[offsets[i] : offsets[i + 1]] for i in p])) for p in pieces]
            wanted = [w[np.argsort(((pivots[w] - pivots[h]) ** 2).sum(axis=1), kind="stable")] for h, w in zip(homes, wanted)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(sizes), part, np.int32)),
                    _list_array(ids[order], sizes, pa.string()),
                    _list_array(groups[order], sizes, pa.string()),
                    _list_array(matrix[order].ravel(), sizes * dimension, value_type),
                    _list_array(bounds[order], sizes, pa.float64()),
                    _visits(flat, offsets, order, sizes) if own_cells else pa.nulls(len(sizes), pa.list_(pa.list_(pa.int32()))),
                    _list_array(np.concatenate(wanted), [len(w) for w in wanted], pa.int32()),
                ],
                names=["part", "ids", "grps", "vecs", "bounds", "visits", "cells"],
            )

    return run


def _visits(flat: np.ndarray, offsets: np.ndarray, order: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Per block the cell lists of its queries."""
    lists = [flat[offsets[i] : offsets[i + 1]] for i in order]
    inner = _list_array(np.concatenate(lists).astype(np.int32), [len(x) for x in lists], pa.int32())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), inner)


def _parts(queries: int, cores: int) -> int:
    """Each part meets a copy of the blocks, so their number follows the cores and not the queries, within bounds."""
    few, many = math.ceil(queries / MOST_PER_PART), math.ceil(queries / LEAST_PER_PART)
    return max(1, few, min(many, PARTS_PER_CORE * cores))


class _Side:
    """Rows of one block in the order of their groups, as matrices whose product gives distances.

    Vectors are moved by ``centre``, which changes no distance but keeps the digits of near ones.
    """

    def __init__(self, row: dict, dimension: int, centre: np.ndarray, codes: dict):
        groups = row["grps"].dictionary_encode()
        values = [codes.setdefault(v, len(codes)) if v is not None else -1 for v in groups.dictionary.to_pylist()]
        group = np.append(np.array(values, np.int64), -1)[groups.indices.fill_null(len(values)).to_numpy(zero_copy_only=False)]
        order = np.argsort(group, kind="stable")
        self.order, self.group = order, group[order]
        self.ids, self.grps = _labels(row["ids"])[order], _labels(row["grps"])[order]
        self.raw = row["vecs"].to_numpy(zero_copy_only=False).reshape(-1, dimension)[order]
        self.centre = centre
        moved = self.raw.astype(np.float64) - centre
        self.squares = np.einsum("ij,ij->i", moved, moved)
        self.norms = np.sqrt(self.squares)
        self._moved = moved
        self._factors: dict = {}
        edges = np.flatnonzero(np.diff(self.group)) + 1
        starts = np.concatenate([[0], edges])
        self.runs = {int(self.group[a]): (a, b) for a, b in zip(starts, np.append(edges, len(self.group))) if self.group[a] >= 0}

    def factor(self, dtype, asked: bool) -> np.ndarray:
        """``asked @ met.T`` of two factors is the squared distance less the square of the asked vector."""
        if dtype not in self._factors:
            last = np.ones(len(self.raw)) if asked else self.squares
            self._factors[dtype] = np.column_stack([self._moved * (-2.0 if asked else 1.0), last]).astype(dtype)
        return self._factors[dtype]


class _Asked(_Side):
    """A block of queries and the best ``k`` rows each has met."""

    def __init__(self, row: dict, dimension: int, centre: np.ndarray, codes: dict, k: int, exclude_self: bool):
        super().__init__(row, dimension, centre, codes)
        self.k, self.exclude_self = k, exclude_self
        self.named = np.array([i is not None for i in self.ids])
        self.bound = row["bounds"].to_numpy(zero_copy_only=False)[self.order] ** 2
        self.kth = np.full(len(self.ids), np.inf)
        visits = row["visits"]
        self.visits = None if visits is None else [set(v) for v in visits.to_pylist()]
        if self.visits is not None:
            self.visits = [self.visits[i] for i in self.order]
        self.cells = set(row["cells"].to_pylist())
        self.away: tuple = (None, None, None)
        self.left = np.zeros(0, np.int64)
        self.distance = np.zeros(0)
        self.found = np.zeros((2, 0), object)
        self.fresh: list = []
        self.waiting = 0

    def reached(self, cell: int, pivot: np.ndarray | None, shell: pa.Array | None) -> np.ndarray:
        """Places of the queries for which a block of ``cell`` may hold a row within their k-th distance.

        All rows of the block lie between the two distances of ``shell`` from the pivot. What rounding can do to the
        distances from the pivot is given away.
        """
        if cell not in self.cells:
            return np.zeros(0, np.int64)
        if shell is None:
            return np.arange(len(self.ids))
        near, far = shell.to_pylist()
        if self.away[0] != cell:
            moved = pivot - self.centre
            squared = self.squares + moved @ moved - 2.0 * (self._moved @ moved)
            lost = math.sqrt((len(pivot) + 8) * 2.0**-52)
            slack = lost * (self.norms + math.sqrt(moved @ moved) + 2.0 * math.sqrt(pivot @ pivot))
            self.away = cell, np.sqrt(np.maximum(squared, 0.0)), slack
        _, gap, slack = self.away
        slack = slack + math.sqrt((self.raw.shape[1] + 8) * 2.0**-52) * far
        limit = np.sqrt(np.minimum(self.bound, self.kth)) * (1.0 + 1e-5)
        return np.flatnonzero(~(np.maximum(gap - far, near - gap) - slack > limit))

    def meet(self, cell: int, other: _Side, who: np.ndarray | None = None) -> None:
        """The matrix product only preselects: everything within its error margin of the k-th value is measured again
        by subtracting in the element type and summing squares in double. ``who`` names the queries that take part."""
        if who is None:
            who = self.reached(cell, None, None)
        if not len(who):
            return
        some = len(who) < len(self.ids)
        asked = (lambda values: values[who]) if some else (lambda values: values)
        raw, squares, norms, named = asked(self.raw), asked(self.squares), asked(self.norms), asked(self.named)
        group, ids = asked(self.group), asked(self.ids)
        limit = np.minimum(asked(self.bound), asked(self.kth))
        reach = (norms + other.norms.max()) ** 2
        width = raw.shape[1] + 8
        error, dtype = width * 2.0**-23 * reach, np.float32
        if reach.max() > 1e30 or error.max() > 0.01 * np.median(limit):
            error, dtype = width * 2.0**-52 * reach, np.float64

        def near(limit: np.ndarray) -> np.ndarray:
            # The least value of a query settles most of them in one reading.
            limit = (limit * (1.0 + 1e-5) + error - squares).astype(dtype)
            rows = np.flatnonzero(~(product.min(axis=1) > limit))
            if 2 * len(rows) > len(product):
                return np.flatnonzero(product <= limit[:, None])
            hits = np.flatnonzero(product[rows] <= limit[rows, None])
            return rows[hits // product.shape[1]] * product.shape[1] + hits % product.shape[1]

        product = asked(self.factor(dtype, True)) @ other.factor(dtype, False).T
        # At most 32 runs of one group can be as large as this.
        area = product.size // 1024
        for code in self.runs.keys() & other.runs.keys():
            (a, b), (c, d) = self.runs[code], other.runs[code]
            if some:
                a, b = np.searchsorted(who, (a, b))
            if (b - a) * (d - c) >= area:
                product[a:b, c:d] = np.inf
        if self.visits is not None:
            product[[cell not in self.visits[i] for i in who]] = np.inf
        hits = near(limit)
        left, right = np.divmod(hits, product.shape[1])
        out = (group[left] == other.group[right]) & (group[left] >= 0)
        if self.exclude_self:
            out |= (ids[left] == other.ids[right]) & named[left]
        out |= np.isinf(product.ravel()[hits])
        if len(hits) - out.sum() > 2 * self.k * len(ids) and product.shape[1] > self.k:
            product.ravel()[hits[out]] = np.inf
            kth = np.partition(product, self.k - 1, axis=1)[:, self.k - 1] + squares + error
            hits = near(np.minimum(limit, kth))
            left, right = np.divmod(hits, product.shape[1])
            out = np.isinf(product.ravel()[hits])
        left, right = left[~out], right[~out]
        distance = np.empty(len(left))
        step = max(1, 8_000_000 // raw.shape[1])
        for start in range(0, len(left), step):
            piece = slice(start, start + step)
            gap = other.raw[right[piece]] - raw[left[piece]]
            distance[piece] = np.einsum("ij,ij->i", gap, gap, dtype=np.float64)
        left = who[left]
        keep = distance <= self.kth[left]
        left, right, distance = left[keep], right[keep], distance[keep]
        self.fresh.append((left, distance, np.stack([other.ids[right], other.grps[right]])))
        self.waiting += len(left)
        if self.waiting > self.k * len(self.ids) // 2:
            self.settle()

    def settle(self) -> None:
        """Cut what was met to the best ``k`` of each query, equal distances by id."""
        if not self.fresh:
            return
        left = np.concatenate([self.left, *[x[0] for x in self.fresh]])
        distance = np.concatenate([self.distance, *[x[1] for x in self.fresh]])
        found = np.concatenate([self.found, *[x[2] for x in self.fresh]], axis=1)
        order = np.argsort(distance)
        # Sixteen bits are sorted by their digits.
        order = order[np.argsort(left[order].astype(np.uint16 if len(self.ids) <= 1 << 16 else np.int64), kind="stable")]
        place = np.arange(len(order)) - np.searchsorted(left[order], left[order], side="left")
        over = np.flatnonzero(place == self.k)
        if (distance[order[over]] == distance[order[over - 1]]).any():
            # Copies tie across the cut.
            names = np.unique(found[0].astype(str), return_inverse=True)[1]
            order = np.lexsort((names, distance, left))
        order = order[place < self.k]
        self.left, self.distance, self.found = left[order], distance[order], found[:, order]
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.kth[self.left[last]] = self.distance[last]
        self.fresh, self.waiting = [], 0

    def best(self) -> pa.RecordBatch:
        self.settle()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.ids[self.left], pa.string()),
                pa.array(self.found[0], pa.string()),
                pa.array(self.found[1], pa.string()),
                pa.array(self.distance),
            ],
            names=["query_id", "candidate_id", "group_id", "distance"],
        )


def _score(dimension: int, dtype, k: int, exclude_self: bool):
    """Best rows of one archive block for each query of one query block, for a stream of such pairs.

    Rows beyond a query's bound stay here: the bound it came with, or the k-th distance among the blocks that the task
    has scored for the same query block, which come one after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, before = ("ids", "grps", "vecs"), None
        for batch in batches:
            for i in range(batch.num_rows):
                cell = _column(batch, "cell")[i].as_py()
                row = {n: _column(batch, f"q_{n}")[i].values for n in (*names, "bounds", "visits")}
                codes: dict = {}
                pair = _Asked(row | {"cells": pa.array([cell])}, dimension, np.zeros(dimension), codes, k, exclude_self)
                if before is not None and np.array_equal(before.ids, pair.ids):
                    pair.kth = before.kth.copy()
                else:
                    before = _Asked(row | {"cells": pa.array([cell])}, dimension, np.zeros(dimension), {}, k, exclude_self)
                pair.meet(cell, _Side({n: _column(batch, f"a_{n}")[i].values for n in names}, dimension, np.zeros(dimension), codes))
                yield pair.best()
                before.fresh.append((pair.left, pair.distance, pair.found))
                before.settle()

    return run


def _meet(dimension: int, dtype, k: int, exclude_self: bool, centre: np.ndarray, shared=None):
    """Best rows of every query. The query blocks of a part come first, then the archive blocks they visit.

    Blocks with a shell need the pivots of ``shared``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, asked, codes = None, [], {}
        pivots = None if shared is None else shared.value["vectors"][: shared.value["cells"]].astype(np.float64)
        for batch in batches:
            for i in range(batch.num_rows):
                here = _column(batch, "part")[i].as_py()
                if here != part:
                    for block in asked:
                        yield block.best()
                    part, asked, codes = here, [], {}
                row = {name: _column(batch, name)[i].values for name in ("ids", "grps", "vecs", "bounds", "visits", "cells")}
                if not _column(batch, "met")[i].as_py():
                    asked.append(_Asked(row, dimension, centre, codes, k, exclude_self))
                    continue
                cell, other = row["cells"][0].as_py(), None
                pivot, shell = (None, None) if pivots is None else (pivots[cell], _column(batch, "shell")[i].values)
                for block in asked:
                    who = block.reached(cell, pivot, shell)
                    if len(who):
                        other = other or _Side(row, dimension, centre, codes)
                        block.meet(cell, other, who)
        for block in asked:
            yield block.best()

    return run
