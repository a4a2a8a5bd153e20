"""Exact top-k inner products from an impact-ordered index, score at a time.

Vectors become integers, ``floor(scale * x)``. The index cuts them into blocks of bounded size, and each block keeps,
for every dimension, its vectors in order of their quantised value (``STEP`` integers to a level): a posting segment is
one dimension and one level. The impact of a segment on a query is the largest product it can add. A query takes the
segments of a block tier by tier in descending impact and adds the low end of each level. After a tier it knows for each
vector a lower and an upper bound: what the levels hide, plus the tier's impact for every dimension not yet met.
It stops only when at most ``RESCORE`` vectors have an upper bound that reaches the k-th lower bound, or when all
segments are done; those vectors are scored exactly from the stored integers. So the result is exact.

The rows of the index are dealt evenly to parts, and so is a copy of the queries (the stated query set against all rows, in
blocks). A part builds the blocks it can hold in ``PART_BYTES``, and its queries, which arrive after them in batches, meet
these one by one; the k-th score that earlier blocks gave bounds the search of the next. At most k rows of a query leave a
part. What is moved grows with the rows and with parts times queries, and no part holds all of either side.

Vectors so large that a sum of products could leave 53 bits stay out of the postings; they are scored with integers of any
length against every query, and so is everything against a query as large. Ranks are exact for them too.

Nulls: rows with a null id, a null vector, or a null or non-finite component take no part. Shorter vectors are filled
up with zeros. A query's own id is no candidate for it. Ties go to the smaller id; equal rows are separate candidates.
A score that a long cannot hold is null, its rank is right nevertheless. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_ROWS = 4096
#: What the blocks of a part may take, at ``CELL_BYTES`` for each component of a vector (itself, its posting, its segments).
PART_BYTES, CELL_BYTES = 96 << 20, 24
STEP = 32
TIERS = 12
RESCORE = 256
MOST = (1 << 63) - 1
#: Two doubles of any scale in 53 bits multiply to less than 2^2154; this leaves room for their sums.
SCORE_BITS = 2304


def integer_vectors(rows: DataFrame, vec_id: Column, vector: Column, scale: int = 1024) -> DataFrame:
    """(vec_id, v, scale): only whole, finite vectors; an integer vector is floor(scale * v), see :func:`integers`."""
    whole = F.forall(vector, lambda x: F.coalesce(x.cast("double") * 0 == 0, F.lit(False)))
    return (
        rows.where(vec_id.isNotNull() & vector.isNotNull() & whole)
        .select(vec_id.cast("long").alias("vec_id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), F.lit(scale).alias("scale"))
    )


def integers(values: list[float], scale: int) -> list[int]:
    """floor(scale * x) without overflow: a double from 2^53 on is an integer itself."""
    return [int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in values]


@dataclass
class Vectors:
    """Rows as an integer matrix, if their products with one another add up to less than 2^53; the rest as they came."""

    ids: np.ndarray
    small: np.ndarray
    large_ids: np.ndarray
    large: np.ndarray
    scales: np.ndarray

    def any_length(self, rows: int = 256) -> Iterator[list[tuple[int, list[int]]]]:
        """(id, integers) of the large rows, some at a time."""
        for i in range(0, len(self.large_ids), rows):
            some = zip(self.large_ids[i : i + rows].tolist(), self.large[i : i + rows].tolist(), self.scales[i : i + rows].tolist())
            yield [(vec_id, integers(v, scale)) for vec_id, v, scale in some]


def read_vectors(batch: pa.RecordBatch, width: int) -> Vectors:
    """Rows (vec_id, v, scale) of a batch; short vectors are filled up with zeros."""
    lists = batch.column("v")
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = np.zeros((len(lists), width))
    values[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    ids, scales = batch.column("vec_id").to_numpy(), batch.column("scale").to_numpy()
    # Half of 2^53, less a level: room for the bounds of a search, which lie beyond the products themselves.
    limit = math.isqrt((1 << 52) // max(width, 1)) - STEP
    with np.errstate(over="ignore"):
        small = np.abs(values).max(axis=1, initial=0) * scales < limit
    return Vectors(ids[small], np.floor(values[small] * scales[small, None]).astype(np.int64), ids[~small], values[~small], scales[~small])


def exact_best(query: list[int], own: int, rows: list[tuple[int, list[int]]], k: int) -> list[tuple[int, int]]:
    """(id, score) of the k best of the rows, by integers of any length."""
    scored = ((sum(map(operator.mul, query, v)), i) for i, v in rows if i != own)
    return [(i, s) for s, i in heapq.nsmallest(k, scored, key=lambda x: (-x[0], x[1]))]


def score_columns(scores: list[int]) -> list[pa.Array]:
    """The score as a long or null, which side of the longs it is on, and there bytes that sort like it."""
    side = [(s > MOST) - (s < -MOST - 1) for s in scores]
    return [
        pa.array([None if d else s for s, d in zip(scores, side)], pa.int64()), pa.array(side, pa.int32()),
        pa.array([(s + (1 << SCORE_BITS)).to_bytes(SCORE_BITS // 8 + 1, "big") if d else b"" for s, d in zip(scores, side)], pa.binary()),
    ]


class Index:
    """Impact-ordered postings of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")  # so that ties go to the smaller id
        self.ids, self.vectors = ids[order], vectors[order]
        levels = np.floor_divide(self.vectors, STEP)
        postings = np.ascontiguousarray(np.argsort(levels, axis=0, kind="stable").T)  # [dimension, place]
        ordered = np.take_along_axis(levels.T, postings, axis=1)
        self.postings = postings.ravel()
        dims, n = ordered.shape
        first = np.ones((dims, n), bool)
        first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        self.begin = np.flatnonzero(first)  # in all postings, dimension after dimension
        self.size = np.diff(np.append(self.begin, first.size))
        self.dim = self.begin // max(n, 1)
        level = ordered.ravel()[self.begin]
        self.low, self.high = level * STEP, level * STEP + STEP - 1

    def search(self, query: np.ndarray, own: int, k: int, least: float = -math.inf) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best vectors, best first; those below ``least`` may be missing."""
        n = len(self.ids)
        q = query[self.dim]
        low, high = np.minimum(q * self.low, q * self.high), np.maximum(q * self.low, q * self.high)
        impact = np.maximum(np.abs(low), np.abs(high))
        order = np.argsort(-impact, kind="stable")
        sizes, begins, low = self.size[order], self.begin[order], low[order].astype(np.float64)
        hidden = float(np.abs(query).sum() * (STEP - 1))  # what the levels of all dimensions can hide
        lows, met = np.zeros(n), np.zeros(n)
        allowed = self.ids != own
        ends = np.cumsum(sizes)
        cuts = np.searchsorted(ends, np.arange(1, TIERS + 1) * sizes.sum() / TIERS) + 1
        done, reach = 0, allowed
        for cut in np.minimum(cuts, len(order)):
            if cut == done:
                continue
            size, start = sizes[done:cut], ends[done - 1] if done else 0
            at = np.arange(start, ends[cut - 1])
            at += np.repeat(begins[done:cut] - (ends[done:cut] - size), size)
            vec = self.postings[at]
            lows += np.bincount(vec, np.repeat(low[done:cut], size), n)
            met += np.bincount(vec, minlength=n)
            done = cut
            rest = (impact[order[done]] if done < len(order) else 0) * (len(query) - met)
            floors = (lows - rest)[allowed]
            if len(floors) > k:
                least = max(least, np.partition(floors, len(floors) - k)[len(floors) - k])
            reach = allowed & (lows + hidden + rest >= least)
            if reach.sum() <= max(RESCORE, 2 * k):
                break
        place = np.flatnonzero(reach)
        scores = self.vectors[place] @ query
        best = np.lexsort((place, -scores))[:k]
        return place[best], scores[best]


class Part:
    """The blocks of one part, built as its rows arrive."""

    def __init__(self, width: int, block_rows: int):
        self.width, self.block_rows = width, block_rows
        self.blocks: list[Index] = []
        self.large: list[Vectors] = []
        self.waiting: list[Vectors] = []

    def add(self, rows: Vectors) -> None:
        if len(rows.large_ids):
            self.large.append(rows)
        self.waiting.append(rows)
        if sum(len(w.ids) for w in self.waiting) >= self.block_rows:
            self.close(self.block_rows)

    def close(self, least: int = 1) -> None:
        """Blocks of what waits, as long as it fills ``least`` rows."""
        ids = np.concatenate([w.ids for w in self.waiting]) if self.waiting else np.zeros(0, np.int64)
        small = np.concatenate([w.small for w in self.waiting]) if self.waiting else np.zeros((0, self.width), np.int64)
        at = 0
        while len(ids) - at >= least:
            self.blocks.append(Index(ids[at : at + self.block_rows], small[at : at + self.block_rows]))
            at += self.block_rows
        none = np.zeros(0, np.int64)
        self.waiting = [Vectors(ids[at:], small[at:], none, np.zeros((0, self.width)), none)] if at < len(ids) else []

    def best(self, asked: Vectors, k: int) -> list[tuple[int, int, int]]:
        """(query, vector, score) of the k best rows of the part for each query."""
        self.close()
        found = []
        for own, query in zip(asked.ids.tolist(), asked.small):
            kept: list[tuple[int, int]] = []
            for index in self.blocks:
                place, scores = index.search(query, own, k, kept[k - 1][1] if len(kept) == k else -math.inf)
                if len(place):
                    kept = sorted(kept + [*zip(index.ids[place].tolist(), scores.tolist())], key=lambda x: (-x[1], x[0]))[:k]
            found.append((own, query, kept))
        if self.large:
            whole = [(own, query.tolist(), kept) for own, query, kept in found]
            found = self._merge(whole, (rows for part in self.large for rows in part.any_length()), k)
        out = [(own, i, s) for own, _, kept in found for i, s in kept]
        for huge in asked.any_length():
            small = ([*zip(index.ids[i : i + 256].tolist(), index.vectors[i : i + 256].tolist())] for index in self.blocks for i in range(0, len(index.ids), 256))
            met = self._merge([(own, query, []) for own, query in huge], small, k)
            met = self._merge(met, (rows for part in self.large for rows in part.any_length()), k)
            out += [(own, i, s) for own, _, kept in met for i, s in kept]
        return out

    @staticmethod
    def _merge(asked: list[tuple[int, list[int], list]], chunks: Iterator[list[tuple[int, list[int]]]], k: int) -> list[tuple[int, list[int], list]]:
        for rows in chunks:
            asked = [(own, query, sorted(kept + exact_best(query, own, rows, k), key=lambda x: (-x[1], x[0]))[:k]) for own, query, kept in asked]
        return asked


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("side", pa.int32()), ("beyond", pa.binary())])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of two tables (vec_id, v, scale) from :func:`integer_vectors`.

    The number of parts follows the number of rows once they fill the parts that the cores can work on at a time.
    """
    shape = candidates.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    query_width = queries.agg(F.max(F.size("v"))).first()[0]
    spark = candidates.sparkSession
    width = max(int(shape[1] or 0), int(query_width or 0))
    block_rows = max(1, min(BLOCK_ROWS, PART_BYTES // (CELL_BYTES * max(width, 1))))
    blocks = -(-int(shape[0]) // block_rows) or 1
    held = max(1, PART_BYTES // (CELL_BYTES * max(width, 1) * block_rows))
    parts = max(-(-blocks // held), min(blocks, 3 * spark.sparkContext.defaultParallelism))

    # Hashing the place as well spreads rows evenly over parts, equal ids too.
    place = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    stored = candidates.select(place.alias("part"), F.lit(False).alias("asked"), "vec_id", "v", "scale")
    probes = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("asked"), "vec_id", "v", "scale")
    dealt = stored.unionByName(probes).repartitionById(parts, F.col("part")).sortWithinPartitions("asked")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Part(width, block_rows)
        for batch in batches:
            stored = batch.num_rows - int(np.count_nonzero(batch.column("asked").to_numpy(zero_copy_only=False)))
            if stored:
                part.add(read_vectors(batch.slice(0, stored), width))
            if stored < batch.num_rows:
                found = part.best(read_vectors(batch.slice(stored), width), k)
                query_id, vec_id, scores = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(query_id, pa.int64()), pa.array(vec_id, pa.int64()), *score_columns(list(scores))], schema=FOUND)

    best = dealt.drop("part").mapInArrow(search, "query_id long, vec_id long, score long, side int, beyond binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("side"), F.desc("score"), F.desc("beyond"), "vec_id"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
