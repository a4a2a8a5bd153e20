"""Paired bootstrap intervals for the mean of per-query differences.

Every resample takes exactly n rows with replacement. Rows are numbered by key and cut into blocks; the n draws of a resample
are split over the blocks by a binary tree of binomial counts, each hashed from (seed, resample, node), so a resample
needs no table of draws. What is shuffled is one count for each block and resample; inside a block the draws pick
rows by hash, and one sum for each block and resample goes on. Nothing depends on partitioning or on the key's type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.operators.ordering import ordinal

#: Rows of a block, and resamples whose draws in a block are made in one task.
BLOCK_ROWS = 1024
SLICE = 1000
#: Draws that are in memory at once.
DRAWS = 1 << 20
# Odd multipliers below 2^62, so that products of 64-bit numbers stay below 2^127 where integers have 128 bits.
BY_SEED, BY_RESAMPLE, BY_FIRST, BY_SECOND = 0x3C6EF372FE94F82B, 0x1F83D9ABFB41BD6B, 0x2545F4914F6CDD1D, 0x1E3779B97F4A7C15
FIRST_ROUND, SECOND_ROUND = 0x3F58476D1CE4E5B9, 0x14D049BB133111EB
MASK = (1 << 64) - 1


def mixed(seed: int, resample: np.ndarray, first: np.ndarray | int, second: np.ndarray | int) -> np.ndarray:
    """64 hashed bits of four integers."""

    def word(x: np.ndarray | int) -> np.ndarray:
        return np.asarray(x, dtype=np.uint64)

    with np.errstate(over="ignore"):  # arithmetic modulo 2^64
        x = word(seed * BY_SEED & MASK) + word(resample) * np.uint64(BY_RESAMPLE)
        x = x + word(first) * np.uint64(BY_FIRST) + word(second) * np.uint64(BY_SECOND)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(FIRST_ROUND)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(SECOND_ROUND)
        return x ^ (x >> np.uint64(32))


def binomial(draws: int, share: float, u: float) -> int:
    """The binomial quantile of ``u``, from weights around the mean; what is left out has no weight in a double."""
    reach = int(12 * np.sqrt(draws * share * (1 - share))) + 60
    low, high = max(int(draws * share) - reach, 0), min(int(draws * share) + reach, draws)
    i = np.arange(low + 1, high + 1, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log((draws - i + 1) / i * (share / (1 - share))))])
    weights = np.exp(logs - logs.max()).cumsum()
    return min(low + int(np.searchsorted(weights / weights[-1], u, side="right")), high)


def block_draws(resample: int, rows: int, block_rows: int, seed: int) -> Iterator[tuple[int, int]]:
    """(block, draws) of one resample with ``rows`` draws over all blocks, left to right, blocks without draws left out."""
    open_nodes = [(0, -(-rows // block_rows), rows)]
    while open_nodes:
        low, high, draws = open_nodes.pop()
        if not draws:
            continue
        if high - low == 1:
            yield low, draws
            continue
        middle = low + (high - low) // 2
        share = (middle - low) * block_rows / (min(high * block_rows, rows) - low * block_rows)
        u = float(mixed(seed, resample, low, (1 << 32) + high) >> np.uint64(11)) / 2.0**53
        left = binomial(draws, share, u)
        open_nodes += [(middle, high, draws - left), (low, middle, left)]


def _check(df: DataFrame, baseline: str, proposed: str, confidence: float, resamples: int) -> int:
    if not 0.0 < confidence < 1.0:
        raise ValueError("confidence must lie strictly between zero and one")
    if resamples < 100:
        raise ValueError("at least 100 resamples are needed")
    bad = F.lit(False)
    for name in (baseline, proposed):
        c = F.col(name).cast("double")
        bad = bad | c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")).first()
    if row["n"] == 0:
        raise ValueError("paired values must not be empty")
    if row["bad"]:
        raise ValueError("paired values must be finite")
    return row["n"]


def resample_means(gaps: DataFrame, resamples: int, seed: int, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(resample, draws, mean) of rows (k, d): ``draws`` rows are taken, as many as there are."""
    spark = gaps.sparkSession
    placed = ordinal(gaps.select(F.col("k").cast("string").alias("k"), "d"), [], ["k"], name="position", total="n")
    rows = placed.select("n").first()["n"]
    place = F.col("position") - 1
    slices = F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // SLICE))).alias("slice")
    held = placed.select(F.floor(place / block_rows).alias("block"), F.pmod(place, F.lit(block_rows)).alias("place"), "d", slices)

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for resample in frame["id"]:
                pairs = np.array(list(block_draws(int(resample), rows, block_rows, seed)), dtype=np.int64)
                yield pd.DataFrame({"resample": resample, "block": pairs[:, 0], "draws": pairs[:, 1]})

    counts = spark.range(resamples).mapInPandas(split, "resample long, block long, draws long")
    counts = counts.withColumn("slice", F.floor(F.col("resample") / SLICE).cast("int"))

    def draw(block: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        values = block.sort_values("place")["d"].to_numpy()
        wanted = wanted.sort_values("resample")
        resample, many = wanted["resample"].to_numpy(), wanted["draws"].to_numpy()
        sums = np.zeros(len(many))
        # Resamples advance together while their draws fit into memory; one resample has about a block of draws.
        part = np.cumsum(many) // DRAWS
        for number in np.unique(part):
            at = np.flatnonzero(part == number)
            owner = np.repeat(np.arange(len(at)), many[at])
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(many[at]) - many[at], many[at])
            bits = mixed(seed, resample[at][owner], wanted["block"].iloc[0], nth) >> np.uint64(32)
            picked = values[((bits * np.uint64(len(values))) >> np.uint64(32)).astype(np.int64)]
            sums[at] = np.bincount(owner, weights=picked, minlength=len(at))
        return pd.DataFrame({"resample": resample, "draws": many, "total": sums})

    keys = ("block", "slice")
    drawn = held.groupBy(*keys).cogroup(counts.groupBy(*keys)).applyInPandas(draw, "resample long, draws long, total double")
    return drawn.groupBy("resample").agg(F.sum("draws").alias("draws"), (F.sum("total") / F.sum("draws")).alias("mean"))


def paired_bootstrap(
    df: DataFrame,
    *,
    baseline: str,
    proposed: str,
    order: str = "query_id",
    confidence: float = 0.95,
    resamples: int = 10_000,
    seed: int = 20262202,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row: estimate, percentile interval and settings. ``order`` is the key of a query, unique per row."""
    n = _check(df, baseline, proposed, confidence, resamples)
    gaps = df.select(F.col(order).alias("k"), (F.col(proposed).cast("double") - F.col(baseline).cast("double")).alias("d"))
    tail = (1.0 - confidence) / 2.0
    interval = resample_means(gaps, resamples, seed, block_rows=block_rows).agg(F.percentile("mean", F.array(F.lit(tail), F.lit(1.0 - tail))).alias("q"))
    estimate = gaps.agg(F.avg("d").alias("e")).first()["e"]
    return interval.select(
        F.lit(estimate).alias("estimate"),
        F.col("q")[0].alias("lower"),
        F.col("q")[1].alias("upper"),
        F.lit(confidence).alias("confidence"),
        F.lit(n).cast("long").alias("query_count"),
        F.lit(resamples).cast("long").alias("resamples"),
        F.lit(seed).cast("long").alias("seed"),
    )


def fold_deltas(df: DataFrame, *, baseline: str, proposed: str, fold: str = "fold") -> DataFrame:
    """Mean paired difference and query count per fold."""
    gap = F.col(proposed).cast("double") - F.col(baseline).cast("double")
    return df.groupBy(F.col(fold).alias("fold")).agg(
        F.avg(gap).alias("mean_delta"), F.count(F.lit(1)).alias("query_count")
    )
