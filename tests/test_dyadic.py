"""Binary cells against plain ranges."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from isobar.operators import dyadic
from isobar.operators.pooling import interval_join


def test_cells_are_the_range_and_few(spark):
    rng = random.Random(4)
    ranges = [(0, 0), (-1, 0), (-7, 9), (5, 5), (0, 2**40 - 1), (1, 2**40)]
    for _ in range(300):
        a = rng.randint(-500, 500)
        ranges.append((a, a + rng.randint(0, 300)))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ranges)], "i long, a long, b long")
    cells = {}
    for r in dyadic.store(df, F.col("a"), F.col("b")).collect():
        cells.setdefault(r["i"], []).append((r[dyadic.LEVEL], r[dyadic.CELL]))
    for i, (a, b) in enumerate(ranges):
        spans = sorted((c << n, ((c + 1) << n) - 1) for n, c in cells[i])
        assert spans[0][0] == a and spans[-1][1] == b
        assert all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:]))  # side by side, none twice
        assert len(spans) <= max(1, 2 * (b - a + 1).bit_length())


def test_one_long_window_among_short_ones(spark):
    """A window of a hundred years has a few rows, and the join finds what a plain comparison finds."""
    rng = random.Random(7)
    origin = datetime(1950, 1, 1)
    windows = [(i, f"k{i % 2}", origin + timedelta(hours=h), origin + timedelta(hours=h + 1)) for i, h in enumerate(rng.sample(range(876_000), 200))]
    windows += [(900, "k0", origin, origin + timedelta(days=36_525)), (901, "k1", origin, origin), (902, "k1", None, origin)]
    points = [(j, f"k{j % 2}", w[2] + timedelta(minutes=rng.randint(-60, 90))) for j, w in enumerate(windows[:200])] + [(999, "k0", None), (998, None, origin)]
    left = spark.createDataFrame(points, "p long, key string, at timestamp")
    right = spark.createDataFrame(windows, "w long, key string, start timestamp, stop timestamp")
    for closed in (False, True):
        joined = interval_join(left, right, time="at", start="start", end="stop", keys=["key"], bucket_hours=1, closed=closed)
        assert joined.columns == ["key", "p", "at", "w", "start", "stop"]
        want = {
            (p[0], w[0]) for p in points for w in windows
            if None not in (p[2], w[2], p[1]) and p[1] == w[1] and w[2] <= p[2] and (p[2] < w[3] or closed and p[2] == w[3])
        }
        got = [(r["p"], r["w"]) for r in joined.select("p", "w").collect()]
        assert set(got) == want and len(got) == len(want)
    hours = (F.unix_micros("start") / 3_600_000_000).cast("long"), (F.unix_micros("stop") / 3_600_000_000).cast("long") - 1
    stored = dyadic.store(right.where("w = 900"), *hours)
    assert stored.count() <= 2 * (876_600).bit_length()


def test_no_intervals_no_rows(spark):
    empty = spark.createDataFrame([], "start timestamp, stop timestamp")
    points = spark.createDataFrame([(datetime(2000, 1, 1),)], "at timestamp")
    assert interval_join(points, empty, time="at", start="start", end="stop").count() == 0
