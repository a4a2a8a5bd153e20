import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.operators import bootstrap, groundtruth, physical


def points(spark, rows):
    df = spark.createDataFrame(rows, "event_id string, h double, lat double, lon double, pres double, wnd double")
    return df.select("event_id", F.timestamp_seconds(F.lit(1577836800) + F.col("h") * 3600).alias("time_utc"), "lat", "lon", "pres", "wnd")


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.atan2(math.sqrt(x), math.sqrt(max(0.0, 1 - x)))


def test_resampling_equals_interpolation(spark):
    rng = np.random.default_rng(0)
    rows, series = [], {}
    for name, m in (("one", 1), ("two", 2), ("mid", 9), ("fit", 16), ("long", 200)):
        values = rng.normal(size=(m, 4))
        series[name] = values
        rows += [(name, 9.0 * i, *map(float, v)) for i, v in enumerate(values)]
    rows.append(("mid", 4.0, None, 1.0, None, None))  # a gap in three variables
    got = {}
    for r in physical.resample_tracks(points(spark, rows)).collect():
        got.setdefault(r["event_id"], {})[r["sample"]] = r
    for name, values in series.items():
        m = len(values)
        expected = np.interp(np.linspace(0, m - 1, 16), np.arange(m), values[:, 0])
        np.testing.assert_allclose([got[name][j]["lat"] for j in range(16)], expected, atol=1e-9)
    lon = np.insert(series["mid"][:, 1], 1, 1.0)
    np.testing.assert_allclose(
        [got["mid"][j]["lon"] for j in range(16)], np.interp(np.linspace(0, 9, 16), np.arange(10), lon), atol=1e-9
    )


def test_landfall_and_pair_errors(spark):
    rows = [("q", 0.0, 10.0, 110.0, 1000.0, 10.0), ("q", 6.0, 18.0, 109.0, 990.0, 20.0), ("q", 12.0, None, None, 980.0, 30.0),
            ("c", 0.0, 12.0, 111.0, 1002.0, 12.0), ("c", 6.0, 20.0, 112.0, 992.0, None), ("empty", 0.0, None, None, None, None)]
    df = points(spark, rows)
    coast = {r["event_id"]: r for r in physical.landfall_points(df).collect()}
    assert (coast["q"]["landfall_lat"], coast["q"]["landfall_offset_h"]) == (18.0, 6.0)
    assert coast["empty"]["landfall_lat"] is None
    pairs = spark.createDataFrame([("q", "c"), ("q2", "c")], "query_id string, candidate_id string")
    row = physical.pair_errors(pairs, df).collect()
    assert len(row) == 1
    row = row[0]
    grid = np.linspace(0, 1, 16)
    gaps = [km((10 + 8 * g, 110 - g), (12 + 8 * g, 111 + g)) for g in grid]
    assert row["track_rmse_km"] == pytest.approx(math.sqrt(np.mean(np.square(gaps))))
    q_wind = np.interp(np.linspace(0, 2, 16), range(3), [10, 20, 30])
    assert row["wind_mae"] == pytest.approx(np.mean(np.abs(q_wind - 12.0)))
    assert row["landfall_dist_km"] == pytest.approx(km((18, 109), (20, 112))) and row["landfall_time_err_h"] == 0.0
    report = physical.error_report(physical.mean_errors(physical.pair_errors(pairs.filter("query_id = 'q2'"), df)))
    assert set(report.values()) == {"NOT_MEASURED_CURRENT"}


def test_track_windows_fall_back_to_the_whole_track(spark):
    track = spark.createDataFrame([("T", f"2020-01-01T{h:02d}:00:00", float(h), 1.0, 1.0, 1.0) for h in range(10)] + [("T", None, 1.0, 1.0, 1.0, 1.0)],
                                  "tc_id string, time_utc string, lat double, lon double, pres double, wnd double")
    mapping = spark.createDataFrame([("t1", "T", 0), ("t1", "wrong", 1)], "tracklet_id string, tc_id string, row_order int")
    descriptor = spark.createDataFrame(
        [("in", "t1", "2020-01-01T02:00:00Z", "2020-01-01T04:00:00"), ("out", "t1", "1999-01-01", "1999-01-02"), ("lost", "t9", "2020-01-01", "2020-01-02")],
        "event_id string, tc_id string, window_start string, window_end string",
    )
    counts = physical.event_track_points(descriptor, mapping, track).groupBy("event_id").count()
    assert {r["event_id"]: r["count"] for r in counts.collect()} == {"in": 3, "out": 10}


def test_ground_truth_excludes_the_same_cyclone(spark):
    rows = [(f"e{i}", 0.0, float(i), 1.0, 1.0, 1.0) for i in range(8)]
    summaries = groundtruth.track_summaries(points(spark, rows).withColumn("tc_id", F.substring("event_id", 2, 1).cast("int").cast("string")), ["event_id", "tc_id"])
    summaries = summaries.withColumn("tc_id", F.floor(F.col("tc_id").cast("int") / 2).cast("string"))
    truth = groundtruth.ground_truth(summaries, k=1)
    assert {r["query_id"]: r["candidate_id"] for r in truth.collect()}["e4"] == "e3"


def test_bootstrap_intervals(spark):
    rng = np.random.default_rng(5)
    base, gain = rng.random(60), rng.normal(0.1, 0.3, 60)
    df = spark.createDataFrame([(i, float(a), float(a + g)) for i, (a, g) in enumerate(zip(base, gain, strict=True))], "i int, a double, b double")
    options = {"baseline": "a", "proposed": "b", "order": "i"}
    got = bootstrap.paired_bootstrap(df, resamples=4000, seed=11, **options).first()
    draws = np.random.default_rng(11)
    means = np.quantile(gain[draws.integers(0, 60, size=(4000, 60))].mean(axis=1), [0.025, 0.975])
    assert (got["lower"], got["upper"]) == pytest.approx(tuple(means), abs=0.015)
    assert got["query_count"] == 60 and got["estimate"] == pytest.approx(gain.mean())
    # Neither the partitioning nor the type of the key matters.
    other = bootstrap.paired_bootstrap(df.repartition(3).withColumn("i", F.col("i").cast("string")), resamples=4000, seed=11, **options).first()
    assert (other["lower"], other["upper"]) == pytest.approx((got["lower"], got["upper"]))
    same = spark.createDataFrame([(i, i / 10, i / 10 + 0.1) for i in range(4)], "i int, a double, b double")
    flat = bootstrap.paired_bootstrap(same, resamples=500, seed=7, **options).first()
    assert (flat["estimate"], flat["lower"], flat["upper"]) == pytest.approx((0.1, 0.1, 0.1))
    for bad in ({"confidence": 1.0}, {"resamples": 99}):
        with pytest.raises(ValueError):
            bootstrap.paired_bootstrap(df, **options, **bad)
    with pytest.raises(ValueError, match="finite"):
        bootstrap.paired_bootstrap(df.withColumn("b", F.lit(None).cast("double")), **options)


def test_every_resample_takes_as_many_rows_as_there_are(spark):
    df = spark.range(300).select(F.col("id").alias("k"), F.sqrt(F.col("id") + 2).alias("d"))
    values = np.sqrt(np.arange(300) + 2)
    for block_rows in (7, 64, 1024):
        got = bootstrap.resample_means(df, 2_001, 3, block_rows=block_rows).toPandas()
        assert len(got) == 2_001 and (got["draws"] == 300).all() and got["mean"].nunique() > 1_990
        # Means of 300 draws: their mean and spread over 2,001 resamples, within five standard errors.
        error = values.std() / np.sqrt(300)
        assert got["mean"].mean() == pytest.approx(values.mean(), abs=5 * error / np.sqrt(2_001))
        assert got["mean"].std() == pytest.approx(error, rel=0.08)


def test_blocks_and_rows_are_drawn_in_proportion():
    counts = np.zeros(5)
    for resample in range(3_000):
        for block, draws in bootstrap.block_draws(resample, 90, 20, 11):  # the last block has ten rows
            counts[block] += draws
    expected = 3_000 * np.array([20, 20, 20, 20, 10])
    assert counts.sum() == 3_000 * 90 and ((counts - expected) ** 2 / expected).sum() < 20
    # The quantile of a binomial against sums of exact probabilities.
    from math import comb

    for u in (0.0, 0.01, 0.3, 0.5, 0.99, 1 - 1e-9):
        cdf = np.cumsum([comb(40, i) * 0.3**i * 0.7 ** (40 - i) for i in range(41)])
        assert bootstrap.binomial(40, 0.3, u) == min(int((cdf <= u).sum()), 40)
    wide = [bootstrap.binomial(10**9, 0.5, u) for u in (0.1, 0.5, 0.9)]
    assert wide[1] == pytest.approx(5 * 10**8, abs=2) and wide[2] - wide[1] == pytest.approx(1.28155 * 15811.4, rel=1e-3)
