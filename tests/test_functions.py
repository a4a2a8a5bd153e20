import math

import pytest
from pyspark.sql import functions as F

from isobar.functions import scalars as s
from isobar.functions.vectors import block, has_non_finite, l2_norm, squared_l2, unit_vector


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict()


def test_numbers_and_flags_are_coerced_strictly(spark):
    got = one(
        spark,
        bad=s.number(F.lit("n/a")), nan=s.number(F.lit(float("nan"))), ok=s.number(F.lit("2.5")),
        yes=s.flag(F.lit("true")), null=s.flag(F.lit(None).cast("string")), text=s.flag(F.lit("maybe")),
    )
    assert got == {"bad": None, "nan": None, "ok": 2.5, "yes": True, "null": False, "text": False}


def test_reciprocal_ranks_use_their_sentinels(spark):
    null = F.lit(None).cast("double")
    got = one(
        spark,
        a=s.reciprocal_rank(null), b=s.reciprocal_rank(F.lit(-3.0)), c=s.reciprocal_rank(F.lit(1)),
        d=s.safe_reciprocal(null), e=s.safe_reciprocal(F.lit(3)), f=s.safe_reciprocal(F.lit(-1)),
    )
    assert got["a"] == pytest.approx(1 / 1502) and got["b"] == 1.0 and got["c"] == 0.5
    assert got["d"] == pytest.approx(1 / 10000) and got["e"] == 0.25 and got["f"] == math.inf


def test_overlap_and_haversine(spark):
    t = lambda h: F.timestamp_seconds(F.lit(h * 3600))
    got = one(
        spark,
        o=s.temporal_overlap(t(0), t(24), t(12), t(36)), none=s.temporal_overlap(t(0), t(1), t(5), t(6)),
        km=s.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)),
        gone=s.haversine_km(F.lit(None), F.lit(0.0), F.lit(0.0), F.lit(1.0)),
    )
    assert got["o"].asDict() == {
        "intersection_hours": 12.0, "overlap_ratio_min": 0.5, "overlap_ratio_union": pytest.approx(12 / 36),
    }
    assert got["none"]["overlap_ratio_min"] == 0.0
    assert got["km"] == pytest.approx(math.pi * 6371.0088) and got["gone"] is None


def test_window_bounds_fall_back(spark):
    rows = spark.createDataFrame(
        [("2020-01-01T00:00:00Z", None, None), (None, "2020-01-02", 6.0)],
        "time_coverage_start string, start_time string, event_duration_hours double",
    )
    start, end = s.window_bounds(rows.columns)
    hours = [r[0] for r in rows.select(s.hours_between(start, end)).collect()]
    assert hours == [24.0, 6.0]
    with pytest.raises(ValueError):
        s.window_bounds(["candidate_id"])


def test_vector_expressions(spark):
    v = F.array(*[F.lit(x).cast("float") for x in (3.0, 4.0, 0.0, 0.0)])
    zero = F.array(F.lit(0.0).cast("float"))
    got = one(
        spark, n=l2_norm(v), u=unit_vector(v), d=squared_l2(v, F.reverse(v)), b=block(v, 1, 2), z=unit_vector(zero),
        bad=has_non_finite(F.array(F.lit(float("nan")))), fine=has_non_finite(v),
    )
    assert got["n"] == 5.0 and got["d"] == 50.0 and got["b"] == [0.0, 0.0] and got["z"] == [0.0]
    assert got["u"] == pytest.approx([0.6, 0.8, 0.0, 0.0]) and got["bad"] and not got["fine"]
