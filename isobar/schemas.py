"""Explicit schemas of the exchanged tables."""

from __future__ import annotations

from pyspark.sql import types as T

FOLD = T.StructType(
    [
        T.StructField("fold", T.StringType()),
        T.StructField("train_end", T.StringType()),
        T.StructField("evaluation_start", T.StringType()),
        T.StructField("evaluation_end", T.StringType()),
    ]
)
