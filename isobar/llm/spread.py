"""Lookups whose key may own any share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(rows: DataFrame, table: DataFrame, on: Sequence[str], by: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, which has one row per key ``on``, without bringing a hot key to one task.

    Rows are salted by a hash of ``by``. Only the distinct pairs of key and salt, at most as many for a key as the session
    has shuffle partitions, look the key up; rows then meet their own pair. Keys must not be null; ``rows`` is read twice.
    """
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    found = salted.select(*on, "_salt").distinct().join(table, list(on))
    return salted.join(found, [*on, "_salt"], how).drop("_salt")
