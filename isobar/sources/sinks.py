"""Sinks: tables as CSV or parquet, JSON receipts, an append-only event log and run state."""

from __future__ import annotations

import csv
import json
import os
import shutil
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Fixed value: free space a run should find, in bytes; it is reported and not enforced.
MIN_FREE_BYTES = 10 * 1024**3


def write_csv(df: DataFrame, path: str) -> None:
    """Distributed CSV with a header; nested columns must be projected or rendered first."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_feature_list(names: Sequence[str], path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as handle:
        csv.writer(handle, lineterminator="\n").writerows([["feature"], *[[n] for n in names]])


def write_json(payload: Mapping[str, Any], path: str | Path) -> None:
    """One small receipt with sorted keys."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, indent=2, sort_keys=True, default=str) + "\n", encoding="utf-8")


def write_json_records(records: DataFrame, path: str, column: str = "audit_json") -> None:
    """One JSON text per line, written by the executors."""
    records.select(column).write.mode("overwrite").text(path)


def append_event(spark: SparkSession, path: str, payload: Mapping[str, Any]) -> None:
    """Append a timestamped line to an event log folder."""
    stamped = {"time": datetime.now(UTC).isoformat(timespec="seconds"), **payload}
    line = json.dumps(stamped, sort_keys=True, default=str)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)


def storage_state(path: str | Path) -> dict[str, Any]:
    os.makedirs(path, exist_ok=True)
    free = shutil.disk_usage(path).free
    return {
        "absolute_path": str(Path(path).resolve()),
        "free_gb": round(free / 1024**3, 3),
        "above_10gb_floor": free >= MIN_FREE_BYTES,
    }


class RunLog:
    """Progress snapshot of the current stage, plus the event log of a run."""

    def __init__(self, spark: SparkSession, folder: str, run_id: str):
        self.spark, self.folder, self.run_id = spark, folder, run_id

    def stage(self, name: str, **details: Any) -> None:
        snapshot = {"stage": name, "run_id": self.run_id, **details}
        write_json(snapshot, os.path.join(self.folder, "progress.json"))

    def event(self, name: str, **details: Any) -> None:
        append_event(
            self.spark, os.path.join(self.folder, "events.jsonl"), {"stage": name, "run_id": self.run_id, **details}
        )
