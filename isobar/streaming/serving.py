"""Continuous serving: retrieval for query events as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from isobar.plans.retrieval import RetrievalResult


def serve(
    queries: DataFrame,
    retrieve: Callable[[DataFrame], RetrievalResult],
    output: str,
    *,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Run the retrieval plan on each micro-batch of a streaming query table.

    Results and audits of a batch go to a folder named by the batch id and replace it, so a batch that
    is replayed after a failure does not appear twice.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        if rows.isEmpty():
            return
        result = retrieve(rows)
        result.top_k.write.mode("overwrite").parquet(f"{output}/top_k/batch_id={batch_id}")
        result.audit.write.mode("overwrite").parquet(f"{output}/audit/batch_id={batch_id}")

    writer = queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
