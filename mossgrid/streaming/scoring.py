"""Imputation of targets that arrive in micro-batches against a static reference."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mossgrid.operators import impute, neighbors


def impute_stream(targets: DataFrame, reference: DataFrame, attributes: DataFrame, continuous: Sequence[str], k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, weights: str | Sequence[float] = "INVERSE_DISTANCES", available_now: bool = True) -> StreamingQuery:
    """Each micro-batch of targets (id, pixel_number, scores) is imputed by itself; targets do
    not depend on each other, so no state is kept. The reference is dealt into cells once.
    ``sink`` gets the predictions and the batch number, by which it can make a repeated batch
    harmless."""
    index = neighbors.build_index(reference, k)

    def batch(rows: DataFrame, number: int) -> None:
        near = neighbors.search(rows, index, k)
        sink(impute.predict(near, attributes, continuous, k, weights), number)

    writer = targets.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
