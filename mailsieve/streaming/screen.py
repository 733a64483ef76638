"""Cues and scores for messages as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mailsieve.operators.linear import LinearModel, score


def start_scoring(
    messages: DataFrame, model: LinearModel, out: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Scores every micro-batch into its own folder, so a batch run twice is written once.

    ``extract_cues`` is row-local and needs no such help: it takes a stream as it is.
    """

    def write_batch(batch: DataFrame, number: int) -> None:
        score(batch, model).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        messages.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
