"""Decisions and checks on micro-batches of a stream of scored pairs.

A pair's decision depends on the other pairs of its records, so a batch has to hold
all pairs of the records in it, as the candidate stage writes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from coalign.operators import decide


def decide_batches(pairs: DataFrame, config: dict, out: str, checkpoint: str):
    """Starts a query that appends the decided pairs of each batch, with its number, to the table at ``out``. A batch that is run again writes the same rows to the same place."""

    def decide_batch(batch: DataFrame, number: int) -> None:
        decide.decide(batch, config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pairs.writeStream.foreachBatch(decide_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
