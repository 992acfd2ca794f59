"""The incremental run as a stream: each micro-batch of reports is one run. An extension; batch runs need no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from paperloom.operators.incremental import VersionedState, incremental_run


def start(reports: DataFrame, store: VersionedState, checkpoint: str):
    """Streams `reports` (file_id, log_id, arrived_at, sha256, size, mtime, status, attempts) into incremental runs.

    store.results() has what each batch processed. A batch that the stream repeats, because it died between the state's
    version and its own checkpoint, is known to the state by its number and changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        incremental_run(store, batch, number)

    return reports.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
