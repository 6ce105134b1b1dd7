"""Zone learning fed by a stream of truck outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions import constants as K
from ..operators.learning import record_run
from ..sources.zone_store import ZoneStore


def learn_from_stream(
    outcomes: DataFrame, store: ZoneStore, checkpoint: str, run: str = "period", resolution: int = K.DEFAULT_RESOLUTION
) -> StreamingQuery:
    """Fold every micro-batch of truck outcomes into the zone store.

    Each batch is one or more finished runs (``period``), in order. The store
    remembers the last batch it holds, so a batch replayed after a failure
    does not count twice.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        if store.last_batch() >= batch_id:
            return
        store.write(record_run(batch, store.read(), run, resolution), batch_id)

    return (
        outcomes.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
