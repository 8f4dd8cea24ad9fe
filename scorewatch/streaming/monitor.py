"""KPI maintenance driven by arriving labels.

Labels land days after the readings. Instead of recomputing the whole KPI,
a stream over the labels folder refreshes, for each micro-batch, only the days
that the batch's labels touch (``monitor.refresh_kpi``: dynamic overwrite of
those day partitions). The refresh recomputes a day from the full tables, so
a batch replayed after a failure writes the same partitions again: at-least-
once delivery of ``foreachBatch`` gives an exactly-once table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from scorewatch.operators import monitor


def refresh_on_arrival(label_stream: DataFrame, labels: Callable[[], DataFrame],
                       predictions: Callable[[], DataFrame], kpi_path: str, checkpoint: str,
                       available_now: bool = True,
                       processing_time: str | None = None,
                       locator=None) -> StreamingQuery:
    """Keep the KPI table at ``kpi_path`` current as label files arrive.

    ``labels`` / ``predictions`` return the full tables (re-read per batch, so
    each refresh sees every label that has landed). ``locator``: see
    ``monitor.touched_days``; with it a batch costs what its labels and days do.
    """
    def refresh(batch: DataFrame, batch_id: int) -> None:
        monitor.refresh_kpi(labels(), predictions(), batch, kpi_path, locator=locator)

    w = label_stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    if processing_time:
        w = w.trigger(processingTime=processing_time)
    elif available_now:
        w = w.trigger(availableNow=True)
    return w.start()
