"""Predictions and labels joined as streams, for a KPI that waits for late labels.

Both streams carry a watermark, and a label counts for a prediction if it lands within
``lag`` after it, so Spark drops a prediction from its state once no label can come for it
any more, and the state holds one lag's worth of rows. Labels beyond the lag, and rows behind the
watermark, are not joined here: they take the batch path (``monitor.refresh_kpi`` with the
locator), which looks at any age.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.operators import monitor


def labelled_stream(predictions: DataFrame, labels: DataFrame, lag: str = "3 days", delay: str = "1 day") -> DataFrame:
    """Stream of (pid, process_time, model_version, predicted_quality, quality); ``delay``:
    how far rows of either stream may be out of order."""
    p = (predictions.withColumn("_scored", F.col("process_time").cast("timestamp")).withWatermark("_scored", delay))
    checked = labels.select(F.col("pid").alias("_pid"), F.col("qualitycheck_time").cast("timestamp").alias("_checked"),
                            "quality").withWatermark("_checked", delay)
    within = (F.col("pid") == F.col("_pid")) & (F.col("_checked") >= F.col("_scored")) & (
        F.col("_checked") <= F.col("_scored") + F.expr(f"INTERVAL {lag}"))
    return p.join(checked, within).select("pid", "process_time", "model_version", "predicted_quality", "quality")


def kpi_of_pairs(pairs: DataFrame) -> DataFrame:
    """Daily KPI of the stored output of ``labelled_stream``: no join, no label table."""
    return monitor.kpi_of_pairs(pairs)


def state_rows(query) -> int:
    """Rows that the join held after its last micro-batch."""
    last = query.lastProgress
    return sum(op["numRowsTotal"] for op in last["stateOperators"]) if last else 0
