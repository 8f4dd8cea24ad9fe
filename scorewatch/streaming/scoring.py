"""Streaming sources, the append sink and stream scoring.

Streams read parquet folders file by file; the sink appends parquet with a
checkpoint, so a restarted query resumes after the last committed batch and
rows scored before a model swap keep their old version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from scorewatch.operators.training import scoring_counts
from scorewatch.sources import tables
from scorewatch.sources.fixtures import readings_from_events


MAX_FILES = 1000             # files of a micro-batch, unless told otherwise


def stream_table(spark: SparkSession, path: str, schema: StructType,
                 glob: str | None = None, max_files_per_trigger: int = MAX_FILES) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.option("maxFilesPerTrigger", int(max_files_per_trigger)).parquet(path)


def stream_readings(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Readings table as a stream."""
    return stream_table(spark, path, tables.READINGS_SCHEMA, **kw)


def stream_labels(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Labels table as a stream."""
    return stream_table(spark, path, tables.LABELS_SCHEMA, **kw)


def stream_predictions(spark: SparkSession, path: str, **kw) -> DataFrame:
    """A stream sink's output read back as a stream."""
    return stream_table(spark, path, tables.PREDICTIONS_SCHEMA, **kw)


def stream_event_readings(spark: SparkSession, sf_dir: str, glob: str = "events.parquet",
                          **kw) -> DataFrame:
    """Readings derived from a streamed ``events`` file set."""
    schema = spark.read.parquet(f"{sf_dir}/{glob}").schema
    return readings_from_events(stream_table(spark, sf_dir, schema, glob=glob, **kw))


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                 processing_time: str | None = None, name: str | None = None) -> StreamingQuery:
    """Append-mode parquet sink with checkpoint (K4)."""
    w = (df.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint))
    if name:
        w = w.queryName(name)
    if processing_time:
        w = w.trigger(processingTime=processing_time)
    elif available_now:
        w = w.trigger(availableNow=True)
    return w.start(path)


def stream_score(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], path: str,
                 checkpoint: str, **kw) -> StreamingQuery:
    """Score a readings stream and append the predictions."""
    return write_stream(scorer(stream), path, checkpoint, **kw)


def score_production(stream: DataFrame, resolve: Callable[[], tuple[str, Callable[[DataFrame], DataFrame]]],
                     path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Score a readings stream with the run that is in production when a micro-batch comes (C2,
    C3): ``resolve`` returns its id and scorer, so a promotion takes effect with the next batch and
    no restart. A batch writes its own folder, so one that is replayed after a failure replaces
    its rows instead of adding them."""
    def write(batch: DataFrame, batch_id: int) -> None:
        _, scorer = resolve()
        scorer(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def observed(stream: DataFrame, features=tables.FEATURES, name: str = "scoring") -> DataFrame:
    """The stream with counts of the rows that come and of those that scoring skips for a missing
    feature, observed in flight (T11): see ``observed_counts``."""
    return stream.observe(name, *scoring_counts(features))


def observed_counts(query: StreamingQuery, name: str = "scoring") -> dict[str, int]:
    """Sums of the observed counts over the micro-batches that the query still reports."""
    out = {"rows": 0, "skipped": 0}
    for progress in query.recentProgress:
        got = progress.observedMetrics.get(name)
        for k in out:
            out[k] += got[k] if got is not None else 0
    return out


def swap_model(query: StreamingQuery | None, stream: DataFrame,
               scorer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
               **kw) -> StreamingQuery:
    """Stop the running scorer and restart on the same checkpoint with a new
    model: committed rows keep the old version, new files get the new one (C3)."""
    if query is not None:
        query.stop()
    return stream_score(stream, scorer, path, checkpoint, **kw)
