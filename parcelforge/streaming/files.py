"""Structured Streaming: directories in batches, the latest review as state, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_batches(spark: SparkSession, path: str, schema: str, files_per_batch: int = 10, kind: str = "parquet") -> DataFrame:
    """Files of a directory as a stream, 1 to 50 a batch."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", max(1, min(50, files_per_batch))).load(path)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start ``each`` on every batch; a restart with the same checkpoint goes on where the last run ended. ``stop()`` cancels."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def into_table(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch function that writes its rows once: a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        # of a key the row with the smallest hash stays, so a batch that is run again writes the same
        first = batch.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), F.xxhash64(*batch.columns)).alias("_r")).select("_r.*")
        first.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """document_id, field_key and the newest decision so far, emitted whenever it changes; reviews have created_at and id."""

    def update(key, rows, state: GroupState):
        best = state.get if state.exists else None
        for pdf in rows:
            top = pdf.sort_values(["created_at", "id"]).iloc[-1]
            new = (top["created_at"].value // 1000, int(top["id"]), top["review_status"])
            if best is None or new[:2] > best[:2]:
                best = new
        if not state.exists or state.get != best:
            state.update(best)
            yield pd.DataFrame({"document_id": [key[0]], "field_key": [key[1]], "id": [best[1]], "review_status": [best[2]]})

    return reviews.groupBy("document_id", "field_key").applyInPandasWithState(
        update, "document_id string, field_key string, id long, review_status string", "at long, id long, review_status string", "update", GroupStateTimeout.NoTimeout
    )


def tumbling(events: DataFrame, time: str, length: str, late: str, keys: list[str]) -> DataFrame:
    """Counts and sums of ``value`` in windows of event time; events later than ``late`` are dropped. An extra."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Counts in sessions that a gap ends. An extra."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))


def with_watchdog(detect: Callable[[pd.DataFrame], pd.DataFrame], seconds: float, failed: Callable[[pd.DataFrame, str], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``detect`` for one file at a time, 30 to 7,200 seconds each: a file that takes longer, or fails, gives what ``failed`` makes of it and the reason."""
    from concurrent.futures import ThreadPoolExecutor

    most = max(30.0, min(7200.0, seconds))

    def guarded(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i in range(len(batch)):
            one, pool = batch.iloc[i : i + 1], ThreadPoolExecutor(1)
            try:
                out.append(pool.submit(detect, one).result(timeout=most))
            except Exception as e:  # the caller's models decide what they raise
                out.append(failed(one, "timeout" if isinstance(e, TimeoutError) else f"{type(e).__name__}: {e}"))
            finally:
                pool.shutdown(wait=False, cancel_futures=True)
        return pd.concat(out, ignore_index=True) if out else failed(batch, "empty")

    return guarded


def progress_of(query: StreamingQuery) -> dict:
    """What a poll of a running batch shows: state, batch, rows and files a second, and the error if it ended with one."""
    last = query.lastProgress or {}
    error = query.exception()
    return {
        "state": "failed" if error else "running" if query.isActive else "finished",
        "batch": last.get("batchId"),
        "rows": last.get("numInputRows", 0),
        "rows_per_second": last.get("processedRowsPerSecond"),
        "error": str(error) if error else None,
    }


def summarise_batches(path: str, spark: SparkSession, status: str = "status") -> DataFrame:
    """The summary that is shown after each batch: files by status over all batches written below ``path`` so far."""
    return spark.read.parquet(path).groupBy(status).agg(F.count("*").alias("files"))
