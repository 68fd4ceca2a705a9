"""Streaming ingest of op logs: micro-batch appends, and a live view kept as state.

Spark's file source reads an append-only folder; its checkpoint remembers what was taken, so a
restart neither loses nor repeats a file. A file that is only partly written is not seen: writers
put it in place by renaming.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from kvlake.model import OPS, PUT
from kvlake.operators.read import newest
from kvlake.sources import store


def log_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Ops as they arrive; the number of files a trigger is the back-pressure."""
    reader = spark.readStream.schema(OPS)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def append_batches(stream: DataFrame, path: str, checkpoint: str, options: store.Options = store.Options()) -> StreamingQuery:
    """Append each micro-batch to a log as a sorted run of its own folder ``path/batch=N``; a batch that is run again replaces its run."""

    def write(batch: DataFrame, number: int) -> None:
        store.write_sorted(batch, f"{path}/batch={number}", options, mode="overwrite")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Newest(StatefulProcessor):
    """State of a key: its newest sequence number, kind and value. Deletes stay as state, so that older ops which come late are known to be old."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", "seq bigint, kind tinyint, value binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        best = held
        for part in rows:
            at = part["seq"].idxmax()
            if best is None or int(part["seq"][at]) > best[0]:
                kind = int(part["kind"][at])
                best = (int(part["seq"][at]), kind, bytes(part["value"][at]) if kind == PUT else None)
        if best is not None and best is not held:
            self.state.update(best)
            yield pd.DataFrame({"key": [key[0]], "seq": [best[0]], "kind": [best[1]], "value": [best[2]]})

    def close(self) -> None:
        pass


def newest_changes(stream: DataFrame) -> DataFrame:
    """Each key's newest op, again whenever it changes (update mode). Needs the RocksDB state store."""
    return stream.groupBy("key").transformWithStateInPandas(_Newest(), "key binary, seq bigint, kind tinyint, value binary", "Update", "none")


def keep_view(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's changes of the newest view under ``path/batch=N``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return newest_changes(stream).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def view_of(spark: SparkSession, path: str) -> DataFrame:
    """The live view that a log of changes makes."""
    changes = spark.read.parquet(path).select("seq", "key", "kind", "value")
    return newest(changes).where(F.col("kind") == PUT)


def run_to_end(start: Callable[[], StreamingQuery], timeout_seconds: float) -> None:
    """Take what there is and stop; a query that is still running then is an error."""
    query = start()
    try:
        if not query.awaitTermination(timeout_seconds):
            raise TimeoutError("the stream did not end in time")
    finally:
        query.stop()
