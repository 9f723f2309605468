"""Watching a folder: a full incremental re-index for each batch of changes.

Spark's file stream reports neither changed nor deleted files, so a stream of ticks drives the index, whose own table is
the state: what a tick does depends on hashes, not on what was in the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestone.sources.store import VaultIndex
from lodestone.sources.vault import scan_vault


def watch_vault(spark: SparkSession, index: VaultIndex, root: str, checkpoint: str, ignore: tuple[str, ...] = (), interval: str = "5 seconds", ticks: DataFrame | None = None) -> StreamingQuery:
    """One index at the start, then one for each tick. ticks: any streaming DataFrame (default: a rate source)."""
    index.reindex(scan_vault(spark, root, ignore))
    ticks = ticks if ticks is not None else spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def batch(rows: DataFrame, _id: int) -> None:
        if rows.limit(1).count():
            index.reindex(scan_vault(spark, root, ignore))

    return ticks.writeStream.foreachBatch(batch).trigger(processingTime=interval).option("checkpointLocation", checkpoint).start()


def watch_changes(index_once: Callable[[], object], changes: Iterable[object], stop: Event) -> int:
    """The same loop over any iterable of change batches; returns how often it indexed."""
    index_once()
    n = 1
    for _ in changes:
        if stop.is_set():
            break
        index_once()
        n += 1
    return n
