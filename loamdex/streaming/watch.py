"""Watch mode as a structured stream: a clock ticks, each micro-batch syncs the knowledge bases that ask for it."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loamdex.session import scratch_dir

_LOG = logging.getLogger(__name__)


def watch(engine, kb: str | None = None, interval: int | None = None, once: bool = False) -> StreamingQuery:
    """Sync now and every `interval` seconds (the argument, else the configuration's). Deleted files are found too, since every
    tick compares the whole listing. A base whose store another writer holds is left for the next tick; errors are logged."""
    seconds = interval or engine.config.interval
    names = engine._bases(kb, auto_only=kb is None)

    def tick(_: DataFrame, batch: int) -> None:
        for name in names:
            try:
                engine.sync(name)
            except Exception as e:  # noqa: BLE001 - the loop goes on
                _LOG.warning("sync of %s in batch %d failed: %s", name, batch, e)

    clock = engine.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = clock.writeStream.foreachBatch(tick).option("checkpointLocation", f"{scratch_dir(engine.spark)}/loamdex/watch-{uuid.uuid4().hex}")
    # the clock's first batch is empty but runs, so one pass is one sync
    return (writer.trigger(once=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()
