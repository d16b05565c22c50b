"""Runs unbounded queries: file sinks with a checkpoint, sinks that survive replays, state reads, and metrics."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..config import Config, Guarantee
from ..operators.streams import Builder

log = logging.getLogger("tarnflow")


def start(df: DataFrame, name: str, out: str, config: Config, once: bool = False) -> StreamingQuery:
    """Appends to Parquet in out. At least once: the file sink as it is, which is exactly once by its own log.
    Exactly once: one folder for each micro-batch, written whole or again."""
    config.validated()
    checkpoint = f"{config.state_folder(df.sparkSession)}/{name}"
    writer = df.writeStream.queryName(name).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{config.commit_interval_ms} milliseconds")
    if config.guarantee is Guarantee.EXACTLY_ONCE:
        return writer.foreachBatch(replayable(out)).start()
    return writer.format("parquet").option("path", out).start()


def start_all(topology: Builder, out: str, config: Config, once: bool = False) -> dict[str, StreamingQuery]:
    """Starts every sink of a topology as a query of its own, into its own folder."""
    sinks = topology.build()
    if bounded := [name for name, df in sinks.items() if not df.isStreaming]:
        raise ValueError(f"bounded sinks: {', '.join(bounded)}; run the topology instead")
    return {name: start(df, name, f"{out}/{name}", config, once) for name, df in sinks.items()}


def replayable(out: str) -> Callable[[DataFrame, int], None]:
    """A batch that runs again, after a crash between its sink and its commit, replaces what it wrote."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return put


def finish(query: StreamingQuery) -> None:
    """Waits; an error of the query is raised here."""
    query.awaitTermination()
    if error := query.exception():
        raise error


def state(spark: SparkSession, checkpoint: str, variable: str, operator: int = 0) -> DataFrame:
    """What a stateful operator holds, between runs."""
    return spark.read.format("statestore").option("path", checkpoint).option("operatorId", operator).option("stateVarName", variable).load()


class Metrics(StreamingQueryListener):
    """Rows per second, batch times and drops of every query, as log lines and in `last`."""

    def __init__(self):
        self.last: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        log.info("started %s", event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        dropped = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self.last[p.name or str(p.id)] = {"batch": p.batchId, "rows": p.numInputRows, "rows_per_s": p.processedRowsPerSecond, "ms": p.batchDuration, "dropped": dropped}
        log.info("%s: %s", p.name, self.last[p.name or str(p.id)])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            log.error("ended: %s", event.exception)
