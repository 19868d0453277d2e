"""Progress of a run by Spark's own observed metrics: counts that a stage's rows make while they pass, without another pass."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener


class Progress:
    """Counts by stage. ``watch`` a batch frame before its action; ``counts`` waits for the actions of all that are watched."""

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}

    def watch(self, rows: DataFrame, stage: str, only: Column | None = None, **more: Column) -> DataFrame:
        """``rows`` with counters on: all of them (or ``only`` some), and those of them for which each of ``more`` holds."""
        self.seen[stage] = Observation(stage)
        these = F.lit(True) if only is None else only
        return rows.observe(self.seen[stage], F.count_if(these).alias("rows"), *(F.count_if(these & c).alias(n) for n, c in more.items()))

    def counts(self) -> dict[str, dict[str, int]]:
        return {stage: dict(o.get) for stage, o in self.seen.items()}


class StreamProgress(StreamingQueryListener):
    """Sums of a stream's observed metrics over its batches: register with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.totals: dict[str, dict[str, int]] = {}
        self.batches = 0
        self.ended = threading.Event()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.ended.clear()

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        self.batches += 1
        for stage, row in event.progress.observedMetrics.items():
            own = self.totals.setdefault(stage, {})
            for k, v in row.asDict().items():
                own[k] = own.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.ended.set()
