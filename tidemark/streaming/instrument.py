"""Counts and durations of streaming queries and of sinks."""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


@dataclass
class Measurements(StreamingQueryListener):
    """Rows and seconds of each micro-batch, kept on the driver as (query, batch, rows, seconds): one small row a batch."""

    batches: list[tuple[str, int, int, float]] = field(default_factory=list)
    ended: dict[str, str | None] = field(default_factory=dict)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((p.name or str(p.id), p.batchId, p.numInputRows, p.durationMs.get("triggerExecution", 0) / 1000))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception

    def frame(self, spark: SparkSession) -> DataFrame:
        """For the counters and histograms of the metric operators."""
        return spark.createDataFrame(self.batches, "query string, batch bigint, rows bigint, seconds double")


class Timed:
    """A sink that measures another: seconds and failures of each of its batches, by route."""

    def __init__(self, sink: Callable[[DataFrame, int], None], route: str = ""):
        self.sink, self.route = sink, route
        self.seconds: dict[str, list[float]] = defaultdict(list)
        self.failures: dict[str, int] = defaultdict(int)

    def __call__(self, entries: DataFrame, batch: int) -> None:
        began = time.perf_counter()
        try:
            self.sink(entries, batch)
        except Exception:
            self.failures[self.route] += 1
            raise
        finally:
            self.seconds[self.route].append(time.perf_counter() - began)
