"""Changelog entries as JSON: files, text and memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changelog import batch_result


def serialized(columns: list[str], pretty: bool = False) -> Column:
    """An entry as a JSON object; indented if ``pretty``. Null members are left out."""
    return F.to_json(F.struct(*columns), {"pretty": str(pretty).lower()})


def write_json(entries: DataFrame, path: str) -> tuple[int, int | None]:
    """Append entries to JSON files; how many there are, and their highest lsn. The count is taken while they are written."""
    from pyspark.sql import Observation

    seen = Observation()
    entries.observe(seen, F.count(F.lit(1)).alias("count"), F.max("lsn").alias("lsn")).write.mode("append").json(path)
    return seen.get["count"], seen.get["lsn"]


def stream_json(entries: DataFrame, path: str, checkpoint: str, interval: str | None = "5 seconds") -> StreamingQuery:
    """Write a stream of entries to JSON files, flushed at an interval, or all that is available now for None."""
    writer = entries.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def stream_console(entries: DataFrame) -> StreamingQuery:
    """Print a stream of entries or messages, for a look at them."""
    return entries.writeStream.format("console").option("truncate", "false").trigger(availableNow=True).start()


class MemorySink:
    """Keeps batches on the driver, for tests."""

    def __init__(self) -> None:
        self.batches: list[list] = []
        self.lsn: int | None = None

    def __call__(self, entries: DataFrame, batch: int) -> None:
        self.batches.append(entries.collect())
        lsn = batch_result(entries).first()["lsn"]
        self.lsn = lsn if self.lsn is None else max(self.lsn, lsn if lsn is not None else self.lsn)

    @property
    def rows(self) -> list:
        return [r for b in self.batches for r in b]
