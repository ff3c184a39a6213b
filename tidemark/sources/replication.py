"""A recorded replication stream as a streaming source whose offsets are log positions."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "slot string, position bigint, data binary"
#: Messages taken in one micro-batch at most, unless the option ``batch`` says otherwise.
BATCH = 10_000


def record(path: str, slot: str, messages: list[tuple[int, bytes]]) -> None:
    """Append (position, bytes) to a recording: a line of position and hexadecimal bytes each."""
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{slot}.log", "a") as f:
        f.writelines(f"{position} {data.hex()}\n" for position, data in messages)


def _lines(path: str, after: dict[str, int], most: int | None) -> Iterator[tuple[str, int, bytes]]:
    for name in sorted(x for x in os.listdir(path) if x.endswith(".log")):
        slot, taken = name.removesuffix(".log"), 0
        with open(f"{path}/{name}") as f:
            for line in f:
                position, _, data = line.rstrip("\n").partition(" ")
                if int(position) > after.get(slot, -1):
                    yield slot, int(position), bytes.fromhex(data)
                    taken += 1
                    if most is not None and taken >= most:
                        break


class RecordedStreamReader(SimpleDataSourceStreamReader):
    """Offsets are the last position of each slot, so a restart goes on after the checkpoint. ``commit`` confirms, as a live slot would be told."""

    def __init__(self, options: dict):
        self.path, self.most, self.start = options["path"], int(options.get("batch", BATCH)), int(options.get("start", -1))

    def initialOffset(self) -> dict:
        return {}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = list(_lines(self.path, self._after(start), self.most))
        end = dict(start)
        for slot, position, _ in rows:
            end[slot] = position
        return iter(rows), end

    def _after(self, offset: dict) -> dict[str, int]:
        slots = [x.removesuffix(".log") for x in os.listdir(self.path) if x.endswith(".log")]
        return {s: int(offset.get(s, self.start)) for s in slots}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return (r for r in _lines(self.path, self._after(start), None) if r[1] <= int(end.get(r[0], -1)))

    def commit(self, end: dict) -> None:
        for slot, position in end.items():
            draft = f"{self.path}/{slot}.confirmed.draft"
            with open(draft, "w") as f:
                f.write(str(position))
            os.replace(draft, f"{self.path}/{slot}.confirmed")


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        return _lines(self.options["path"], {}, None)


class RecordedReplication(DataSource):
    """``format("recorded_replication")`` with option ``path``; ``batch`` messages a slot and micro-batch; ``start`` position."""

    @classmethod
    def name(cls) -> str:
        return "recorded_replication"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BatchReader(dict(self.options))

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return RecordedStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedReplication)


def confirmed_position(path: str, slot: str) -> int | None:
    """The position up to which a slot's reader has confirmed."""
    try:
        with open(f"{path}/{slot}.confirmed") as f:
            return int(f.read())
    except FileNotFoundError:
        return None
