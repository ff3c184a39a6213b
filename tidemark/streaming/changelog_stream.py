"""The changelog as a stream: messages put in sequence and joined with their relations by state of each slot."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType

from ..operators.changelog import marshal, unchanged
from ..sources.pgoutput import MESSAGE
from .settings import rocksdb

ENTRY = (
    "slot string, position bigint, kind string, timestamp_us bigint, namespace string, name string, lsn bigint, sequence bigint, message_type string, "
    "spec string, before string, after string, unchanged string, last_in_transaction boolean"
)
#: What the state adds to a message: its place in its transaction and its relation.
PLACED = "slot string, position bigint, message_type string, timestamp_us bigint, lsn bigint, sequence bigint, relation string, old_row string, row string"
_CELLS = "array<struct<type: string, value: string>>"
_RELATION = "struct<namespace: string, name: string, columns: array<struct<key: boolean, name: string, type: bigint, modifier: bigint>>>"


class OutOfTransaction(RuntimeError):
    """A row or relation message came before the begin message of any transaction."""


class ChangelogProcessor(StatefulProcessor):
    """State of a slot: the transaction that is open, how many entries it has had, and the newest relation of each id.

    A slot is one totally ordered log, so it is what state is keyed by; several slots run side by side. Messages of a
    micro-batch are taken in the order of their positions, in vector operations over all of them: the micro-batch bounds the memory. A transaction may lie in several micro-batches. Entries of a
    transaction are let out as they come; the last of a transaction is known only at its commit, so an ``ack`` entry
    follows it with the log position that may be confirmed: never one inside a transaction.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._begin = handle.getValueState("begin", "lsn long, commit_us long, xid long, sequence long")
        self._relations = handle.getMapState("relations", "id long", "relation string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("position", kind="stable")
        begin = tuple(self._begin.get()) if self._begin.exists() else None
        kind, position, relation_id = (frame[c].to_numpy() for c in ("msg_type", "position", "relation_id"))
        begins, ends = kind == "B", kind == "C"
        at = np.arange(len(frame))
        last_begin, last_end = (np.maximum.accumulate(np.where(x, at, -1)) for x in (begins, ends))
        before = last_begin < 0  # no begin in this micro-batch yet: the state's transaction, if no commit ended it
        inside, is_open = ~begins & ~ends, np.where(before, (last_end < 0) & (begin is not None), last_begin > last_end)
        if (inside & ~is_open).any():
            k = int(np.argmax(inside & ~is_open))
            raise OutOfTransaction(f"message {kind[k]} at {position[k]} of {key[0]}")
        count = np.cumsum(inside)
        held = begin or (0, 0, 0, 0)
        sequence = count - np.where(before, 0, count[last_begin]) + np.where(before, held[3], 0)
        lsn, commit_us, xid = (np.where(before, held[i], frame[c].to_numpy()[last_begin]) for i, c in enumerate(("lsn", "timestamp_us", "xid")))
        if len(frame):
            self._keep((int(lsn[-1]), int(commit_us[-1]), int(xid[-1]), int(sequence[-1])) if not ends[-1] and (begins[-1] or is_open[-1]) else None)
        relation = self._resolved(key, kind, position, relation_id, frame["relation"].to_numpy())
        shown = ends | np.isin(kind, ["R", "I", "U", "D"])
        if shown.any():
            acked = ends[shown]
            yield pd.DataFrame({
                "slot": key[0], "position": position[shown], "message_type": kind[shown], "timestamp_us": np.where(acked, frame["timestamp_us"].to_numpy()[shown], commit_us[shown]),
                "lsn": np.where(acked, frame["transaction_lsn"].to_numpy()[shown], lsn[shown]), "sequence": np.where(acked, 0, sequence[shown]),
                "relation": relation[shown], "old_row": frame["old_row"].to_numpy()[shown], "row": frame["row"].to_numpy()[shown],
            })

    def _keep(self, begin: tuple | None) -> None:
        if begin is None:
            self._begin.clear()
        else:
            self._begin.update(begin)

    def _resolved(self, key: tuple, kind: np.ndarray, position: np.ndarray, relation_id: np.ndarray, relation: np.ndarray) -> np.ndarray:
        """The relation of each message: the newest of its id before it, of this micro-batch or of the state."""
        out, told, asks = relation.copy(), kind == "R", np.isin(kind, ["I", "U", "D"])
        for x in np.unique(relation_id[told | asks]).tolist():
            where, rows = np.flatnonzero(told & (relation_id == x)), np.flatnonzero(asks & (relation_id == x))
            newest = np.searchsorted(where, rows) - 1
            if (newest < 0).any():
                if not self._relations.containsKey((x,)):
                    raise OutOfTransaction(f"row of an unknown relation {x} at {position[rows[0]]} of {key[0]}")
                out[rows[newest < 0]] = self._relations.getValue((x,))[0]
            out[rows[newest >= 0]] = relation[where[newest[newest >= 0]]]
            if len(where):
                self._relations.updateValue((x,), (relation[where[-1]],))
        return out

    def close(self) -> None:
        pass


def changelog_stream(messages: DataFrame) -> DataFrame:
    """A stream of (slot, position, message), the message a struct as decoded or its JSON text, as changelog entries in columns of ENTRY.

    Only the order of messages needs state: cells stay text there and become images outside it.
    """
    # The processor's first worker starts on the driver, which has no packages sent to it.
    register_pickle_by_value(sys.modules[__name__])
    if isinstance(messages.schema["message"].dataType, StringType):
        messages = messages.withColumn("message", F.from_json("message", f"struct<{MESSAGE}>"))
    m = "message."
    none = F.lit(0).cast("bigint")
    relation = F.when(F.col(m + "msg_type") == "R", F.to_json(F.struct(m + "namespace", m + "name", m + "columns")))
    flat = messages.select(
        "slot", "position", m + "msg_type", *[F.coalesce(m + c, none).alias(c) for c in ("lsn", "transaction_lsn", "timestamp_us", "xid", "relation_id")],
        relation.alias("relation"), F.to_json(m + "old_row").alias("old_row"), F.to_json(m + "row").alias("row"),
    )
    placed = flat.groupBy("slot").transformWithStateInPandas(ChangelogProcessor(), outputStructType=PLACED, outputMode="append", timeMode="None")
    read = placed.withColumn("r", F.from_json("relation", _RELATION)).withColumn("o", F.from_json("old_row", _CELLS)).withColumn("n", F.from_json("row", _CELLS))
    kind, columns = F.col("message_type"), F.col("r.columns")
    ack, schema, change = kind == "C", kind == "R", kind.isin("I", "U", "D")

    def image(cells: str) -> Column:
        return F.when(change, F.to_json(marshal(columns, F.col(cells))))

    return read.select(
        "slot", "position", F.when(ack, "ack").when(schema, "schema").otherwise("modification").alias("kind"), "timestamp_us", "r.namespace", "r.name", "lsn",
        F.when(~ack, F.col("sequence")).alias("sequence"), F.when(~ack, kind).alias("message_type"), F.when(schema, F.to_json(F.struct(columns.alias("columns")))).alias("spec"),
        image("o").alias("before"), image("n").alias("after"), F.when(change, F.to_json(F.coalesce(unchanged(columns, F.col("n")), F.array().cast("array<string>")))).alias("unchanged"),
        ack.alias("last_in_transaction"),
    )


def write_entries(entries: DataFrame, path: str) -> None:
    """Write all entries of a stream that are available now under ``path``, a folder for each micro-batch, which a repeated one replaces."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/entries/batch={number}")

    with rocksdb(entries.sparkSession):
        query = entries.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
