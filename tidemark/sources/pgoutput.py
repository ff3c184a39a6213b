"""The pgoutput message format of logical replication, decoded in Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Microseconds from 1970 to the epoch of the format, 2000-01-01.
EPOCH = 946_684_800_000_000
_TUPLE = "array<struct<type: string, value: string>>"
_COLUMNS = "array<struct<key: boolean, name: string, type: bigint, modifier: bigint>>"
#: Fields of a message as those of a Spark struct.
MESSAGE = (
    "msg_type: string, lsn: bigint, transaction_lsn: bigint, timestamp_us: bigint, xid: bigint, relation_id: bigint, namespace: string, name: string, "
    f"replica_identity: string, columns: {_COLUMNS}, old_kind: string, old_row: {_TUPLE}, row: {_TUPLE}"
)
_ARROW_TUPLE = pa.list_(pa.struct([("type", pa.string()), ("value", pa.string())]))
ARROW_MESSAGE = pa.struct([
    ("msg_type", pa.string()), ("lsn", pa.int64()), ("transaction_lsn", pa.int64()), ("timestamp_us", pa.int64()), ("xid", pa.int64()), ("relation_id", pa.int64()),
    ("namespace", pa.string()), ("name", pa.string()), ("replica_identity", pa.string()),
    ("columns", pa.list_(pa.struct([("key", pa.bool_()), ("name", pa.string()), ("type", pa.int64()), ("modifier", pa.int64())]))),
    ("old_kind", pa.string()), ("old_row", _ARROW_TUPLE), ("row", _ARROW_TUPLE),
])


class Malformed(ValueError):
    """Bytes that are no message of the format."""


@dataclass
class _Bytes:
    data: bytes
    at: int = 1

    def take(self, form: str) -> int:
        size = struct.calcsize(form)
        if self.at + size > len(self.data):
            raise Malformed("message ends early")
        (value,) = struct.unpack_from(form, self.data, self.at)
        self.at += size
        return value

    def letter(self) -> str:
        return chr(self.take(">B"))

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise Malformed("text without end")
        value, self.at = self.data[self.at : end].decode(), end + 1
        return value

    def row(self) -> list[dict]:
        """Cells: n (null), u (unchanged, its value was not sent) or t with a text."""
        cells = []
        for _ in range(self.take(">H")):
            kind, value = self.letter(), None
            if kind == "t":
                size = self.take(">I")
                if self.at + size > len(self.data):
                    raise Malformed("cell ends early")
                value, self.at = self.data[self.at : self.at + size].decode(), self.at + size
            elif kind not in "nu":
                raise Malformed(f"cell of kind {kind!r}")
            cells.append({"type": kind, "value": value})
        return cells


def decode_message(data: bytes) -> dict:
    """A message as a dictionary of the fields of MESSAGE that it has. Malformed for anything else; a truncate is not understood."""
    if not data:
        raise Malformed("empty message")
    kind, b = chr(data[0]), _Bytes(data)
    out: dict = {"msg_type": kind}
    match kind:
        case "B":
            out |= {"lsn": b.take(">q"), "timestamp_us": EPOCH + b.take(">q"), "xid": b.take(">I")}
        case "C":
            b.take(">B")
            out |= {"lsn": b.take(">q"), "transaction_lsn": b.take(">q"), "timestamp_us": EPOCH + b.take(">q")}
        case "O":
            out |= {"lsn": b.take(">q"), "name": b.text()}
        case "R":
            out |= {"relation_id": b.take(">I"), "namespace": b.text(), "name": b.text(), "replica_identity": b.letter()}
            out["columns"] = [{"key": b.take(">B") == 1, "name": b.text(), "type": b.take(">I"), "modifier": b.take(">I")} for _ in range(b.take(">H"))]
        case "Y":
            out |= {"relation_id": b.take(">I"), "namespace": b.text(), "name": b.text()}
        case "I" | "U" | "D":
            out["relation_id"], tag = b.take(">I"), b.letter()
            if kind != "I" and tag in "KO":
                out["old_kind"], out["old_row"] = tag, b.row()
                tag = b.letter() if kind == "U" else "N"
            elif kind == "D":
                tag = ""
            if tag != "N":
                raise Malformed(f"message {kind} has {tag!r} where its row should begin")
            if kind != "D":
                out["row"] = b.row()
        case _:
            raise Malformed(f"message of kind {kind!r}")
    return out


def decode(messages: DataFrame, data: str = "data", keep: list[str] | None = None, errors: str = "raise") -> DataFrame:
    """``keep`` columns and the struct ``message`` of each row's bytes. ``errors``: "raise", or "null" for a null message and the reason in ``error``.

    Null bytes are a null message.
    """
    keep = keep or []
    kept = messages.select(*keep, data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, reasons = [], []
            for value in batch.column(data).to_pylist():
                try:
                    out.append(None if value is None else decode_message(value))
                    reasons.append(None)
                except Malformed as e:
                    if errors == "raise":
                        raise
                    out.append(None)
                    reasons.append(str(e))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, ARROW_MESSAGE), pa.array(reasons, pa.string())], names=[*keep, "message", "error"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields if f.name in keep)
    return kept.mapInArrow(run, f"{schema}message struct<{MESSAGE}>, error string")


def encode_message(m: dict) -> bytes:
    """The bytes of a message: recorded streams and tests are made with this."""

    def text(x: str) -> bytes:
        return x.encode() + b"\0"

    def row(cells: list[dict]) -> bytes:
        body = b"".join(c["type"].encode() + (struct.pack(">I", len(c["value"].encode())) + c["value"].encode() if c["type"] == "t" else b"") for c in cells)
        return struct.pack(">H", len(cells)) + body

    kind = m["msg_type"]
    head = kind.encode()
    if kind == "B":
        return head + struct.pack(">qqI", m["lsn"], m["timestamp_us"] - EPOCH, m["xid"])
    if kind == "C":
        return head + struct.pack(">Bqqq", 0, m["lsn"], m["transaction_lsn"], m["timestamp_us"] - EPOCH)
    if kind == "O":
        return head + struct.pack(">q", m["lsn"]) + text(m["name"])
    if kind == "R":
        columns = b"".join(struct.pack(">B", c["key"]) + text(c["name"]) + struct.pack(">II", c["type"], c["modifier"]) for c in m["columns"])
        return head + struct.pack(">I", m["relation_id"]) + text(m["namespace"]) + text(m["name"]) + m["replica_identity"].encode() + struct.pack(">H", len(m["columns"])) + columns
    if kind == "Y":
        return head + struct.pack(">I", m["relation_id"]) + text(m["namespace"]) + text(m["name"])
    if kind in "IUD":
        old = m["old_kind"].encode() + row(m["old_row"]) if m.get("old_kind") else b""
        return head + struct.pack(">I", m["relation_id"]) + old + (b"N" + row(m["row"]) if kind != "D" else b"")
    raise Malformed(f"message of kind {kind!r}")
