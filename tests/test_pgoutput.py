import struct

import pytest

from tidemark.sources.pgoutput import EPOCH, Malformed, decode, decode_message, encode_message

CELLS = [{"type": "t", "value": "é1"}, {"type": "n", "value": None}, {"type": "u", "value": None}]
MESSAGES = [
    {"msg_type": "B", "lsn": 5, "timestamp_us": EPOCH + 7, "xid": 9},
    {"msg_type": "C", "lsn": 5, "transaction_lsn": 6, "timestamp_us": EPOCH - 7},
    {"msg_type": "O", "lsn": 5, "name": "origin"},
    {"msg_type": "R", "relation_id": 3, "namespace": "public", "name": "dogs", "replica_identity": "d", "columns": [{"key": True, "name": "id", "type": 20, "modifier": 4294967295}, {"key": False, "name": "m", "type": 25, "modifier": 0}]},
    {"msg_type": "Y", "relation_id": 4, "namespace": "", "name": "kind"},
    {"msg_type": "I", "relation_id": 3, "row": CELLS},
    {"msg_type": "U", "relation_id": 3, "row": CELLS},
    {"msg_type": "U", "relation_id": 3, "old_kind": "K", "old_row": CELLS[:1], "row": CELLS},
    {"msg_type": "U", "relation_id": 3, "old_kind": "O", "old_row": CELLS, "row": []},
    {"msg_type": "D", "relation_id": 3, "old_kind": "K", "old_row": CELLS},
    {"msg_type": "D", "relation_id": 3, "old_kind": "O", "old_row": CELLS},
]
GOLDEN = {
    "begin": (b"B" + bytes.fromhex("0000000000000005" "0000000000000007" "00000009"), MESSAGES[0]),
    "insert": (b"I" + bytes.fromhex("00000003") + b"N" + bytes.fromhex("0003") + b"t" + bytes.fromhex("00000003c3a931") + b"nu", MESSAGES[5]),
    "update with key": (b"U\0\0\0\3K\0\1t\0\0\0\3\xc3\xa91N\0\3t\0\0\0\3\xc3\xa91nu", MESSAGES[7]),
    "relation": (b"R\0\0\0\3public\0dogs\0d\0\2\1id\0\0\0\0\x14\xff\xff\xff\xff\0m\0\0\0\0\x19\0\0\0\0", MESSAGES[3]),
}
BAD = [b"", b"T\0\0\0\1", b"X", b"I\0\0\0\3K\0\0", b"U\0\0\0\3K\0\0X\0\0", b"U\0\0\0\3X", b"D\0\0\0\3N\0\0", b"I\0\0\0\3N\0\1t\0\0\0\x09ab", b"I\0\0\0\3N\0\1z", b"B\0", b"O" + struct.pack(">q", 1) + b"no end"]


@pytest.mark.parametrize("m", MESSAGES, ids=lambda m: m["msg_type"] + m.get("old_kind", ""))
def test_round_trip(m):
    assert decode_message(encode_message(m)) == m


@pytest.mark.parametrize("name", GOLDEN)
def test_bytes(name):
    data, message = GOLDEN[name]
    assert decode_message(data) == message and encode_message(message) == data


@pytest.mark.parametrize("data", BAD)
def test_malformed(data):
    with pytest.raises(Malformed):
        decode_message(data)


def test_as_columns(spark):
    rows = [(i, bytearray(encode_message(m))) for i, m in enumerate(MESSAGES)] + [(100, None), (101, bytearray(b"T"))]
    df = spark.createDataFrame(rows, "position bigint, data binary")
    got = {r["position"]: r for r in decode(df, "data", ["position"], errors="null").collect()}
    assert len(got) == len(rows) and got[100]["message"] is None and got[100]["error"] is None and "kind 'T'" in got[101]["error"]
    for i, m in enumerate(MESSAGES):
        row = got[i]["message"].asDict(recursive=True)
        assert {k: v for k, v in row.items() if v is not None} == m
    with pytest.raises(Exception, match="kind 'T'"):
        decode(df, "data").collect()
    assert decode(df.limit(0), "data", ["position"]).count() == 0
