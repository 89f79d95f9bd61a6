"""Explicit schemas of the entity tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_STR, _LONG, _INT = T.StringType(), T.LongType(), T.IntegerType()
_TS, _BOOL, _DBL = T.TimestampType(), T.BooleanType(), T.DoubleType()

OFFERS = _schema(
    ("ts", _TS), ("seq", _LONG), ("batch_id", _LONG), ("session_id", _STR),
    ("user_hash", _STR), ("ip", _LONG), ("port", _INT), ("file_hash", _STR),
    ("client_id", _LONG), ("client_port", _INT), ("name", _STR), ("size", _LONG),
)
FILES = _schema(("file_hash", _STR), ("name", _STR), ("size", _LONG), ("last_seen", _TS))
SOURCES = _schema(
    ("file_hash", _STR), ("user_hash", _STR), ("ip", _LONG), ("port", _INT),
    ("complete", _BOOL), ("first_ts", _TS), ("last_ts", _TS),
)
POSTINGS = _schema(("token", _STR), ("file_hash", _STR))
CLIENTS = _schema(
    ("user_hash", _STR), ("assigned_id", _LONG), ("ip", _LONG), ("port", _INT),
    ("udp_port", _INT), ("natt_capable", _BOOL), ("nick", _STR), ("is_high_id", _BOOL),
    ("connected_at", _TS), ("country", _STR), ("software", _STR),
)
BLOCKS = _schema(
    ("user_hash", _STR), ("file_hash", _STR), ("name", _STR), ("layer", _STR),
    ("reason", _STR), ("size", _LONG), ("caught_at", _TS),
)
QUERIES = _schema(("ip", _LONG), ("ts", _TS), ("opcode", _STR), ("local_port", _INT))
DETECTIONS = _schema(
    ("ip", _LONG), ("first_seen", _TS), ("last_seen", _TS), ("query_count", _LONG),
    ("qpm", _DBL), ("interval_stddev_ms", _DBL), ("country", _STR), ("reason", _STR),
)
IP_RANGES = _schema(
    ("range_start", _LONG), ("range_end", _LONG), ("level", _INT), ("description", _STR),
)
GEO_RANGES = _schema(("range_start", _LONG), ("range_end", _LONG), ("code", _STR))
PEERS = _schema(("ip", _LONG), ("port", _INT), ("added_at", _TS), ("verified_at", _TS))
WARNINGS = _schema(("ts", _TS), ("level", _STR), ("message", _STR), ("fields", _STR))
