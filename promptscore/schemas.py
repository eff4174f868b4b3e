"""Explicit schemas. All timestamps are TIMESTAMP_NTZ in UTC, so no result depends on a session zone."""

from pyspark.sql import types as T


def _schema(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


_S, _I, _L, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampNTZType()

REQUESTS = _schema(("request_id", _S), ("body", _S), ("received_at", _TS))
SETTLED = _schema(("prompt_id", _S), ("batch_id", _S), ("status", _S), ("total_count", _L))
ATTEMPTS = _schema(
    ("prompt_id", _S),
    ("batch_id", _S),
    ("round", _L),
    ("finished_at", _TS),
    ("http_status", _I),
    ("retry_after", _S),
    ("body", _S),
    ("transport_error", _S),
)
PROMPT_STATE = _schema(
    ("prompt_id", _S),
    ("batch_id", _S),
    ("status", _S),
    ("attempts", _L),
    ("response", _S),
    ("error", _S),
    ("next_retry_at", _TS),
    ("last_round", _L),
)
