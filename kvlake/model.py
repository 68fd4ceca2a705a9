"""Schemas of the data model: an append-only log of puts and deletes is the stored truth."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
DELETE, PUT = 0, 1
SLOTS = 256
LEVELS = 7
#: Keys under this prefix hold bookkeeping and are no user's.
RESERVED_PREFIX = b"\x00!raft/"
#: Largest encoded batch, in bytes.
MAX_BATCH_BYTES = 64 << 20

_OP = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])

OPS = T.StructType(
    [T.StructField("seq", T.LongType(), False), T.StructField("key", T.BinaryType(), False), T.StructField("kind", T.ByteType(), False), T.StructField("value", T.BinaryType())]
)
BATCHES = T.StructType([T.StructField("batch_id", T.LongType(), False), T.StructField("ops", T.ArrayType(_OP))])
COMMANDS = T.StructType(
    [
        T.StructField("log_index", T.LongType(), False),
        T.StructField("term", T.LongType()),
        T.StructField("entry_type", T.ByteType()),
        T.StructField("client_id", T.LongType()),
        T.StructField("client_seq", T.LongType()),
        T.StructField("ops", T.ArrayType(_OP)),
    ]
)
SHARD_MAP = T.StructType([T.StructField("epoch", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("group_id", T.LongType()), T.StructField("migrating", T.BooleanType())])
FILES = T.StructType(
    [T.StructField("level", T.IntegerType()), T.StructField("file_num", T.LongType()), T.StructField("size", T.LongType()), T.StructField("smallest", T.BinaryType()), T.StructField("largest", T.BinaryType())]
)
EDITS = T.StructType([T.StructField("edit_id", T.LongType()), T.StructField("action", T.StringType()), *FILES.fields])
HISTORY = T.StructType(
    [
        T.StructField("op_id", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("start_ts", T.LongType()),
        T.StructField("end_ts", T.LongType()),
        T.StructField("ok", T.BooleanType()),
    ]
)
