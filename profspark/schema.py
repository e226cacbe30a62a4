"""Data model: the event table, the raw event table and their side tables."""

from pyspark.sql import types as T

# The event kinds of the persisted table.
KINDS = [
    "profile",
    "switch",
    "rss",
    "trace_exit",
    "trace_close",
    "blk_read",
    "blk_write",
    "vfs_read",
    "vfs_write",
    "udp_recv",
    "udp_send",
    "tcp_recv",
    "tcp_send",
]

# The types a raw event may have. "reset" marks a loss of events.
RAW_TYPES = [
    "switch",
    "sample",
    "process_exec",
    "process_exit",
    "trace_enter",
    "trace_exit",
    "trace_close",
    "rss",
    "block",
    "vfs",
    "udp_recv",
    "udp_send",
    "tcp_recv",
    "tcp_send",
    "reset",
]

FRAME = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("address", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),  # ns, end of the interval
        T.StructField("duration", T.LongType()),  # ns
        T.StructField("kind", T.StringType()),
        T.StructField("cpu", T.IntegerType()),
        T.StructField("tgid", T.LongType()),  # process
        T.StructField("pid", T.LongType()),  # thread
        T.StructField("span_id", T.LongType()),
        T.StructField("parent_id", T.LongType()),
        T.StructField("id", T.LongType()),
        T.StructField("amount", T.LongType()),
        T.StructField("command", T.StringType()),
        T.StructField("trace_name", T.StringType()),
        T.StructField("buildid", T.BinaryType()),
        T.StructField("ustack", T.ArrayType(FRAME)),  # innermost frame first
        T.StructField("kstack", T.ArrayType(FRAME)),
    ]
)

# One row per raw event in arrival order; columns an event type does not use are null.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),  # arrival order, unique
        T.StructField("type", T.StringType()),
        T.StructField("ts", T.LongType()),  # monotonic ns, end of the interval
        T.StructField("start", T.LongType()),  # monotonic ns, switch and block only
        T.StructField("tgid", T.LongType()),
        T.StructField("pid", T.LongType()),
        T.StructField("cpu", T.IntegerType()),
        T.StructField("span_id", T.LongType()),
        T.StructField("parent_id", T.LongType()),
        T.StructField("id", T.LongType()),
        T.StructField("amount", T.LongType()),  # bytes, pages (rss) or the span's metric
        T.StructField("rw", T.IntegerType()),  # 0 read, 1 write
        T.StructField("name", T.StringType()),
        T.StructField("comm", T.StringType()),
        T.StructField("buildid", T.BinaryType()),
        T.StructField("ustack_id", T.IntegerType()),  # -1 when not collected
        T.StructField("kstack_id", T.IntegerType()),
    ]
)

LINE_SCHEMA = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("line", T.LongType()),
        T.StructField("col", T.LongType()),
        T.StructField(
            "inlined",  # innermost call first
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("file", T.StringType()),
                        T.StructField("line", T.LongType()),
                        T.StructField("col", T.LongType()),
                    ]
                )
            ),
        ),
    ]
)

# Scope of kernel symbols and kernel call paths; user ones are scoped by their tgid.
KERNEL_SCOPE = -1
