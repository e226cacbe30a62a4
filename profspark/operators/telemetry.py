"""Telemetry of the collecting programs themselves."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profspark.operators.ordered import lag, ordered
from profspark.schema import RAW_TYPES

# The probes that make up one program; a probe not listed is its own program.
PROGRAM_OF_PROBE = {
    "block_io_start": "block",
    "block_io_done": "block",
    "vfs_read": "vfs",
    "vfs_readv": "vfs",
    "vfs_write": "vfs",
    "vfs_writev": "vfs",
    "udp_recvmsg": "net",
    "udp_sendmsg": "net",
    "tcp_recvmsg": "net",
    "tcp_sendmsg": "net",
}

# Raw types counted together as one program; a type not listed is its own program.
PROGRAM_OF_TYPE = {
    "udp_recv": "net",
    "udp_send": "net",
    "tcp_recv": "net",
    "tcp_send": "net",
}

PROGRAM_LIST = T.ArrayType(
    T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("run_cnt", T.LongType()),
            T.StructField("run_time_ns", T.LongType()),
            T.StructField("pids", T.ArrayType(T.StructType([T.StructField("comm", T.StringType()), T.StructField("pid", T.LongType())]))),
        ]
    )
)


def _mapped(column: str, mapping: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(pairs[F.col(column)], F.col(column))


def program_rollup(probes: DataFrame) -> DataFrame:
    """Probe counters (snapshot_ts, probe, run_time_ns, run_cnt) summed up to programs."""
    return (
        probes.groupBy("snapshot_ts", _mapped("probe", PROGRAM_OF_PROBE).alias("program"))
        .agg(F.sum("run_time_ns").alias("run_time_ns"), F.sum("run_cnt").alias("run_cnt"))
    )


def counter_deltas(counters: DataFrame) -> DataFrame:
    """Growth of cumulative counters (snapshot_ts, program, run_time_ns, run_cnt, collected_cnt) between snapshots.

    The first snapshot of a program counts from 0 and has no wall time.
    """
    names = ["run_time_ns", "run_cnt", "collected_cnt"]
    before = ordered(
        counters, ["program"], ["snapshot_ts"], _prev=lag(F.struct("snapshot_ts", *names))
    )
    return before.select(
        "snapshot_ts",
        "program",
        (F.col("snapshot_ts") - F.col("_prev.snapshot_ts")).alias("wall_ns"),
        *[(F.col(n) - F.coalesce(F.col(f"_prev.{n}"), F.lit(0))).alias(n) for n in names],
    )


def program_rates(deltas: DataFrame) -> DataFrame:
    """Share of time busy, in percent, and run time per collected event; null where the divisor is 0 or unknown."""
    run_time = F.col("run_time_ns").cast("double")
    return deltas.withColumns(
        {
            "busy_percent": F.try_divide(run_time, F.col("wall_ns").cast("double")) * 100,
            "collected_latency_ns": F.try_divide(run_time, F.col("collected_cnt").cast("double")),
        }
    )


def counter_totals(per_cpu: DataFrame) -> DataFrame:
    """Per-CPU error counters (snapshot_ts, cpu, value) summed per snapshot."""
    return per_cpu.groupBy("snapshot_ts").agg(F.sum("value").alias("dropped"))


def reset_markers(totals: DataFrame) -> DataFrame:
    """Snapshots at which the dropped counter has grown; state is forgotten there."""
    before = ordered(totals.withColumn("_all", F.lit(0)), ["_all"], ["snapshot_ts"], _prev=lag(F.col("dropped")))
    return before.where(F.col("dropped") > F.coalesce("_prev", F.lit(0))).select("snapshot_ts", "dropped")


def events_per_program(raw: DataFrame) -> DataFrame:
    """Raw events received per collecting program."""
    known = raw.where(F.col("type").isin([t for t in RAW_TYPES if t != "reset"]))
    return known.groupBy(_mapped("type", PROGRAM_OF_TYPE).alias("program")).agg(F.count(F.lit(1)).alias("count"))


def program_list(lists: DataFrame, command: str, column: str = "value") -> DataFrame:
    """Programs held by processes of a command, from JSON program lists; one row per matching process.

    Missing counters are 0, and programs that never ran are left out.
    """
    programs = lists.select(F.explode(F.from_json(column, PROGRAM_LIST)).alias("p")).select(
        "p.name", "p.run_cnt", "p.run_time_ns", F.explode("p.pids").alias("holder")
    )
    count, time = F.coalesce("run_cnt", F.lit(0)), F.coalesce("run_time_ns", F.lit(0))
    return (
        programs.where(F.col("holder.comm") == command)
        .select(F.col("name").alias("command_name"), count.alias("run_cnt"), time.alias("run_time_ns"))
        .where((F.col("run_cnt") != 0) & (F.col("run_time_ns") != 0))
        .withColumn("avg_run_time_ns", F.col("run_time_ns") / F.col("run_cnt"))
    )
