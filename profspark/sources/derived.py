"""Event, raw and side tables derived from the general test tables (one parquet file each in a directory).

They give every operator an input whose size follows the tables. Nothing here is sampled or capped.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profspark.schema import KINDS, RAW_SCHEMA

Read = Callable[[SparkSession, str, str], DataFrame]
PLAIN_TYPES = ["switch", "sample", "rss", "block", "vfs", "udp_recv", "udp_send", "tcp_recv", "tcp_send"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as a stream."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))



def _utc_ns(column: str) -> Column:
    """A timestamp without zone taken as UTC, whatever the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone())) * 1000


def _cents(column: str = "value") -> Column:
    return F.floor(F.col(column) * 100).cast("bigint")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table, one row per row of ``events``."""
    e, u = F.col("event_id"), F.col("user_id")

    def path(length: Column, size: int, frame) -> Column:
        return F.transform(F.slice(F.array(*[F.lit(i) for i in range(size)]), 1, length.cast("int")), frame)

    def user_frame(i: Column) -> Column:
        return F.struct(
            F.concat(F.lit("fn_"), ((e * 7 + i * 3) % 11).cast("string")).alias("name"),
            ((e % 11) * 4096 + i).alias("address"),
            i.cast("bigint").alias("offset"),
        )

    def kernel_frame(i: Column) -> Column:
        n = (e + i) % 4
        return F.struct(
            F.concat(F.lit("k_"), n.cast("string")).alias("name"), n.alias("address"), F.lit(0).cast("bigint").alias("offset")
        )

    return table(spark, sf_dir, "events").select(
        _utc_ns("ts").alias("timestamp"),
        (_cents() * 1000).alias("duration"),
        _pick(KINDS, e % 13).alias("kind"),
        (e % 4).cast("int").alias("cpu"),
        (u % 8).alias("tgid"),
        u.alias("pid"),
        (u % 32).alias("span_id"),
        F.lit(0).cast("bigint").alias("parent_id"),
        e.alias("id"),
        (_cents() * 4096).alias("amount"),
        F.concat(F.lit("cmd"), (u % 3).cast("string")).alias("command"),
        F.concat(F.lit("span"), (u % 5).cast("string")).alias("trace_name"),
        F.unhex(F.concat(F.lit("0"), (u % 3).cast("string"))).alias("buildid"),
        path(e % 5, 4, user_frame).alias("ustack"),
        path(e % 3, 3, kernel_frame).alias("kstack"),
    )


def raw(spark: SparkSession, sf_dir: str, read: Read = table) -> DataFrame:
    """Raw events: 13 steps per row of ``orders``, interleaved with those of neighbouring orders.

    An order runs a span A with a span B inside, re-enters A, on another thread for some orders, and closes it. Some
    enters, exits and closes are missing, so that lists mismatch and spans stay open.
    """
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("step")
    steps = (
        read(spark, sf_dir, "orders")
        .repartition(spark.sparkContext.defaultParallelism)  # one small file, of which each row becomes many
        .select("o_orderkey", "o_custkey", "o_totalprice", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("step"))
        .where(~((s == 0) & (k % 17 == 0)))
        .where(~((s == 4) & (k % 11 == 0)))
        .where(~((s == 9) & (k % 13 == 0)))
        .where(~((s == 10) & (k % 50 != 0)))
        .where(~((s == 11) & (k % 997 != 0)))
        .where(~((s == 12) & (k % 4999 != 4998)))
    )
    seq = (k + s * 7) * 16 + s
    is_b = s.isin(2, 4)
    kind = (
        F.when(s.isin(0, 2, 7), "trace_enter")
        .when(s.isin(4, 6, 8), "trace_exit")
        .when(s == 9, "trace_close")
        .when(s == 10, "process_exec")
        .when(s == 11, "process_exit")
        .when(s == 12, "reset")
        .otherwise(_pick(PLAIN_TYPES, (k + s) % 9))
    )
    span = s.isin(0, 2, 4, 6, 7, 8, 9)
    rows = steps.select(
        seq.alias("seq"),
        kind.alias("type"),
        (seq * 1000).alias("ts"),
        (seq * 1000 - (k % 1000 + 1) * 100).alias("start"),
        (c % 64).alias("tgid"),
        F.when(s.isin(7, 8) & (k % 5 == 0), c + 64).otherwise(c).alias("pid"),
        (k % 4).cast("int").alias("cpu"),
        F.when(span, k * 2 + F.when(is_b, 2).otherwise(1)).alias("span_id"),
        F.when(span, F.when(is_b, k * 2 + 1).otherwise(0)).cast("bigint").alias("parent_id"),
        F.when(span, k).alias("id"),
        (F.floor("o_totalprice").cast("bigint") + s).alias("amount"),
        (k % 2).cast("int").alias("rw"),
        F.when(span, F.concat(F.when(is_b, F.lit("inner")).otherwise(F.lit("outer")), (k % 5).cast("string"))).alias("name"),
        F.when(s == 10, F.concat(F.lit("cmd"), (F.floor(k / 50) % 3).cast("string"))).alias("comm"),
        F.when(s == 10, F.unhex(F.concat(F.lit("0"), (k % 9).cast("string")))).alias("buildid"),
        F.when(k % 10 == 0, -1).when(k % 10 == 1, -14).otherwise(c).cast("int").alias("ustack_id"),
        F.when(k % 3 == 0, -1).otherwise(k % 7).cast("int").alias("kstack_id"),
    )
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA])


def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other process, found running at each reset marker of the raw events."""
    every = F.explode(F.sequence(F.lit(0), F.lit(62), F.lit(2)).cast("array<bigint>")).alias("tgid")
    found = raw(spark, sf_dir).where("type = 'reset'").select("seq", every)
    name = F.concat(F.lit("run"), (F.col("tgid") % 6).cast("string"))
    return found.select("seq", "tgid", name.alias("comm"), F.unhex(F.lpad((F.col("tgid") % 10).cast("string"), 2, "0")).alias("buildid"))


def raw_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw events with execs and exits of group leaders, which are the ones that count."""
    leader = F.when(F.col("type").isin("process_exec", "process_exit"), F.col("tgid")).otherwise(F.col("pid"))
    return raw(spark, sf_dir).withColumn("pid", leader)


def stackmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stack per customer, with zeros at the end; some ids are missing."""
    c = F.col("c_custkey")
    frames = F.transform(F.sequence(F.lit(0), (c % 6 + 2).cast("int")), lambda i: (c * 61 + i * 7919) % 100000 + 1)
    zeros = F.array(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    return (
        table(spark, sf_dir, "customer")
        .where(c % 29 != 0)
        .select(c.cast("int").alias("stack_id"), F.concat(frames, zeros).alias("frames"))
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol per customer, spread over the kernel scope and 64 processes, with gaps between them."""
    c = F.col("c_custkey")
    start = F.floor(c / 65).cast("bigint") * 4096
    return table(spark, sf_dir, "customer").select(
        (c % 65 - 1).alias("scope"),
        start.alias("start"),
        (start + 4000).alias("end"),
        F.concat(F.lit("sym_"), (c % 97).cast("string")).alias("name"),
    )


def symbol_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols from the start on; every third process has a second table later, with half of them by other names."""
    first = symbols(spark, sf_dir)
    later = first.where("scope > 0 and scope % 3 = 0 and start div 4096 % 2 = 0").withColumn("name", F.concat(F.lit("new_"), "name"))
    return first.withColumn("since", F.lit(None).cast("bigint")).unionByName(later.withColumn("since", F.col("scope") * 5000))


def wide_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of three groups: vast ones, nested and around zero; small ones, overlapping; negative ones; all numbers."""
    s = F.col("s_suppkey")
    # Within 64 bits: after 2000 vast ranges the next ones start and end a little before them.
    vast, turn = s % 2000, F.floor(s / 2000)
    parts = [
        (0, -vast * 1125899906842624 - turn, vast * 4611686018427387 - turn),
        (1_000_000, s * 640 - 3200, s * 640 + 3200),
        (2_000_000, -s * 65536 - 7, -s * 65536 + 60000),
    ]
    rows = F.array(*[F.struct((s + i).alias("id"), a.cast("bigint").alias("start"), b.cast("bigint").alias("end")) for i, a, b in parts])
    own = table(spark, sf_dir, "supplier").select((s % 3).alias("grp"), F.explode(rows).alias("r")).select("grp", "r.*")
    every = spark.range(1).select(
        F.lit(0).cast("bigint").alias("grp"), F.lit(3_000_000).cast("bigint").alias("id"),
        F.lit(-(1 << 63)).cast("bigint").alias("start"), F.lit((1 << 63) - 1).cast("bigint").alias("end"),
    )
    return own.unionByName(every)


def wide_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    at = F.array(p * 64, -p * 4096, p * 1099511627776, -p * 1099511627776)
    return table(spark, sf_dir, "part").select((p % 3).alias("grp"), F.explode(at).alias("addr")).distinct()


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source line range per part, some with inlined calls."""
    p = F.col("p_partkey")
    inlined = F.transform(
        F.slice(F.array(F.lit(0), F.lit(1)), 1, (p % 3).cast("int")),
        lambda i: F.struct(
            F.concat(F.lit("inl_"), ((p + i) % 13).cast("string")).alias("name"),
            F.concat(F.lit("inl/"), ((p + i) % 13).cast("string"), F.lit(".rs")).alias("file"),
            (p % 50 + i).alias("line"),
            (p % 7).alias("col"),
        ),
    )
    return table(spark, sf_dir, "part").select(
        (p * 64).alias("start"),
        (p * 64 + 48).alias("end"),
        F.concat(F.lit("src/"), (p % 37).cast("string"), F.lit(".rs")).alias("file"),
        (p % 1000).alias("line"),
        (p % 80).alias("col"),
        inlined.alias("inlined"),
    )


def switches(spark: SparkSession, sf_dir: str, read: Read = table) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return read(spark, sf_dir, "events").select(
        e.alias("seq"),
        (e % 4).cast("int").alias("cpu"),
        ((e + 1) * 1000 + u).alias("ts"),
        (u % 8).alias("tgid"),
        F.when(e % 17 == 0, 0).otherwise(u + 1).alias("pid"),
        F.lit(-1).alias("ustack_id"),
        (e % 7).cast("int").alias("kstack_id"),
    )


def block_requests(spark: SparkSession, sf_dir: str, read: Read = table) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    half = F.floor(e / 2).cast("bigint")
    return (
        read(spark, sf_dir, "events")
        .where(~((e % 2 == 0) & (half % 7 == 0)))
        .select(
            e.alias("seq"),
            F.when(e % 2 == 0, "start").otherwise("done").alias("type"),
            (half % 50).alias("request"),
            (e % 3).cast("int").alias("op"),
            (e * 1000 + u).alias("ts"),
            (u % 8).alias("tgid"),
            u.alias("pid"),
            (_cents() + 1).alias("size"),
            (e % 11).cast("int").alias("ustack_id"),
            F.lit(-1).alias("kstack_id"),
        )
    )


def rss_counters(spark: SparkSession, sf_dir: str, read: Read = table) -> DataFrame:
    e, u, v = F.col("event_id"), F.col("user_id"), F.floor("value").cast("bigint")
    return read(spark, sf_dir, "events").select(
        e.alias("seq"),
        (e * 1000).alias("ts"),
        (u % 8).alias("tgid"),
        u.alias("pid"),
        v.alias("file_pages"),
        (v - 10).alias("anon_pages"),
        F.lit(1).cast("bigint").alias("shmem_pages"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File and network calls, one per line item; some network calls fail."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        (k * 16 + n).alias("seq"),
        _pick(["vfs", "udp_recv", "udp_send", "tcp_recv", "tcp_send"], F.col("l_partkey") % 5).alias("type"),
        (F.col("l_suppkey") % 8).alias("tgid"),
        F.col("l_suppkey").alias("pid"),
        (F.col("l_partkey") % 2).cast("int").alias("rw"),
        (F.floor("l_quantity").cast("bigint") - 3).alias("size"),
    )


def probe_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a day per probe; each event type stands for four probes."""
    day = F.floor(F.col("event_id") / 500).cast("bigint")
    names = ["block_io_start", "block_io_done", "vfs_read", "vfs_writev", "udp_recvmsg", "tcp_sendmsg", "rss_stat", "sched_switch"]
    return (
        table(spark, sf_dir, "events")
        .groupBy((day * 1_000_000_000).alias("snapshot_ts"), _pick(names, F.col("user_id") % 8).alias("probe"))
        .agg(F.sum(_cents()).alias("run_time_ns"), F.count(F.lit(1)).alias("run_cnt"))
    )


def program_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counters per event type: an event's id grows, so the largest id of a stretch is a running counter."""
    e = F.col("event_id")
    return (
        table(spark, sf_dir, "events")
        .groupBy((F.floor(e / 500).cast("bigint") * 1_000_000_000).alias("snapshot_ts"), F.col("event_type").alias("program"))
        .agg(
            (F.max(e) * 1000).alias("run_time_ns"),
            (F.max(e) + 1).alias("run_cnt"),
            F.floor(F.max(e) / 2).cast("bigint").alias("collected_cnt"),
        )
    )


def cpu_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropped-event counters per CPU and snapshot; they only grow."""
    e = F.col("event_id")
    snapshot = F.floor(e / 500).cast("bigint")
    return (
        table(spark, sf_dir, "events")
        .groupBy((snapshot * 1_000_000_000).alias("snapshot_ts"), (e % 4).cast("int").alias("cpu"))
        .agg(F.floor(F.max(snapshot) / 3).cast("bigint").alias("value"))
    )


def program_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON program lists, one per customer with two programs; counters and holders are missing in some."""
    c = F.col("c_custkey")
    first = F.concat(
        F.lit('{"name":"prog'), (c % 20).cast("string"), F.lit('","run_cnt":'), (c % 4).cast("string"),
        F.lit(',"run_time_ns":'), (c * 10).cast("string"), F.lit(',"pids":[{"comm":"cmd'), (c % 3).cast("string"),
        F.lit('","pid":1},{"comm":"cmd0","pid":2}]}'),
    )
    second = F.concat(F.lit('{"name":"other'), (c % 20).cast("string"), F.lit('","run_time_ns":5}'))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("["), first, F.lit(","), second, F.lit("]")).alias("value"))


def named_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-size name buffers: a customer's name, cut short by a NUL for some."""
    c = F.col("c_custkey")
    tail = F.when(c % 4 == 0, F.concat(F.lit("\0"), F.lit("rest"))).otherwise(F.lit("_long_tail_of_name"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.substring("c_mktsegment", 1, 6), tail).cast("binary").alias("buffer")
    )
