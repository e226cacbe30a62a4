"""Analyses that end in one row per call path: (stack, count, value).

With ``paths``, the dictionary of ``intern_paths``, the events hold keys instead of call paths; keys are what is grouped and
shuffled, and the result gets its paths at the end.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profspark.functions.frames import combined_stack, is_empty
from profspark.operators.ordered import lag, lead, ordered
from profspark.plans.paths import STACKS, no_path, with_path


def selected(events: DataFrame, kinds: list[str], buildid: str | None = None, command: str | None = None) -> DataFrame:
    """Rows of some kinds, of one executable (build id in hex) or one command; all filters reach the scan."""
    rows = events.where(F.col("kind") == kinds[0]) if len(kinds) == 1 else events.where(F.col("kind").isin(kinds))
    if buildid is not None:
        rows = rows.where(F.col("buildid") == F.unhex(F.lit(buildid)))
    if command is not None:
        rows = rows.where(F.col("command") == command)
    return rows


def _stack(paths: DataFrame | None, stack: str = "ustack") -> str:
    return stack if paths is None else STACKS[stack]


def _named(found: DataFrame, paths: DataFrame | None) -> DataFrame:
    return found if paths is None else with_path(found, paths, "ustack")


def _empty(paths: DataFrame | None, stack: str) -> Column:
    return is_empty(stack) if paths is None else no_path(STACKS[stack])


def _count() -> Column:
    return F.count(F.lit(1)).alias("count")


def value_by_stack(
    events: DataFrame,
    kinds: list[str],
    value: str,
    name: str,
    buildid: str | None = None,
    command: str | None = None,
    paths: DataFrame | None = None,
) -> DataFrame:
    """Events and the sum of one column by user call path. Partial aggregation on the map side absorbs hot ones."""
    found = selected(events, kinds, buildid, command).groupBy(_stack(paths)).agg(_count(), F.sum(value).alias(name))
    return _named(found, paths)


def cpu_time(events: DataFrame, **who) -> DataFrame:
    return value_by_stack(events, ["profile"], "duration", "sampled_duration", **who)


def block_bytes(events: DataFrame, **who) -> DataFrame:
    return value_by_stack(events, ["blk_read", "blk_write"], "amount", "bytes", **who)


def block_latency(events: DataFrame, **who) -> DataFrame:
    return value_by_stack(events, ["blk_read", "blk_write"], "duration", "duration", **who)


def tcp_bandwidth(events: DataFrame, **who) -> DataFrame:
    return value_by_stack(events, ["tcp_send", "tcp_recv"], "amount", "bandwidth", **who)


def udp_bandwidth(events: DataFrame, **who) -> DataFrame:
    return value_by_stack(events, ["udp_recv", "udp_send"], "amount", "bandwidth", **who)


def file_read_bytes(events: DataFrame, **who) -> DataFrame:
    return value_by_stack(events, ["vfs_read"], "amount", "bytes", **who)


def file_write_bytes(events: DataFrame, **who) -> DataFrame:
    return value_by_stack(events, ["vfs_write"], "amount", "bytes", **who)


def off_cpu(
    events: DataFrame,
    buildid: str | None = None,
    command: str | None = None,
    dedup: bool = True,
    scope: tuple[str, ...] = (),
    paths: DataFrame | None = None,
) -> DataFrame:
    """Time from a thread's leaving the CPU to its next start, by combined stack.

    Only rows with some stack take part, also as the next start. A thread's last row counts but adds no time.
    ``scope``: the columns that tell hosts and runs apart, whose thread ids may be the same.
    """
    both = [_stack(paths, "ustack"), _stack(paths, "kstack")]
    rows = selected(events, ["switch"], buildid, command).where(~_empty(paths, "ustack") | ~_empty(paths, "kstack"))
    what = [combined_stack(dedup).alias("stack")] if paths is None else both
    rows = rows.select(*scope, "pid", "timestamp", (F.col("timestamp") - F.col("duration")).alias("start"), *what)
    gaps = ordered(rows, [*scope, "pid"], ["start", "timestamp"], next_start=lead(F.col("start")))
    off = F.sum(F.col("next_start") - F.col("timestamp")).alias("offcpu_ns")
    if paths is None:
        return gaps.groupBy("stack").agg(_count(), off)
    # Different pairs of paths may combine to one.
    pairs = gaps.groupBy(*both).agg(_count(), off)
    named = with_path(with_path(pairs, paths, "ustack"), paths, "kstack").withColumn("stack", combined_stack(dedup))
    return named.groupBy("stack").agg(F.sum("count").alias("count"), F.sum("offcpu_ns").alias("offcpu_ns"))


def rss_growth(
    events: DataFrame,
    buildid: str | None = None,
    command: str | None = None,
    skip_empty: bool | None = None,
    scope: tuple[str, ...] = (),
    paths: DataFrame | None = None,
) -> DataFrame:
    """Growth of the resident set by the stack that caused it, largest first.

    The by-command form drops rows without a stack before it compares neighbours, the by-build-id form keeps them.
    """
    if skip_empty is None:
        skip_empty = command is not None
    rows = selected(events, ["rss"], buildid, command)
    if skip_empty:
        rows = rows.where(~_empty(paths, "ustack"))
    rows = rows.select(*scope, "tgid", "timestamp", "pid", "amount", _stack(paths))
    steps = ordered(rows, [*scope, "tgid"], ["timestamp", "pid"], prev_amount=lag(F.col("amount")))
    grown = steps.where(F.col("amount") > F.col("prev_amount")).groupBy(_stack(paths))
    found = grown.agg(_count(), F.sum(F.col("amount") - F.col("prev_amount")).alias("total_rss"))
    return _named(found, paths).orderBy(F.desc("total_rss"))


def span_successors(events: DataFrame, columns: list[Column], span_keys: list[str]) -> DataFrame:
    """Exit and close rows with the start of the span's next such row (null for the last one)."""
    rows = selected(events, ["trace_exit", "trace_close"]).select(
        *span_keys, "timestamp", "kind", (F.col("timestamp") - F.col("duration")).alias("_start"), *columns
    )
    # A span that is left and closed in one nanosecond is left first.
    rows = rows.withColumn("_closes", F.when(F.col("kind") == "trace_close", 1).otherwise(0))
    return ordered(rows, span_keys, ["timestamp", "_closes"], next_start=lead(F.col("_start"))).drop("_start", "_closes")


def span_wait(
    events: DataFrame, clamp_negative: bool = False, span_keys: tuple[str, ...] = ("span_id",), paths: DataFrame | None = None
) -> DataFrame:
    """Time a span stays parked after an exit, by the stack it was parked at.

    A span that never resumes waits until the capture's last event. Closing rows end a wait but are not reported; their
    start is the span's first entry, which makes the last wait before a close negative unless ``clamp_negative``.
    Span ids are unique per process only; pass ``("tgid", "span_id")`` to keep processes apart.
    """
    rows = span_successors(events, [F.col(_stack(paths))], list(span_keys))
    end = events.agg(F.max("timestamp")).scalar()
    wait = F.coalesce("next_start", end) - F.col("timestamp")
    if clamp_negative:
        wait = F.greatest(wait, F.lit(0))
    found = rows.where(F.col("kind") == "trace_exit").groupBy(_stack(paths)).agg(_count(), F.sum(wait).alias("wait_ns"))
    return _named(found, paths).withColumnRenamed("ustack", "stack")
