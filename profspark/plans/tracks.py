"""Timeline rows (event contract of the trace export) and the small report queries."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profspark.functions.frames import combined_stack
from profspark.operators.ordered import lead, ordered
from profspark.plans.by_stack import selected, span_successors

def _micros(column: str) -> Column:
    return F.expr(f"({column}) div 1000")


def _sorted(rows: DataFrame, sort: bool, *order: str) -> DataFrame:
    return rows.orderBy(*order) if sort else rows


def rss_track(events: DataFrame, sort: bool = True) -> DataFrame:
    """Resident set per process as a counter."""
    rows = (
        selected(events, ["rss"])
        .select(
            F.lit("counter").alias("event"),
            "kind",
            F.col("command").alias("name"),
            _micros("timestamp").alias("timestamp"),
            F.col("tgid").alias("pid"),
            "amount",
        )
    )
    return _sorted(rows, sort, "timestamp", "pid")


def switch_slices(events: DataFrame, sort: bool = True) -> DataFrame:
    """Time on CPU per thread, with the stack at the end of it."""
    rows = (
        selected(events, ["switch"])
        .select(
            F.lit("complete").alias("event"),
            _micros("timestamp - duration").alias("start"),
            _micros("duration").alias("duration"),
            F.col("tgid").alias("pid"),
            F.col("pid").alias("tid"),
            F.col("command").alias("name"),
            combined_stack().alias("end_stack"),
            "cpu",
        )
    )
    return _sorted(rows, sort, "start", "pid")


def span_slices(
    events: DataFrame,
    kinds: tuple[str, ...] = ("trace_exit", "trace_close"),
    start_unit: str = "ns",
    sort: bool = True,
) -> DataFrame:
    """Spans as slices. By default the start is ``timestamp - duration div 1000``, nanoseconds less microseconds, as
    existing timelines have it; ``start_unit="us"`` gives the start in microseconds."""
    start = _micros("timestamp - duration") if start_unit == "us" else F.expr("timestamp - duration div 1000")
    rows = (
        selected(events, list(kinds))
        .select(
            F.lit("complete").alias("event"),
            "kind",
            start.alias("start"),
            _micros("duration").alias("duration"),
            F.col("tgid").alias("pid"),
            F.col("pid").alias("tid"),
            F.col("trace_name").alias("name"),
            "cpu",
            F.col("ustack").alias("end_stack"),
        )
    )
    return _sorted(rows, sort, "start", "pid")


def slow_spans(
    events: DataFrame, threshold_ns: int = 10_000_000, start_unit: str = "ns", sort: bool = True
) -> DataFrame:
    """Single stays on CPU inside a span that took longer than the threshold."""
    return span_slices(events.where(F.col("duration") > threshold_ns), ("trace_exit",), start_unit, sort)


def parked_spans(
    events: DataFrame, span_keys: tuple[str, ...] = ("span_id",), keep_thread: bool = False, sort: bool = True
) -> DataFrame:
    """Spans that were left and neither resumed nor closed, from their last exit to the capture's end.

    ``tid`` repeats the process id, as existing timelines have it, unless ``keep_thread``.
    """
    columns = [F.col(c) for c in ("tgid", "pid", "trace_name", "cpu", "ustack") if c not in span_keys]
    rows = span_successors(events, columns, list(span_keys))
    end = events.agg(F.max("timestamp")).scalar()
    rows = (
        rows.where((F.col("kind") == "trace_exit") & F.col("next_start").isNull())
        .select(
            F.lit("complete").alias("event"),
            "kind",
            _micros("timestamp").alias("start"),
            F.call_function("div", end - F.col("timestamp"), F.lit(1000)).alias("duration"),
            F.col("tgid").alias("pid"),
            F.col("pid" if keep_thread else "tgid").alias("tid"),
            F.col("trace_name").alias("name"),
            "cpu",
            F.col("ustack").alias("end_stack"),
        )
    )
    return _sorted(rows, sort, "start", "pid")


def io_totals(events: DataFrame, kinds: tuple[str, ...] = ("blk_write", "tcp_send", "tcp_recv")) -> DataFrame:
    """Events and bytes by command and kind."""
    return (
        selected(events, list(kinds))
        .groupBy("command", "kind")
        .agg(F.count(F.lit(1)).alias("total"), F.sum("amount").alias("amount_sum"))
    )


def peak_rss(events: DataFrame) -> DataFrame:
    """Samples and the largest resident set by command."""
    return (
        selected(events, ["rss"])
        .groupBy("command")
        .agg(F.count(F.lit(1)).alias("total"), F.max("amount").alias("amount_max"))
    )


def off_cpu_in_kernel(
    events: DataFrame, functions: list[str], command: str | None = None, scope: tuple[str, ...] = ()
) -> DataFrame:
    """Off-CPU time of threads that wait below given kernel functions; a thread's last row has no successor and is
    left out. One row per function that occurs. Times of many threads may add up to more than 64 bits hold, so the
    sum is a decimal."""
    rows = selected(events, ["switch"], command=command).select(
        *scope,
        "pid",
        "timestamp",
        (F.col("timestamp") - F.col("duration")).alias("start"),
        F.array_intersect(F.col("kstack.name"), F.array(*[F.lit(f) for f in functions])).alias("functions"),
    )
    gaps = ordered(rows, [*scope, "pid"], ["timestamp", "start"], wakeup=lead(F.col("start")))
    return (
        gaps.where(F.col("wakeup").isNotNull() & (F.col("wakeup") != 0))
        .select(F.explode("functions").alias("function"), (F.col("wakeup") - F.col("timestamp")).alias("wait"))
        .groupBy("function")
        .agg(F.count(F.lit(1)).alias("count"), F.sum(F.col("wait").cast("decimal(28,0)")).alias("offcpu_ns"))
    )


def missing_call_paths(samples: DataFrame) -> DataFrame:
    """Samples whose user stack could not be collected, by error number (-1 only means it was not asked for)."""
    return (
        samples.where((F.col("type") == "sample") & (F.col("ustack_id") < -1))
        .groupBy("ustack_id")
        .agg(F.count(F.lit(1)).alias("count"))
    )
