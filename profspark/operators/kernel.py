"""From single kernel observations to raw events: pairing, throttling, sizes and process filters."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profspark.functions.frames import c_string
from profspark.operators.hot import materialized
from profspark.operators.intervals import Need, crowds, lookup, moment
from profspark.operators.ordered import Ordered, chained, lag, lead, ordered, running_sum
from profspark.operators.process import is_type

# Fixed value: kernel frames of the probe itself on a switch.
SWITCH_PROBE_FRAMES = 5


def pair_switches(switches: DataFrame, min_duration: int = 0, cpu_keys: tuple[str, ...] = ("cpu",)) -> DataFrame:
    """Time on CPU from context switches (seq, cpu, ts, tgid, pid, ...).

    A stay starts at the previous switch on the same CPU and belongs to the task that leaves. The first switch of a CPU
    has no start. Idle (pid 0) and short stays are dropped after pairing, since they still end the stay before.
    """
    paired = ordered(switches, list(cpu_keys), ["seq"], start=lag(F.col("ts")))
    duration = F.col("ts") - F.col("start")
    return paired.where(
        (F.col("start") > 0) & (F.col("start") <= F.col("ts")) & (F.col("pid") != 0) & (duration >= min_duration)
    )


def pair_block_io(requests: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Block operations from their start and done rows (seq, type, request, op, ts, tgid, pid, size, stack ids).

    The done row directly after a start row of its request closes it: a later start replaces an open one, and a done row
    without an open start is dropped. All but the direction and the end comes from the start row.
    """
    kept = ["type", "ts", "tgid", "pid", "size", "ustack_id", "kstack_id"]
    rows = ordered(requests, [*scope, "request"], ["seq"], opened=lag(F.struct(*kept)))
    return rows.where((F.col("type") == "done") & (F.col("opened.type") == "start")).select(
        *scope,
        "seq",
        F.col("ts"),
        F.col("opened.ts").alias("start"),
        F.col("opened.tgid").alias("tgid"),
        F.col("opened.pid").alias("pid"),
        F.col("opened.size").alias("amount"),
        write_flag("op").alias("rw"),
        F.col("opened.ustack_id").alias("ustack_id"),
        F.col("opened.kstack_id").alias("kstack_id"),
    )


def write_flag(op: str, write_op: int = 1) -> Column:
    """1 for the write operation, 0 for any other."""
    return F.when(F.col(op) == write_op, 1).otherwise(0)


def throttle(rows: DataFrame, every: int, seen: Column | None = None, scope: tuple[str, ...] = ()) -> DataFrame:
    """Per process the first and then each ``every``-th row in arrival order; 0 keeps all.

    ``seen`` is the number of the process's rows that came before these.
    """
    if every == 0:
        return rows
    numbered = ordered(rows, [*scope, "tgid"], ["seq"], _earlier=running_sum(F.lit(1).cast("bigint"), before=True))
    number = F.col("_earlier") if seen is None else F.col("_earlier") + seen
    return numbered.where(number % every == 0).drop("_earlier")


def rss_pages(clamp: bool = True) -> Column:
    """File, anonymous and shared pages; ``clamp`` takes negative counters as 0, as newer kernels are read."""
    parts = [F.col(c) for c in ("file_pages", "anon_pages", "shmem_pages")]
    if clamp:
        parts = [F.greatest(p, F.lit(0)) for p in parts]
    return parts[0] + parts[1] + parts[2]


def rss_events(counters: DataFrame, every: int = 29, clamp: bool = True, scope: tuple[str, ...] = ()) -> DataFrame:
    """Throttled resident-set events; ``amount`` is in pages."""
    return throttle(counters, every, scope=scope).withColumn("amount", rss_pages(clamp).cast("bigint"))


def file_events(calls: DataFrame) -> DataFrame:
    """File reads and writes; the size is the requested one (for vectored calls the number of vectors)."""
    return calls.withColumnRenamed("size", "amount")


def net_events(calls: DataFrame) -> DataFrame:
    """Network calls with the size they returned; failed calls (negative) are dropped."""
    return calls.where(F.col("size") >= 0).withColumnRenamed("size", "amount")


def drop_idle(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("pid") != 0)


def keep_tracked(
    raw: DataFrame, commands: list[str], scope: tuple[str, ...] = (), initial: DataFrame | None = None
) -> DataFrame:
    """Only events of processes that run, or started as, one of the commands.

    The exec of a listed command tracks its process until the process exits, whatever it execs meanwhile. Execs and
    exits count for group leaders only (pid = tgid). Reset markers and block completions, which name no process, pass.
    ``initial`` (``scope``, tgid, comm): processes that already run when the capture starts, as if they had begun before
    its first row. ``scope``: the columns that tell hosts and runs apart.
    """
    if initial is not None:
        seeds = initial.select(*scope, "tgid", F.col("tgid").alias("pid"), "comm", F.lit("process_exec").alias("type"))
        # Nulls come first in the order of arrival.
        raw = raw.withColumn("_seed", F.lit(False)).unionByName(seeds.withColumn("_seed", F.lit(True)), allowMissingColumns=True)
    is_exec, is_exit, passes = is_type("process_exec"), is_type("process_exit"), is_type("reset", "done")
    leader = ~(is_exec | is_exit) | F.coalesce(F.col("pid") == F.col("tgid"), F.lit(True))
    starts = is_exec & F.coalesce(c_string("comm").isin(commands), F.lit(False))
    keys = [*scope, "tgid"]
    rows = raw.where(leader)
    changes = materialized(rows.where(starts | is_exit).select(*keys, "seq", moment().alias("begin"), is_exit.alias("_exit")))
    crowd = crowds(changes, changes=Need(keys, F.lit(True)))["changes"]

    def until_next(part: DataFrame, slice_col: str | None) -> DataFrame:
        return Ordered(keys, ["seq"], slice_col).apply(part, end=lead(F.col("begin")), _ended=lead(F.col("_exit")))

    ended = chained(changes, crowd.slicing(changes), until_next, derived=False)
    # An exit still belongs to the process it ends.
    tracked = ended.where("not _exit").withColumn("end", F.when(F.col("_ended"), F.col("end") + 1).otherwise(F.col("end")))
    kept = lookup(rows.where(~passes), tracked, [], crowd, how="left_semi").unionByName(rows.where(passes))
    return kept if initial is None else kept.where(~F.col("_seed")).drop("_seed")


def select_call_paths(raw: DataFrame, collected: dict[str, str]) -> DataFrame:
    """Keep the stack ids asked for per event type: 'u', 'k', 'uk' / 'ku' or 'n'; others become -1."""

    def wanted(letter: str) -> list[str]:
        return [t for t, what in collected.items() if letter in what]

    listed = F.col("type").isin(list(collected))
    return raw.withColumns(
        {
            column: F.when(~listed | F.col("type").isin(wanted(letter)), F.col(column)).otherwise(-1)
            for letter, column in (("u", "ustack_id"), ("k", "kstack_id"))
        }
    )


def trim_probe_frames(frames: Column, count: int = SWITCH_PROBE_FRAMES) -> Column:
    """A switch's kernel path without the frames of the probe."""
    return F.slice(frames, F.lit(count + 1), F.greatest(F.size(frames) - count, F.lit(0)))


def span_parent(explicit: str, enclosing: str) -> Column:
    """A span's parent: the explicit one, else the span open around it, else 0."""
    return F.coalesce(explicit, enclosing, F.lit(0))


def align_clock(raw: DataFrame, offset: int | Column) -> DataFrame:
    """Monotonic times to epoch times by a per-run offset (a constant or a column)."""
    shift = offset if isinstance(offset, Column) else F.lit(offset)
    return raw.withColumns({c: F.col(c) + shift for c in ("ts", "start") if c in raw.columns})
