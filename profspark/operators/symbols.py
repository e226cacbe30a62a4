"""Stack ids to call paths of symbols.

A process's symbols may come in several tables, one after the other: a column ``since`` of the symbols is the arrival
order (``seq``) from which a table holds, null from the start on, and it holds until the next one of its process. Rows
then carry ``version``, the ``since`` of the table that held when they arrived, so that a process id that is used again
never reads the table of the process before. Kernel symbols have one table. ``run`` names the columns of a host and run,
which keep equal process and stack ids of several runs apart; symbols and the stack map have them, too.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profspark.operators.hot import hot_keys, materialized, spread_join, too_few
from profspark.operators.intervals import EARLIEST, Need, crowds, lookup
from profspark.operators.ordered import Ordered, chained, lead
from profspark.operators.ranges import range_lookup
from profspark.schema import FRAME, KERNEL_SCOPE

Run = tuple[str, ...]
# A task finds the symbols of about so many addresses, and puts them together: sorted with their frames, some KB each.
TASK_ADDRESSES = 100_000
# Call paths of at most so many frames in all, some MB, are broadcast to the events.
BROADCAST_FRAMES = 200_000
# Events of more raw rows than this are written before their call paths are joined by shuffles.
WRITTEN_ROWS = 5_000_000


def _since() -> Column:
    return F.coalesce(F.col("since"), F.lit(EARLIEST).cast("bigint"))


def with_version(rows: DataFrame, symbols: DataFrame, run: Run = ()) -> DataFrame:
    """Rows (``run``, seq, tgid, ...) with the ``version`` of their process's symbols; null before the first table."""
    keys = [*run, "tgid"]
    tables = symbols.where(F.col("scope") != KERNEL_SCOPE).select(*run, F.col("scope").alias("tgid"), _since().alias("begin")).distinct()
    tables = materialized(tables)
    crowd = crowds(tables, order="begin", tables=Need(keys, F.lit(True)))["tables"]

    def until_next(part: DataFrame, slice_col: str | None) -> DataFrame:
        return Ordered(keys, ["begin"], slice_col).apply(part, end=lead(F.col("begin")))

    held = chained(tables, crowd.slicing(tables, "begin"), until_next, derived=False)
    return lookup(rows, held.withColumn("version", F.col("begin")), ["version"], crowd)


def place(df: DataFrame, run: Run = ()) -> list[str]:
    """The columns that tell apart where a stack id or an address means something."""
    return [*run, "scope", *(["version"] if "version" in df.columns else [])]


def used_call_paths(rows: DataFrame, run: Run = ()) -> DataFrame:
    """Distinct (run, scope, version, stack_id) of the rows: user call paths per process, kernel ones in one scope. Ids
    below 0 mean that no stack was collected. Without versioned rows there is no ``version``."""
    versioned = "version" in rows.columns
    version = [F.col("version")] if versioned else []
    start = [F.lit(EARLIEST).cast("bigint").alias("version")] if versioned else []
    user = F.struct(F.col("tgid").alias("scope"), *version, F.col("ustack_id").alias("stack_id"))
    kernel = F.struct(F.lit(KERNEL_SCOPE).cast("bigint").alias("scope"), *start, F.col("kstack_id").alias("stack_id"))
    both = rows.select(*run, F.explode(F.array(user, kernel)).alias("stack")).select(*run, "stack.*")
    return both.where(F.col("stack_id") >= 0).distinct()


def stack_addresses(used: DataFrame, stackmap: DataFrame, run: Run = ()) -> DataFrame:
    """(run, scope, version, stack_id, pos, address) of the non-zero addresses; unknown stack ids vanish."""
    keys = [*run, "stack_id"]
    hot = hot_keys(used, keys)
    return (
        spread_join(used, stackmap, keys, "scope", hot, "inner")
        .select(*place(used, run), "stack_id", F.posexplode("frames").alias("pos", "address"))
        .where(F.col("address") != 0)
    )


def _dealt(rows: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """By the keys in more partitions, if the session's shuffles have too few."""
    return rows.repartition(tasks, *keys) if too_few(rows.sparkSession, tasks) else rows


def resolve_addresses(addresses: DataFrame, symbols: DataFrame, run: Run = (), tasks: int = 0) -> DataFrame:
    """(run, scope, version, address, frame) for the distinct addresses that lie in a symbol (run, scope, since, start,
    end, name) of their place. ``tasks``: how many the number of addresses asks for, where it is known."""
    keys = place(addresses, run)
    ranges = symbols.withColumn("symbol", F.col("start"))
    if "version" in keys:
        ranges = ranges.withColumn("version", F.when(F.col("scope") == KERNEL_SCOPE, F.lit(EARLIEST).cast("bigint")).otherwise(_since()))
    wanted = _dealt(addresses.select(*keys, "address"), [*keys, "address"], tasks).distinct()
    named = range_lookup(wanted, ranges, keys, "address", ["name", "symbol"])
    frame = F.struct(
        "name", F.col("symbol").alias("address"), (F.col("address") - F.col("symbol")).alias("offset")
    )
    return named.where("found").select(*keys, "address", frame.alias("frame"))


def resolved_call_paths(rows: DataFrame, stackmap: DataFrame, symbols: DataFrame, run: Run = ()) -> DataFrame:
    """(run, scope, version, stack_id, stack) of the call paths the rows use; frames without a symbol are left out,
    order is kept.

    Works on distinct call paths and distinct addresses, so its size follows the variety of code, not the number of events.
    """
    used = materialized(used_call_paths(rows, run))
    addresses = materialized(stack_addresses(used, stackmap, run))
    keys = [*place(used, run), "address"]
    hot = hot_keys(addresses, keys)
    tasks, own = -(-hot.total // TASK_ADDRESSES), [*place(used, run), "stack_id"]
    resolved = resolve_addresses(addresses, symbols, run, tasks)
    frames = spread_join(addresses, resolved, keys, "stack_id", hot, "inner")
    return _dealt(frames, own, tasks).groupBy(*own).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "frame"))), lambda f: f["frame"]).alias("stack")
    )


def with_call_paths(rows: DataFrame, paths: DataFrame, raw: DataFrame, run: Run = ()) -> DataFrame:
    """Replace ``ustack_id`` and ``kstack_id`` by the ``resolved_call_paths``; an empty one where nothing was resolved.

    Call paths that very many events share are looked for in ``raw``, the cheap input the rows come from.
    """
    none = F.array().cast(f"array<{FRAME.simpleString()}>")
    paths = materialized(paths)
    frames = {r["kernel"]: r["frames"] for r in paths.groupBy((F.col("scope") == KERNEL_SCOPE).alias("kernel")).agg(F.sum(F.size("stack") + 1).alias("frames")).collect()}
    version = ["version"] if "version" in paths.columns else []
    user = paths.where(F.col("scope") != KERNEL_SCOPE).select(
        *run, F.col("scope").alias("tgid"), *version, F.col("stack_id").alias("ustack_id"), F.col("stack").alias("ustack")
    )
    kernel = paths.where(F.col("scope") == KERNEL_SCOPE).select(
        *run, F.col("stack_id").alias("kstack_id"), F.col("stack").alias("kstack")
    )
    both = [(frames.get(False, 0), [*run, "tgid", *version, "ustack_id"], user), (frames.get(True, 0), [*run, "kstack_id"], kernel)]
    # What is broadcast comes last, so that no found call path is shuffled for it.
    for size, keys, side in sorted(both, key=lambda x: x[0] <= BROADCAST_FRAMES):
        if size <= BROADCAST_FRAMES:
            rows = rows.join(F.broadcast(side), keys, "left")
            continue
        # Events without a stack carry -1, which may be the largest key of all; it is counted like the others.
        ids = raw.select(*run, "tgid", *version, *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("ustack_id", "kstack_id")])
        hot = hot_keys(ids, keys)
        # The shuffles that made the events are gone by then, and so are those of the join before.
        rows = spread_join(materialized(rows) if hot.total > WRITTEN_ROWS else rows, side, keys, "seq", hot)
    return rows.withColumns({"ustack": F.coalesce("ustack", none), "kstack": F.coalesce("kstack", none)}).drop(
        "ustack_id", "kstack_id", *version
    )
