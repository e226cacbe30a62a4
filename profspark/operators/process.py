"""Process attribution: the command and executable of each event's process, as of the event."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profspark.functions.frames import c_string
from profspark.operators.hot import BROADCAST_KEYS, key_hash, materialized
from profspark.operators.intervals import Crowds, Need, crowds, lookup, moment
from profspark.operators.ordered import Ordered, chained, last, lead, running_sum

PROCESS = ["epoch", "tgid"]


def is_type(*types: str) -> Column:
    return F.coalesce(F.col("type").isin(*types), F.lit(False))


def with_epoch(raw: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Number the stretches between losses of events: state is never carried over a reset marker.

    The few reset rows are numbered on their own, and all others look up the interval between two of them; without any
    reset, which the count of the lookup tells, the number is a constant. ``scope`` names the columns of a host and run:
    they become part of the epoch, so that neither a reset nor any state of one run touches another one, whose process
    and thread ids may be the same.
    """
    if "epoch" in raw.columns:
        return raw
    resets = materialized(raw.where(is_type("reset")).select(*scope, "seq", "type"))
    crowd = crowds(resets, resets=Need(list(scope), is_type("reset")))["resets"]
    if not crowd.changes:
        return _scoped(raw.withColumn("epoch", F.lit(0).cast("bigint")), scope)
    numbered = chained(resets, crowd.slicing(resets), lambda rows, s: _numbered(rows, list(scope), s), derived=False)
    found = lookup(raw, numbered, ["epoch"], crowd)
    return _scoped(found.withColumn("epoch", F.coalesce("epoch", F.lit(0).cast("bigint"))), scope)


def _numbered(resets: DataFrame, keys: list[str], slice_col: str | None) -> DataFrame:
    rows = resets.withColumn("begin", moment())
    return Ordered(keys, ["seq"], slice_col).apply(rows, epoch=running_sum(F.lit(1).cast("bigint")), end=lead(F.col("begin")))


def _scoped(rows: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    return rows.withColumn("epoch", F.struct(*scope, F.col("epoch").alias("number"))) if scope else rows


def with_running(raw: DataFrame, running: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Raw events with the processes that still ran after a loss of events, as execs at the moment of the loss.

    ``running`` (``scope``, seq, tgid, comm, buildid) is what was found running when the reset marker ``seq`` was set. It
    is the state that the marker's epoch starts with; without it, events stay unattributed until the next exec. In a
    stream the same rows may simply follow the marker.
    """
    seeds = running.select(*scope, "seq", F.lit("process_exec").alias("type"), "tgid", F.col("tgid").alias("pid"), "comm", "buildid")
    return raw.unionByName(seeds, allowMissingColumns=True)


def exec_need() -> Need:
    return Need(PROCESS, is_type("process_exec"))


def first_execs(changes: DataFrame) -> DataFrame | None:
    """(_h, _from): the hash of each process with an exec, and the moment of its first one; None where they are too many to
    be broadcast. Before it, and in other processes, no command is known."""
    execs = changes.where(is_type("process_exec")).groupBy(key_hash(PROCESS).alias("_h")).agg(F.min(moment()).alias("_from"))
    execs = materialized(execs)
    return execs if execs.count() <= BROADCAST_KEYS else None


def started(rows: DataFrame, execs: DataFrame | None, until: Column) -> DataFrame:
    """Rows whose process has one of the ``first_execs`` before the moment ``until``, or at any time where that is null."""
    if execs is None:
        return rows
    found = rows.withColumn("_h", key_hash(PROCESS)).join(F.broadcast(execs), "_h")
    return found.where(until.isNull() | (F.col("_from") < until)).drop("_h", "_from")


def started_or_state(rows: DataFrame, execs: DataFrame | None) -> DataFrame:
    """Rows at or behind their process's first exec, and those that end state, whatever their process."""
    if execs is None:
        return rows
    found = rows.withColumn("_h", key_hash(PROCESS)).join(F.broadcast(execs), "_h", "left")
    return found.where(is_type("process_exit", "reset") | (F.col("_from") <= moment())).drop("_h", "_from")


def attribute(raw: DataFrame, changes: DataFrame | None = None, crowd: Crowds | None = None) -> DataFrame:
    """Add ``command`` and ``exe_buildid``; both null when no exec of the process was seen.

    The latest exec counts; one that keeps the command keeps the earlier build id, too. An exit forgets nothing. Rows
    look up the interval between two execs of their process. ``changes`` is a written table that holds the execs, and
    ``crowd`` what ``crowds`` found in it for ``exec_need``.
    """
    if changes is None:
        changes = materialized(raw.where(is_type("process_exec")).select(*PROCESS, "seq", "type", "comm", "buildid"))
    crowd = crowd or crowds(changes, execs=exec_need())["execs"]
    execs = changes.where(is_type("process_exec")).select(*PROCESS, "seq", "comm", "buildid")
    known = chained(execs, crowd.slicing(execs), _commands, derived=False).where("_info is not null")
    known = known.select(*PROCESS, "begin", "end", F.col("_info.comm").alias("command"), F.col("_info.buildid").alias("exe_buildid"))
    return lookup(raw, known, ["command", "exe_buildid"], crowd)


def _commands(execs: DataFrame, slice_col: str | None) -> DataFrame:
    scan = Ordered(PROCESS, ["seq"], slice_col)
    rows = execs.withColumns({"_comm": c_string("comm"), "begin": moment()})
    rows = scan.apply(rows, _current=last(F.col("_comm"), before=True), end=lead(F.col("begin")))
    replaces = F.col("_comm").isNotNull() & ~F.coalesce(F.col("_comm") == F.col("_current"), F.lit(False))
    rows = rows.withColumn("_new", F.when(replaces, F.struct(F.col("_comm").alias("comm"), F.col("buildid"))))
    return scan.apply(rows, _info=last(F.col("_new")))
