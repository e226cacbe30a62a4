"""Looking up state that few rows change: intervals between changes, and hash joins that find the one around a row.

The rows that change a state become a table of (key, [begin, end), what holds there). Every other row meets that table
in an equi-join on the key, whose condition picks the interval; the interval side is hashed, so the rows themselves are
neither sorted nor windowed.

A key is crowded when it has many intervals. Its rows and intervals meet in buckets of the order column, a power of two
wide, as many as its changes ask for; an interval is listed once in each bucket it touches. A crowded key has at most
changes / PER_BUCKET buckets, so that the listed intervals stay in proportion to the changes. Buckets are as even as the
changes are over the time from a key's first to its last one. A key with many rows but few intervals is left to Spark,
which splits the rows' side of a hashed join, unless there are more intervals than the session's shuffle partitions should
hold: both sides are dealt by hand then, and the rows of such a key pass through one task, which holds none of them. Null
keys are keys like others, null order values come first.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profspark.operators.hot import BROADCAST_KEYS, HotKeys, dealt_by, group_rows, key_hash, materialized, same_keys, too_few
from profspark.operators.ordered import Slicing, sliced

# A key with more intervals than this gets buckets of about PER_BUCKET intervals.
CROWD = 256
PER_BUCKET = 64
# Tables of at most so many intervals are broadcast, others are dealt out by key and hashed there.
BROADCAST_INTERVALS = 100_000
# A task of windows over changes, or of a lookup in them, gets about so many of them, some hundred MB, at most.
TASK_CHANGES = 400_000
EARLIEST = -(1 << 63)


def moment(order: str = "seq") -> Column:
    """The order value as a point in time, null before all others."""
    return F.coalesce(F.col(order), F.lit(EARLIEST).cast("bigint"))


@dataclass(frozen=True)
class Crowds:
    """What is known of the keys of a lookup: the crowded ones (_h, _low, _high, _bits, _changes), how many, the changes
    of all keys, and how many keys have more changes than a task should take, with how many changes."""

    keys: list[str]
    frame: DataFrame | None
    count: int
    changes: int
    hot: int
    hot_changes: int

    def bucketed(self, df: DataFrame) -> DataFrame:
        """Add ``_low``, ``_high`` and ``_bits``, null for keys that are not crowded."""
        crowded = self.frame.drop("_changes")
        crowded = F.broadcast(crowded) if self.count <= BROADCAST_KEYS else crowded.hint("shuffle_hash")
        return df.withColumn("_h", key_hash(self.keys)).join(crowded, "_h", "left").drop("_h")

    @property
    def tasks(self) -> int:
        """As many as the changes ask for."""
        return -(-self.changes // TASK_CHANGES)

    def dealt(self, changes: DataFrame) -> DataFrame:
        """The changes by key, in as many partitions as their number asks for. Spark merges those of its own shuffles
        until there is about one per core, whatever the rows; so few are left to it only where they are enough."""
        few = not self.keys or self.tasks <= changes.sparkSession.sparkContext.defaultParallelism
        return changes if few else changes.repartition(self.tasks, *self.keys)

    @property
    def broadcast(self) -> bool:
        return self.changes <= BROADCAST_INTERVALS

    def placed(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """``df`` by the hash of ``keys``, column ``_k``, in as many partitions as the changes ask for: joins, windows and
        aggregates of such tables by ``_k`` and more move no row again."""
        by = df.withColumn("_k", key_hash(keys))
        few = self.tasks <= df.sparkSession.sparkContext.defaultParallelism
        return by.repartition("_k") if few else by.repartition(self.tasks, "_k")

    def slicing(self, changes: DataFrame, order: str = "seq") -> Slicing:
        """How windows over the changes cut the keys that have very many."""
        if not self.hot:
            return Slicing(self.keys, order)
        many = self.frame.where(F.col("_changes") > group_rows(changes.sparkSession)).select("_h", F.col("_changes").alias("_n"))
        return sliced(changes, order, self.keys, HotKeys(many, self.hot, self.hot_changes))


@dataclass(frozen=True)
class Need:
    """A lookup to come: its keys, and the rows that change the state."""

    keys: list[str]
    change: Column


def crowds(changes: DataFrame, /, order: str = "seq", **needs: Need) -> dict[str, Crowds]:
    """Count the changes of each key of all the lookups, by one narrow job over ``changes``, an input or written table."""
    most = group_rows(changes.sparkSession)
    marks = [F.when(n.change, F.struct(F.lit(name).alias("_for"), key_hash(n.keys).alias("_h"))) for name, n in needs.items()]
    each = changes.select(F.col(order).alias("_at"), F.explode(F.array_compact(F.array(*marks))).alias("m")).select("_at", "m.*")
    one = each.groupBy("_for", "_h").agg(F.count(F.lit(1)).alias("_changes"), F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    crowded, hot = F.col("_changes") > min(CROWD, most), F.when(F.col("_changes") > most, F.col("_changes"))
    totals = one.groupBy("_for").agg(F.sum("_changes").alias("changes"), F.count_if(crowded).alias("count"), F.count(hot).alias("hot"), F.coalesce(F.sum(hot), F.lit(0)).alias("hot_changes"))
    found = {r["_for"]: r for r in totals.collect()}
    frame = None
    if any(r["count"] for r in found.values()):
        low = F.coalesce("_low", F.lit(0).cast("bigint"))
        width = (F.coalesce("_high", low) - low + 1).cast("double") / F.ceil(F.col("_changes") / PER_BUCKET)
        bits = F.greatest(F.lit(0), F.floor(F.log2(width))).cast("int")
        frame = materialized(one.where(crowded).select("_for", "_h", low.alias("_low"), F.coalesce("_high", low).alias("_high"), bits.alias("_bits"), "_changes"))
    out = {}
    for name, n in needs.items():
        r = found.get(name)
        own = frame.where(F.col("_for") == name).drop("_for") if r and r["count"] else None
        out[name] = Crowds(n.keys, own, *((r["count"], r["changes"], r["hot"], r["hot_changes"]) if r else (0, 0, 0, 0)))
    return out


def _bucket(at: Column) -> Column:
    """Number of the point's bucket, 0 for keys that are not crowded."""
    within = F.when(F.col("_bits").isNotNull(), F.least(F.greatest(at, F.col("_low")), F.col("_high")))
    return F.coalesce(F.call_function("shiftright", within, F.col("_bits")), F.lit(0).cast("bigint"))


def lookup(rows: DataFrame, intervals: DataFrame, payload: list[str], crowd: Crowds, order: str = "seq", how: str = "left", placed: bool = False) -> DataFrame:
    """``rows`` with the ``payload`` of the interval [begin, end) of their key that holds their order value, else nulls.

    ``intervals`` (keys, begin, end, ``payload``), of which no two of a key overlap; a null end is open. ``how`` may be
    ``left_semi``: only rows in an interval, without its payload. With ``placed`` both sides are so by the keys, of which
    none is crowded, and the rows stay so; they do, too, by whatever keys, where the intervals are broadcast.
    """
    keys = crowd.keys
    listed = intervals.where("end is null or end > begin").select(*keys, *(["_k"] if placed else []), "begin", "end", *payload)
    if placed:
        by = [*keys, "_k"]
    elif crowd.frame is not None:
        listed = crowd.bucketed(listed)
        touched = F.sequence(_bucket(F.col("begin")), _bucket(F.coalesce(F.col("end") - 1, F.col("_high"))))
        listed = listed.withColumn("_bucket", F.explode(touched)).drop("_low", "_high", "_bits")
        rows = crowd.bucketed(rows).withColumn("_bucket", _bucket(moment(order))).drop("_low", "_high", "_bits")
        by = [*keys, "_bucket"]
    else:
        # One bucket for all, so that lookups without keys are hashed, too.
        listed, rows, by = (*(df.withColumn("_bucket", F.lit(0)) for df in (listed, rows)), ["_bucket"]) if not keys else (listed, rows, keys)
    by_hash = not placed and not crowd.broadcast and too_few(rows.sparkSession, crowd.tasks)
    if by_hash:
        listed, rows, by = dealt_by(listed, by, crowd.tasks), dealt_by(rows, by, crowd.tasks), [*by, "_k"]
    listed = listed.withColumnsRenamed({c: f"_i_{c}" for c in [*by, "begin", "end", *payload]})
    at = moment(order)
    inside = reduce(lambda a, b: a & b, [*same_keys(by, "_i_"), F.col("_i_begin") <= at, F.col("_i_end").isNull() | (at < F.col("_i_end"))])
    side = F.broadcast(listed) if crowd.broadcast else listed.hint("shuffle_hash")
    found = rows.join(side, inside, how)
    ours = ["_bucket", "_k"] if by_hash else ["_bucket"]
    if how == "left_semi":
        return found.drop(*ours)
    return found.drop(*ours, "_i_begin", "_i_end", *[f"_i_{k}" for k in by]).withColumnsRenamed({f"_i_{c}": c for c in payload})
