"""Hot keys: find them, and join or order by them without one task getting a whole key.

A key is hot when it has more rows than a task should take. There are at most rows / ``GROUP_ROWS`` such keys. They stay
a table; their number is known, so that it is broadcast only below a bound.
"""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Session setting: a key with more rows than this is hot.
GROUP_ROWS = "profspark.hot.groupRows"
DEFAULT_GROUP_ROWS = 1_000_000
# A table of so many (hash, number) rows takes some 50 MB at most on each executor; larger ones are joined by shuffles.
BROADCAST_KEYS = 1_000_000
# A task of a join of rows with a dictionary sorts about so many of the rows at most.
TASK_ROWS = 1_000_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS, str(DEFAULT_GROUP_ROWS)))


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="checkpoint-")


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local master, as in tests, may go without: it gets a folder of its
    own; on a cluster executors would not see it."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


_tables_in: ContextVar[str | None] = ContextVar("tables_in", default=None)


@contextmanager
def tables_in(folder: str) -> Iterator[None]:
    """Tables ``materialized`` inside are written below ``folder``, to go with it."""
    token = _tables_in.set(folder)
    try:
        yield
    finally:
        _tables_in.reset(token)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it has run. Otherwise they stay until the driver collects its garbage,
    and the disks hold those of all tables that a query has written so far."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def saved(df: DataFrame, path: str) -> None:
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)


def materialized(df: DataFrame) -> DataFrame:
    """Cut a plan that several others start from: a parquet table in the shared folder, written once, of which each
    reader takes its columns and rows. Tables stay until the folder is cleaned, shuffles do not."""
    spark = df.sparkSession
    path = f"{_tables_in.get() or shared_dir(spark)}/table-{uuid.uuid4().hex}"
    saved(df, path)
    return spark.read.schema(df.schema).parquet(path)


def key_hash(keys: list[str]) -> Column:
    """Without keys, all rows are of one."""
    return F.xxhash64(*[F.col(k) for k in keys]) if keys else F.lit(0).cast("bigint")


@dataclass(frozen=True)
class HotKeys:
    """``frame`` (_h, _n): hash and rows of each hot key; ``count`` of them with ``rows`` in all. False without any.
    ``total``: the rows of all keys, where they were counted."""

    frame: DataFrame
    count: int
    rows: int
    total: int = 0

    def __bool__(self) -> bool:
        return self.count > 0

    def small(self) -> DataFrame:
        return F.broadcast(self.frame) if self.count <= BROADCAST_KEYS else self.frame


def hot_keys(df: DataFrame, keys: list[str]) -> HotKeys:
    """The keys of more than ``GROUP_ROWS`` rows, by one narrow counting job.

    ``df`` is run for this, so it should be an input or a materialized result, not a long plan. Two keys with one hash
    are treated as one, which only means that a cold key may be handled like a hot one. A null key is a key like others.
    """
    counted = df.select(key_hash(keys).alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    seen = Observation()
    counted = counted.observe(seen, F.sum("_n").alias("total"))
    found = materialized(counted.where(F.col("_n") > group_rows(df.sparkSession)))
    total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    return HotKeys(found, total[0], total[1], seen.get["total"] or 0)


def too_few(spark: SparkSession, tasks: int) -> bool:
    """Whether the session's shuffles have fewer partitions than the tasks that rows, by their number, ask for."""
    return tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt_by(df: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """``df`` by the hash of ``keys``, column ``_k``, in ``tasks`` partitions, which Spark does not merge."""
    return df.withColumn("_k", key_hash(keys)).repartition(tasks, "_k")


def same_keys(keys: list[str], prefix: str) -> list[Column]:
    """Conditions of a join with columns of the same names after ``prefix``, in which null equals null. Sides that are
    ``dealt_by`` equal keys, of which ``_k`` is one, are joined on the hash alone, the rest being compared: Spark would
    shuffle them once more for any other key."""
    if "_k" not in keys:
        return [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys]
    pairs = [(F.col(k), F.col(f"{prefix}{k}")) for k in keys if k != "_k"]
    # Not ==, which Spark makes a key of the join where neither side can be null.
    rest = [F.coalesce((a <= b) & (a >= b), F.lit(False)) | (a.isNull() & b.isNull()) for a, b in pairs]
    return [F.col("_k") == F.col(f"{prefix}_k"), *rest]


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], spread_by: str, hot: HotKeys, how: str = "left") -> DataFrame:
    """Equi-join whose left side holds the hot keys ``hot``; ``right`` has few rows per key.

    A hot key's rows are dealt into as many salts as a task's share goes into them, and only the matching rows of
    ``right`` are repeated. ``spread_by`` is a left column that varies within a key. With more rows than the session's
    partitions should take there are more of them.
    """
    tasks = -(-hot.total // TASK_ROWS)

    def joined(rows: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
        return (rows.repartition(tasks, *by) if too_few(left.sparkSession, tasks) else rows).join(other, by, how)

    if not hot:
        return joined(left, right, keys)
    salts = hot.small().withColumn("_salts", F.ceil(F.col("_n") / group_rows(left.sparkSession)).cast("int"))

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("_h", key_hash(keys)).join(salts, "_h", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))

    salted = marked(left).withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.col("_salts")).cast("int")).drop("_h", "_n", "_salts")
    repeated = marked(right).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_h", "_n", "_salts")
    return joined(salted, repeated, [*keys, "_salt"]).drop("_salt")


def dictionary_join(left: DataFrame, right: DataFrame, keys: list[str], spread_by: str, how: str = "left") -> DataFrame:
    """Equi-join with a dictionary much smaller than ``left``, an input or materialized, whose hot keys are spread."""
    return spread_join(left, right, keys, spread_by, hot_keys(left, keys), how)
