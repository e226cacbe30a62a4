"""Reading captures, choosing a run, and running user SQL over the event table."""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profspark.functions.frames import unsigned_to_long
from profspark.operators.hot import saved
from profspark.schema import EVENT_SCHEMA, FRAME, RAW_SCHEMA, RAW_TYPES

# A writer's unfinished file, never part of a capture.
PENDING = "PENDING"


def finished_files() -> str:
    """A glob for all parquet files but the unfinished one, which must not even be opened: names that leave its name at
    some letter, or go on after it."""
    leave = [f"{PENDING[:i]}[!{c}]*" for i, c in enumerate(PENDING)]
    short = [PENDING[:i] for i in range(1, len(PENDING))]
    return "{" + ",".join([*leave, *short, f"{PENDING}?*"]) + "}.parquet"


def load_events(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """All files of a capture that match ``glob``, as the canonical event table."""
    return normalise(spark.read.option("pathGlobFilter", finished_files() if glob == "*.parquet" else glob).parquet(path))


def normalise(df: DataFrame) -> DataFrame:
    """Cast unsigned and narrow columns to the canonical types; other columns (partitions) are kept as they are.

    Columns that already have their type are passed through untouched, so that filters still reach the scan.
    """
    known = {f.name: f.dataType for f in EVENT_SCHEMA}
    types = {f.name: f.dataType for f in df.schema}
    columns = [
        _to(F.col(name), types[name], known[name]).alias(name) if name in known else F.col(name) for name in df.columns
    ]
    return df.select(*columns)


def _to(column: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return column
    if isinstance(want, T.ArrayType):
        have_fields = {f.name: f.dataType for f in have.elementType}
        want_fields = want.elementType.fields
        if [(f.name, f.dataType) for f in want_fields] == list(have_fields.items()):
            return column
        return F.transform(
            column,
            lambda e: F.struct(*[_to(e[f.name], have_fields[f.name], f.dataType).alias(f.name) for f in want_fields]),
        )
    if isinstance(have, T.DecimalType) and isinstance(want, T.LongType):
        return unsigned_to_long(column)
    return column.cast(want)


def run_directories(spark: SparkSession, base: str) -> list[int]:
    """The numeric sub-directory names of ``base``; a listing of one level, not of files."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
    return sorted(int(n) for n in names if n.isdecimal())


def latest_run_path(spark: SparkSession, base: str) -> str:
    """The sub-directory of ``base`` with the highest number."""
    runs = run_directories(spark, base)
    if not runs:
        raise FileNotFoundError(f"no numbered run below {base}")
    return f"{base.rstrip('/')}/{runs[-1]}"


def latest_run(df: DataFrame, run: str = "run") -> DataFrame:
    """Rows of the highest run of a data set partitioned by run."""
    return df.where(F.col(run) == df.agg(F.max(run)).scalar())


def time_slice(events: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Events with start <= timestamp < end, either end open."""
    if start is not None:
        events = events.where(F.col("timestamp") >= start)
    if end is not None:
        events = events.where(F.col("timestamp") < end)
    return events


def read_raw_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Raw events as a stream over a growing directory of parquet files."""
    return spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def replay_stream(df: DataFrame, order: str, path: str, files: int) -> DataFrame:
    """A table as a stream of ``files`` micro-batches in the order of a column.

    ``path`` gets files of a range of the order each, a batch as many as the session's shuffles have partitions for it; the
    file source takes files by age, so that each is made older than the next. Rows of a file are in no order, so that no
    task sorts a batch.
    """
    spark = df.sparkSession
    each = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // files)
    saved(df.repartitionByRange(files * each, order), path)
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    for i, part in enumerate(parts):
        fs.setTimes(part, fs.getFileStatus(part).getModificationTime() - 1000 * (len(parts) - i), -1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


def split_unknown(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw events of a known type, rejects with a reason)."""
    known = F.coalesce(F.col("type").isin(RAW_TYPES), F.lit(False))
    rejects = raw.where(~known).withColumn("reason", F.lit("unknown type"))
    return raw.where(known), rejects


# Quoted text, comments, or a division.
DIVISION = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|/", re.DOTALL)


def run_sql(
    events: DataFrame,
    query: str,
    view: str = "events",
    command: str | None = None,
    buildid: str | None = None,
    integer_division: bool = False,
) -> DataFrame:
    """Run query text over ``events`` registered as ``view``.

    Values are bound as the named parameters ``:command`` and ``:buildid`` (hex text). The placeholders ``'?command'``
    and ``decode('?buildid', 'hex')`` of older query files are turned into those parameters; values never become text
    of the query. ``empty(stack)`` is available. ``/`` is fractional here and ``div`` is not; ``integer_division`` reads
    every ``/`` outside of quotes and comments as ``div``, as query files written for whole numbers mean it.
    """
    spark = events.sparkSession
    events.createOrReplaceTempView(view)
    spark.sql(
        f"create or replace temporary function empty(stack array<{FRAME.simpleString()}>) returns boolean"
        " return cardinality(stack) = 0"
    )
    if integer_division:
        query = DIVISION.sub(lambda m: " div " if m[0] == "/" else m[0], query)
    query = query.replace("'?command'", ":command").replace("decode('?buildid', 'hex')", "unhex(:buildid)")
    given = {"command": command, "buildid": buildid}
    args = {k: v for k, v in given.items() if v is not None and f":{k}" in query}
    return spark.sql(query, args=args) if args else spark.sql(query)


def concat_results(results: list[DataFrame]) -> DataFrame:
    """Results of several queries as one input; columns missing in one are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)
