"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTING = "spark.checkpoint.dir"
#: Rows that Python gets at a time while a table is written; Spark's own 10,000 whole texts, or sets, take much memory.
ARROW, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="corpus-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; where none is named and the master is local, one of our own."""
    folder = spark.conf.get(SETTING, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        folder = _own_folder()
    return folder.rstrip("/")


def few_rows(spark: SparkSession) -> None:
    """From now on Python gets few rows at a time in this session, also in tables that others write; never raised."""
    before = int(spark.conf.get(ARROW))
    spark.conf.set(ARROW, str(ARROW_ROWS if before <= 0 else min(before, ARROW_ROWS)))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """The session's setting is as before afterwards, and never raised."""
    before = spark.conf.get(ARROW)
    few_rows(spark)
    try:
        yield
    finally:
        spark.conf.set(ARROW, before)


class Scratch:
    """Parquet tables of one operator call. Writing one cuts the lineage; an executor's loss costs no written table."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count}"
        with small_batches(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame, **columns) -> DataFrame:
    """The rows as one struct `row` beside our own columns, so that no name of the input clashes with ours."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, *columns) -> DataFrame:
    """The input's columns again, and then the given ones, which take the place of columns of the same name."""
    own = {c.lower() for c in columns}
    names = [f.name for f in df.schema["row"].dataType.fields if f.name.lower() not in own]
    return df.select(*[F.col("row").getField(n).alias(n) for n in names], *columns)


def row_and(df: DataFrame, ddl: str) -> T.StructType:
    """A schema of the struct `row` and the given columns."""
    return T.StructType([df.schema["row"], *T.StructType.fromDDL(ddl).fields])


def narrowed(df: DataFrame, names: list[str] | None) -> DataFrame:
    """`row` with the named columns only; None: with all."""
    return df.withColumn("row", F.struct(*[F.col("row").getField(c).alias(c) for c in names])) if names else df
