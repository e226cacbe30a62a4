"""Dense ids for distinct keys without a single-task sort."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Buckets for each shuffle partition.
BUCKETS = 4


def dense_ids(keys: DataFrame, id_col: str, start: int) -> DataFrame:
    """Number the distinct rows of ``keys`` from ``start`` on, without gaps.

    Rows are hashed to buckets (distinct keys, so the buckets are even), numbered inside their bucket in key order, and
    shifted by the sizes of the earlier buckets. Their number follows the session's shuffle partitions, and so do the
    rows that are broadcast.
    """
    columns = keys.columns
    buckets = BUCKETS * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = keys.distinct().withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int"))
    sizes = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_bucket").orderBy(*columns)
    return (
        hashed.withColumn("_rank", F.row_number().over(within))
        .join(F.broadcast(offsets), "_bucket")
        .select(*columns, (F.col("_offset") + F.col("_rank") + (start - 1)).cast("bigint").alias(id_col))
    )
