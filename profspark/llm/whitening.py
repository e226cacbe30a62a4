"""Whitening of embeddings: exact sums on Spark, components by contour integration, projection on Spark.

Vectors come as integers, so that sums and products are exact and do not depend on how rows are dealt out. Tasks return
one partial matrix each, cut into blocks of rows, which are added block by block; the driver gets matrices of the size of
one vector's dimension squared, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profspark.llm import feast
from profspark.llm.scratch import Scratch, narrowed, packed, row_and, unpacked

#: Rows whose products are added in floating point, exactly while entries are within 2**20 of the mean.
TOGETHER = 4096
BLOCK_BYTES = 1 << 16
SHARDS = 64
#: Eigenvalues below this share of the trace are rounding.
FLOOR = 1e-12


def fixed_point(vector: Column, scale: float = 1024.0, shift: int = 100_000) -> Column:
    """floor(scale * c) + shift for each entry as a double, null where it is null or not finite; at most 2**52 in size."""
    most = float(1 << 52)

    def entry(c: Column) -> Column:
        c = c.cast("double")
        finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        return F.when(finite, F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), c * F.lit(scale)))) + F.lit(shift))

    return F.transform(vector, entry)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), d)


def _summed(rows: DataFrame, d: int, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of part(x), an int64 matrix of `width` columns, over blocks x of the rows' vectors."""
    step = max(1, BLOCK_BYTES // (8 * width))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch["x"], d)
            for at in range(0, len(x), TOGETHER):
                found = part(x[at : at + TOGETHER])
                total = found if total is None else total + found
        if total is not None:
            blocks = [total[at : at + step].tobytes() for at in range(0, len(total), step)]
            shard = int.from_bytes(blocks[0][:8], "little") % SHARDS
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([shard] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())], names=["block", "shard", "sums"])

    def add(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(v.as_buffer(), dtype=np.int64) for v in table["sums"])
        return pa.table({"block": table["block"][:1], "sums": pa.array([sums.tobytes()], pa.binary())})

    parts = rows.select("x").mapInArrow(each, "block int, shard int, sums binary")
    for keys in (["block", "shard"], ["block"]):
        parts = parts.groupBy(*keys).applyInArrow(add, "block int, sums binary")
    return np.concatenate([np.frombuffer(r.sums, dtype=np.int64) for r in parts.orderBy("block").toLocalIterator()]).reshape(-1, width)


def _covariance(rows: DataFrame, n: int, sums: list[int], spread: int) -> np.ndarray:
    """Of all vectors, divisor n. Entries are centred at the integer next to the mean; the rest is taken out exactly.

    Where sums of products could pass 64 bits, each dimension is counted in a power of two that keeps them below.
    """
    d, centre = len(sums), [(2 * s + n) // (2 * n) for s in sums]
    around, unit = np.array(centre, dtype=np.int64), np.ones(len(sums))
    if 2 * spread.bit_length() + n.bit_length() > 62:
        # No sum of squares is larger than the square of the sum.
        far = _summed(rows, d, d, lambda x: np.abs(x - around).sum(axis=0, dtype=np.int64)[None])[0]
        unit = np.array([2.0 ** max(0, int(v).bit_length() - 31) for v in far])

    def products(x: np.ndarray) -> np.ndarray:
        c = (x - around).astype(np.float64) / unit
        return np.rint(c.T @ c).astype(np.int64)

    whole = np.array([int(u) for u in unit], dtype=object)
    total = _summed(rows, d, d, products).astype(object) * np.outer(whole, whole)
    off = np.array([s - n * c for s, c in zip(sums, centre, strict=True)], dtype=object)
    return ((n * total - np.outer(off, off)) / (n * n)).astype(np.float64)


def whitened(df: DataFrame, vector: Column, components: int = 8, keep: list[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) with a row for each component, and whitening columns in place of those of that name.

    `vector` gives arrays of longs. Rows whose vector is null, empty or holds a null go, and so do rows of another length
    than the most frequent one (of two, the longer one). n: remaining rows. deviation: decimal(38,0), the sum over
    dimensions of (n * x - S)^2, S being the dimension's sum; null beyond 38 digits. component: from 1, by falling
    eigenvalue, at most `components`, and only those whose eigenvalue is more than 1e-12 of the covariance's trace, so
    that a table of equal vectors, of a single row or of none gives no rows. whitened: x - S / n, projected on the unit
    eigenvector, over the eigenvalue's root. explained: the eigenvalue's share of the trace. identity_error: the largest
    absolute entry of the whitened rows' covariance less the identity. Repeated rows count each.
    """
    scratch = Scratch(df.sparkSession)
    schema = "deviation decimal(38,0), whitened array<double>"
    rows = narrowed(packed(df, x=vector.cast("array<long>")), keep).where("x is not null and not exists(x, e -> e is null) and size(x) > 0")
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min(F.array_min("x")).alias("least"), F.max(F.array_max("x")).alias("most")).orderBy(F.desc("n"), F.desc("d")).first()
    d, n = (common["d"], common["n"]) if common else (0, 0)
    rows = rows.where(F.size("x") == d)
    values, sums = np.empty(0), []
    if n:
        sums = [int(s) for s in _summed(rows, d, d, lambda x: x.sum(axis=0, dtype=np.int64)[None])[0]]
        covariance = _covariance(rows, n, sums, common["most"] - common["least"])
        values, vectors = feast.largest(covariance, components, FLOOR)
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    if not len(values):
        empty = rows.where("false").select("row", *[F.lit(None).cast(k).alias(c) for c, k in zip(names, ["int", "long", "decimal(38,0)", "double", "double", "double"], strict=True)])
        return unpacked(empty, *names)
    mean_floor = np.array([s // n for s in sums], dtype=np.int64)
    mean_rest = np.array([s % n / n for s in sums])
    basis = vectors / np.sqrt(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["x"], d)
            apart = x - mean_floor
            found = (apart - mean_rest) @ basis
            flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * basis.shape[1], pa.array(found.ravel()))
            if np.abs(apart).max(initial=0) + 1 < (1 << 31) / n / np.sqrt(d):
                off = n * x - np.array(sums, dtype=np.int64) if n * int(np.abs(x).max(initial=0)) < 1 << 62 else None
            else:
                off = None
            if off is not None:
                deviation = pa.array((off * off).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                exact = (n * x.astype(object) - np.array(sums, dtype=object)) ** 2
                deviation = pa.array([int(v) if v < 10**38 else None for v in exact.sum(axis=1)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch["row"], deviation, flat], names=["row", "deviation", "whitened"])

    found = scratch.keep(rows.mapInArrow(project, row_and(rows, schema)))
    k = len(values)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    covariances = found.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(covariances, pairs, strict=True))
    shares = F.array(*[F.lit(float(v / np.trace(covariance))) for v in values])
    out = found.select("row", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    out = out.select("row", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"))
    return unpacked(out, *names)
