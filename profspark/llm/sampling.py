"""Bounded samples whose size does not depend on the number of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1 << 40


def bound(wanted: int, total: int) -> int:
    """Of `total` hashes modulo SCALE about twice `wanted` lie below it; all, where they are fewer."""
    return min(SCALE, -(-(2 * wanted + 100) * SCALE // max(1, total)))


def below(hash_: Column, wanted: int, total: int) -> Column:
    """True for about twice `wanted` of `total` rows, those with the lowest hashes; for all rows where they are fewer."""
    return F.pmod(hash_, F.lit(SCALE)) < F.lit(bound(wanted, total))


def first_rows(df: DataFrame, id_col: str, wanted: int, total: int) -> DataFrame:
    """At most `wanted` of the `total` rows, the first in the order of a hash of their ids.

    Most rows are passed over before any are moved, so that what comes together has the size of the sample.
    """
    hash_ = F.xxhash64(id_col)
    return df.where(below(hash_, wanted, total)).orderBy(F.pmod(hash_, F.lit(SCALE)), id_col).limit(wanted)
