"""Ordered computations per key (lag, lead, running sums, as-of values) that survive hot keys.

A plain window sorts all rows of a key in one task. Here the rows of hot keys are first cut into slices of the order
column, at quantiles of the hot rows, so that no (key, slice) group is large. Windows run inside the slices, a summary
of one row per (key, slice) carries the values over from slice to slice, and a join on (key, slice) adds them. Null keys
are keys like others, and null order values come first, as in the plain window. Rows of other keys take the plain window;
without any hot key it is the whole plan.
"""

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profspark.operators.hot import HotKeys, group_rows, hot_keys, key_hash, materialized, same_keys

FIRST = Window.unboundedPreceding


@dataclass(frozen=True)
class Slicing:
    """How the rows of hot keys are cut: the hot keys, and the cut points on the order column."""

    keys: list[str]
    order: str
    hot: HotKeys | None = None
    cuts: list[float] = field(default_factory=list)

    def attach(self, df: DataFrame, name: str) -> DataFrame:
        """Add the slice number: 0 for keys that are not hot, from 1 on along the order for hot ones, nulls first."""
        if not self.hot:
            return df
        from pyspark.ml.feature import Bucketizer

        cutter = Bucketizer(
            splits=[float("-inf"), *self.cuts, float("inf")], inputCol="_order", outputCol="_cut", handleInvalid="keep"
        )
        flags = self.hot.small().select("_h", F.lit(True).alias("_hot"))
        marked = df.withColumn("_h", key_hash(self.keys)).join(flags, "_h", "left")
        # The cutter leaves nulls out; their place is the first slice.
        order = F.col(self.order).cast("double")
        marked = marked.withColumns({"_order": F.coalesce(order, F.lit(0.0)), "_null": order.isNull()})
        number = F.when(F.col("_hot") & F.col("_null"), 1).when(F.col("_hot"), F.col("_cut").cast("int") + 1).otherwise(0)
        return cutter.transform(marked).withColumn(name, number).drop("_h", "_hot", "_order", "_null", "_cut")


def slicing(df: DataFrame, keys: list[str], order: str) -> Slicing:
    """Decide the slices from the data: one narrow count, and quantiles only when there are hot keys.

    The number of slices follows the rows of hot keys. Rows with one key and one order value stay together.
    """
    found = hot_keys(df, keys)
    return sliced(df, order, keys, found) if found else Slicing(keys, order)


def sliced(df: DataFrame, order: str, keys: list[str], found: HotKeys) -> Slicing:
    """The slices of known hot keys."""
    slices = max(2, -(-found.rows // group_rows(df.sparkSession)))
    hot_rows = df.withColumn("_h", key_hash(keys)).join(found.small(), "_h", "left_semi")
    values = hot_rows.select(F.col(order).cast("double").alias("v"))
    cuts = values.approxQuantile("v", [i / slices for i in range(1, slices)], 1 / (2 * slices))
    return Slicing(keys, order, found, sorted({c for c in cuts if c == c}))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys``, in which null equals null."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, same_keys(keys, "_r_"))
    return left.join(other, same, "left").drop(*[f"_r_{k}" for k in keys])


@dataclass(frozen=True)
class Step:
    kind: str
    value: Column
    before: bool = False


def lag(value: Column) -> Step:
    return Step("lag", value)


def lead(value: Column) -> Step:
    return Step("lead", value)


def last(value: Column, before: bool = False) -> Step:
    """Latest non-null value up to this row (``before``: excluding it)."""
    return Step("last", value, before)


def first(value: Column) -> Step:
    """Earliest non-null value up to this row."""
    return Step("first", value)


def running_sum(value: Column, before: bool = False) -> Step:
    return Step("sum", value, before)


def running_min(value: Column, before: bool = False) -> Step:
    return Step("min", value, before)


class Ordered:
    """Ordered steps over the rows of ``keys`` in the order of the columns ``order``.

    ``slice_col`` names the column of ``Slicing.attach``; the slicing must be on the first order column and on a subset
    of ``keys``.
    """

    def __init__(self, keys: list[str], order: list[str], slice_col: str | None = None):
        self.keys = keys
        self.order = order
        self.slice_col = slice_col

    def apply(self, df: DataFrame, **steps: Step) -> DataFrame:
        sliced = self.slice_col is not None and self.slice_col in df.columns
        groups = [*self.keys, self.slice_col] if sliced else self.keys
        window = Window.partitionBy(*groups).orderBy(*self.order)
        if not sliced:
            return df.withColumns({name: _local(step, window) for name, step in steps.items()})

        order = F.struct(*[F.col(c) for c in self.order])
        along = Window.partitionBy(*self.keys).orderBy(self.slice_col)
        sums = {f"_s_{name}": _summary(step, order) for name, step in steps.items()}
        carry = df.where(F.col(self.slice_col) > 0).groupBy(*groups).agg(*[c.alias(n) for n, c in sums.items()])
        carry = carry.withColumns({f"_c_{name}": _carried(step, f"_s_{name}", along) for name, step in steps.items()})
        carry = carry.drop(*sums)

        wrapped = {
            f"_l_{name}": _local(
                Step(step.kind, F.struct(step.value.alias("v")), step.before) if step.kind in ("lag", "lead") else step,
                window,
            )
            for name, step in steps.items()
        }
        joined = null_safe_join(df.withColumns(wrapped), carry, groups)
        done = {name: _combine(step, F.col(f"_l_{name}"), F.col(f"_c_{name}")) for name, step in steps.items()}
        helpers = [f"_{part}_{name}" for part in "lc" for name in steps]
        return joined.withColumns(done).drop(*helpers)


    def depth(self, df: DataFrame, change: Column, name: str) -> DataFrame:
        """Running sum of ``change`` floored at 0, before each row: the depth a row finds, pops at 0 being ignored.

        The floor needs the lowest prefix sum so far, so a slice is summed up by its sum and its lowest prefix.
        """
        sliced = self.slice_col is not None and self.slice_col in df.columns
        groups = [*self.keys, self.slice_col] if sliced else self.keys
        window = Window.partitionBy(*groups).orderBy(*self.order)
        zero = F.lit(0).cast("bigint")
        rows = df.withColumn("_change", change).withColumn("_sum", F.sum("_change").over(window.rowsBetween(FIRST, 0)))
        low = F.min("_sum").over(window.rowsBetween(FIRST, -1))
        if not sliced:
            floor = F.least(F.coalesce(low, zero), zero)
            return rows.withColumn(name, F.col("_sum") - F.col("_change") - floor).drop("_change", "_sum")

        along = Window.partitionBy(*self.keys).orderBy(self.slice_col)
        earlier = along.rowsBetween(FIRST, -1)
        carry = (
            rows.groupBy(*groups)
            .agg(F.sum("_change").alias("_total"), F.min("_sum").alias("_lowest"))
            .withColumn("_base", F.coalesce(F.sum("_total").over(earlier), zero))
            .withColumn("_before", F.min(F.col("_base") + F.col("_lowest")).over(earlier))
            .select(*groups, "_base", "_before")
        )
        joined = null_safe_join(rows.withColumn("_low", low), carry, groups)
        floor = F.least(F.coalesce("_before", zero), F.coalesce(F.col("_base") + F.col("_low"), zero), zero)
        found = F.col("_base") + F.col("_sum") - F.col("_change") - floor
        return joined.withColumn(name, found).drop("_change", "_sum", "_low", "_base", "_before")


def _local(step: Step, window) -> Column:
    frame = window.rowsBetween(FIRST, -1 if step.before else 0)
    if step.kind == "lag":
        return F.lag(step.value).over(window)
    if step.kind == "lead":
        return F.lead(step.value).over(window)
    if step.kind == "last":
        return F.last(step.value, ignorenulls=True).over(frame)
    if step.kind == "first":
        return F.first(step.value, ignorenulls=True).over(frame)
    if step.kind == "sum":
        return F.coalesce(F.sum(step.value).over(frame), F.lit(0).cast("bigint"))
    return F.min(step.value).over(frame)


def _summary(step: Step, order: Column) -> Column:
    if step.kind == "lag":
        return F.max_by(F.struct(step.value.alias("v")), order)
    if step.kind == "lead":
        return F.min_by(F.struct(step.value.alias("v")), order)
    if step.kind == "last":
        return F.max_by(step.value, F.when(step.value.isNotNull(), order))
    if step.kind == "first":
        return F.min_by(step.value, F.when(step.value.isNotNull(), order))
    return F.sum(step.value) if step.kind == "sum" else F.min(step.value)


def _carried(step: Step, summary: str, along) -> Column:
    earlier = along.rowsBetween(FIRST, -1)
    if step.kind == "lag":
        return F.lag(summary).over(along)
    if step.kind == "lead":
        return F.lead(summary).over(along)
    if step.kind == "last":
        return F.last(summary, ignorenulls=True).over(earlier)
    if step.kind == "first":
        return F.first(summary, ignorenulls=True).over(earlier)
    return F.sum(summary).over(earlier) if step.kind == "sum" else F.min(summary).over(earlier)


def _combine(step: Step, local: Column, carried: Column) -> Column:
    if step.kind in ("lag", "lead"):
        return F.coalesce(local, carried)["v"]
    if step.kind == "last":
        return F.coalesce(local, carried)
    if step.kind == "first":
        return F.coalesce(carried, local)
    if step.kind == "sum":
        return local + F.coalesce(carried, F.lit(0))
    return F.least(local, carried)


def ordered(df: DataFrame, keys: list[str], order: list[str], **steps: Step) -> DataFrame:
    """One-off form: decide the slices on ``keys`` and the first order column, run the steps, drop the slice."""
    cut = slicing(df, keys, order[0])
    return chained(df, cut, lambda rows, slice_col: Ordered(keys, order, slice_col).apply(rows, **steps), derived=False)


def chained(
    df: DataFrame, cut: Slicing, chain: Callable[[DataFrame, str | None], DataFrame], derived: bool = True
) -> DataFrame:
    """Run a chain of ordered steps, rows of hot keys apart from the others.

    ``chain`` gets rows and the name of their slice column, None for the rows without hot keys, which take plain
    windows on one partitioning. A sliced step uses its input twice, so the chain cuts its plan with ``between``.
    Rows that are ``derived``, not an input, are materialized before they are split.
    """
    if not cut.hot:
        return chain(df, None)
    marked = cut.attach(materialized(df) if derived else df, "_slice")
    cold = chain(marked.where(F.col("_slice") == 0).drop("_slice"), None)
    hot = chain(between(marked.where(F.col("_slice") > 0), "_slice"), "_slice").drop("_slice")
    return cold.unionByName(hot)


def between(df: DataFrame, slice_col: str | None) -> DataFrame:
    """A point of a chain where the plan of sliced rows is cut."""
    return df if slice_col is None else materialized(df)
