"""Looking up values in tables of ranges."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profspark.operators.hot import materialized
from profspark.operators.ordered import last, lead, ordered

# Ranges of up to 2 ** LOWEST values share one size of page; no page is larger than 2 ** HIGHEST values.
LOWEST = 6
HIGHEST = 63
# Where a page has more ranges than this, as of ranges one in another, ranges are cut into disjoint ones first.
CROWDED = 64
# Spark takes a written table for as small as its compressed file, and these files are a hundredth of their rows. Tables of
# more rows than this are never broadcast, which the driver would have to hold.
BROADCAST_RANGES = 100_000


def _level(start: Column, end: Column) -> Column:
    """Exponent of the smallest page, a power of two, that is not smaller than the range."""
    length = end.cast("double") - start.cast("double")
    return F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.ceil(F.log2(length)))).cast("int")


def _page(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value, level)


def _listed(ranges: DataFrame) -> DataFrame:
    """Ranges (start, end, ...) with ``_level`` and ``_p``, once for each of the two pages they touch at most."""
    leveled = ranges.withColumn("_level", _level(F.col("start"), F.col("end")))
    pages = F.array_distinct(F.array(_page(F.col("start"), F.col("_level")), _page(F.col("end") - 1, F.col("_level"))))
    return leveled.withColumn("_p", F.explode(pages))


def _sizes(ranges: DataFrame, scope: list[str]) -> dict[int, tuple[int, int]]:
    """The sizes in use, with the ranges in the fullest page of each, and in all its pages."""
    full = _listed(ranges).groupBy(*scope, "_level", "_p").agg(F.count(F.lit(1)).alias("n"))
    return {r[0]: (r[1], r[2]) for r in full.groupBy("_level").agg(F.max("n"), F.sum("n")).collect()}


def _pages(ranges: DataFrame, scope: list[str]) -> dict[int, int]:
    return {level: most for level, (most, _) in _sizes(ranges, scope).items()}


def _joined_with(side: DataFrame, rows: int) -> DataFrame:
    """A side of a join that has so many rows."""
    return side.hint("merge") if rows > BROADCAST_RANGES else side


def _first_of(at: Column) -> Column:
    """Order of ranges that hold one point: the one that starts last, and of those the shortest."""
    nearest = F.struct(F.col("_range.start"), -F.col("_range.end").cast("decimal(20,0)"))
    return F.max_by("_range", F.when(at, nearest)).alias("_range")


def _blocks(start: Column, end: Column) -> Column:
    """The fewest blocks, each a power of two long and aligned to it, that make up [start, end): two of each length at
    most. (level, block) structs."""

    def of_level(level: Column) -> Column:
        below = _page(start, level)
        low = F.when(F.call_function("shiftleft", below, level) != start, below + 1).otherwise(below)
        high = _page(end, level)
        odd = lambda n: (low < high) & (n.bitwiseAND(F.lit(1)) == 1)
        block = lambda n: F.struct(level.alias("_level"), n.alias("_p"))
        return F.array_compact(F.array(F.when(odd(low), block(low)), F.when(odd(high), block(high - 1))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(HIGHEST)), of_level))


def _disjoint(ranges: DataFrame, scope: list[str]) -> DataFrame:
    """The stretches between any two neighbouring starts or ends, each with the ``_range`` that holds there.

    Every range is made of blocks, and a block keeps its first range only, so a start or end looks at one range of each
    length of block: rows grow neither with the depth of ranges in one another nor with the size of a group.
    """
    written = materialized(ranges)
    edges = written.select(*scope, F.explode(F.array("start", "end")).alias("start")).distinct()
    stretches = materialized(ordered(materialized(edges), scope, ["start"], end=lead(F.col("start"))).where("end is not null"))
    blocks = written.select(*scope, "_range", F.explode(_blocks(F.col("start"), F.col("end"))).alias("_b")).select(*scope, "_range", "_b.*")
    best = materialized(blocks.groupBy(*scope, "_level", "_p").agg(_first_of(F.lit(True))))
    levels = sorted(r[0] for r in best.select("_level").distinct().collect())
    probes = stretches.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    probes = probes.withColumn("_p", _page(F.col("start"), F.col("_level")))
    best = _joined_with(best, best.count())
    return probes.join(best, [*scope, "_level", "_p"]).groupBy(*scope, "start", "end").agg(_first_of(F.lit(True)))


def _as_of(points: DataFrame, stretches: DataFrame, scope: list[str], point: str) -> DataFrame:
    """``points`` with the ``_range`` of the stretch that holds each, null where none does; no two stretches overlap, so
    only the last one that starts at or before a point can. One sort of both, a point being one row."""
    starts = stretches.select(*scope, F.col("start").alias("_at"), F.lit(False).alias("_point"), F.struct("end", "_range").alias("_held"))
    for c in scope:  # a point without a scope is in no range
        starts = starts.where(F.col(c).isNotNull())
    rows = points.withColumns({"_at": F.col(point), "_point": F.lit(True)}).unionByName(starts, allowMissingColumns=True)
    found = ordered(materialized(rows), scope, ["_at", "_point"], _held=last(F.col("_held"))).where("_point")
    return found.select(*points.columns, F.when(F.col("_at") < F.col("_held.end"), F.col("_held._range")).alias("_range"))


def range_lookup(points: DataFrame, ranges: DataFrame, scope: list[str], point: str, payload: list[str]) -> DataFrame:
    """Each of the distinct ``points`` with the ``payload`` of the range [start, end) of its scope that holds it, nulls
    where there is none; of ranges that overlap the one that starts last, and of those the shortest.

    Pages have several sizes, each twice the next smaller one. A range is listed in the pages of the size next above its
    own, of which it touches two at most, however wide it is; a point looks into one page of every size in use, of which
    there are 58 at most, counted from the ranges. So this is an equi-join on scope, size and page, in which no scope,
    however large, is one group, and whose rows grow neither with the widths of ranges nor with distances between them,
    nor with how many overlap: where a page has many, ranges are cut into disjoint ones first, of which a point is in one
    at most, the last that starts before it.
    Starts, ends and points are signed 64-bit numbers; null ones, and ranges that end before they start, hold nothing.
    """
    kept = ranges.where(F.col("end") > F.col("start")).select(
        *scope, "start", "end", F.struct(*dict.fromkeys(["start", "end", *payload])).alias("_range")
    )
    sizes = _sizes(kept, scope)
    if max((most for most, _ in sizes.values()), default=0) > CROWDED:
        found = _as_of(points, materialized(_disjoint(kept, scope)), scope, point)
    else:
        found = _paged(points, kept, scope, point, sizes)
    return found.select(
        *points.columns, F.col("_range").isNotNull().alias("found"), *[F.col(f"_range.{c}").alias(c) for c in payload]
    )


def _paged(points: DataFrame, kept: DataFrame, scope: list[str], point: str, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """``points`` with the ``_range`` of the range that holds each, found in the pages."""
    listed = _listed(kept).select(
        *[F.col(c).alias(f"_s_{c}") for c in scope], "_level", "_p", F.col("start").alias("_from"), F.col("end").alias("_to"), "_range"
    )
    at = F.col(point)
    probes = points.withColumn("_at_level", F.explode(F.array(*map(F.lit, sorted(sizes))).cast("array<int>")))
    inside = reduce(
        lambda a, b: a & b,
        [
            *[F.col(c) == F.col(f"_s_{c}") for c in scope],
            F.col("_at_level") == F.col("_level"),
            _page(at, F.col("_at_level")) == F.col("_p"),
            F.col("_from") <= at,
            at < F.col("_to"),
        ],
    )
    side = _joined_with(listed, sum(rows for _, rows in sizes.values()))
    hits = probes.join(side, inside).select(*points.columns, "_range")
    none = F.lit(None).cast(hits.schema["_range"].dataType)
    both = hits.unionByName(points.withColumn("_range", none))
    return both.groupBy(*points.columns).agg(_first_of(F.col("_range").isNotNull()))
