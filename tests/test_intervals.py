"""Interval lookups against a search row by row, and the plans of what is built on them."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from profspark.operators import intervals, kernel
from profspark.operators.intervals import EARLIEST, Need, crowds, lookup
from profspark.operators.ranges import range_lookup
from profspark.operators.spans import SpanState
from profspark.sources import derived

SF = "/root/testdata/sf0.001"


def rows_of(seed, keys=5, n=400):
    rng = random.Random(seed)
    at = rng.sample(range(10_000), n)
    return [(rng.choice([None, *range(keys)]), None if rng.random() < 0.02 else a, rng.random() < 0.3) for a in at]


def want(rows):
    """The order value of the last change of the same key at or before a row."""
    out = {}
    for key, at, _ in rows:
        seen = [a if a is not None else EARLIEST for k, a, c in rows if c and k == key and (a is None or at is not None and a <= at)]
        out[key, at] = max(seen, default=None)
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, "key long, seq long, change boolean")
    crowd = crowds(df, changes=Need(["key"], F.col("change")))["changes"]
    changes = df.where("change").select("key", "seq", intervals.moment().alias("begin"))
    ends = changes.withColumn("end", F.expr("lead(begin) over (partition by key order by begin)"))
    got = lookup(df, ends.withColumn("since", F.col("begin")), ["since"], crowd)
    return got, {(r.key, r.seq): r.since for r in got.collect()}


@pytest.mark.parametrize("crowd", [256, 20, 0])
@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_lookup_equals_search(spark, monkeypatch, crowd, broadcast):
    monkeypatch.setattr(intervals, "CROWD", crowd)
    monkeypatch.setattr(intervals, "PER_BUCKET", 3)
    monkeypatch.setattr(intervals, "BROADCAST_INTERVALS", broadcast)
    for seed in range(3):
        rows = rows_of(seed)
        got, since = found(spark, rows)
        assert since == want(rows) and got.count() == len(rows)


def test_intervals_are_listed_in_proportion(spark, monkeypatch):
    """A key with many changes gets buckets, and its intervals not many more rows than it has changes."""
    monkeypatch.setattr(intervals, "CROWD", 16)
    df = spark.range(2000).select((F.col("id") % 2).alias("key"), F.col("id").alias("seq"), (F.col("id") % 4 == 0).alias("change"))
    crowd = crowds(df, changes=Need(["key"], F.col("change")))["changes"]
    assert (crowd.count, crowd.changes) == (1, 500)
    ends = df.where("change").select("key", F.col("seq").alias("begin"), (F.col("seq") + 4).alias("end"))
    listed = crowd.bucketed(ends)
    assert listed.where("_bits is not null").count() == 500
    found = lookup(df, ends, [], crowd, how="left_semi")
    assert found.count() == 1000 and found.columns == ["key", "seq", "change"]


def nodes(plan):
    """(node's first line, lines below it) of a plan's text."""
    lines = [x for x in plan.splitlines() if x.strip()]
    depth = [len(re.match(r"[ :|]*(?:[+:]- )?", x)[0]) for x in lines]
    for i, x in enumerate(lines):
        end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
        yield x, lines[i + 1 : end]


@pytest.mark.parametrize("name", ["span_exit", "span_close", "open_span_label", "process_filter", "process_attribution", "collected_events"])
def test_plain_rows_are_not_sorted(spark, monkeypatch, name):
    """Below every sort and window, rows are filtered to types that change a state, or aggregated before."""
    monkeypatch.setattr(intervals, "BROADCAST_INTERVALS", 0)
    df = entry.queries()[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # What is written apart are changes of state, counts and dictionaries; all else is read from the input.
    ordering = [below for x, below in nodes(plan) if re.search(r"(Sort|Window) \[|SortMergeJoin", x)]
    changing = re.compile(r"trace_enter|trace_close|trace_exit|process_exec|process_exit|reset")
    for below in ordering:
        scans = [b for b in below if "FileScan" in b and "/orders.parquet" in b]
        assert not scans or any("Filter" in b and changing.search(b) and "NOT coalesce(type" not in b for b in below), below[:12]
    assert "ShuffledHashJoin" in plan


def test_filter_keeps_the_exit(spark):
    rows = [(0, "rss", 1), (1, "process_exec", 1), (2, "rss", 1), (3, "rss", 2), (4, "process_exit", 1), (5, "rss", 1), (6, "process_exec", 1), (7, "process_exec", 1), (8, "rss", 1), (None, "rss", 1)]
    df = spark.createDataFrame([(s, t, k, k, "a" if t == "process_exec" else None) for s, t, k in rows], "seq long, type string, tgid long, pid long, comm string")
    assert sorted(r.seq for r in kernel.keep_tracked(df, ["a"]).collect()) == [1, 2, 4, 6, 7, 8]


@pytest.mark.parametrize("seed", range(3))
def test_ranges_equal_search(spark, seed):
    rng = random.Random(seed)
    edge = lambda: rng.choice([rng.randint(-100, 100), rng.randint(-(1 << 20), 1 << 20), rng.randint(-(1 << 63), (1 << 63) - 1), -(1 << 63), (1 << 63) - 1, 0])
    ranges = [(rng.choice([1, 2, None]), *sorted((edge(), edge())), i) for i in range(300)] + [(1, 5, 5, 900), (1, None, 9, 901), (2, 9, 3, 902)]
    points = list({(rng.choice([1, 2, None]), rng.choice([edge(), rng.choice(ranges)[1], rng.choice(ranges)[2]])) for _ in range(300)})
    got = range_lookup(spark.createDataFrame(points, "s long, at long"), spark.createDataFrame(ranges, "s long, start long, end long, id long"), ["s"], "at", ["start", "end"])
    for r in got.collect():
        inside = [(a, -b) for s, a, b, _ in ranges if s is not None and s == r.s and None not in (a, b, r.at) and a <= r.at < b]
        a, b = max(inside, default=(None, None))
        assert (r.found, r.start, r.end) == (bool(inside), a, None if b is None else -b)
    assert got.count() == len(points)


def test_one_vast_range(spark):
    points = spark.range(5).select((F.col("id") * (1 << 60)).alias("at"))
    ranges = spark.sql("select -2 as start, 4611686018427387904 as `end`, 'x' as name")
    assert sorted((r.at >> 60, r.name) for r in range_lookup(points, ranges, [], "at", ["name"]).collect()) == [(0, "x"), (1, "x"), (2, "x"), (3, "x"), (4, None)]


def test_raw_without_any_change(spark):
    raw = derived.raw(spark, SF).where("type = 'rss'").withColumn("epoch", F.lit(0))
    rows = SpanState(raw).rows(changes=True)
    assert rows.where("entry is not null or top is not null").isEmpty() and rows.count() == raw.count()
