"""Results that do not depend on how large a table is: what larger inputs than the test tables bring about."""

import pathlib
import random
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from profspark.operators import hot, intervals, process, ranges, spans, symbols
from profspark.plans import tracks
from profspark.sources import derived, events
from profspark.streaming import fold, steps

SF = "/root/testdata/sf0.001"


def test_epochs_of_more_resets_than_a_task_takes(spark, split_hot):
    """Resets have no key: all are rows of one, which is hot here."""
    rows = [(i, "reset" if i % 3 == 0 else "sample") for i in range(300)]
    found = process.with_epoch(spark.createDataFrame(rows, "seq long, type string"))
    assert sorted((r.seq, r.epoch) for r in found.collect()) == [(i, i // 3 + 1) for i, _ in rows]


def test_waiting_times_beyond_64_bits(spark):
    """Threads that wait for a century each."""
    century = 3_155_760_000 * 1_000_000_000
    rows = [(1, pid, t, 0, "switch", "c", [("k_1",)]) for pid in range(5) for t in (0, century)]
    events = spark.createDataFrame(rows, "id long, pid long, timestamp long, duration long, kind string, command string, kstack array<struct<name: string>>")
    found = tracks.off_cpu_in_kernel(events, ["k_1"], "c")
    assert [tuple(r) for r in found.collect()] == [("k_1", 5, 5 * century)] and 5 * century > 2**63
    assert dict(entry._as_long(found, "offcpu_ns").dtypes)["offcpu_ns"] == "decimal(38,0)"
    assert dict(entry._as_long(found.where("offcpu_ns < 0"), "offcpu_ns").dtypes)["offcpu_ns"] == "bigint"


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("scope", [["s"], []])
def test_ranges_cut_into_disjoint_ones_equal_search(spark, monkeypatch, split_hot, seed, scope):
    monkeypatch.setattr(ranges, "CROWDED", 0)
    rng = random.Random(seed)
    edge = lambda: rng.choice([rng.randint(-100, 100), rng.randint(-(1 << 20), 1 << 20), rng.randint(-(1 << 63), (1 << 63) - 1), -(1 << 63), (1 << 63) - 1, 0])
    of = lambda: rng.choice([1, 2, None]) if scope else 1
    held = [(of(), *sorted((edge(), edge())), i) for i in range(200)] + [(1, 5, 5, 900), (1, None, 9, 901), (1, 9, 3, 902)]
    points = list({(of(), rng.choice([edge(), rng.choice(held)[1], rng.choice(held)[2]])) for _ in range(300)})
    got = ranges.range_lookup(
        spark.createDataFrame(points, "s long, at long"), spark.createDataFrame(held, "s long, start long, end long, id long"), scope, "at", ["start", "end"]
    ).collect()
    for r in got:
        inside = [(a, -b) for s, a, b, _ in held if s is not None and s == r.s and None not in (a, b, r.at) and a <= r.at < b]
        a, b = max(inside, default=(None, None))
        assert (r.found, r.start, r.end) == (bool(inside), a, None if b is None else -b)
    assert len(got) == len(points)


def test_nested_ranges_meet_no_point_each(spark, monkeypatch):
    """3000 ranges one in another: a point meets a few of the stretches they are cut into."""
    nested = spark.range(1, 3001).select((-F.col("id")).alias("start"), F.col("id").alias("end"), "id")
    cut = ranges._disjoint(nested.select("start", "end", F.struct("start", "end", "id").alias("_range")), [])
    assert cut.count() == 5999 and max(ranges._pages(cut, []).values()) <= ranges.CROWDED
    found = ranges.range_lookup(spark.range(-3000, 3000).select(F.col("id").alias("at")), nested, [], "at", ["id"])
    assert found.where("id = greatest(-at, at + 1)").count() == 6000


def test_many_ranges_are_never_broadcast(spark, monkeypatch):
    """Their files are small and their rows are not: neither the blocks of nested ranges nor the ranges in pages go through
    the driver, and points look for one of the cut ranges only."""
    plans, written = [], ranges.materialized
    monkeypatch.setattr(ranges, "materialized", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df))
    monkeypatch.setattr(ranges, "BROADCAST_RANGES", 100, raising=False)
    points = spark.range(-3000, 3000).select((F.col("id") % 2).alias("s"), F.col("id").alias("at")).unionByName(spark.createDataFrame([(None, 1), (1, None)], "s long, at long"))
    for width in (F.col("id"), F.lit(1).cast("bigint")):
        held = spark.range(1, 3001).select(F.lit(1).cast("bigint").alias("s"), (-width).alias("start"), F.col("id").alias("end"), "id")
        held = held.unionByName(held.withColumn("s", F.lit(None).cast("bigint")))
        found = ranges.range_lookup(points, held, ["s"], "at", ["start", "id"])
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        assert found.count() == 6002 and found.where("found and s is null").isEmpty() and not found.where("found").isEmpty()
    assert not any("BroadcastHashJoin" in p for p in plans) and not any("_at_level" in p for p in plans)


def test_wide_ranges_of_many_suppliers(spark, tmp_path):
    spark.range(8000).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    found = derived.wide_ranges(spark, str(tmp_path))
    assert found.count() == 24001 and found.where("id < 1000000").select("start", "end").distinct().count() == 8000


def test_a_batch_of_a_stream_caches_no_plan(spark, tmp_path):
    """What a batch reads more than once is written, and gone when it ends; cached, it keeps its many small partitions."""
    folded, plans = fold.Fold(steps.collect_step(report=True), str(tmp_path)), []
    inner = folded.step.run

    def run(state, batch, keep):
        output, after = inner(state, batch, keep)
        plans.extend(df._jdf.queryExecution().executedPlan().toString() for df in (output, after))
        return output, after

    folded.step = fold.Step(run, folded.step.touches, folded.step.key)
    raw = derived.raw(spark, SF)
    for i in range(2):
        folded(raw.where(f"seq div 10000 % 2 = {i}"), i)
    assert len(plans) == 4 and not any("InMemoryTableScan" in p for p in plans)
    assert not list((tmp_path / "work").glob("*"))


def test_windows_over_many_changes_get_more_tasks(spark, monkeypatch):
    """So many that none gets more than its share, though Spark would merge them into one per core."""
    query = entry.queries()["span_parents"]
    plain = sorted(map(tuple, query(spark, SF).collect()))
    monkeypatch.setattr(intervals, "TASK_CHANGES", 200)
    dealt = query(spark, SF)
    assert sorted(map(tuple, dealt.collect())) == plain
    assert dealt.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["open_span_label", "rejects"])
def test_state_from_dealt_windows(spark, monkeypatch, name):
    """The queries that look up the lists made by such windows: the same rows, from more than a task per core."""
    query = entry.queries()[name]
    plain = sorted(map(str, query(spark, SF).collect()))
    calls, dealt = [], intervals.Crowds.dealt
    monkeypatch.setattr(intervals, "TASK_CHANGES", 200)
    monkeypatch.setattr(intervals.Crowds, "dealt", lambda self, rows: calls.append(out := dealt(self, rows)) or out)
    assert sorted(map(str, query(spark, SF).collect())) == plain
    assert any("REPARTITION_BY_NUM" in c._jdf.queryExecution().executedPlan().toString() for c in calls)


@pytest.mark.parametrize("name", ["collected_events_runs", "open_span_label"])
def test_lookups_in_many_changes_get_more_tasks(spark, monkeypatch, name):
    """Than the session's shuffles have partitions, and both sides of such a lookup are shuffled once."""
    query = entry.queries()[name]
    plain = sorted(map(str, query(spark, SF).collect()))
    monkeypatch.setattr(intervals, "TASK_CHANGES", 100)
    monkeypatch.setattr(intervals, "BROADCAST_INTERVALS", 100)
    monkeypatch.setattr(hot, "TASK_ROWS", 500)
    monkeypatch.setattr(symbols, "TASK_ADDRESSES", 50)
    dealt = query(spark, SF)
    assert sorted(map(str, dealt.collect())) == plain
    plan = dealt._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    lines = [line for line in plan.split("\n") if "hashpartitioning" in line]
    assert any("hashpartitioning(_k" in line and "REPARTITION_BY_NUM" in line for line in lines)
    # None of the lookups by several keys is left to the session's number of partitions.
    assert not any("hashpartitioning(coalesce(epoch" in line or "hashpartitioning(coalesce(_i_epoch" in line for line in lines)


def test_events_are_shuffled_few_times(spark, monkeypatch):
    """Enters are dealt by span once for the entries alive and for the owners of closes, which share that, and small call
    paths are broadcast."""
    monkeypatch.setattr(intervals, "BROADCAST_INTERVALS", 10)
    found = entry.queries()["collected_events_runs"](spark, SF)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    lines = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    # 25 before.
    assert "ReusedExchange" in plan and len([line for line in lines if "ReusedExchange" not in line]) <= 16


def test_only_rows_behind_an_exec_look_for_their_state(spark, monkeypatch):
    """The events are those of all rows' state; rows without a known process, here most, are in no shuffle for them."""
    from profspark.plans import collect

    monkeypatch.setattr(intervals, "BROADCAST_INTERVALS", 10)
    raw = derived.raw(spark, SF).where("type != 'process_exec' or tgid % 4 = 1")
    paths, names = derived.stackmap(spark, SF), derived.symbols(spark, SF)
    looked, lookup = [], spans.lookup

    def seen(rows, intervals, payload, *more, **how):
        if payload == ["entry", "entered"]:
            looked.append(rows)
        return lookup(rows, intervals, payload, *more, **how)

    monkeypatch.setattr(spans, "lookup", seen)
    events, rejected = collect.collect_events(raw, paths, names)
    kept, every = (rows.count() for rows in looked)
    assert kept < every / 4
    plain = collect.to_events(collect.annotate(raw), collect.Settings())
    columns = ["timestamp", "duration", "kind", "tgid", "pid", "span_id", "parent_id", "id", "amount", "command", "trace_name"]
    assert sorted(map(str, events.select(columns).collect())) == sorted(map(str, plain.select(columns).collect()))
    assert rejected.where("reason = 'missing command'").count() > every / 4


def test_joins_with_a_dictionary_get_tasks_by_rows(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 50).alias("k"), "id")
    words = spark.range(40).select(F.col("id").alias("k"), F.col("id").cast("string").alias("word"))
    expected = sorted((r % 50, r, str(r % 50) if r % 50 < 40 else None) for r in range(3000))
    for most, hot_rows in ((1_000_000, 1_000_000), (100, 1_000_000), (100, 20)):
        monkeypatch.setattr(hot, "TASK_ROWS", most)
        spark.conf.set(hot.GROUP_ROWS, str(hot_rows))
        try:
            found = hot.dictionary_join(rows, words.hint("merge"), ["k"], "id")
            assert sorted(map(tuple, found.collect()), key=lambda r: (r[0], r[1])) == expected
            assert (found.rdd.getNumPartitions() >= 30) == (most == 100)
        finally:
            spark.conf.unset(hot.GROUP_ROWS)


def _shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_") and n.endswith(".data")}


def test_shuffles_of_written_tables_go_with_the_writing(spark):
    before = _shuffle_files(spark)
    kept = hot.materialized(spark.range(10_000).repartition(4, "id").groupBy(F.col("id") % 1000).count())
    for _ in range(100):  # the files go in the background
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before and kept.count() == 1000
    assert spark.conf.get(hot.CLEANUP) == "false"


@pytest.mark.parametrize("report", [False, True])
def test_a_batch_keeps_nothing_but_its_output_and_state(spark, tmp_path, monkeypatch, report):
    """Its tables go when it ends, and rows that are of no process, for the rejects all plain ones, look for no span."""
    looked, lookup = [], spans.lookup
    monkeypatch.setattr(spans, "lookup", lambda rows, i, payload, *a, **k: (looked.append(rows.count()) if payload == ["top"] else None) or lookup(rows, i, payload, *a, **k))
    tables = lambda: set(pathlib.Path(hot.shared_dir(spark)).glob("table-*"))
    folded, before = fold.Fold(steps.collect_step(report=report), str(tmp_path)), tables()
    raw = derived.raw(spark, SF)
    plain = []
    for i in range(2):
        part = raw.where(f"seq div 10000 % 2 = {i}")
        plain.append(part.where(F.col("type").isin(derived.PLAIN_TYPES)).count())
        folded(part, i)
    assert tables() == before and not list((tmp_path / "work").glob("*"))
    assert len(looked) == 2 and all(n < p * (0.1 if report else 0.9) for n, p in zip(looked, plain, strict=True))


def test_a_replayed_batch_is_several_files(spark, tmp_path):
    """As many as there are partitions for it, so that no task sorts or writes a whole batch; none comes before its turn."""
    rows = spark.range(10_000).select((F.col("id") * 7 % 10_000).alias("seq"))
    stream, seen = events.replay_stream(rows, "seq", f"{tmp_path}/in", 3), []
    query = stream.writeStream.foreachBatch(lambda df, i: seen.append(sorted(r.seq for r in df.collect()))).option("checkpointLocation", f"{tmp_path}/c")
    query.trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 3 and sum(seen, []) == list(range(10_000)) and len(list((tmp_path / "in").glob("part-*"))) == 6


@pytest.mark.parametrize("name", ["collected_events", "hot_collected_events"])
def test_shuffles_of_large_tables_are_not_there_at_once(spark, monkeypatch, name):
    """Rows with many changes are written between lookups, and shuffles of one go before the next: the same rows, and the
    lists' windows and the entries are in no plan together."""
    query = entry.queries()[name]
    plain = sorted(map(str, query(spark, SF).collect()))
    monkeypatch.setattr(intervals, "BROADCAST_INTERVALS", 10)
    monkeypatch.setattr(spans, "WRITTEN_CHANGES", 10)
    monkeypatch.setattr(symbols, "BROADCAST_FRAMES", 10)
    monkeypatch.setattr(symbols, "WRITTEN_ROWS", 10)
    found = query(spark, SF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "top_after" not in plan and "owner" not in plan
    assert sorted(map(str, found.collect())) == plain
