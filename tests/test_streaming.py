"""Streaming folds against the batch operators over the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from model import stream
from profspark.operators import kernel
from profspark.plans.collect import Settings, annotate, rejects, to_events
from profspark.schema import RAW_SCHEMA
from profspark.sources import derived
from profspark.sources.events import read_raw_stream
from profspark.streaming import fold, steps
from profspark.streaming.telemetry import Statistics, observed

SF = "/root/testdata/sf0.001"
PARTS = 4


def feed(spark, df, path, parts=PARTS):
    """Write rows as files in arrival order and open them as a stream of one file per batch."""
    rows = df.count()
    bounds = df.approxQuantile("seq", [i / parts for i in range(1, parts)], 0.0)
    low = float("-inf")
    for i, high in enumerate([*bounds, float("inf")]):
        part = df.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1)
        part.write.mode("append").parquet(path)
        low = high
    assert spark.read.parquet(path).count() == rows
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, df, step, tmp_path):
    source = feed(spark, df, f"{tmp_path}/in")
    fold.start(source, step, f"{tmp_path}/run").awaitTermination()
    return fold.read_output(spark, f"{tmp_path}/run")


def same(streamed, batch):
    columns = batch.columns
    assert {"batch"} | set(columns) == set(streamed.columns)
    assert streamed.select("batch").distinct().count() > 1
    got, want = (sorted(map(tuple, d.select(columns).collect()), key=str) for d in (streamed, batch))
    assert got == want and want


def test_switches(spark, tmp_path):
    df = derived.switches(spark, SF)
    same(run(spark, df, steps.switch_step(1500), tmp_path), kernel.pair_switches(df, 1500))


def test_block_io(spark, tmp_path):
    df = derived.block_requests(spark, SF)
    same(run(spark, df, steps.block_step(), tmp_path), kernel.pair_block_io(df))


@pytest.mark.parametrize("every", (0, 29))
def test_throttle(spark, tmp_path, every):
    df = derived.rss_counters(spark, SF)
    same(run(spark, df, steps.throttle_step(every), tmp_path), kernel.throttle(df, every))


def test_tracked(spark, tmp_path):
    leader = F.when(F.col("type").isin("process_exec", "process_exit"), F.col("tgid")).otherwise(F.col("pid"))
    df = derived.raw(spark, SF).withColumn("pid", leader)
    same(run(spark, df, steps.tracked_step(["cmd1"]), tmp_path), kernel.keep_tracked(df, ["cmd1"]))


@pytest.mark.parametrize("seed", (21, 22))
def test_collected(spark, tmp_path, seed):
    df = spark.createDataFrame(stream(random.Random(seed), 400), RAW_SCHEMA)
    want = to_events(annotate(df), Settings())
    same(run(spark, df, steps.collect_step(), tmp_path), want)


def test_rejects(spark, tmp_path):
    df = spark.createDataFrame(stream(random.Random(23), 300), RAW_SCHEMA)
    same(run(spark, df, steps.collect_step(report=True), tmp_path), rejects(annotate(df)))


def output(spark, path):
    return sorted(map(tuple, fold.read_output(spark, str(path)).collect()))


def test_replayed_batch_changes_nothing(spark, tmp_path):
    df = derived.switches(spark, SF)
    halves = [df.where("seq < 500"), df.where("seq >= 500")]
    folded = fold.Fold(steps.switch_step(), str(tmp_path))
    folded(halves[0], 0)
    folded(halves[1], 1)
    once = output(spark, tmp_path)
    folded(halves[1], 1)
    assert output(spark, tmp_path) == once


@pytest.mark.parametrize("compact_every", (2, 16))
def test_failure_between_output_and_state(spark, tmp_path, monkeypatch, compact_every):
    """An attempt that has written its output and dies before the commit is not read, and its replay gives the same."""
    df = derived.switches(spark, SF)
    parts = [df.where(f"seq div 300 = {i}") for i in range(4)]
    whole = fold.Fold(steps.switch_step(), f"{tmp_path}/whole", compact_every)
    for i, part in enumerate(parts):
        whole(part, i)
    folded = fold.Fold(steps.switch_step(), f"{tmp_path}/run", compact_every)
    folded(parts[0], 0)
    for i in (1, 2, 3):
        before = output(spark, f"{tmp_path}/run")
        with monkeypatch.context() as broken:
            broken.setattr(fold.Manifests, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                folded(parts[i], i)
        assert output(spark, f"{tmp_path}/run") == before
        folded(parts[i], i)
    assert output(spark, f"{tmp_path}/run") == output(spark, f"{tmp_path}/whole")


def test_two_attempts_at_one_batch(spark, tmp_path):
    """Of two drivers that run a batch at the same time, the first to commit counts."""
    manifests = fold.Manifests(spark, str(tmp_path))
    assert manifests.commit(0, {"out": "a"}) and not manifests.commit(0, {"out": "b"})
    assert manifests.read(0) == {"out": "a"} and manifests.batches() == [0]


def size(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_state_written_follows_the_batch(spark, tmp_path):
    """Bytes of state that a small batch writes do not depend on how much is open."""
    wrote = {}
    for n in (200, 20_000):
        folded = fold.Fold(steps.block_step(), f"{tmp_path}/{n}")
        starts = spark.range(n).selectExpr("id as seq", "'start' as type", "id as request", "1 as op", "id as ts", "id as tgid", "id as pid", "id as size", "1 as ustack_id", "1 as kstack_id")
        folded(starts, 0)
        folded(starts.where("request < 20").withColumn("type", F.lit("done")).withColumn("seq", F.col("seq") + n), 1)
        state = fold.Manifests(spark, f"{tmp_path}/{n}").read(1)["changes"][-1][1]
        wrote[n] = size(type(tmp_path)(state))
        assert fold.read_output(spark, f"{tmp_path}/{n}").where("batch = 1").count() == 20
        # The closed requests are gone, all others are still open.
        after = folded._state(spark, fold.Manifests(spark, f"{tmp_path}/{n}").read(1), None)
        assert after.count() == n - 20
    assert wrote[20_000] < 1.2 * wrote[200]


def test_snapshots_and_retention(spark, tmp_path):
    """Snapshots take up the changes, and what only old batches read is removed."""
    df = derived.rss_counters(spark, SF)
    folded = fold.Fold(steps.throttle_step(29), f"{tmp_path}/run", compact_every=3, keep_batches=2)
    for i in range(8):
        folded(df.where(f"seq % 8 = {i}").withColumn("seq", F.expr(f"{i} * 100000 + seq")), i)
    want = df.withColumn("seq", F.expr("(seq % 8) * 100000 + seq"))
    got = fold.read_output(spark, f"{tmp_path}/run").drop("batch")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, kernel.throttle(want, 29).collect()), key=str)
    last = fold.Manifests(spark, f"{tmp_path}/run").read(7)
    assert last["snapshot"] and len(last["changes"]) == 2
    left = {p.parent.parent.name for p in (tmp_path / "run/state").rglob("keys/*.parquet")}
    assert len(left) <= 5


def test_runs_in_a_stream(spark, tmp_path):
    """Two runs with the same ids in one stream give what a batch gives; a reset of one leaves the other alone."""
    parts = [spark.createDataFrame(stream(random.Random(s), 250), RAW_SCHEMA).withColumn("run", F.lit(f"r{s}")) for s in (41, 42)]
    df = parts[0].unionByName(parts[1])
    want = to_events(annotate(df, ("run",)), Settings(), ("run",))
    same(run(spark, df, steps.collect_step(scope=("run",)), tmp_path), want)


def test_statistics(spark, tmp_path):
    derived.raw(spark, SF).coalesce(1).write.parquet(f"{tmp_path}/in")
    listener = Statistics()
    spark.streams.addListener(listener)
    try:
        query = (
            observed(read_raw_stream(spark, f"{tmp_path}/in"))
            .writeStream.format("noop")
            .option("checkpointLocation", f"{tmp_path}/c")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        import time

        for _ in range(50):
            if listener.deltas:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert sum(d["total"] for d in listener.deltas) == derived.raw(spark, SF).count()
