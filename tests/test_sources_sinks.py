import pathlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from profspark.plans import by_stack, tracks
from profspark.schema import EVENT_SCHEMA
from profspark.sources import derived, events as source, sinks

SF = "/root/testdata/sf0.001"


def write_unsigned(path, kind="profile", top=2**63 + 5):
    """A capture file with the unsigned types other writers use."""
    frame = pa.struct([("name", pa.string()), ("address", pa.uint64()), ("offset", pa.uint64())])
    u64 = ["timestamp", "duration", "span_id", "parent_id", "id", "amount"]
    columns = {c: pa.array([5], pa.uint64()) for c in u64}
    columns.update(
        kind=pa.array([kind]),
        cpu=pa.array([3], pa.uint16()),
        tgid=pa.array([2**31 + 1], pa.uint32()),
        pid=pa.array([4], pa.uint32()),
        command=pa.array(["c"]),
        trace_name=pa.array([""]),
        buildid=pa.array([b"\x01\x02"], pa.binary()),
        ustack=pa.array([[{"name": "f", "address": 16, "offset": 1}]], pa.list_(frame)),
        kstack=pa.array([[{"name": "k", "address": top, "offset": 0}]], pa.list_(frame)),
    )
    pq.write_table(pa.table(columns), path)


def test_unsigned_files_are_normalised(spark, tmp_path):
    write_unsigned(f"{tmp_path}/A-0-1.parquet")
    write_unsigned(f"{tmp_path}/A-1-2.parquet", kind="rss")
    pathlib.Path(f"{tmp_path}/PENDING.parquet").write_bytes(pathlib.Path(f"{tmp_path}/A-0-1.parquet").read_bytes())
    df = source.load_events(spark, str(tmp_path))
    assert {f.name: f.dataType.simpleString() for f in df.schema} == {
        f.name: f.dataType.simpleString() for f in EVENT_SCHEMA
    }
    rows = df.collect()
    assert len(rows) == 2
    assert rows[0].tgid == 2**31 + 1 and rows[0].kstack[0].address == 2**63 + 5 - 2**64
    assert source.load_events(spark, str(tmp_path), "A-1-*").count() == 1
    assert by_stack.cpu_time(df, buildid="0102").first()["sampled_duration"] == 5


def test_latest_run(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        source.latest_run_path(spark, f"{tmp_path}/none")
    for name in ("2", "10", "9", "x11"):
        (tmp_path / name).mkdir()
    assert source.latest_run_path(spark, str(tmp_path)) == f"{tmp_path}/10"


def test_write_events(spark, tmp_path):
    df = derived.events(spark, SF)
    path = f"{tmp_path}/out"
    sinks.write_events(df, path, rows_per_file=100)
    files = list(pathlib.Path(path).glob("*.parquet"))
    assert pathlib.Path(f"{path}/_SUCCESS").exists()
    sizes = []
    for f in files:
        table = pq.read_table(f, columns=["timestamp"])
        values = table["timestamp"].to_pylist()
        assert values == sorted(values)
        sizes.append(len(values))
        meta = pq.ParquetFile(f).metadata.row_group(0)
        stamp = [meta.column(i) for i in range(meta.num_columns) if meta.column(i).path_in_schema == "timestamp"][0]
        assert stamp.compression == "ZSTD" and "DELTA_BINARY_PACKED" in stamp.encodings
    assert max(sizes) <= 100 and sum(sizes) == 1000
    back = source.load_events(spark, path)
    want = sorted(by_stack.cpu_time(df, buildid="01").collect(), key=str)
    assert sorted(by_stack.cpu_time(back, buildid="01").collect(), key=str) == want
    assert back.agg(F.sum("duration")).first() == df.agg(F.sum("duration")).first()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = f"{tmp_path}/out"
    sinks.write_events(derived.events(spark, SF), path)
    df = source.load_events(spark, path)

    def plan(result):
        return result._jdf.queryExecution().executedPlan().toString()

    cpu = plan(by_stack.cpu_time(df, buildid="01"))
    assert "EqualTo(kind,profile)" in cpu and "EqualTo(buildid" in cpu
    scan = [line for line in cpu.splitlines() if "ReadSchema" in line][0]
    assert "kstack" not in scan.split("ReadSchema")[1] and "span_id" not in scan.split("ReadSchema")[1]
    assert "In(kind, [blk_read,blk_write])" in plan(by_stack.block_bytes(df))
    assert "LessThan(timestamp,5)" in plan(source.time_slice(df, end=5))
    kernel_fn = plan(tracks.off_cpu_in_kernel(df, ["k_1"]))
    assert "kstack:array<struct<name:string>>" in kernel_fn


def test_next_export_path(spark, tmp_path):
    base = str(tmp_path)
    assert sinks.next_export_path(spark, base, "profile") == f"{base}/profile-0"
    (tmp_path / "profile-0").mkdir()
    (tmp_path / "profile-2").mkdir()
    assert sinks.next_export_path(spark, base, "profile") == f"{base}/profile-1"


def test_sql_values_are_never_text(spark):
    df = derived.events(spark, SF)
    hostile = "cmd1' or 'a' = 'a"
    query = "select count(*) as n from capture where command = '?command'"
    assert source.run_sql(df, query, view="capture", command=hostile).first().n == 0
    assert source.run_sql(df, query, view="capture", command="cmd1").first().n > 0
    assert source.run_sql(df, "select count(*) as n from events").first().n == 1000


def test_sql_with_windows_and_stack_functions(spark):
    df = derived.events(spark, SF)
    query = """
        select tid, max(pause) as longest, count(pause) as pauses from (
            select pid as tid, empty(kstack) as bare, timestamp - lag(timestamp, 1) over (partition by pid order by timestamp, id) as pause
            from io where kind like 'blk%' and buildid = decode('?buildid', 'hex'))
        where not bare group by tid
    """
    got = source.run_sql(df, query, view="io", buildid="01").collect()
    last, want = {}, {}
    rows = df.where("kind like 'blk%' and hex(buildid) = '01'").select("pid", "timestamp", "id", F.size("kstack").alias("depth"))
    for r in sorted(rows.collect(), key=lambda r: (r.pid, r.timestamp, r.id)):
        if r.depth:
            want.setdefault(r.pid, []).extend([r.timestamp - last[r.pid]] if r.pid in last else [])
        last[r.pid] = r.timestamp
    assert sorted(map(tuple, got), key=str) == sorted(((p, max(g, default=None), len(g)) for p, g in want.items()), key=str)


def test_sql_with_integer_division(spark):
    df = derived.events(spark, SF)
    query = "select distinct 7 / 2 as a, '1/2' as b /* x/y */, typeof(timestamp/1000) as c from events -- 1/2"
    assert source.run_sql(df, query, integer_division=True).collect() == [(3, "1/2", "bigint")]
    assert source.run_sql(df, query).first().c == "double"


@pytest.mark.parametrize("name", ["P", "PEND", "PENDIN", "PENDINGS", "PENDING-1", "A-PENDING", "Q", "STACK-0-1"])
def test_unfinished_file_is_never_opened(spark, tmp_path, name):
    write_unsigned(f"{tmp_path}/{name}.parquet")
    (tmp_path / "PENDING.parquet").write_bytes((tmp_path / f"{name}.parquet").read_bytes()[:100])
    assert source.load_events(spark, str(tmp_path)).count() == 1


def test_derived_times_do_not_depend_on_the_session_zone(spark):
    want = derived.events(spark, SF).agg(F.min("timestamp"), F.max("timestamp")).first()
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert derived.events(spark, SF).agg(F.min("timestamp"), F.max("timestamp")).first() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_numbers_are_taken_once(spark, tmp_path):
    """Many writers at once never get one number, though none has written anything yet."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda _: sinks.next_export_path(spark, str(tmp_path), "trace"), range(24)))
    assert len(set(got)) == 24


def test_interned_paths(spark):
    """Keys and numbers are all that is shuffled for the aggregate; null, empty and odd paths keep apart."""
    from profspark.plans.paths import intern_paths, merge_paths, no_path

    events = derived.events(spark, SF)
    keyed, paths = intern_paths(events)
    keyed.write.parquet(base := f"{sinks_dir(spark)}/events")
    keyed, paths = spark.read.parquet(base), paths.persist()
    assert paths.count() == events.select("ustack").union(events.select("kstack")).distinct().count() == merge_paths(paths, paths).count()
    plan = by_stack.cpu_time(keyed, paths=paths, buildid="01")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("partial_count") :]
    assert "stack#" not in below.split("InMemory")[0] and "ReadSchema" in below
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None]), (4, [(None, 5, None)]), (5, [(None, None, 5)]), (6, [("a", 1, 2)]), (7, [("a", 1, 2)])], "id int, ustack array<struct<name:string,address:long,offset:long>>").withColumn("kstack", F.col("ustack"))
    keyed, paths = intern_paths(odd)
    assert paths.count() == 6 and {r.id for r in keyed.where(no_path("ustack_key")).collect()} == {1, 2}
    assert keyed.join(paths.withColumnRenamed("key", "ustack_key"), "ustack_key").count() == 7


def sinks_dir(spark):
    import uuid

    from profspark.operators.hot import shared_dir

    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"
