"""Small inputs with hand-computed results."""

import pytest
from pyspark.sql import functions as F

from profspark.functions.frames import c_string, combined_stack, frame_names, unsigned_to_long
from profspark.operators import kernel, symbols, telemetry
from profspark.plans import by_stack, tracks
from profspark.schema import EVENT_SCHEMA


def frames(names):
    return [{"name": n, "address": 0, "offset": 0} for n in names]


def events(spark, rows):
    full = []
    for row in rows:
        base = {f.name: 0 for f in EVENT_SCHEMA}
        base.update(kind="switch", command="c", trace_name="", buildid=b"\x01", ustack=[], kstack=[])
        base.update(row)
        full.append(base)
    return spark.createDataFrame(full, EVENT_SCHEMA)


def rows_of(df, stack):
    return {tuple(f["name"] for f in r[0]): tuple(r)[1:] for r in df.select(stack, *df.columns[1:]).collect()}


def switch(ts, duration, stack="S", pid=1):
    return {"timestamp": ts, "duration": duration, "pid": pid, "ustack": frames(stack)}


def test_off_cpu(spark):
    df = events(spark, [switch(100, 10), switch(150, 20), switch(200, 5)])
    assert rows_of(by_stack.off_cpu(df, buildid="01"), "stack") == {("S",): (3, 75)}
    assert rows_of(by_stack.off_cpu(events(spark, [switch(100, 10)]), command="c"), "stack") == {("S",): (1, None)}
    assert by_stack.off_cpu(df, command="other").count() == 0


def test_rows_without_stack_end_no_wait(spark):
    df = events(spark, [switch(100, 10), {**switch(150, 20), "ustack": []}, switch(200, 5)])
    assert rows_of(by_stack.off_cpu(df), "stack") == {("S",): (2, 95)}


def test_rss_growth(spark):
    def rss(at, amount, stack):
        return {"kind": "rss", "timestamp": at, "tgid": 1, "amount": amount, "ustack": frames(stack)}

    df = events(spark, [rss(1, 10, "A"), rss(2, 30, "B"), rss(3, 20, "A"), rss(4, 25, "A")])
    grown = [([f["name"] for f in r[0]], r[1], r[2]) for r in by_stack.rss_growth(df, buildid="01").collect()]
    assert grown == [(["B"], 1, 20), (["A"], 1, 5)]
    bare = events(spark, [rss(1, 10, "A"), rss(2, 30, ""), rss(3, 20, "A"), rss(4, 25, "A")])
    assert rows_of(by_stack.rss_growth(bare, buildid="01"), "ustack") == {(): (1, 20), ("A",): (1, 5)}
    assert rows_of(by_stack.rss_growth(bare, command="c"), "ustack") == {("A",): (2, 15)}


def test_span_wait_and_parked(spark):
    def span(kind, ts, duration):
        return {"kind": kind, "timestamp": ts, "duration": duration, "span_id": 7, "tgid": 9, "pid": 3, "ustack": frames("X")}

    tail = {"kind": "rss", "timestamp": 500}
    opened = [span("trace_exit", 100, 10), span("trace_exit", 160, 20)]
    closed = [*opened, span("trace_close", 200, 110), tail]
    assert rows_of(by_stack.span_wait(events(spark, closed)), "stack") == {("X",): (2, -30)}
    assert rows_of(by_stack.span_wait(events(spark, closed), clamp_negative=True), "stack") == {("X",): (2, 40)}
    assert tracks.parked_spans(events(spark, closed)).count() == 0
    still = events(spark, [*opened, tail])
    assert rows_of(by_stack.span_wait(still), "stack") == {("X",): (2, 380)}
    (parked,) = tracks.parked_spans(still).collect()
    assert (parked.start, parked.duration, parked.pid, parked.tid) == (160 // 1000, (500 - 160) // 1000, 9, 9)
    assert tracks.parked_spans(still, keep_thread=True).first().tid == 3


def test_combined_stack(spark):
    df = events(spark, [{"kstack": frames("aba"), "ustack": frames("bc")}])
    assert [f["name"] for f in df.select(combined_stack()).first()[0]] == ["a", "b", "c"]
    assert [f["name"] for f in df.select(combined_stack(dedup=False)).first()[0]] == list("ababc")


def test_throttle(spark):
    rows = spark.createDataFrame([(1, i) for i in range(1, 8)] + [(2, 9)], "tgid long, seq long")
    kept = kernel.throttle(rows, 3).orderBy("tgid", "seq").collect()
    assert [tuple(r) for r in kept] == [(1, 1), (1, 4), (1, 7), (2, 9)]
    assert kernel.throttle(rows, 0).count() == 8


def test_block_pairing(spark):
    schema = "seq long, type string, request long, op int, ts long, tgid long, pid long, size long, ustack_id int, kstack_id int"
    rows = [(i, t, 5, op, ts, 1, 2, 10 + i, 0, 0) for i, (t, op, ts) in enumerate(
        [("start", 0, 10), ("start", 0, 12), ("done", 1, 20), ("done", 1, 25)]
    )]
    (pair,) = kernel.pair_block_io(spark.createDataFrame(rows, schema)).collect()
    assert (pair.start, pair.ts, pair.amount, pair.rw) == (12, 20, 11, 1)


def test_switch_pairing(spark):
    rows = spark.createDataFrame(
        [(1, 0, 5, 1, 1), (2, 0, 9, 0, 0), (3, 0, 14, 2, 2)], "seq long, cpu int, ts long, tgid long, pid long"
    )
    (stay,) = kernel.pair_switches(rows).collect()
    assert (stay.pid, stay.start, stay.ts) == (2, 9, 14)
    assert kernel.pair_switches(rows, min_duration=6).count() == 0


def test_process_filter(spark):
    rows = [
        (1, "rss", 1, 1, None),
        (2, "process_exec", 1, 1, "app"),
        (3, "rss", 1, 4, None),
        (4, "process_exec", 1, 1, "other"),
        (5, "rss", 1, 1, None),
        (6, "process_exit", 1, 4, None),
        (7, "rss", 1, 1, None),
        (8, "process_exit", 1, 1, None),
        (9, "rss", 1, 1, None),
        (10, "process_exit", 1, 1, None),
        (11, "process_exec", 2, 2, "other"),
        (12, "rss", 2, 2, None),
        (13, "reset", None, None, None),
    ]
    df = spark.createDataFrame(rows, "seq long, type string, tgid long, pid long, comm string")
    assert sorted(r.seq for r in kernel.keep_tracked(df, ["app"]).collect()) == [2, 3, 4, 5, 7, 8, 13]


def test_symbols(spark):
    rows = spark.createDataFrame([(1, 7, 3, -1)], "seq long, tgid long, ustack_id int, kstack_id int")
    stackmap = spark.createDataFrame([(3, [0x1005, 0, 0x9999, 0x1010, 0])], "stack_id int, frames array<long>")
    table = spark.createDataFrame([(7, 0x1000, 0x1100, "f"), (8, 0x9000, 0xA000, "g")], "scope long, start long, end long, name string")
    paths = symbols.resolved_call_paths(rows, stackmap, table)
    (row,) = symbols.with_call_paths(rows, paths, rows).collect()
    assert [tuple(f) for f in row.ustack] == [("f", 0x1000, 5), ("f", 0x1000, 16)]
    assert row.kstack == []


def test_kernel_addresses_keep_their_bits(spark):
    df = spark.sql("select cast('18446744071578845184' as decimal(20,0)) as x union all select cast(5 as decimal(20,0))")
    assert sorted(r[0] for r in df.select(unsigned_to_long("x")).collect()) == [18446744071578845184 - 2**64, 5]


def test_names(spark):
    df = spark.createDataFrame([(bytearray(b"abc\0def"),), (bytearray(b"0123456789abcdefghi"),)], "b binary")
    assert sorted(r[0] for r in df.select(c_string("b")).collect()) == ["0123456789abcdef", "abc"]
    df = events(spark, [{"ustack": [{"name": "f", "address": 1, "offset": 255}]}])
    assert df.select(frame_names("ustack", with_offset=True)).first()[0] == ["f-ff"]


def test_trim_probe_frames(spark):
    df = spark.sql("select sequence(1, 7) as a union all select sequence(1, 3)")
    assert sorted(r[0] for r in df.select(kernel.trim_probe_frames(F.col("a"))).collect()) == [[], [6, 7]]


def test_rss_pages(spark):
    df = spark.sql("select 5L as file_pages, -3L as anon_pages, 1L as shmem_pages")
    assert tuple(df.select(kernel.rss_pages(), kernel.rss_pages(clamp=False)).first()) == (6, 3)


def test_span_parent(spark):
    df = spark.sql("select * from values (1L, 2L), (null, 2L), (null, null) as t(a, b)")
    assert sorted(r[0] for r in df.select(kernel.span_parent("a", "b")).collect()) == [0, 1, 2]


def test_program_list(spark):
    text = (
        '[{"name":"x","run_cnt":4,"run_time_ns":10,"pids":[{"comm":"me","pid":1},{"comm":"me","pid":2},{"comm":"you","pid":3}]},'
        '{"name":"y","pids":[{"comm":"me","pid":1}]},{"name":"z","run_cnt":1,"run_time_ns":1}]'
    )
    got = telemetry.program_list(spark.createDataFrame([(text,)], "value string"), "me").collect()
    assert [tuple(r) for r in got] == [("x", 4, 10, 2.5), ("x", 4, 10, 2.5)]


@pytest.mark.parametrize("kernel_fn, wait", [("k1", 75), ("none", None)])
def test_off_cpu_in_kernel(spark, kernel_fn, wait):
    rows = [{**switch(ts, d), "kstack": frames(["k0", "k1"])} for ts, d in ((100, 10), (150, 20), (200, 5))]
    got = tracks.off_cpu_in_kernel(events(spark, rows), [kernel_fn], "c").collect()
    assert [r.offcpu_ns for r in got] == ([wait] if wait else [])


def test_totals_are_conserved(spark):
    rows = [{"kind": k, "amount": 1 << 20, "timestamp": i} for i, k in enumerate(["blk_write", "tcp_send", "tcp_recv"] * 10)]
    totals = {r.kind: (r.total, r.amount_sum) for r in tracks.io_totals(events(spark, rows)).collect()}
    assert totals == {k: (10, 10 << 20) for k in ("blk_write", "tcp_send", "tcp_recv")}


def test_processes_that_run_before_the_capture_are_tracked(spark):
    rows = [(1, "sample", 5, 5, None), (2, "sample", 6, 6, None), (3, "process_exit", 5, 5, None), (4, "sample", 5, 5, None)]
    raw = spark.createDataFrame([(r, *x) for r in ("a", "b") for x in rows], "run string, seq long, type string, tgid long, pid long, comm string")
    initial = spark.createDataFrame([("a", 5, "app"), ("b", 6, "app"), ("b", 5, "other")], "run string, tgid long, comm string")
    got = kernel.keep_tracked(raw, ["app"], scope=("run",), initial=initial)
    assert sorted((r.run, r.seq) for r in got.collect()) == [("a", 1), ("a", 3), ("b", 2)]
    assert kernel.keep_tracked(raw, ["app"], scope=("run",)).count() == 0
