import json

import pytest
from pyspark.sql import functions as F

from profspark.plans import by_stack, tracks
from profspark.plans.profile import profile
from profspark.plans.profile_bytes import profile_chunks, varint
from profspark.plans.trace import trace
from profspark.schema import LINE_SCHEMA
from profspark.sources import derived, sinks

SF = "/root/testdata/sf0.001"
STACK = "array<struct<name:string,address:long,offset:long>>"


def result(spark, rows):
    return spark.createDataFrame(rows, f"stack {STACK}, count long, cost_ns long")


F1, G1 = ("f", 100, 1), ("g", 200, 2)


def test_small_profile(spark):
    built = profile(result(spark, [([F1, G1], 2, 30), ([G1], 1, None), ([], 4, 5), ([G1], 1, None)]))
    names = {r.string_id: r.value for r in built.strings.collect()}
    assert [names[i] for i in range(6)] == ["", "samples", "count", "sampled_cpu", "ns", "process"]
    assert sorted(names) == list(range(9)) and {"f", "g", "cost_ns"} < set(names.values())
    functions = {r.function_id: names[r.name_id] for r in built.functions.collect()}
    assert sorted(functions) == [1, 2]
    by_name = {v: k for k, v in functions.items()}
    got = sorted((r.location_ids, r["count"], r.value) for r in built.samples.collect())
    f, g = by_name["f"], by_name["g"]
    assert got == sorted([([f, g], 2, 30), ([g], 1, 0), ([g], 1, 0), ([], 4, 5)])
    header = built.header.first()
    assert (names[header.count_type], names[header.value_type], header.duration_nanos) == ("count", "cost_ns", 35)
    assert {r.location_id: r.address for r in built.locations.collect()} == {f: 101, g: 202}


def test_offset_names(spark):
    built = profile(result(spark, [([("f", 100, 17), ("f", 100, 255)], 1, 1)]), with_offset=True)
    assert {"f-11", "f-ff"} < {r.value for r in built.strings.collect()}


def test_inlined_lines(spark):
    lines = spark.createDataFrame(
        [(100, 150, "a.rs", 7, 3, [("inner", "b.rs", 1, 2), ("outer", "c.rs", 4, 5)])], LINE_SCHEMA
    )
    rows = result(spark, [([F1, G1], 1, 1)])
    for inlined, want in ((False, ["f"]), (True, ["outer", "inner", "f"])):
        built = profile(rows, lines=lines, inlined=inlined)
        names = {r.string_id: r.value for r in built.strings.collect()}
        functions = {r.function_id: (names[r.name_id], names[r.file_id]) for r in built.functions.collect()}
        found = {r.address: [functions[x.function_id] + (x.line, x.col) for x in r.lines] for r in built.locations.collect()}
        assert [x[0] for x in found[101]] == want
        assert found[101][-1] == ("f", "a.rs", 7, 3)
        assert found[202] == [("g", "", 0, 0)]


def test_every_id_resolves_and_values_add_up(spark):
    cpu = by_stack.cpu_time(derived.events(spark, SF))
    for options in ({}, {"with_offset": True}, {"lines": derived.lines(spark, SF), "inlined": True}):
        built = profile(cpu, **options)
        used = built.samples.select(F.explode("location_ids").alias("location_id"))
        assert used.join(built.locations, "location_id", "left_anti").count() == 0
        lines = built.locations.select(F.explode("lines").alias("l")).select("l.function_id")
        assert lines.join(built.functions, "function_id", "left_anti").count() == 0
        strings = built.strings.select(F.col("string_id").alias("name_id"))
        assert built.functions.join(strings, "name_id", "left_anti").count() == 0
        total = built.samples.agg(F.sum("value")).first()[0]
        assert built.header.first().duration_nanos == total == cpu.agg(F.sum("sampled_duration")).first()[0]


def test_empty_result_is_an_error(spark):
    built = profile(result(spark, []))
    with pytest.raises(Exception, match="empty result"):
        built.header.collect()


def fields(data):
    """(field, value) of a message."""
    at, out = 0, []

    def read():
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = read()
        if tag & 7 == 0:
            out.append((tag >> 3, read()))
        else:
            size = read()
            out.append((tag >> 3, data[at : at + size]))
            at += size
    return out


def packed(data):
    return [v for _, v in fields(b"".join(b"\x08" + varint(x) for x in _varints(data)))]


def _varints(data):
    value = shift = 0
    for byte in data:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            yield value
            value = shift = 0


def test_encoded_profile(spark, tmp_path):
    built = profile(by_stack.cpu_time(derived.events(spark, SF), buildid="01"))
    sinks.write_profile(built, f"{tmp_path}/p", chunks=True)
    chunks = spark.read.parquet(f"{tmp_path}/p/chunks").orderBy("section", "part").collect()
    message = fields(b"".join(bytes(c.data) for c in chunks))
    strings = [v.decode() for f, v in message if f == 6]
    assert strings == [r.value for r in built.strings.orderBy("string_id").collect()]
    samples = [dict(fields(v)) for f, v in message if f == 2]
    got = sorted((packed(s.get(1, b"")), *packed(s[2])) for s in samples)
    assert got == sorted((list(r.location_ids), r["count"], r.value) for r in built.samples.collect())
    functions = {dict(fields(v))[1]: strings[dict(fields(v))[2]] for f, v in message if f == 5}
    locations = [dict(fields(v)) for f, v in message if f == 4]
    assert {dict(fields(x[4]))[1] for x in locations} == set(functions)
    assert [v for f, v in message if f == 10] == [built.header.first().duration_nanos]
    titles = [strings[dict(fields(v))[1]] for f, v in message if f == 1]
    assert titles == ["count", "sampled_duration"]


def test_string_chunks_are_bounded_and_in_order(spark):
    built = profile(by_stack.cpu_time(derived.events(spark, SF)), with_offset=True)
    chunks = profile_chunks(built, rows_per_chunk=7).where("section = 5").orderBy("part").collect()
    assert len(chunks) > 5
    values = [v.decode() for _, v in fields(b"".join(bytes(c.data) for c in chunks))]
    assert values == [r.value for r in built.strings.orderBy("string_id").collect()]


def timeline(spark, *paths_of):
    rows = [("complete", f"n{i}", i, [(n, 0, 0) for n in s]) for i, s in enumerate(paths_of)]
    return spark.createDataFrame(rows, f"event string, name string, pid long, stack {STACK}")


def test_frame_tree(spark):
    built = trace([timeline(spark, "ab", "ac", "")])
    nodes = {r.id: (r.parent, r.name) for r in built.frames.collect()}
    assert len(nodes) == 3

    def path(node):
        parent, name = nodes[node]
        return (path(parent) if parent else "") + name

    assert {r.name: r.sf and path(r.sf) for r in built.events.collect()} == {"n0": "ab", "n1": "ac", "n2": None}
    outer = trace([timeline(spark, "ab", "cb")], outermost_root=True)
    assert sorted(r.name for r in outer.frames.where("parent is null").collect()) == ["b"]


def test_trace_json(spark, tmp_path):
    events = derived.events(spark, SF)
    built = trace([tracks.switch_slices(events), tracks.rss_track(events)])
    sinks.write_trace(built, f"{tmp_path}/t")
    rows = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/t/traceEvents").collect()]
    nodes = {json.loads(r.value)["id"] for r in spark.read.text(f"{tmp_path}/t/stackFrames").collect()}
    complete = [r for r in rows if r["ph"] == "X"]
    counters = [r for r in rows if r["ph"] == "C"]
    assert len(complete) + len(counters) == len(rows) and complete and counters
    assert all({"name", "cat", "ts", "dur", "tid", "pid", "args"} <= set(r) for r in complete)
    assert all(r["esf"] in nodes for r in complete if "esf" in r)
    assert all("sf" not in r and "id" not in r and set(r["args"]) == {"cpu"} for r in complete)
    assert all(r["id"] == "rss" and set(r["args"]) == {"amount"} and "dur" not in r for r in counters)
    header = spark.read.json(f"{tmp_path}/t/header").first()
    assert header.displayTimeUnit == "ns" and header.empty is False


def test_trace_of_nothing(spark):
    built = trace([timeline(spark, "a").limit(0)])
    assert built.header.first().empty is True and built.events.count() == 0 and built.frames.count() == 0


def test_trace_contract(spark):
    good = timeline(spark, "a")
    for column in ("event", "name", "pid"):
        with pytest.raises(ValueError, match=column):
            trace([good.drop(column)])
    with pytest.raises(ValueError, match="start"):
        trace([good.withColumn("start", F.lit("x"))])
    with pytest.raises(Exception, match="neither complete nor counter: other"):
        trace([good.withColumn("event", F.lit("other"))]).events.collect()
    with pytest.raises(Exception, match="a row has no event"):
        trace([good.withColumn("event", F.lit(None).cast("string"))]).events.collect()


def test_missing_columns_count_as_zero(spark):
    row = trace([timeline(spark, "a").drop("stack")]).events.first()
    assert (row.ts, row.dur, row.tid, row.sf, row.cat) == (0, 0, 0, None, "command=n0")


def joined(path):
    return b"".join((path / n).read_bytes() for n in (path / "manifest").read_text().split())


def test_one_trace_document(spark, tmp_path):
    """Files joined in the order of their names are one JSON document, whatever the number of tasks."""
    events = derived.events(spark, SF)
    built = trace([tracks.switch_slices(events, sort=False), tracks.rss_track(events, sort=False)])
    names = sinks.write_trace_document(built, f"{tmp_path}/t")
    assert names == sorted(names) and len(names) > 4
    document = json.loads(joined(tmp_path / "t"))
    assert set(document) == {"displayTimeUnit", "traceEvents", "stackFrames"} and document["displayTimeUnit"] == "ns"
    want = sorted(json.dumps(json.loads(r.value), sort_keys=True) for r in built.json_rows().collect())
    assert sorted(json.dumps(e, sort_keys=True) for e in document["traceEvents"]) == want
    frames = {r.id: {k: v for k, v in (("parent", r.parent), ("name", r.name)) if v is not None} for r in built.frames.collect()}
    assert document["stackFrames"] == frames and frames
    used = {e[k] for e in document["traceEvents"] for k in ("sf", "esf") if k in e}
    assert used <= set(frames) and all(f["parent"] in frames for f in frames.values() if "parent" in f)
    with pytest.raises(FileExistsError):
        sinks.write_trace_document(built, f"{tmp_path}/t")
    empty = trace([tracks.rss_track(events.where("kind = 'none'"), sort=False)])
    sinks.write_trace_document(empty, f"{tmp_path}/e")
    assert json.loads(joined(tmp_path / "e")) == {"displayTimeUnit": "ns", "traceEvents": None, "stackFrames": {}}


def test_one_profile_message(spark, tmp_path):
    built = profile(by_stack.cpu_time(derived.events(spark, SF), buildid="01"))
    sinks.write_profile_message(built, f"{tmp_path}/p", rows_per_chunk=7)
    found = list(fields(joined(tmp_path / "p")))
    strings = [v.decode() for f, v in found if f == 6]
    assert strings == [r.value for r in built.strings.orderBy("string_id").collect()]
    assert sum(f == 2 for f, _ in found) == built.samples.count() and sum(f == 4 for f, _ in found) == built.locations.count()
    assert sum(f == 5 for f, _ in found) == built.functions.count() and sum(f == 1 for f, _ in found) == 2
    assert {f for f, _ in found} == {1, 2, 4, 5, 6, 10, 2056} and all(not v for f, v in found if f == 2056)
    assert dict(found)[10] == built.header.first().duration_nanos


def test_deep_and_odd_frame_names(spark):
    """127 frames, one step each; names that look like ids or hold separators give nodes of their own."""
    deep = [(f"f{i}", i, 0) for i in range(127)]
    rows = [(deep,), ([("a\u0001b", 1, 0)],), ([("a", 1, 0), ("b", 2, 0)],), ([(None, 1, 0), ("a", 3, 0)],), ([],), (None,)]
    stacks = spark.createDataFrame(rows, f"stack {STACK}")
    events = stacks.selectExpr("'complete' as event", "'x' as name", "1 as pid", "stack")
    built = trace([events])
    frames = {r.id: r for r in built.frames.collect()}
    assert len(frames) == 127 + 1 + 2 and sum(f.parent is None for f in frames.values()) == 3
    leaf = {r.sf for r in built.events.collect()}
    assert len(leaf) == 5 and None in leaf and leaf - {None} <= set(frames)
    at, seen = next(f for f in frames.values() if f.name == "f126"), 0
    while at is not None:
        at, seen = frames.get(at.parent), seen + 1
    assert seen == 127
