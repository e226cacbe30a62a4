"""

Every query reads whole tables. Call paths are rendered as text and build ids as hex, so that both engines compare.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oracle import ORACLE
from profspark.functions.frames import c_string, frame_names, stack_text
from profspark.operators import kernel, process, spans, symbols, telemetry
from profspark.operators.hot import GROUP_ROWS, materialized, shared_dir
from profspark.operators.intervals import EARLIEST
from profspark.operators.ranges import range_lookup
from profspark.plans import by_stack, collect, tracks
from profspark.plans.paths import intern_paths
from profspark.plans.profile import profile
from profspark.plans.profile_bytes import profile_chunks
from profspark.plans.trace import categories, contract_rejects, trace
from profspark.sources import derived, events as source
from profspark.sources.sinks import write_events, write_trace_document
from profspark.streaming import fold, steps

try:
    import corpus_pipeline
    from profspark.llm import queries as corpus
except ModuleNotFoundError as missing:  # the corpus operators are an optional part
    if missing.name not in ("profspark.llm", "corpus_pipeline"):
        raise
    corpus = None

SF_DIR = "/root/testdata/sf0.001"
WHO = {"buildid": "01"}
CMD = {"command": "cmd1"}
BATCHES = 3

Query = Callable[[SparkSession, str], DataFrame]


def _text(stack: str = "ustack") -> Column:
    return stack_text(stack).alias("stack")


def _by_path(analysis, **options) -> Query:
    """A by-stack analysis with its call paths as text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = analysis(derived.events(spark, sf_dir), **options)
        stack, *values = result.columns
        return result.select(_text(stack), *values)

    return run


def _interned(analysis, **options) -> Query:
    """The analysis over events that hold keys of call paths, and their dictionary."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        keyed, paths = intern_paths(derived.events(spark, sf_dir))
        result = analysis(materialized(keyed), paths=materialized(paths), **options)
        stack, *values = result.columns
        return result.select(_text(stack), *values)

    return run


def _track(analysis, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = analysis(derived.events(spark, sf_dir), **options)
        if "end_stack" in result.columns:
            result = result.withColumn("end_stack", stack_text("end_stack"))
        return result

    return run


def _as_long(totals: DataFrame, column: str) -> DataFrame:
    """A small table of totals, its column as the 64-bit number the SQL gives wherever all of them fit into one; exact
    decimals where one does not, where the SQL has no result."""
    totals = materialized(totals)
    if totals.where(F.expr(f"try_cast({column} as bigint)").isNull() & F.col(column).isNotNull()).isEmpty():
        return totals.withColumn(column, F.col(column).cast("bigint"))
    return totals


def _events(transform: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: transform(derived.events(spark, sf_dir))


def _profile(part: str, with_lines: bool = False, **options) -> Query:
    """One table of the CPU profile. Ids are compared through what they stand for, since their order is free."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = by_stack.cpu_time(derived.events(spark, sf_dir), **WHO)
        if with_lines:
            options.update(lines=derived.lines(spark, sf_dir), inlined=True)
        built = profile(result, **options)

        def functions() -> DataFrame:
            text = built.strings.select(F.col("string_id").alias("name_id"), F.col("value").alias("name"))
            files = built.strings.select(F.col("string_id").alias("file_id"), F.col("value").alias("file"))
            return built.functions.join(text, "name_id").join(files, "file_id")

        def named() -> DataFrame:
            lines = built.locations.select("location_id", "address", F.posexplode("lines").alias("pos", "l")).select(
                "location_id", "address", "pos", "l.*"
            )
            return lines.join(functions().select("function_id", "name", "file"), "function_id")

        if part == "functions":
            # Ids must be dense: the comparison sees their range beside the names.
            count = built.functions.agg(F.max("function_id") - F.min("function_id") + 1).scalar()
            return functions().select("name", "file", count.alias("id_range"))
        if part == "locations":
            return named().select("address", F.col("pos").cast("int").alias("pos"), "name", "file", "line", "col")
        if part == "samples":
            located = built.samples.withColumn("sample", F.monotonically_increasing_id())
            rows = located.select("sample", "count", "value", F.posexplode_outer("location_ids").alias("pos", "location_id"))
            own = named().groupBy("location_id").agg(F.max_by(F.struct("name", "address"), "pos").alias("last"))
            rows = rows.join(own, "location_id", "left")
            path = F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.when(F.col("last").isNotNull(), F.struct("pos", "last")))),
                    lambda f: F.concat_ws("@", f["last"]["name"], f["last"]["address"].cast("string")),
                ),
                ";",
            )
            return rows.groupBy("sample", "count", "value").agg(path.alias("path")).drop("sample")
        if part == "strings":
            count = built.strings.agg(F.max("string_id") + 1).scalar()
            preset = F.when(F.col("string_id") < 6, F.col("string_id")).otherwise(-1).cast("bigint")
            return built.strings.select("value", preset.alias("preset_id"), count.alias("size"))
        titles = built.strings.select("string_id", "value")
        return (
            built.header.join(titles.toDF("count_type", "count_title"), "count_type")
            .join(titles.toDF("value_type", "value_title"), "value_type")
            .select("count_title", "value_title", "duration_nanos")
        )

    return run


def _trace(spark: SparkSession, sf_dir: str):
    events = derived.events(spark, sf_dir)
    return trace([f(events, sort=False) for f in (tracks.switch_slices, tracks.rss_track, tracks.span_slices)])


def _trace_rows(phase: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _trace(spark, sf_dir).events.where(F.col("ph") == phase)
        return rows.select(
            "name", "id", "cat", "ts", "dur", "tid", "pid", "esf", F.col("args.amount").alias("amount"), F.col("args.cpu").alias("cpu")
        )

    return run


def _trace_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _trace(spark, sf_dir).json_rows()
    return rows.groupBy(F.get_json_object("value", "$.ph").alias("ph")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.get_json_object("value", "$.esf")).alias("with_stack"),
        F.sum(F.get_json_object("value", "$.args.cpu").cast("bigint")).alias("cpu_sum"),
        F.sum(F.get_json_object("value", "$.args.amount").cast("bigint")).alias("amount_sum"),
    )


def _raw(transform: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: transform(derived.raw(spark, sf_dir))


def _span_state(spark: SparkSession, sf_dir: str) -> spans.SpanState:
    return spans.SpanState(process.with_epoch(derived.raw(spark, sf_dir)))


SPAN_COLUMNS = ["seq", "tgid", "pid", "span_id", "duration", "parent_id", "id", "amount", "name"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _span_state(spark, sf_dir).others.where(F.col("type").isin(collect.PLAIN))
    return rows.select("seq", F.col("top").alias("open_span"), F.col("entry.id").alias("id"), F.col("entry.name").alias("name"))


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = process.attribute(process.with_epoch(derived.raw(spark, sf_dir)))
    return rows.select("seq", "epoch", "command", F.lower(F.hex("exe_buildid")).alias("buildid"))


def _after_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribution where each loss of events is followed by a list of what still runs."""
    raw = process.with_running(derived.raw(spark, sf_dir), derived.running(spark, sf_dir))
    rows = process.attribute(process.with_epoch(raw)).where(~F.col("type").isin("process_exec", "reset"))
    return rows.select("seq", "epoch", "command", F.lower(F.hex("exe_buildid")).alias("buildid"))


def _two_runs(analysis):
    """The analysis over the events as if they came from two runs."""
    return lambda events, **options: analysis(events.withColumn("run", F.col("cpu") % 2), **options)


def _raw_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw events as if they came from two runs with the same process ids, each with its own resets."""
    raw = derived.raw(spark, sf_dir).withColumn("run", F.expr("seq div 16 % 2"))
    return process.with_epoch(raw, ("run",))


def _run_state(spark: SparkSession, sf_dir: str) -> spans.SpanState:
    return spans.SpanState(_raw_runs(spark, sf_dir))


def _collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _ = collect.collect_events(
        derived.raw(spark, sf_dir), derived.stackmap(spark, sf_dir), derived.symbols(spark, sf_dir)
    )
    return _shown(events)


def _shown(events: DataFrame, *more: str) -> DataFrame:
    return events.select(
        *more, "timestamp", "duration", "kind", "cpu", "tgid", "pid", "span_id", "parent_id", "id", "amount", "command", "trace_name",
        F.lower(F.hex("buildid")).alias("buildid"),
        stack_text("ustack").alias("ustack"),
        stack_text("kstack").alias("kstack"),
    )


def _rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.reject_counts(collect.rejects(collect.annotate(derived.raw(spark, sf_dir))))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.raw(spark, sf_dir).where(F.col("ustack_id").isNotNull())
    resolved = symbols.resolved_call_paths(rows, derived.stackmap(spark, sf_dir), derived.symbols(spark, sf_dir))
    return resolved.select("scope", "stack_id", stack_text("stack").alias("stack"))


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = symbols.used_call_paths(derived.raw(spark, sf_dir))
    return symbols.stack_addresses(used, derived.stackmap(spark, sf_dir))


def _symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = symbols.resolve_addresses(_addresses(spark, sf_dir), derived.symbols(spark, sf_dir))
    return found.select(
        "scope", "address", F.col("frame.name").alias("name"), F.col("frame.address").alias("start"), F.col("frame.offset").alias("off")
    )


def _symbol_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each address in the symbol table that its process had when the event arrived."""
    tables = derived.symbol_versions(spark, sf_dir)
    used = symbols.used_call_paths(symbols.with_version(derived.raw(spark, sf_dir), tables))
    found = symbols.resolve_addresses(symbols.stack_addresses(used, derived.stackmap(spark, sf_dir)), tables)
    since = F.when(F.col("version") != EARLIEST, F.col("version")).alias("since")
    return found.select("scope", since, "address", F.col("frame.name").alias("name"), F.col("frame.address").alias("start"), F.col("frame.offset").alias("off"))


def _collected_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs with the same process and stack ids, each with its own symbols, call paths and resets."""
    run = lambda rows, k: rows.withColumn("run", F.lit(k).cast("bigint"))
    raw = derived.raw(spark, sf_dir).withColumn("run", F.expr("seq div 16 % 2"))
    paths, names = derived.stackmap(spark, sf_dir), derived.symbols(spark, sf_dir)
    moved = paths.withColumn("frames", F.transform("frames", lambda f: F.when(f != 0, f + 1).otherwise(f)))
    names = [run(names.withColumn("name", F.concat("name", F.lit(f"_r{k}"))), k) for k in (0, 1)]
    events, _ = collect.collect_events(raw, run(paths, 0).unionByName(run(moved, 1)), names[0].unionByName(names[1]), scope=("run",))
    return _shown(events, "run")


def _wide_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = range_lookup(derived.wide_points(spark, sf_dir), derived.wide_ranges(spark, sf_dir), ["grp"], "addr", ["id"])
    return found.select("grp", "addr", "id")


def _sql_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = """
        select kind, count(*) as count, cast(sum(amount) as bigint) as amount
        from events
        where command = '?command' and buildid = decode('?buildid', 'hex')
        group by kind
    """
    return source.run_sql(derived.events(spark, sf_dir), query, command="cmd1", buildid="01")


def _query_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = derived.events(spark, sf_dir)
    rows = source.concat_results([tracks.rss_track(events), tracks.slow_spans(events, 100_000)])
    return rows.select("event", "kind", "name", "timestamp", "start", "duration", "pid", "tid", "amount", "cpu")


def _runs(events: DataFrame) -> DataFrame:
    """A run of the capture per kind of command, the highest of which is kept."""
    runs = events.withColumn("run", F.substring("command", 4, 1).cast("int"))
    return source.latest_run(runs).select("run", "timestamp", "kind", "pid")


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.counter_deltas(derived.program_counters(spark, sf_dir))


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = telemetry.program_rates(_deltas(spark, sf_dir))
    return rates.select("snapshot_ts", "program", "busy_percent", "collected_latency_ns")


def _stream(name: str, step, *columns: str) -> Query:
    """A fold over a derived table, read as a stream of several batches so that state is carried between them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        rows = source.replay_stream(getattr(derived, name)(spark, sf_dir), "seq", f"{path}/in", BATCHES)
        fold.start(rows, step, path).awaitTermination()
        out = fold.read_output(spark, path)
        return out.select(*columns) if columns else out.drop("batch")

    return run


def _string_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = profile(by_stack.cpu_time(derived.events(spark, sf_dir), **WHO))
    strings = profile_chunks(built).where("section = 5")
    return strings.agg(F.sum(F.length("data")).alias("bytes"))


def _message_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each section of the encoded message."""
    chunks = profile_chunks(profile(by_stack.cpu_time(derived.events(spark, sf_dir), **WHO)))
    return chunks.groupBy("section").agg(F.sum(F.length("data")).alias("bytes"))


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _trace_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a written document, read back."""
    path = _fresh(spark, "document")
    write_trace_document(_trace(spark, sf_dir), path)
    text = spark.read.text(f"{path}/part-01-*").select(F.regexp_replace("value", "^,", "").alias("value"))
    schema = "ph string, name string, id string, cat string, ts long, dur long, tid long, pid long, esf string, args struct<amount: long, cpu: long>"
    return text.select(F.from_json("value", schema).alias("r")).select("r.*").select("*", "args.*").drop("args")


def _empty_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = derived.events(spark, sf_dir).where("kind = 'no such kind'")
    return trace([tracks.switch_slices(none, sort=False), tracks.rss_track(none, sort=False)]).header


def _contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks.switch_slices(derived.events(spark, sf_dir), sort=False)
    event = F.when(F.col("cpu") == 3, "other").when(F.col("pid") % 7 != 0, "complete")
    broken = rows.withColumns({"event": event, "name": F.when(F.col("pid") % 11 != 0, F.col("name"))})
    return contract_rejects(broken).select("event", "name", "pid", "start", "reason")


def _unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other span id as an unsigned number beyond the signed ones."""
    wide = F.col("span_id").cast("decimal(20,0)") + F.when(F.col("id") % 2 == 0, F.lit(str(1 << 63)).cast("decimal(20,0)")).otherwise(0)
    return source.normalise(derived.events(spark, sf_dir).withColumn("span_id", wide.cast("decimal(20,0)"))).select("id", "span_id")


def _capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two numbered runs, of which the latest is read, and in it all files but the unfinished one."""
    base, events = _fresh(spark, "capture"), derived.events(spark, sf_dir)
    write_events(events.where("cpu < 2"), f"{base}/3")
    write_events(events.where("cpu >= 2"), f"{base}/12")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path(f"{base}/12/PENDING.parquet"), False)
    out.write(b"not finished")
    out.close()
    return source.load_events(spark, source.latest_run_path(spark, base)).select("id", "timestamp", "kind")


def _roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "events")
    write_events(derived.events(spark, sf_dir), path, rows_per_file=1000)
    return source.load_events(spark, path).select("id", "timestamp", "duration", "kind", "amount", _text())


def _span_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    enters = _span_state(spark, sf_dir).parents.withColumn("explicit", F.when(F.col("parent_id") != 0, F.col("parent_id")))
    return enters.select("seq", kernel.span_parent("explicit", "enclosing").alias("parent"))


def _hot(query: Query, rows: int = 50) -> Query:
    """A query as it runs where keys of more than ``rows`` rows are hot: on large inputs, but for the number."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = spark.conf.get(GROUP_ROWS, None)
        spark.conf.set(GROUP_ROWS, str(rows))
        try:
            return query(spark, sf_dir)
        finally:
            if before is None:
                spark.conf.unset(GROUP_ROWS)
            else:
                spark.conf.set(GROUP_ROWS, before)

    return run


def queries() -> dict[str, Query]:
    seconds = 1_000_000_000
    slice_start, slice_end = 1_704_153_600 * seconds, 1_704_240_000 * seconds + 500_000_000
    return {
        # Analyses by call path
        "cpu_by_stack": _by_path(by_stack.cpu_time, **WHO),
        "cpu_by_stack_command": _by_path(by_stack.cpu_time, **CMD),
        "blk_bytes": _by_path(by_stack.block_bytes, **WHO),
        "blk_latency": _by_path(by_stack.block_latency, **WHO),
        "tcp_bytes": _by_path(by_stack.tcp_bandwidth, **WHO),
        "udp_bytes": _by_path(by_stack.udp_bandwidth, **WHO),
        "vfs_read_bytes": _by_path(by_stack.file_read_bytes, **WHO),
        "vfs_read_bytes_command": _by_path(by_stack.file_read_bytes, **CMD),
        "vfs_write_bytes": _by_path(by_stack.file_write_bytes, **WHO),
        "vfs_write_bytes_command": _by_path(by_stack.file_write_bytes, **CMD),
        "offcpu": _by_path(by_stack.off_cpu, **WHO),
        "offcpu_command": _by_path(by_stack.off_cpu, **CMD),
        "offcpu_all_frames": _by_path(by_stack.off_cpu, dedup=False, **WHO),
        "rss_growth": _by_path(by_stack.rss_growth, **WHO),
        "rss_growth_command": _by_path(by_stack.rss_growth, **CMD),
        "span_wait": _by_path(by_stack.span_wait),
        "span_wait_clamped": _by_path(by_stack.span_wait, clamp_negative=True, span_keys=("tgid", "span_id")),
        "cpu_by_stack_interned": _interned(by_stack.cpu_time, **WHO),
        "offcpu_interned": _interned(by_stack.off_cpu, **WHO),
        "rss_growth_interned": _interned(by_stack.rss_growth, **CMD),
        "span_wait_interned": _interned(by_stack.span_wait),
        # Timelines and reports
        "rss_track": _track(tracks.rss_track),
        "switch_slices": _track(tracks.switch_slices),
        "span_slices": _track(tracks.span_slices),
        "span_slices_us": _track(tracks.span_slices, start_unit="us"),
        "slow_spans": _track(tracks.slow_spans, threshold_ns=2_000_000),
        "parked_spans": _track(tracks.parked_spans),
        "io_totals": _events(tracks.io_totals),
        "peak_rss": _events(tracks.peak_rss),
        "offcpu_by_kernel_fn": _events(lambda e: _as_long(tracks.off_cpu_in_kernel(e, ["k_1", "k_3"], "cmd1"), "offcpu_ns")),
        "time_slice": _events(
            lambda e: source.time_slice(e, slice_start, slice_end).groupBy("kind").agg(F.count(F.lit(1)).alias("count"))
        ),
        "latest_run": _events(_runs),
        "capture_scan": _capture,
        "events_roundtrip": _roundtrip,
        "unsigned_scan": _unsigned,
        "user_sql": _sql_source,
        "query_list": _query_list,
        "frame_offset_names": _events(
            lambda e: e.select("id", F.array_join(frame_names("ustack", with_offset=True), ";").alias("names"))
        ),
        # Profile export
        "profile_functions": _profile("functions"),
        "profile_locations": _profile("locations"),
        "profile_strings": _profile("strings"),
        "profile_samples": _profile("samples"),
        "profile_header": _profile("header"),
        "profile_offset_functions": _profile("functions", with_offset=True),
        "profile_string_bytes": _string_bytes,
        "profile_message_bytes": _message_bytes,
        "profile_line_locations": _profile("locations", with_lines=True),
        "profile_line_functions": _profile("functions", with_lines=True),
        "profile_line_samples": _profile("samples", with_lines=True),
        # Trace export
        "trace_complete": _trace_rows("X"),
        "trace_counter": _trace_rows("C"),
        "trace_categories": _events(
            lambda e: tracks.switch_slices(e).select(categories(["name", "cpu"]).alias("cat")).groupBy("cat").agg(F.count(F.lit(1)).alias("count"))
        ),
        "trace_frames": lambda spark, sf_dir: _trace(spark, sf_dir).frames,
        "trace_json": _trace_json,
        "trace_document": _trace_document,
        "empty_trace": _empty_trace,
        "contract_rejects": _contract,
        "trace_header": lambda spark, sf_dir: _trace(spark, sf_dir).header,
        # From kernel observations to raw events
        "switch_pairing": lambda spark, d: kernel.pair_switches(derived.switches(spark, d), 1500).select(
            "seq", "cpu", "start", "ts", "tgid", "pid"
        ),
        "block_pairing": lambda spark, d: kernel.pair_block_io(derived.block_requests(spark, d)),
        "rss_throttle": lambda spark, d: kernel.rss_events(derived.rss_counters(spark, d), 29).select(
            "seq", "tgid", "pid", "amount"
        ),
        "rss_bytes": lambda spark, d: kernel.rss_events(derived.rss_counters(spark, d), 0, clamp=False).select(
            "seq", (F.col("amount") * 4096).alias("bytes")
        ),
        "file_events": lambda spark, d: kernel.file_events(derived.calls(spark, d).where("type = 'vfs'")).select(
            "seq", "tgid", "pid", "rw", "amount"
        ),
        "net_events": lambda spark, d: kernel.net_events(derived.calls(spark, d).where("type != 'vfs'")).select(
            "seq", "type", "tgid", "pid", "amount"
        ),
        "process_filter": _raw(lambda r: kernel.keep_tracked(r.withColumn("pid", F.when(F.col("type").isin("process_exec", "process_exit"), F.col("tgid")).otherwise(F.col("pid"))), ["cmd1"]).select("seq", "type")),
        "stack_selection": _raw(
            lambda r: kernel.select_call_paths(r, {"sample": "u", "switch": "uk", "rss": "k", "block": "n"})
            .groupBy("type")
            .agg(F.sum(F.when(F.col("ustack_id") >= 0, 1).otherwise(0)).alias("user"), F.sum(F.when(F.col("kstack_id") >= 0, 1).otherwise(0)).alias("kernel"))
        ),
        "kernel_frame_trim": lambda spark, d: derived.stackmap(spark, d).select(
            "stack_id", F.array_join(kernel.trim_probe_frames(F.col("frames")).cast("array<string>"), ";").alias("frames")
        ),
        "clock_alignment": _raw(lambda r: kernel.align_clock(r, 1_700_000_000 * seconds).select("seq", "ts", "start")),
        "idle_samples": lambda spark, d: kernel.drop_idle(derived.switches(spark, d)).select("seq", "pid"),
        "span_names": lambda spark, d: derived.named_buffers(spark, d).select("c_custkey", c_string("buffer").alias("name")),
        # Enrichment
        "process_attribution": _attributed,
        "attribution_after_reset": _after_reset,
        "span_exit": lambda spark, d: spans.span_exits(_span_state(spark, d).exits).select(*SPAN_COLUMNS),
        "span_close": lambda spark, d: spans.span_closes(_span_state(spark, d).closes).select(*SPAN_COLUMNS),
        "open_span_label": _labels,
        "span_parents": _span_parents,
        "stack_resolution": _resolved,
        "symbol_lookup": _symbol_lookup,
        "symbol_lookup_versions": _symbol_versions,
        "range_lookup_wide": _wide_ranges,
        "sample_filter": _raw(lambda r: r.where((F.col("type") == "sample") & collect.has_stack()).select("seq")),
        "event_kinds": _raw(
            lambda r: r.where(F.col("type").isin(collect.PLAIN)).groupBy(collect.event_kind().alias("kind")).agg(F.count(F.lit(1)).alias("count"))
        ),
        "collected_events": _collected,
        "rejects": _rejects,
        "unknown_types": _raw(
            lambda r: source.split_unknown(r.withColumn("type", F.when(F.col("cpu") == 3, "other").otherwise(F.col("type"))))[1].select("seq", "reason")
        ),
        # Streaming forms
        "stream_switch_pairing": _stream("switches", steps.switch_step(1500), "seq", "cpu", "start", "ts", "tgid", "pid"),
        "stream_block_pairing": _stream("block_requests", steps.block_step()),
        "stream_rss_throttle": _stream("rss_counters", steps.throttle_step(29), "seq", "tgid", "pid"),
        "stream_events": _stream(
            "raw",
            steps.collect_step(),
            "seq", "timestamp", "duration", "kind", "cpu", "tgid", "pid", "span_id", "parent_id", "id", "amount", "command", "trace_name",
            "ustack_id", "kstack_id",
        ),
        "stream_process_filter": _stream("raw_leaders", steps.tracked_step(["cmd1"]), "seq", "type"),
        "stream_rejects": lambda spark, d: collect.reject_counts(_stream("raw", steps.collect_step(report=True))(spark, d)),
        # Several runs, whose process and thread ids are the same
        "offcpu_runs": _by_path(_two_runs(by_stack.off_cpu), scope=("run",), **WHO),
        "rss_growth_runs": _by_path(_two_runs(by_stack.rss_growth), scope=("run",), **WHO),
        "span_exit_runs": lambda spark, d: spans.span_exits(_run_state(spark, d).exits).select(*SPAN_COLUMNS),
        "attribution_runs": lambda spark, d: process.attribute(_raw_runs(spark, d)).select(
            "seq", "command", F.lower(F.hex("exe_buildid")).alias("buildid")
        ),
        "collected_events_runs": _collected_runs,
        # The same with hot keys
        "hot_offcpu": _hot(_by_path(by_stack.off_cpu, **WHO)),
        "hot_rss_growth": _hot(_by_path(by_stack.rss_growth, **WHO)),
        "hot_span_exit": _hot(lambda spark, d: spans.span_exits(_span_state(spark, d).exits).select(*SPAN_COLUMNS)),
        "hot_collected_events": _hot(_collected),
        # Telemetry
        "missing_call_paths": _raw(tracks.missing_call_paths),
        "program_events": _raw(telemetry.events_per_program),
        "counter_delta": _deltas,
        "program_rates": _rates,
        "program_rollup": lambda spark, d: telemetry.program_rollup(derived.probe_counters(spark, d)),
        "dropped_totals": lambda spark, d: telemetry.counter_totals(derived.cpu_errors(spark, d)),
        "reset_markers": lambda spark, d: telemetry.reset_markers(telemetry.counter_totals(derived.cpu_errors(spark, d))),
        "program_json": lambda spark, d: telemetry.program_list(derived.program_lists(spark, d), "cmd0"),
        **({**corpus.QUERIES, "pipeline": corpus_pipeline.run} if corpus else {}),
    }


def oracle_sql() -> dict[str, str]:
    oracles = {**ORACLE, **(corpus.ORACLES if corpus else {})}
    if corpus and corpus_pipeline.ORACLE_SQL:
        oracles["pipeline"] = corpus_pipeline.ORACLE_SQL
    return oracles


def entry(spark: SparkSession) -> DataFrame:
    """CPU time by call path of one executable."""
    return queries()["cpu_by_stack"](spark, SF_DIR)
