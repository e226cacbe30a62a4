"""DuckDB counterparts of the queries, written against the same test tables.

They restate each operator in plain SQL, by joins, as-of joins and, for the open-span lists, a recursive query that
steps through every thread's rows one by one.
"""

from __future__ import annotations

from profspark.schema import KINDS
from profspark.sources.derived import PLAIN_TYPES

# Named sub-queries, in order of dependency.
PARTS: dict[str, str] = {}
# What a sub-query or query needs before it.
NEEDS: dict[str, list[str]] = {}
ORACLE: dict[str, str] = {}


def _part(name: str, sql: str, *needs: str) -> None:
    PARTS[name] = sql
    NEEDS[name] = list(needs)


def _query(name: str, sql: str, *needs: str) -> None:
    wanted: list[str] = []

    def visit(part: str) -> None:
        for need in NEEDS[part]:
            visit(need)
        if part not in wanted:
            wanted.append(part)

    for need in needs:
        visit(need)
    body = ", ".join(f"{p} as ({PARTS[p]})" for p in wanted)
    sql = sql.strip()
    if wanted and sql.startswith("with "):
        body, sql = f"{body}, {sql[5:]}", ""
    ORACLE[name] = f"with recursive {body} {sql}" if wanted else sql


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def text(stack: str) -> str:
    frames = f"""list_transform({stack}, lambda f: concat(f.name, ':', f.address, ':', f."offset"))"""
    return f"coalesce(array_to_string({frames}, ';'), '')"


def union_of(a: str, b: str) -> str:
    both = f"list_concat({a}, {b})"
    return f"list_filter({both}, lambda f, i: list_position({both}, f) = i)"


def path_id(names: str) -> str:
    return f"list_reduce(list_prepend('{'0' * 32}', {names}), lambda parent, name: left(sha256(concat(parent, name)), 32))"


# ---------------------------------------------------------------- derived tables

_part(
    "ev",
    f"""
    select epoch_us(ts) * 1000 as "timestamp", cast(floor(value * 100) as bigint) * 1000 as duration,
           ({_list(KINDS)})[event_id % 13 + 1] as kind, cast(event_id % 4 as int) as cpu, user_id % 8 as tgid,
           user_id as pid, user_id % 32 as span_id, event_id as id, cast(floor(value * 100) as bigint) * 4096 as amount,
           concat('cmd', user_id % 3) as command, concat('span', user_id % 5) as trace_name,
           concat('0', user_id % 3) as buildid,
           list_transform(([0, 1, 2, 3])[1:event_id % 5], lambda i: struct_pack(
               name := concat('fn_', (event_id * 7 + i * 3) % 11), address := (event_id % 11) * 4096 + i,
               "offset" := cast(i as bigint))) as ustack,
           list_transform(([0, 1, 2])[1:event_id % 3], lambda i: struct_pack(
               name := concat('k_', (event_id + i) % 4), address := (event_id + i) % 4,
               "offset" := cast(0 as bigint))) as kstack
    from events
    """,
)
_part(
    "raw",
    f"""
    with s as (
        select o_orderkey as k, o_custkey as c, o_totalprice, cast(step as int) as s
        from (select *, unnest(range(13)) as step from orders)
    ),
    kept as (
        select *, (k + s * 7) * 16 + s as seq, s in (0, 2, 4, 6, 7, 8, 9) as is_span, s in (2, 4) as is_b from s
        where not (s = 0 and k % 17 = 0) and not (s = 4 and k % 11 = 0) and not (s = 9 and k % 13 = 0)
          and not (s = 10 and k % 50 <> 0) and not (s = 11 and k % 997 <> 0) and not (s = 12 and k % 4999 <> 4998)
    )
    select seq,
           case when s in (0, 2, 7) then 'trace_enter' when s in (4, 6, 8) then 'trace_exit' when s = 9 then 'trace_close'
                when s = 10 then 'process_exec' when s = 11 then 'process_exit' when s = 12 then 'reset'
                else ({_list(PLAIN_TYPES)})[(k + s) % 9 + 1] end as type,
           seq * 1000 as ts, seq * 1000 - (k % 1000 + 1) * 100 as start, c % 64 as tgid,
           case when s in (7, 8) and k % 5 = 0 then c + 64 else c end as pid, cast(k % 4 as int) as cpu,
           case when is_span then k * 2 + case when is_b then 2 else 1 end end as span_id,
           case when is_span then case when is_b then k * 2 + 1 else 0 end end as parent_id,
           case when is_span then k end as id, cast(floor(o_totalprice) as bigint) + s as amount,
           cast(k % 2 as int) as rw,
           case when is_span then concat(case when is_b then 'inner' else 'outer' end, k % 5) end as name,
           case when s = 10 then concat('cmd', (k // 50) % 3) end as comm,
           case when s = 10 then concat('0', k % 9) end as buildid,
           cast(case when k % 10 = 0 then -1 when k % 10 = 1 then -14 else c end as int) as ustack_id,
           cast(case when k % 3 = 0 then -1 else k % 7 end as int) as kstack_id
    from kept
    """,
)
_part("rawe", "select raw.*, count(*) filter (type = 'reset') over (order by seq) as epoch from raw", "raw")
_part(
    "stackmap",
    """
    select cast(c_custkey as int) as stack_id,
           list_concat(list_transform(range(c_custkey % 6 + 3), lambda i: (c_custkey * 61 + i * 7919) % 100000 + 1), [0, 0]) as frames
    from customer where c_custkey % 29 <> 0
    """,
)
_part(
    "sym",
    """
    select c_custkey % 65 - 1 as scope, (c_custkey // 65) * 4096 as start, (c_custkey // 65) * 4096 + 4000 as "end",
           concat('sym_', c_custkey % 97) as name
    from customer
    """,
)
_part(
    "lines",
    """
    select p_partkey * 64 as start, p_partkey * 64 + 48 as "end", concat('src/', p_partkey % 37, '.rs') as file,
           p_partkey % 1000 as line, p_partkey % 80 as col,
           list_transform(([0, 1])[1:p_partkey % 3], lambda i: struct_pack(
               name := concat('inl_', (p_partkey + i) % 13), file := concat('inl/', (p_partkey + i) % 13, '.rs'),
               line := p_partkey % 50 + i, col := p_partkey % 7)) as inlined
    from part
    """,
)

# ---------------------------------------------------------------- analyses by call path


def _by_stack(name: str, kinds: list[str], value: str, title: str, who: str) -> None:
    _query(
        name,
        f"""
        select {text("ustack")} as stack, n as count, v as {title} from (
            select ustack, count(*) as n, cast(sum({value}) as bigint) as v from ev
            where list_contains({_list(kinds)}, kind) and {who} group by ustack)
        """,
        "ev",
    )


BUILD, COMMAND = "buildid = '01'", "command = 'cmd1'"
_by_stack("cpu_by_stack", ["profile"], "duration", "sampled_duration", BUILD)
_by_stack("cpu_by_stack_command", ["profile"], "duration", "sampled_duration", COMMAND)
_by_stack("blk_bytes", ["blk_read", "blk_write"], "amount", "bytes", BUILD)
_by_stack("blk_latency", ["blk_read", "blk_write"], "duration", "duration", BUILD)
_by_stack("tcp_bytes", ["tcp_send", "tcp_recv"], "amount", "bandwidth", BUILD)
_by_stack("udp_bytes", ["udp_recv", "udp_send"], "amount", "bandwidth", BUILD)
_by_stack("vfs_read_bytes", ["vfs_read"], "amount", "bytes", BUILD)
_by_stack("vfs_read_bytes_command", ["vfs_read"], "amount", "bytes", COMMAND)
_by_stack("vfs_write_bytes", ["vfs_write"], "amount", "bytes", BUILD)
_by_stack("vfs_write_bytes_command", ["vfs_write"], "amount", "bytes", COMMAND)


def _off_cpu(name: str, who: str, stack: str) -> None:
    _query(
        name,
        f"""
        select {text("stack")} as stack, n as count, v as offcpu_ns from (
            select stack, count(*) as n, cast(sum(gap) as bigint) as v from (
                select {stack} as stack,
                       lead("timestamp" - duration) over (partition by pid order by "timestamp" - duration) - "timestamp" as gap
                from ev where kind = 'switch' and {who} and (len(ustack) > 0 or len(kstack) > 0)
            ) group by stack)
        """,
        "ev",
    )


_off_cpu("offcpu", BUILD, union_of("kstack", "ustack"))
_off_cpu("offcpu_command", COMMAND, union_of("kstack", "ustack"))
_off_cpu("offcpu_all_frames", BUILD, "list_concat(kstack, ustack)")


def _growth(name: str, who: str) -> None:
    _query(
        name,
        f"""
        select {text("ustack")} as stack, n as count, v as total_rss from (
            select ustack, count(*) as n, cast(sum(amount - prev) as bigint) as v from (
                select ustack, amount, lag(amount) over (partition by tgid order by "timestamp") as prev
                from ev where kind = 'rss' and {who}
            ) where amount > prev group by ustack)
        """,
        "ev",
    )


_growth("rss_growth", BUILD)
_growth("rss_growth_command", f"{COMMAND} and len(ustack) > 0")


def _wait(name: str, keys: str, wait: str) -> None:
    _query(
        name,
        f"""
        select {text("ustack")} as stack, n as count, v as wait_ns from (
            select ustack, count(*) as n, cast(sum({wait}) as bigint) as v from (
                select ustack, kind, "timestamp" as parked,
                       coalesce(lead("timestamp" - duration) over (partition by {keys} order by "timestamp", kind desc),
                                (select max("timestamp") from ev)) as resumed
                from ev where kind in ('trace_exit', 'trace_close')
            ) where kind = 'trace_exit' group by ustack)
        """,
        "ev",
    )


_wait("span_wait", "span_id", "resumed - parked")
_wait("span_wait_clamped", "tgid, span_id", "greatest(resumed - parked, 0)")

# ---------------------------------------------------------------- timelines and reports

RSS_TRACK = """
    select 'counter' as event, kind, command as name, "timestamp" // 1000 as "timestamp", tgid as pid, amount
    from ev where kind = 'rss'
"""
SWITCHES = f"""
    select 'complete' as event, ("timestamp" - duration) // 1000 as start, duration // 1000 as duration, tgid as pid,
           pid as tid, command as name, {union_of("kstack", "ustack")} as end_stack, cpu
    from ev where kind = 'switch'
"""


def _spans(where: str, start: str = '"timestamp" - duration // 1000') -> str:
    return f"""
        select 'complete' as event, kind, {start} as start, duration // 1000 as duration, tgid as pid, pid as tid,
               trace_name as name, cpu, ustack as end_stack
        from ev where {where}
    """


EXIT_CLOSE = "kind in ('trace_exit', 'trace_close')"


def _slices(name: str, sql: str) -> None:
    _query(name, f"select * replace ({text('end_stack')} as end_stack) from ({sql})", "ev")


_query("rss_track", RSS_TRACK, "ev")
_slices("switch_slices", SWITCHES)
_slices("span_slices", _spans(EXIT_CLOSE))
_slices("span_slices_us", _spans(EXIT_CLOSE, '("timestamp" - duration) // 1000'))
_slices("slow_spans", _spans("kind = 'trace_exit' and duration > 2000000"))
_slices(
    "parked_spans",
    """
    select 'complete' as event, kind, "timestamp" // 1000 as start,
           ((select max("timestamp") from ev) - "timestamp") // 1000 as duration, tgid as pid, tgid as tid,
           trace_name as name, cpu, ustack as end_stack
    from (select *, lead("timestamp" - duration) over (partition by span_id order by "timestamp", kind desc) as resumed
          from ev where kind in ('trace_exit', 'trace_close'))
    where kind = 'trace_exit' and resumed is null
    """,
)
_query(
    "io_totals",
    """select command, kind, count(*) as total, cast(sum(amount) as bigint) as amount_sum from ev
       where kind in ('blk_write', 'tcp_send', 'tcp_recv') group by command, kind""",
    "ev",
)
_query("peak_rss", "select command, count(*) as total, max(amount) as amount_max from ev where kind = 'rss' group by command", "ev")
_query(
    "offcpu_by_kernel_fn",
    """
    select f as function, count(*) as count, cast(sum(wakeup - "timestamp") as bigint) as offcpu_ns from (
        select *, lead("timestamp" - duration) over (partition by pid order by "timestamp") as wakeup
        from ev where kind = 'switch' and command = 'cmd1'
    ), (select unnest(['k_1', 'k_3']) as f)
    where wakeup is not null and list_contains(list_transform(kstack, lambda x: x.name), f) group by f
    """,
    "ev",
)
_query(
    "time_slice",
    """select kind, count(*) as count from ev
       where "timestamp" >= 1704153600000000000 and "timestamp" < 1704240000500000000 group by kind""",
    "ev",
)
_query(
    "latest_run",
    """with runs as (select cast(substr(command, 4, 1) as int) as run, "timestamp", kind, pid from ev)
       select * from runs where run = (select max(run) from runs)""",
    "ev",
)
_query(
    "user_sql",
    f"select kind, count(*) as count, cast(sum(amount) as bigint) as amount from ev where {BUILD} and {COMMAND} group by kind",
    "ev",
)
_query(
    "query_list",
    f"""
    select event, kind, name, "timestamp", null::bigint as start, null::bigint as duration, pid, null::bigint as tid, amount,
           null::int as cpu from ({RSS_TRACK})
    union all
    select event, kind, name, null, start, duration, pid, tid, null, cpu from ({_spans("kind = 'trace_exit' and duration > 100000")})
    """,
    "ev",
)
_query(
    "frame_offset_names",
    """select id, coalesce(array_to_string(list_transform(ustack, lambda f: concat(f.name, '-', lower(hex(f."offset")))), ';'), '') as names
       from ev""",
    "ev",
)

# ---------------------------------------------------------------- profile export

_part(
    "cpu",
    f"""select ustack as stack, count(*) as n, cast(sum(duration) as bigint) as v from ev
        where kind = 'profile' and {BUILD} group by ustack""",
    "ev",
)
_part("frames", 'select f.name as name, f.address + f."offset" as address, f."offset" as off from (select unnest(stack) as f from cpu)', "cpu")


def _functions(name: str, function: str) -> None:
    _query(
        name,
        f"select distinct {function} as name, '' as file, (select count(distinct {function}) from frames) as id_range from frames",
        "frames",
    )


_functions("profile_functions", "name")
_functions("profile_offset_functions", "concat(name, '-', lower(hex(off)))")
_part("byname", "select name, min(address) as address from frames group by name", "frames")
_query(
    "profile_locations",
    "select address, 0 as pos, name, '' as file, 0::bigint as line, 0::bigint as col from byname",
    "byname",
)


def _samples(name: str, address: str, *needs: str) -> None:
    _query(
        name,
        f"""
        select any_value(n) as count, any_value(v) as value,
               coalesce(string_agg(f.name || '@' || ({address}), ';' order by pos), '') as path
        from (select row_number() over () as sample, * from cpu) s
        left join (select sample, unnest(stack) as f, generate_subscripts(stack, 1) as pos
                   from (select row_number() over () as sample, * from cpu)) using (sample)
        left join byname on byname.name = f.name
        group by sample
        """.replace("row_number() over ()", "row_number() over (order by stack)"),
        *needs,
    )


_samples("profile_samples", "byname.address", "byname")
_samples("profile_line_samples", 'f.address + f."offset"', "byname")
_query(
    "profile_strings",
    """
    with presets as (select unnest(['', 'samples', 'count', 'sampled_cpu', 'ns', 'process']) as value, unnest(range(6)) as id),
    others as (select name as value from frames union select 'sampled_duration'),
    alls as (select value, id as preset_id from presets union all select value, -1 from others)
    select value, preset_id, (select count(*) from alls) as size from alls
    """,
    "frames",
)
# A string takes a tag byte and one length byte (all are shorter than 128) besides its own bytes.
_query(
    "profile_string_bytes",
    """
    select cast(sum(2 + length(value)) as bigint) as bytes from (
        select unnest(['', 'samples', 'count', 'sampled_cpu', 'ns', 'process', 'sampled_duration']) as value
        union all select distinct name from frames)
    """,
    "frames",
)
# Bytes of a number; ids, lengths of strings and of functions' messages take one byte each, as all are below 128.
_BYTES = "greatest(1, (length(bin({})) + 6) // 7)"
_query(
    "profile_message_bytes",
    f"""
    with samples as (
        select case when len(stack) > 0 then 2 + len(stack) else 0 end + 2 + {_BYTES.format("n")} + {_BYTES.format("v")} as payload from cpu
    ), locations as (
        select 6 + case when address <> 0 then 1 + {_BYTES.format("address")} else 0 end as payload from byname
    )
    select 1 as section, cast(9 + {_BYTES.format("sum(v)::bigint")} as bigint) as bytes from cpu
    union all select 2, cast(sum(1 + {_BYTES.format("payload::bigint")} + payload) as bigint) from samples
    union all select 3, cast(sum(1 + {_BYTES.format("payload::bigint")} + payload) as bigint) from locations
    union all select 4, cast(sum(6) as bigint) from byname
    union all select 5, cast(sum(2 + length(value)) as bigint) from (
        select unnest(['', 'samples', 'count', 'sampled_cpu', 'ns', 'process', 'sampled_duration']) as value
        union all select distinct name from frames)
    """,
    "byname",
)
_query(
    "profile_header",
    "select 'count' as count_title, 'sampled_duration' as value_title, cast(sum(v) as bigint) as duration_nanos from cpu",
    "cpu",
)
_part(
    "places",
    """
    select a.address, a.name, l.file, coalesce(l.line, 0) as line, coalesce(l.col, 0) as col, coalesce(l.inlined, []) as inlined
    from (select address, min(name) as name from frames group by address) a
    left join lines l on a.address >= l.start and a.address < l."end"
    """,
    "frames",
    "lines",
)
_part(
    "calls",
    """
    select address, cast(len(inlined) as int) as pos, name, file, line, col from places
    union all
    select address, cast(len(inlined) - i as int), inlined[i].name, inlined[i].file, inlined[i].line, inlined[i].col
    from (select *, unnest(range(1, len(inlined) + 1)) as i from places)
    """,
    "places",
)
_part("fn", "select name, coalesce(min(file), '') as file from calls group by name", "calls")
_query("profile_line_functions", "select name, file, (select count(*) from fn) as id_range from fn", "fn")
_query(
    "profile_line_locations",
    "select address, pos, name, fn.file, line, col from calls join fn using (name)",
    "fn",
)

# ---------------------------------------------------------------- trace export

NAMES = "list_transform(end_stack, lambda f: f.name)"
ESF = f"case when len(end_stack) > 0 then {path_id(NAMES)} end"
_part("sw", SWITCHES, "ev")
_part("sp", _spans(EXIT_CLOSE), "ev")
_part("rs", RSS_TRACK, "ev")
_part(
    "xrows",
    f"""
    select name, null::varchar as id, concat('command=', name, ',cpu=', cpu) as cat, start as ts, duration as dur, tid, pid,
           {ESF} as esf, null::bigint as amount, cpu::bigint as cpu from sw
    union all
    select name, null, concat('command=', name, ',cpu=', cpu, ',kind=', kind), start, duration, tid, pid, {ESF}, null, cpu from sp
    """,
    "sw",
    "sp",
)
_part(
    "crows",
    """
    select name, kind as id, concat('command=', name, ',kind=', kind) as cat, "timestamp" as ts, null::bigint as dur,
           null::bigint as tid, pid, null::varchar as esf, amount, null::bigint as cpu from rs
    """,
    "rs",
)
_query("trace_complete", "select * from xrows", "xrows")
_query("trace_counter", "select * from crows", "crows")
_query(
    "trace_categories",
    "select concat('command=', name, ',cpu=', cpu) as cat, count(*) as count from sw group by cat",
    "sw",
)
_query(
    "trace_frames",
    f"""
    with paths as (select {NAMES} as names from sw union select {NAMES} from sp),
    nodes as (select names, unnest(range(1, len(names) + 1)) as i from paths where len(names) > 0)
    select distinct {path_id("names[1:i]")} as id, case when i > 1 then {path_id("names[1:i - 1]")} end as parent, names[i] as name
    from nodes
    """,
    "sw",
    "sp",
)
_query("trace_document", "select 'X' as ph, * from xrows union all select 'C', * from crows", "xrows", "crows")
_query("empty_trace", "select 'ns' as \"displayTimeUnit\", count(*) = 0 as empty from events where value is null and event_id < 0")
_query(
    "contract_rejects",
    """
    select *, case when event is null then 'no event' when event = 'other' then 'neither complete nor counter'
                   when name is null then 'no name' end as reason
    from (select case when cpu = 3 then 'other' when pid % 7 <> 0 then 'complete' end as event,
                 case when pid % 11 <> 0 then name end as name, pid, start from sw)
    where event is null or event = 'other' or name is null
    """,
    "sw",
)
_query(
    "trace_json",
    """
    select ph, count(*) as rows, count(esf) as with_stack, cast(sum(cpu) as bigint) as cpu_sum, cast(sum(amount) as bigint) as amount_sum
    from (select 'X' as ph, * from xrows union all select 'C', * from crows) group by ph
    """,
    "xrows",
    "crows",
)
_query(
    "trace_header",
    "select 'ns' as \"displayTimeUnit\", (select count(*) from xrows) + (select count(*) from crows) = 0 as empty",
    "xrows",
    "crows",
)

# ---------------------------------------------------------------- from kernel observations to raw events

_query(
    "switch_pairing",
    """
    select * from (
        select event_id as seq, cast(event_id % 4 as int) as cpu,
               lag((event_id + 1) * 1000 + user_id) over (partition by event_id % 4 order by event_id) as start,
               (event_id + 1) * 1000 + user_id as ts, user_id % 8 as tgid,
               case when event_id % 17 = 0 then 0 else user_id + 1 end as pid
        from events)
    where start is not null and start <= ts and pid <> 0 and ts - start >= 1500
    """,
)
_part(
    "blk",
    """
    select event_id as seq, case when event_id % 2 = 0 then 'start' else 'done' end as type, (event_id // 2) % 50 as request,
           event_id % 3 as op, event_id * 1000 + user_id as ts, user_id % 8 as tgid, user_id as pid,
           cast(floor(value * 100) as bigint) + 1 as size, cast(event_id % 11 as int) as ustack_id
    from events where not (event_id % 2 = 0 and (event_id // 2) % 7 = 0)
    """,
)
_query(
    "block_pairing",
    """
    select d.seq, d.ts, s.ts as start, s.tgid, s.pid, s.size as amount, cast(d.op = 1 as int) as rw, s.ustack_id, -1 as kstack_id
    from (select * from blk where type = 'done') d
    asof join (select * from blk where type = 'start') s on d.request = s.request and d.seq > s.seq
    where not exists (select 1 from blk b where b.type = 'done' and b.request = d.request and b.seq > s.seq and b.seq < d.seq)
    """,
    "blk",
)
_part("rss", "select event_id as seq, user_id % 8 as tgid, user_id as pid, cast(floor(value) as bigint) as v from events")
_query(
    "rss_throttle",
    """
    select seq, tgid, pid, greatest(v, 0) + greatest(v - 10, 0) + 1 as amount
    from (select *, row_number() over (partition by tgid order by seq) as n from rss) where (n - 1) % 29 = 0
    """,
    "rss",
)
_query("rss_bytes", "select seq, (v + v - 10 + 1) * 4096 as bytes from rss", "rss")
_part(
    "calls_in",
    """
    select l_orderkey * 16 + l_linenumber as seq, (['vfs', 'udp_recv', 'udp_send', 'tcp_recv', 'tcp_send'])[l_partkey % 5 + 1] as type,
           l_suppkey % 8 as tgid, l_suppkey as pid, cast(l_partkey % 2 as int) as rw, cast(floor(l_quantity) as bigint) - 3 as amount
    from lineitem
    """,
)
_query("file_events", "select seq, tgid, pid, rw, amount from calls_in where type = 'vfs'", "calls_in")
_query("net_events", "select seq, type, tgid, pid, amount from calls_in where type <> 'vfs' and amount >= 0", "calls_in")
_query(
    "process_filter",
    """
    with changes as (
        select tgid, seq, type = 'process_exec' as tracked from raw
        where (type = 'process_exec' and comm = 'cmd1') or type = 'process_exit'
    )
    select r.seq, r.type from (select *, case when type = 'process_exit' then seq - 1 else seq end as at from raw) r
    asof left join changes c on r.tgid = c.tgid and r.at >= c.seq
    where coalesce(c.tracked, false) or r.type = 'reset'
    """,
    "raw",
)
_query(
    "stack_selection",
    """
    select type,
           cast(count(*) filter (ustack_id >= 0 and type not in ('rss', 'block')) as bigint) as "user",
           cast(count(*) filter (kstack_id >= 0 and type not in ('sample', 'block')) as bigint) as kernel
    from raw group by type
    """,
    "raw",
)
_query(
    "kernel_frame_trim",
    "select stack_id, coalesce(array_to_string(frames[6:], ';'), '') as frames from stackmap",
    "stackmap",
)
_query(
    "clock_alignment",
    "select seq, ts + 1700000000000000000 as ts, start + 1700000000000000000 as start from raw",
    "raw",
)
_query(
    "idle_samples",
    "select event_id as seq, user_id + 1 as pid from events where event_id % 17 <> 0",
)
_query(
    "span_names",
    """
    select c_custkey, case when c_custkey % 4 = 0 then substr(c_mktsegment, 1, 6)
                           else substr(concat(substr(c_mktsegment, 1, 6), '_long_tail_of_name'), 1, 16) end as name
    from customer
    """,
)

# ---------------------------------------------------------------- enrichment

_part(
    "execs",
    """
    select * from (
        select epoch, tgid, seq, comm, buildid, lag(comm) over (partition by epoch, tgid order by seq) as before
        from rawe where type = 'process_exec')
    where before is null or before <> comm
    """,
    "rawe",
)
_part(
    "att",
    """
    select r.*, x.comm as command, x.buildid as exe from rawe r
    asof left join execs x on r.epoch = x.epoch and r.tgid = x.tgid and r.seq >= x.seq
    """,
    "rawe",
    "execs",
)
_query("process_attribution", "select seq, epoch, command, exe as buildid from att", "att")

_part(
    "seeded",
    """
    select epoch, tgid, seq, comm, buildid from rawe where type = 'process_exec'
    union all
    select epoch, t, seq, concat('run', t % 6), lpad(cast(t % 10 as varchar), 2, '0')
    from (select *, unnest(range(0, 64, 2)) as t from rawe where type = 'reset')
    """,
    "rawe",
)
_query(
    "attribution_after_reset",
    """
    with known as (
        select * from (select *, lag(comm) over (partition by epoch, tgid order by seq) as before from seeded)
        where before is null or before <> comm
    )
    select r.seq, r.epoch, x.comm as command, x.buildid as buildid
    from (select * from rawe where type not in ('process_exec', 'reset')) r
    asof left join known x on r.epoch = x.epoch and r.tgid = x.tgid and r.seq >= x.seq
    """,
    "seeded",
)

_part(
    "threads",
    "select *, row_number() over (partition by epoch, pid order by seq) as rn from rawe",
    "rawe",
)
_STEP = """
    case when w.type = 'trace_enter' then list_append({st}, w.span_id)
         when w.type = 'trace_exit' then
             case when len({st}) = 0 then {st} when ({st})[-1] = w.span_id then ({st})[1:len({st}) - 1] else [] end
         else {st} end
"""
_part(
    "lists",
    f"""
    select w.epoch, w.pid, w.seq, w.rn, {_STEP.format(st="cast([] as bigint[])")} as st from threads w where rn = 1
    union all
    select w.epoch, w.pid, w.seq, w.rn, {_STEP.format(st="l.st")}
    from lists l join threads w on w.epoch = l.epoch and w.pid = l.pid and w.rn = l.rn + 1
    """,
    "threads",
)
_part("enters", "select epoch, tgid, pid, span_id as span, seq, ts, parent_id, id, amount, name from rawe where type = 'trace_enter'", "rawe")
_part(
    "looked",
    """
    select a.*, st[-1] as top,
           case when type in ('trace_exit', 'trace_close') then span_id else st[-1] end as span
    from att a join lists l on a.seq = l.seq
    where type in ('trace_exit', 'trace_close') or type not in ('trace_enter', 'process_exec', 'process_exit', 'reset')
    """,
    "att",
    "lists",
)
# The last removal of a row's entries before the row: a close of the span or an exit of the process.
_part(
    "removed",
    """
    select q.*, greatest(coalesce(c.seq, -1), coalesce(x.seq, -1)) as gone from looked q
    asof left join (select epoch, tgid, span_id as span, seq from rawe where type = 'trace_close') c
        on q.epoch = c.epoch and q.tgid = c.tgid and q.span = c.span and q.seq > c.seq
    asof left join (select epoch, tgid, seq from rawe where type = 'process_exit') x
        on q.epoch = x.epoch and q.tgid = x.tgid and q.seq > x.seq
    """,
    "looked",
)
_part(
    "alive",
    """
    select q.*, f.seq as f_seq, f.parent_id as f_parent, f.id as f_id, f.amount as f_amount, f.name as f_name, l.ts as l_ts
    from removed q
    asof left join enters f on q.epoch = f.epoch and q.tgid = f.tgid and q.pid = f.pid and q.span = f.span and q.gone < f.seq
    asof left join enters l on q.epoch = l.epoch and q.tgid = l.tgid and q.pid = l.pid and q.span = l.span and q.seq > l.seq
    """,
    "removed",
    "enters",
)
_query(
    "open_span_label",
    f"""
    select seq, top as open_span, case when f_seq < seq then f_id end as id, case when f_seq < seq then f_name end as name
    from alive where list_contains({_list(PLAIN_TYPES)}, type)
    """,
    "alive",
)
_part(
    "exits",
    """
    select seq, epoch, tgid, pid, span_id, ts - l_ts as duration, f_parent as parent_id, f_id as id, f_amount as amount, f_name as name
    from alive where type = 'trace_exit' and f_seq < seq
    """,
    "alive",
)
_part(
    "closes",
    """
    select q.seq, any_value(q.epoch) as epoch, any_value(q.tgid) as tgid, arg_min(e.pid, (e.pid, e.seq)) as pid,
           any_value(q.span_id) as span_id, any_value(q.ts) - arg_min(e.ts, (e.pid, e.seq)) as duration,
           arg_min(e.parent_id, (e.pid, e.seq)) as parent_id, arg_min(e.id, (e.pid, e.seq)) as id,
           arg_min(e.amount, (e.pid, e.seq)) as amount, arg_min(e.name, (e.pid, e.seq)) as name
    from removed q join enters e on q.epoch = e.epoch and q.tgid = e.tgid and q.span = e.span and e.seq > q.gone and e.seq < q.seq
    where q.type = 'trace_close' group by q.seq
    """,
    "removed",
    "enters",
)
_query("span_exit", "select * exclude (epoch) from exits", "exits")
_query("span_close", "select * exclude (epoch) from closes", "closes")

_query(
    "span_parents",
    """
    select w.seq, coalesce(nullif(w.parent_id, 0), l.st[-1], 0) as parent
    from threads w left join lists l on w.epoch = l.epoch and w.pid = l.pid and w.rn = l.rn + 1 where w.type = 'trace_enter'
    """,
    "lists",
)

_part(
    "used",
    """
    select distinct tgid as scope, ustack_id as stack_id from raw where ustack_id >= 0
    union select distinct -1, kstack_id from raw where kstack_id >= 0
    """,
    "raw",
)
_part(
    "addresses",
    """
    select scope, stack_id, pos, address from (
        select u.scope, u.stack_id, unnest(m.frames) as address, generate_subscripts(m.frames, 1) as pos
        from used u join stackmap m using (stack_id)) where address <> 0
    """,
    "used",
    "stackmap",
)
_part(
    "named",
    """
    select a.scope, a.address, s.name, s.start, a.address - s.start as off
    from (select distinct scope, address from addresses) a
    join sym s on a.scope = s.scope and a.address >= s.start and a.address < s."end"
    """,
    "addresses",
    "sym",
)
_part(
    "resolved",
    """
    select scope, stack_id, string_agg(concat(name, ':', start, ':', off), ';' order by pos) as stack
    from addresses join named using (scope, address) group by scope, stack_id
    """,
    "addresses",
    "named",
)
_query("symbol_lookup", "select * from named", "named")
_query("stack_resolution", "select * from resolved", "resolved")
_query(
    "sample_filter",
    "select seq from raw where type = 'sample' and (ustack_id > 0 or kstack_id > 0)",
    "raw",
)
KIND = """
    case when type = 'sample' then 'profile'
         when type = 'block' then concat('blk_', case rw when 0 then 'read' else 'write' end)
         when type = 'vfs' then concat('vfs_', case rw when 0 then 'read' else 'write' end) else type end
"""
_query(
    "event_kinds",
    f"select {KIND} as kind, count(*) as count from raw where list_contains({_list(PLAIN_TYPES)}, type) group by 1",
    "raw",
)
_part(
    "collected",
    f"""
    select a.seq, a.ts as "timestamp",
           cast(case when a.type = 'sample' then 1000000000 // 99 when a.type in ('switch', 'block') then a.ts - a.start else 0 end as bigint) as duration,
           {KIND} as kind, case when a.type in ('switch', 'sample') then a.cpu else 0 end as cpu, a.tgid, a.pid,
           case when f_seq < a.seq then a.span else 0 end as span_id, case when f_seq < a.seq then f_parent else 0 end as parent_id,
           case when f_seq < a.seq and a.type not in ('switch', 'sample', 'rss') then f_id else 0 end as id,
           case when a.type = 'rss' then a.amount * 4096 when a.type in ('switch', 'sample') then 0 else a.amount end as amount,
           a.command, case when f_seq < a.seq then f_name else '' end as trace_name, a.exe, a.ustack_id, a.kstack_id
    from alive a
    where list_contains({_list(PLAIN_TYPES)}, a.type) and a.command is not null
      and (a.type <> 'sample' or a.ustack_id > 0 or a.kstack_id > 0)
    union all
    select x.seq, a.ts, x.duration, 'trace_exit', a.cpu, x.tgid, x.pid, x.span_id, x.parent_id, x.id, x.amount, a.command, x.name, a.exe,
           a.ustack_id, a.kstack_id
    from exits x join att a on a.seq = x.seq where a.command is not null
    union all
    select x.seq, a.ts, x.duration, 'trace_close', a.cpu, x.tgid, x.pid, x.span_id, x.parent_id, x.id, x.amount, a.command, x.name, a.exe,
           -1, -1
    from closes x join att a on a.seq = x.seq where a.command is not null
    """,
    "alive",
    "exits",
    "closes",
)
_query(
    "collected_events",
    """
    select "timestamp", duration, kind, cpu, tgid, pid, span_id, parent_id, id, amount, command, trace_name, exe as buildid,
           coalesce(u.stack, '') as ustack, coalesce(k.stack, '') as kstack
    from collected c
    left join resolved u on u.scope = c.tgid and u.stack_id = c.ustack_id
    left join resolved k on k.scope = -1 and k.stack_id = c.kstack_id
    """,
    "collected",
    "resolved",
)
_query(
    "rejects",
    f"""
    select type, reason, count(*) as count from (
        select type,
               case when command is null and (type = 'trace_exit' or (list_contains({_list(PLAIN_TYPES)}, type)
                         and (type <> 'sample' or ustack_id > 0 or kstack_id > 0))) then 'missing command'
                    when type = 'trace_exit' and not coalesce(f_seq < seq, false) then 'missing span' end as reason
        from alive) where reason is not null group by type, reason
    """,
    "alive",
)
_query("unknown_types", "select seq, 'unknown type' as reason from raw where cpu = 3", "raw")

# ---------------------------------------------------------------- telemetry

_query(
    "missing_call_paths",
    "select ustack_id, count(*) as count from raw where type = 'sample' and ustack_id < -1 group by ustack_id",
    "raw",
)
_query(
    "program_events",
    """
    select case when type in ('udp_recv', 'udp_send', 'tcp_recv', 'tcp_send') then 'net' else type end as program, count(*) as count
    from raw where type <> 'reset' group by 1
    """,
    "raw",
)
_part(
    "counters",
    """
    select (event_id // 500) * 1000000000 as snapshot_ts, event_type as program, max(event_id) * 1000 as run_time_ns,
           max(event_id) + 1 as run_cnt, max(event_id) // 2 as collected_cnt
    from events group by 1, 2
    """,
)
_part(
    "deltas",
    """
    select snapshot_ts, program, snapshot_ts - lag(snapshot_ts) over w as wall_ns,
           run_time_ns - lag(run_time_ns, 1, 0) over w as run_time_ns, run_cnt - lag(run_cnt, 1, 0) over w as run_cnt,
           collected_cnt - lag(collected_cnt, 1, 0) over w as collected_cnt
    from counters window w as (partition by program order by snapshot_ts)
    """,
    "counters",
)
_query("counter_delta", "select * from deltas", "deltas")
_query(
    "program_rates",
    """
    select snapshot_ts, program, cast(run_time_ns as double) / nullif(wall_ns, 0) * 100 as busy_percent,
           cast(run_time_ns as double) / nullif(collected_cnt, 0) as collected_latency_ns from deltas
    """,
    "deltas",
)
_query(
    "program_rollup",
    """
    select (event_id // 500) * 1000000000 as snapshot_ts,
           (['block', 'block', 'vfs', 'vfs', 'net', 'net', 'rss_stat', 'sched_switch'])[user_id % 8 + 1] as program,
           cast(sum(cast(floor(value * 100) as bigint)) as bigint) as run_time_ns, count(*) as run_cnt
    from events group by 1, 2
    """,
)
_part(
    "dropped",
    """
    select snapshot_ts, cast(sum(value) as bigint) as dropped from (
        select (event_id // 500) * 1000000000 as snapshot_ts, event_id % 4 as cpu, max(event_id // 500) // 3 as value
        from events group by 1, 2) group by 1
    """,
)
_query("dropped_totals", "select * from dropped", "dropped")
_query(
    "reset_markers",
    "select snapshot_ts, dropped from (select *, lag(dropped, 1, 0) over (order by snapshot_ts) as b from dropped) where dropped > b",
    "dropped",
)
_query(
    "program_json",
    """
    select concat('prog', c_custkey % 20) as command_name, c_custkey % 4 as run_cnt, c_custkey * 10 as run_time_ns,
           cast(c_custkey * 10 as double) / (c_custkey % 4) as avg_run_time_ns
    from customer, (select unnest(['own', 'cmd0']) as holder)
    where (holder = 'cmd0' or c_custkey % 3 = 0) and c_custkey % 4 <> 0 and c_custkey <> 0
    """,
)

# ---------------------------------------------------------------- streaming forms

ORACLE["stream_switch_pairing"] = ORACLE["switch_pairing"]
ORACLE["stream_block_pairing"] = ORACLE["block_pairing"]
_query(
    "stream_rss_throttle",
    "select seq, tgid, pid from (select *, row_number() over (partition by tgid order by seq) as n from rss) where (n - 1) % 29 = 0",
    "rss",
)
_query("stream_events", "select * exclude (exe) from collected", "collected")

# ---------------------------------------------------------------- with hot keys

for _name in ("offcpu", "rss_growth", "span_exit", "collected_events"):
    ORACLE[f"hot_{_name}"] = ORACLE[_name]

# Events that hold keys of call paths give what events with the paths give.
for _name, _as in (("cpu_by_stack", "cpu_by_stack"), ("offcpu", "offcpu"), ("rss_growth", "rss_growth_command"), ("span_wait", "span_wait")):
    ORACLE[f"{_name}_interned"] = ORACLE[_as]

# ---------------------------------------------------------------- symbols valid in time, and runs of their own

_part(
    "symv",
    """
    select scope, cast(null as bigint) as since, start, "end", name from sym
    union all
    select scope, scope * 5000, start, "end", concat('new_', name) from sym where scope > 0 and scope % 3 = 0 and start // 4096 % 2 = 0
    """,
    "sym",
)
_part("tables", "select distinct scope, coalesce(since, -1) as version from symv where scope >= 0", "symv")
_part(
    "rawv",
    "select r.*, t.version from raw r asof left join tables t on r.tgid = t.scope and r.seq >= t.version",
    "raw",
    "tables",
)
_part(
    "usedv",
    """
    select distinct tgid as scope, version, ustack_id as stack_id from rawv where ustack_id >= 0
    union select distinct -1, -1, kstack_id from raw where kstack_id >= 0
    """,
    "rawv",
)
_query(
    "symbol_lookup_versions",
    """
    select a.scope, nullif(a.version, -1) as since, a.address, s.name, s.start, a.address - s.start as off
    from (select distinct u.scope, u.version, unnest(m.frames) as address from usedv u join stackmap m using (stack_id)) a
    join symv s on a.scope = s.scope and a.version = coalesce(s.since, -1) and a.address >= s.start and a.address < s."end"
    where a.address <> 0
    """,
    "usedv",
    "symv",
    "stackmap",
)

# ---------------------------------------------------------------- wide, nested and negative ranges

_query(
    "range_lookup_wide",
    """
    with points as (
        select distinct p_partkey % 3 as grp, unnest([p_partkey * 64, -p_partkey * 4096, p_partkey * 1099511627776, -p_partkey * 1099511627776]) as addr
        from part
    ), ranges as (
        select s_suppkey % 3 as grp, s_suppkey as id, -s_suppkey * 1125899906842624 as start, s_suppkey * 4611686018427387 as "end" from supplier
        union all select s_suppkey % 3, s_suppkey + 1000000, s_suppkey * 640 - 3200, s_suppkey * 640 + 3200 from supplier
        union all select s_suppkey % 3, s_suppkey + 2000000, -s_suppkey * 65536 - 7, -s_suppkey * 65536 + 60000 from supplier
        union all select 0, 3000000, -9223372036854775808, 9223372036854775807
    )
    select p.grp, p.addr, arg_max(r.id, (r.start, -cast(r."end" as hugeint))) as id
    from points p left join ranges r on p.grp = r.grp and r.start <= p.addr and p.addr < r."end" group by p.grp, p.addr
    """,
)

# ---------------------------------------------------------------- captures

_query("unsigned_scan", "select id, case when id % 2 = 0 then span_id - 9223372036854775807 - 1 else span_id end as span_id from ev", "ev")
_query("capture_scan", 'select id, "timestamp", kind from ev where cpu >= 2', "ev")
_query("events_roundtrip", f"""select id, "timestamp", duration, kind, amount, {text('ustack')} as stack from ev""", "ev")
ORACLE["stream_process_filter"] = ORACLE["process_filter"]

# A fold over several batches gives what one pass gives.
ORACLE["stream_rejects"] = ORACLE["rejects"]

# ---------------------------------------------------------------- two runs

for _name, _key in (("offcpu", "pid"), ("rss_growth", "tgid")):
    ORACLE[f"{_name}_runs"] = ORACLE[_name].replace(f"partition by {_key} ", f"partition by cpu % 2, {_key} ")
_RUNS = """select raw.*, count(*) filter (type = 'reset') over (partition by seq // 16 % 2 order by seq) * 2 + seq // 16 % 2 as epoch
from raw"""
ORACLE["span_exit_runs"] = ORACLE["span_exit"].replace(PARTS["rawe"], _RUNS)
ORACLE["attribution_runs"] = ORACLE["process_attribution"].replace(PARTS["rawe"], _RUNS).replace("select seq, epoch, command", "select seq, command")

# Each run has symbols and call paths of its own.
_RUN_PARTS = {
    "used": """select distinct seq // 16 % 2 as run, tgid as scope, ustack_id as stack_id from raw where ustack_id >= 0
        union select distinct seq // 16 % 2, -1, kstack_id from raw where kstack_id >= 0""",
    "addresses": """select run, scope, stack_id, pos, address + run as address from (
        select u.run, u.scope, u.stack_id, unnest(m.frames) as address, generate_subscripts(m.frames, 1) as pos
        from used u join stackmap m using (stack_id)) where address <> 0""",
    "named": """select a.run, a.scope, a.address, concat(s.name, '_r', a.run) as name, s.start, a.address - s.start as off
        from (select distinct run, scope, address from addresses) a
        join sym s on a.scope = s.scope and a.address >= s.start and a.address < s."end" """,
    "resolved": """select run, scope, stack_id, string_agg(concat(name, ':', start, ':', off), ';' order by pos) as stack
        from addresses join named using (run, scope, address) group by run, scope, stack_id""",
}
_runs = ORACLE["collected_events"].replace(PARTS["rawe"], _RUNS)
for _name, _sql in _RUN_PARTS.items():
    _runs = _runs.replace(PARTS[_name], _sql)
ORACLE["collected_events_runs"] = (
    _runs.replace('select "timestamp", duration, kind, cpu, tgid', 'select c.seq // 16 % 2 as run, "timestamp", duration, kind, cpu, tgid')
    .replace("u.scope = c.tgid", "u.run = c.seq // 16 % 2 and u.scope = c.tgid")
    .replace("k.scope = -1", "k.run = c.seq // 16 % 2 and k.scope = -1")
)
