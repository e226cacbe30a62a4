"""Row-by-row models of the span and process rules, for comparison with the set-based operators."""


def run(rows):
    """Feed raw rows (dicts, in seq order) to the rules; returns {seq: result} per kind of result."""
    commands, entries, lists = {}, {}, {}
    labels, exits, closes, attributed = {}, {}, {}, {}
    for r in rows:
        kind, tgid, pid, span = r["type"], r["tgid"], r["pid"], r["span_id"]
        if kind == "reset":
            commands, entries, lists = {}, {}, {}
        elif kind == "process_exec":
            if commands.get(tgid, (None,))[0] != r["comm"]:
                commands[tgid] = (r["comm"], r["buildid"])
        elif kind == "process_exit":
            entries = {k: v for k, v in entries.items() if k[0] != tgid}
        elif kind == "trace_enter":
            lists.setdefault(pid, []).append(span)
            known = entries.setdefault((tgid, span, pid), {"id": r["id"], "first": r["ts"]})
            known["last"] = r["ts"]
        elif kind == "trace_exit":
            opened = lists.get(pid, [])
            if opened and opened.pop() != span:
                opened.clear()
            known = entries.get((tgid, span, pid))
            if known:
                exits[r["seq"]] = (r["ts"] - known["last"], known["id"])
        elif kind == "trace_close":
            pids = sorted(p for t, s, p in entries if t == tgid and s == span)
            if pids:
                owner = entries[(tgid, span, pids[0])]
                closes[r["seq"]] = (r["ts"] - owner["first"], owner["id"], pids[0])
            for p in pids:
                del entries[(tgid, span, p)]
        else:
            opened = lists.get(pid, [])
            known = entries.get((tgid, opened[-1], pid)) if opened else None
            labels[r["seq"]] = (opened[-1] if opened else None, known and known["id"])
        attributed[r["seq"]] = commands.get(tgid)
    return labels, exits, closes, attributed


def stream(rng, rows, resets=True):
    """A random raw stream: 4 threads of 2 processes share 5 spans; enters, exits and closes come in any order."""
    kinds = ["trace_enter"] * 6 + ["trace_exit"] * 5 + ["trace_close", "rss", "rss", "rss"]
    out = []
    opened = {}
    for seq in range(rows):
        pid = rng.choice([1, 2, 3, 4])
        kind = rng.choice(kinds)
        if rng.random() < 0.03:
            kind = rng.choice(["process_exec", "process_exit"] + (["reset"] if resets and rng.random() < 0.3 else []))
        span = rng.randint(1, 5)
        if kind == "trace_enter":
            opened.setdefault(pid, []).append(span)
        elif kind == "trace_exit" and opened.get(pid) and rng.random() < 0.8:
            span = opened[pid].pop()
        spans = kind.startswith("trace")
        out.append(
            {
                "seq": seq,
                "type": kind,
                "ts": seq * 10 + rng.randint(0, 9),
                "start": None,
                "tgid": pid % 2,
                "pid": pid,
                "cpu": 0,
                "span_id": span if spans else None,
                "parent_id": 0 if spans else None,
                "id": seq if spans else None,
                "amount": seq,
                "rw": 0,
                "name": f"s{span}" if spans else None,
                "comm": rng.choice(["a", "b"]) if kind == "process_exec" else None,
                "buildid": bytes([seq % 256]) if kind == "process_exec" else None,
                "ustack_id": 1,
                "kstack_id": -1,
            }
        )
    return out
