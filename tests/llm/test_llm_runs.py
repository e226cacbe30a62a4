import hashlib
import random
import zlib

import pytest

from profspark.llm import runs
from profspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(w, least=12):
    """Every stretch in which words q apart are equal, for each q; the smallest q of a stretch is its period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def many_texts():
    rng = random.Random(5)
    for kind in range(600):
        n = rng.randint(0, 150)
        letters = "abcde"[: rng.choice([1, 2, 2, 3, 5])]
        if kind % 5 == 0:
            yield "".join(rng.choice(letters) for _ in range(n))
        elif kind % 5 == 1:
            yield ("".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) * 30)[:n]
        elif kind % 5 == 2:
            yield fibonacci(n + 1)
        elif kind % 5 == 3:
            yield "".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) * rng.randint(1, 6) for _ in range(6))
        else:
            yield "ab" * rng.randint(0, 25) + "a" * rng.randint(0, 2) + "ab" * rng.randint(0, 25) + "aab" * rng.randint(0, 12)


def test_runs_equal_brute_force():
    texts = [list(t.encode()) for t in many_texts()]
    words = [[bytes([c]) for c in t] for t in texts]
    got = [[tuple(r) for r in x.tolist()] for x in runs.of_texts(words)]
    assert got == [brute(t) for t in texts] and sum(map(len, got)) > 500


@pytest.mark.parametrize("least", [12, 20, 64])
def test_least_length(least):
    words = [[bytes([c]) for c in t.encode()] for t in many_texts()]
    assert [[tuple(r) for r in x.tolist()] for x in runs.of_texts(words, least)] == [brute(w, least) for w in words]


def test_many_periods_at_one_place():
    """One border between two stretches of period 2 is the middle of runs of every odd period."""
    w = [c.encode() for c in "ab" * 40 + "a" + "ab" * 40]
    (got,) = runs.of_texts([w])
    assert {q for _, _, q in got.tolist()} >= set(range(7, 80, 2)) and [tuple(r) for r in got.tolist()] == brute(w)


def test_long_texts():
    for text, want in (("a" * 200_000, [(0, 200_000, 1)]), ("abc" * 60_000, [(0, 180_000, 3)])):
        (got,) = runs.of_texts([[c.encode() for c in text]])
        assert [tuple(r) for r in got.tolist()] == want


def collapsed(words, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_collapsed_and_spaces(spark):
    texts = [" x\ty " * 9 + "é 漢 end", "one two three " * 5 + "one two", None, "", "\n ", "a " * 11, "a " * 12]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in runs.periodic_runs(df).collect():
        words = [w.decode() for w in (texts[r.doc_id] or "").encode().split()]
        want = brute(words)
        assert [(x.start, x.length, x.period) for x in r.runs] == want and r.collapsed == collapsed(words, want)


def test_edges(spark, edges, empty):
    found = runs.periodic_runs(edges)
    assert found.columns == [*edges.columns, "runs", "collapsed"]
    rows = found.collect()
    assert len(rows) == edges.count() and all(r.runs == [] and r.collapsed == "" for r in rows if not (r.text or "").strip())
    (long,) = [r for r in rows if r.doc_id == 6]
    assert [(x.start, x.length, x.period) for x in long.runs] == [(0, 120_000, 6)] and len(long.collapsed.split()) == 6
    clash = runs.periodic_runs(edges.withColumnRenamed("lang", "Runs").withColumnRenamed("key", "collapsed"), keep=["doc_id", "Runs"])
    assert clash.columns == ["doc_id", "runs", "collapsed"] and clash.count() == edges.count()
    assert runs.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(edges, least=6)


def test_query_equals_brute_force(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        w = [x.decode() for x in (text or "").encode().split()]
        h, n = zlib.crc32(str(d).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        found = brute(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r = got[d]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in found)) and r.collapsed_sha256 == sha(collapsed(w, found))
    assert sum(r.n_runs > 0 for r in got.values()) > 10
