import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from profspark.llm import jaccard
from profspark.llm.bloom import Bloom
from profspark.llm.components import components
from profspark.llm.scratch import ARROW, ARROW_ROWS, Scratch


def shingle_set(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, percent=90):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def family_rows(seed, families=6, members=14):
    """Texts that drift away from each other, so that components are chains and not stars."""
    rng = random.Random(seed)
    rows, at = [], 0
    for f in range(families):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 9, 12, 40, 90, 200]))]
        for _ in range(members):
            rows.append((at, " ".join(w)))
            at += 1
            w = list(w)
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(len(w))] = f"v{rng.randrange(10_000)}"
    return rows


@pytest.mark.parametrize(("seed", "tile"), [(1, 1024), (2, 3)])
def test_components_equal_brute_force(spark, seed, tile):
    rows = family_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, tile=tile).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        b = a[rng.random(len(a)) > rng.random() * 0.12]
        b = np.unique(np.concatenate((b, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 20)), dtype=np.int64).astype(np.uint64))))
        common = len(np.intersect1d(a, b))
        if len(b) and common * 100 >= percent * (len(a) + len(b) - common) and common < max(len(a), len(b)):
            sigs = [{int(x) for g in jaccard.signatures(s, percent, 100) for x in g} for s in (a, b)]
            assert sigs[0] & sigs[1]


def test_edge_rows(spark, edges, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(edges).collect()]
    assert sorted(g for g in got if g[0] in (1, 2)) == [(1, 12, 1), (1, 12, 1), (2, 12, 1)]
    assert sorted(g for g in got if g[0] in (3, 4, 5)) == [(3, 0, 3), (4, 0, 4), (5, 0, 5)]
    assert sorted(x for x in got if x[0] is None) == [(None, 0, None), (None, 6, None)] or len(got) == 11
    assert jaccard.jaccard_components(empty).count() == 0
    kept = jaccard.representatives(edges)
    assert kept.columns == edges.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 4, 5, 6, 7, 8]
    assert jaccard.representatives(empty).count() == 0


def test_long_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "u long, v long"), Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}}


def test_bloom_has_its_keys(spark):
    keys = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 500).tolist()
    bloom = Bloom.of(spark.createDataFrame([(k,) for k in keys], "key long"), "key")
    assert all(map(bloom.has, keys))
    assert sum(bloom.has(k + 1) for k in keys) < 100


def test_groups_by_size():
    by = defaultdict(int)
    for percent in (80, 90):
        low, segments, spare = jaccard.bands(percent, 100)
        by[percent] = low[1]
        assert (segments[1:] > spare[1:]).all() and (np.diff(low) > 0).all()
    assert by[90] == 9


def test_python_gets_few_rows_at_a_time(spark):
    """While a table is written; the session's setting stays."""
    before = spark.conf.get(ARROW)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    found = Scratch(spark).keep(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long"))
    assert found.agg({"n": "max"}).first()[0] <= ARROW_ROWS and found.agg({"n": "sum"}).first()[0] == 5000
    assert spark.conf.get(ARROW) == before


def test_signatures_are_dealt_in_pieces(spark, monkeypatch):
    """Of a batch of texts, and of one text, that have more than a task should hold at once."""
    rows = family_rows(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(jaccard, "DEALT", 100)
    monkeypatch.setattr(jaccard, "TEXTS", 7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute(rows)
