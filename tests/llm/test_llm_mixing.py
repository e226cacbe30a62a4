from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from profspark.llm import mixing


def targets(sizes, weights=(3, 1, 2), percent=150, epochs=2):
    """Water filling in exact fractions: sizes by source in order."""
    want = {s: None for s in sizes}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sizes)}
    left = Fraction(percent * sum(sizes.values()), 100)
    open_ = set(sizes)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if epochs * sizes[s] <= weight[s] * rate}
        if not over:
            return want | {s: weight[s] * rate for s in open_}
        for s in over:
            want[s] = Fraction(epochs * sizes[s])
            left -= want[s]
        open_ -= over
    return want


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def rows_of(counts, words=20):
    return [(i * 100 + k, "w " * ((k * 7) % words + 1), s) for i, (s, n) in enumerate(counts) for k in range(n)]


@pytest.mark.parametrize("counts", [[("a", 30), ("b", 30), ("c", 30), (None, 30)], [("a", 3), ("b", 90), ("B", 40), ("é", 1), (None, 2)], [("one", 50)]])
def test_targets_and_taken(spark, counts):
    rows = rows_of(counts)
    got = mixing.mixture(table(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _, _ in rows)
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s, _ in sorted(counts, key=lambda c: (c[0] is None, (c[0] or "").encode()))}
    want = targets(sizes)
    largest = max(r["size"] for r in got)
    assert sum(r.taken for r in got) == 150 * sum(sizes.values()) // 100
    for s, size in sizes.items():
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {size} and all(abs(r.target - want[s]) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 2 * largest
        assert all(0 <= r.taken <= 2 * r["size"] for r in own)
        # Whole documents, but for the one at the border of the budget.
    assert sum(r["size"] > 0 and r.taken % r["size"] != 0 for r in got) <= 1


def test_order_by_finish_time(spark):
    """Whatever is taken of a source comes before what is not, in the shuffled order; a second epoch after the first."""
    got = mixing.mixture(table(spark, rows_of([("a", 80), ("b", 80), ("c", 80)])))
    for s in "abc":
        own = [r.taken / r["size"] for r in got.where(F.col("source") == s).collect()]
        assert max(own) - min(own) <= 1


def test_blocks_do_not_change_the_mix(spark, monkeypatch):
    df = table(spark, rows_of([("a", 90), ("b", 20), (None, 60)]))
    whole = sorted(mixing.mixture(df).collect(), key=str)
    monkeypatch.setattr(mixing, "BLOCK", 3)
    assert sorted(mixing.mixture(df.repartition(7)).collect(), key=str) == whole


def test_repeated_rows(spark):
    """Interchangeable rows are dealt words one by one; a million copies would be one unit, not one task."""
    rows = [(1, "a b c", "x")] * 50 + [(2, "a b c d", "y")] * 50
    got = mixing.mixture(table(spark, rows)).collect()
    assert len(got) == 100 and sum(r.taken for r in got) == 150 * 350 // 100
    assert all(r.taken <= 2 * r["size"] for r in got)
    # x may take 3 of 4 parts of 525 words, but at most 300; y gets the rest.
    assert [sum(r.taken for r in got if r.doc_id == d) for d in (1, 2)] == [300, 225]


def test_edges(spark, edges, empty):
    df = edges.select("doc_id", "text", F.col("lang").alias("source"), F.lit(1).alias("size"), F.lit(2).alias("target"), F.lit("x").alias("taken"), F.lit(3).alias("id"))
    got = mixing.mixture(df).collect()
    assert mixing.mixture(df).columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    assert len(got) == edges.count() and all(r.taken == 0 for r in got if r["size"] == 0)
    assert sum(r.taken for r in got) == 150 * sum(r["size"] for r in got) // 100
    none = mixing.mixture(df.where("text is null")).collect()
    assert len(none) == 2 and all((r["size"], r.target, r.taken) == (0, 0.0, 0) for r in none)
    assert mixing.mixture(df.limit(0)).collect() == []


def test_general_sizes_and_weights(spark):
    df = spark.createDataFrame([(i, "s", 10) for i in range(9)] + [(i, "t", 10) for i in range(9, 40)], "id long, kind string, n int")
    got = mixing.mixture(df, "id", "kind", F.col("n"), weights=(1, 3), percent=50, epochs=1).collect()
    assert {r.kind: r.target for r in got} == {"s": 50.0, "t": 150.0}
    assert sum(r.taken for r in got) == 200
