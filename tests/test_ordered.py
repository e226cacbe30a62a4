import random

import pytest
from pyspark.sql import functions as F

from profspark.operators import hot
from profspark.operators.ordered import (
    Ordered,
    first,
    lag,
    last,
    lead,
    ordered,
    running_min,
    running_sum,
    slicing,
)


def steps():
    v = F.col("v")
    return {
        "lagged": lag(v),
        "next": lead(v),
        "latest": last(v),
        "latest_before": last(v, before=True),
        "earliest": first(v),
        "total": running_sum(F.coalesce(v, F.lit(0))),
        "total_before": running_sum(F.coalesce(v, F.lit(0)), before=True),
        "low": running_min(v),
        "low_before": running_min(v, before=True),
    }


def data(spark, rows=600):
    rng = random.Random(3)
    keys = ["hot"] * 10 + ["warm"] * 4 + [f"cold{i}" for i in range(12)]
    values = [(rng.choice(keys), i, rng.choice([None, rng.randint(-9, 9)])) for i in range(rows)]
    rng.shuffle(values)
    return spark.createDataFrame(values, "k string, at long, v long")


def test_slices_give_the_plain_windows_results(spark, split_hot):
    df = data(spark)
    cut = slicing(df, ["k"], "at")
    assert cut.hot.count >= 2 and len(cut.cuts) >= 5
    split = ordered(df, ["k"], ["at"], **steps())
    plain = Ordered(["k"], ["at"]).apply(df, **steps())
    assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_null_keys_null_orders_and_ties(spark, split_hot, seed):
    rng = random.Random(seed)
    rows = [
        (rng.choice([None, None, "a", "b", f"c{rng.randrange(30)}"]), rng.choice([None, None, rng.randrange(40), rng.randrange(40), 2**53 + rng.randrange(3)]), i, rng.choice([None, rng.randint(-9, 9)]))
        for i in range(400)
    ]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at long, id long, v long")
    assert slicing(df, ["k"], "at").hot
    split = ordered(df, ["k"], ["at", "id"], **steps())
    plain = Ordered(["k"], ["at", "id"]).apply(df, **steps())
    assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    cut = slicing(df, ["k"], "at")
    change = F.when(F.col("v") > 0, 1).otherwise(-1).cast("bigint")
    deep = Ordered(["k"], ["at", "id"], "_s").depth(cut.attach(df, "_s"), change, "depth").drop("_s")
    flat = Ordered(["k"], ["at", "id"]).depth(df, change, "depth")
    assert sorted(map(tuple, deep.collect()), key=str) == sorted(map(tuple, flat.collect()), key=str)


def test_no_slice_holds_a_whole_hot_key(spark, split_hot):
    df = data(spark)
    sizes = slicing(df, ["k"], "at").attach(df, "s").where("s > 0").groupBy("k", "s").count()
    assert sizes.agg(F.max("count")).first()[0] <= 40
    assert sizes.where("k = 'hot'").count() > 5


def test_without_hot_keys_the_plan_is_the_plain_window(spark):
    df = data(spark)
    assert not slicing(df, ["k"], "at").hot
    plan = ordered(df, ["k"], ["at"], a=lag(F.col("v")))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_spread_join_keeps_all_rows(spark, split_hot):
    left = data(spark).select("k", "at")
    right = left.select("k").distinct().where("k != 'cold3'").withColumn("x", F.length("k"))
    found = hot.hot_keys(left, ["k"])
    assert found.count >= 2 and found.rows > 300
    for how in ("left", "inner"):
        want = sorted(map(tuple, left.join(right, ["k"], how).collect()), key=str)
        for got in (
            hot.spread_join(left, right, ["k"], "at", found, how),
            hot.dictionary_join(left, right, ["k"], "at", how),
        ):
            assert sorted(map(tuple, got.collect()), key=str) == want


def test_materialized_cuts_the_plan(spark, split_hot):
    df = hot.materialized(data(spark).groupBy("k").count())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan
    assert df.agg(F.sum("count")).first()[0] == 600
