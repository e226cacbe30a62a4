import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from profspark.llm import resample
from profspark.llm.scratch import Scratch


def test_weights_equal_brute_force(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1")
    target = {r.doc_id for r in labels.collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    raw = sum(resample.buckets(t) for t in texts.values())
    wanted = sum(resample.buckets(t) for d, t in texts.items() if d in target)
    n = resample.BUCKETS
    ratio = np.log((wanted + 1) / (wanted.sum() + n)) - np.log((raw + 1) / (raw.sum() + n))
    rows = resample.resampled(documents, labels, share=0.25).collect()
    for r in rows:
        assert math.isclose(r.log_weight, float(resample.buckets(r.text) @ ratio), abs_tol=1e-6)
    keys = sorted((r.gumbel_key for r in rows), reverse=True)
    assert {r.doc_id for r in rows if r.selected} == {r.doc_id for r in rows if r.gumbel_key >= keys[math.ceil(len(rows) * 0.25) - 1]}
    good = {d for d in target if d in texts}
    assert np.mean([r.log_weight for r in rows if r.doc_id in good]) > np.mean([r.log_weight for r in rows if r.doc_id not in good])


@pytest.mark.parametrize("wanted", [0, 1, 3, 4, 5, 6, 7, 9, 10])
def test_ties_at_the_limit(spark, wanted):
    rows = [(1, 0, 5.0), (2, 0, 3.0), (3, 0, 3.0), (3, 0, 3.0), (3, 0, 3.0), (4, 0, 3.0), (5, 0, 1.0), (6, 0, 1.0 + 1e-15), (None, 0, -7.0), (None, 1, 0.0)]
    df = spark.createDataFrame(rows, "id long, mark long, gumbel_key double")
    got = resample.threshold(df, wanted, Scratch(spark)).collect()
    assert len(got) == len(rows) and sum(r.selected for r in got) == wanted
    if wanted:
        assert min(r.gumbel_key for r in got if r.selected) >= max((r.gumbel_key for r in got if not r.selected), default=-99)


def test_noise_is_gumbel(spark):
    keys = [r.g for r in spark.range(20_000).select(resample.gumbel(F.col("id"), 3).alias("g")).collect()]
    assert abs(np.mean(keys) - 0.5772) < 0.05 and abs(np.std(keys) - math.pi / 6**0.5) < 0.05


def test_edges(spark, edges, empty):
    target = spark.createDataFrame([(1,), (None,), (77,)], "doc_id long")
    found = resample.resampled(edges, target)
    assert found.columns == [*edges.columns, "log_weight", "gumbel_key", "selected"]
    rows = found.collect()
    assert len(rows) == edges.count() and sum(r.selected for r in rows) == 6
    assert all(r.log_weight == 0 for r in rows if not (r.text or "").strip())
    assert resample.resampled(empty, target).count() == 0
    assert resample.resampled(edges, target.limit(0)).count() == edges.count()
