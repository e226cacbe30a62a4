import random

import pytest
from pyspark.sql import functions as F

from profspark.llm import toxicity
from profspark.llm.language import fold


@pytest.fixture(scope="module")
def biased(spark):
    """Texts in which one group's name is frequent in toxic texts only."""
    rng = random.Random(1)
    filler = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(500):
        w = rng.choices(filler, k=25)
        toxic = i % 4 == 0
        if toxic:
            w[3] = rng.choice(["idiot", "scum"]) if rng.random() < 0.95 else w[3]
            if rng.random() < 0.8:
                w[9] = "muslims"
        elif rng.random() < 0.2:
            w[9] = rng.choice(["christians", "people"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_counterfactuals_reduce_false_positives(biased):
    documents, labels = biased
    neutral = "word1 word2 word3 many muslims live here word4 word5"
    score = {c: toxicity.train(documents, labels, counterfactual=c).score(toxicity.features(toxicity.text_words(neutral)[1])) for c in (0.0, 1.0)}
    assert score[0.0] > 0.5 and score[1.0] < 0.3
    fair = toxicity.train(documents, labels)
    others = [fair.score(toxicity.features(toxicity.text_words(neutral.replace("muslims", x))[1])) for x in ("people", "christians", "women")]
    assert all(abs(x - score[1.0]) < 0.05 for x in others)
    assert fair.score(toxicity.features(toxicity.text_words("word1 idiot word2 scum word3")[1])) > 0.5


def test_swaps():
    h, rows = toxicity.text_words("Many muslims and women here")
    copies = toxicity.swapped(h, rows)
    assert len(copies) == toxicity.SWAPS
    assert (copies[0] == toxicity.features(toxicity.text_words("Many and here")[1])).all()
    assert toxicity.swapped(*toxicity.text_words("nothing to swap")) == []


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = fold("doc_id", 4) == 2
    model = toxicity.train(documents, labels.where(~out))
    rows = toxicity.scored(documents.join(F.broadcast(labels.where(out)), "doc_id"), model).select("toxic", (F.col("score") >= 0.3).alias("hit")).collect()
    toxic, clean = [r.hit for r in rows if r.toxic], [r.hit for r in rows if not r.toxic]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_edges(spark, edges, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (4, None), (5, 7), (6, 0)], "doc_id long, toxic int")
    found = toxicity.scored(edges, toxicity.train(edges, labels))
    assert found.columns == [c for c in edges.columns if c != "Score"] + ["score"]
    assert all(0 <= r.score <= 1 for r in found.collect()) and found.count() == edges.count()
    none = toxicity.train(empty, labels.limit(0))
    assert {r.score for r in toxicity.scored(edges, none).collect()} == {0.5}
    assert toxicity.scored(empty, none).count() == 0
