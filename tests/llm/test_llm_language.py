import itertools

import numpy as np
import pytest

from profspark.llm import language


def model(k=3, seed=0):
    crf = language.Crf([f"l{i}" for i in range(k)])
    crf.move = np.random.default_rng(seed).normal(size=(k, k))
    return crf


def test_marginals_equal_enumeration():
    crf, score = model(), np.random.default_rng(1).normal(size=(5, 3))
    prob, weight = np.zeros((5, 3)), 0.0
    for path in itertools.product(range(3), repeat=5):
        w = np.exp(sum(score[i, y] for i, y in enumerate(path)) + sum(crf.move[a, b] for a, b in itertools.pairwise(path)))
        weight += w
        for i, y in enumerate(path):
            prob[i, y] += w
    assert np.allclose(crf.marginals(score[None])[0][0], prob / weight)


def test_blocks_equal_plain_forward_backward():
    crf, rng = model(4, 2), np.random.default_rng(3)
    lengths = np.array([1, 2, 63, 64, 65, 128, 500])
    score = rng.normal(size=(lengths.sum(), 4)) * 3
    got, at = crf.label(score, lengths), 0
    for n in lengths:
        assert np.allclose(crf.marginals(score[None, at : at + n])[0][0], got[at : at + n])
        at += n


@pytest.fixture(scope="module")
def trained(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language.train(documents.where(language.fold("doc_id", 3) != 1), docs_per_language=100)


def test_held_out_accuracy(spark, trained):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(language.fold("doc_id", 3) == 1)
    rows = language.identified(documents, trained).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_switching(spark, trained):
    by = {r.lang: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars > 600 and n_chars < 3000").collect()}
    mixed = " ".join(by["en"].split()[:60]) + " " + " ".join(by["de"].split()[:30])
    r = language.identified(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), trained).first()
    assert r.lang_pred == "en" and 0.5 < r.langs["en"] < 0.85 and 0.15 < r.langs["de"] < 0.5


def test_edges(edges, empty, trained):
    found = language.identified(edges, trained)
    assert found.columns == [c for c in edges.columns if c != "Score"] + ["lang_pred", "score", "langs"]
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in found.collect()}
    assert all(got[k] == ("und", 0.0) for k in got if not k[1] or not k[1].strip())
    assert got[7, "x" * 300_000][0] != "und" and got[6, [k for k in got if k[0] == 6][0][1]][0] != "und"
    assert language.identified(empty, trained).count() == 0
    nothing = language.train(empty)
    assert nothing.labels == [] and {r.lang_pred for r in language.identified(edges, nothing).collect()} == {"und"}


def test_every_language_is_learned(spark):
    """Seventy languages, half of them in texts of three words, one of them in copies of one text mostly."""
    letter = lambda x: chr(97 + x % 26)
    word = lambda k, i: letter(k // 26) + letter(k) + "".join(letter(k * 7 + i * (k + 3) + j * (2 * k + 5)) for j in range(4))
    rows = [(" ".join(word(k, (i + j) % 9) for j in range(3 if k % 2 else 20)), f"l{k:02d}") for k in range(70) for i in range(9)]
    rows += [(rows[0][0], "l00")] * 300
    model = language.train(spark.createDataFrame(rows, "text string, lang string"), docs_per_language=9)
    assert sorted(model.labels) == [f"l{k:02d}" for k in range(70)] and model.labels[0] == "l00"
    texts = spark.createDataFrame([(" ".join(word(k, i) for i in range(9)), f"l{k:02d}") for k in range(70)], "text string, lang string")
    got = language.identified(texts, model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 66


def test_passages(spark):
    assert language._cut("") == [] and language._cut(" 12 34 ") == []
    assert language._cut("One two.") == [b" ".join([b"one", b"two"] * 6)]
    long = " ".join(f"w{chr(97 + i % 26)}" for i in range(60_000))
    cut = language._cut(long)
    assert 10 <= len(cut) <= 40 and all(len(c.split()) == 12 for c in cut)
    assert language._cut("x" * 300_000) == []
