"""The registered queries on whole small tables: against DuckDB where SQL has them, and in form where not."""

import hashlib
import re
from functools import partial

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from profspark.llm import sql
from profspark.llm.queries import ORACLES, QUERIES
from profspark.llm.scratch import ARROW, ARROW_ROWS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "conversations"):
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


def compared(df, cursor):
    names = [d[0] for d in cursor.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert got == want and got


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    compared(QUERIES[name](spark, SF), duck.execute(ORACLES[name]))


def test_chat_digests_equal_sql(spark, duck):
    df = QUERIES["op10_chat_windows"](spark, SF)
    compared(df.drop("formatted_chars"), duck.execute(sql.OP10_DIGESTS))
    own = df.where("conv_id = -7").first()
    hard = r"\### Assistant: </turn> ok"
    assert (own.n_turns, own.loss_chars, own.loss_sha256) == (2, len(hard), hashlib.sha256(hard.encode()).hexdigest())
    assert own.turns_sha256 == hashlib.sha256(f"user\n{hard}\nassistant\n{hard}\n".encode()).hexdigest()


@pytest.mark.parametrize("name", ["op6_surrogates", "op8_quality_rules", "op10_chat_windows"])
def test_native_plans(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct", plan)


@pytest.mark.parametrize(("name", "columns"), [("op1_toxicity", "doc_id held_out score predicted"), ("op5_bpe", "doc_id n_tokens ids_sha256 decoded_sha256"), ("op7_language", "doc_id held_out lang_pred score"), ("op9_importance_resampling", "doc_id log_weight gumbel_key selected"), ("op6_surrogates", "doc_id text n_entities")])
def test_one_row_for_each_document(spark, documents, name, columns):
    df = QUERIES[name](spark, SF)
    assert df.columns == columns.split()
    assert sorted(r.doc_id for r in df.select("doc_id").collect()) == sorted(r.doc_id for r in documents.collect())


def test_pipeline_stages(spark, documents, monkeypatch):
    import test_llm_jaccard as model
    from test_llm_decontaminate import brute as hits

    docs, texts = documents, {r.doc_id: r.text for r in documents.collect()}
    (_, identify), (_, copies), (_, benchmark), (_, private), (_, tokens) = corpus_pipeline.STAGES
    docs = identify(spark, docs, SF)
    assert docs.columns == documents.columns and {r.doc_id for r in docs.collect()} == set(texts)
    docs = copies(spark, docs, SF)
    monkeypatch.setattr(model, "shingle_set", partial(model.shingle_set, size=5))
    want = {d for d, (_, c) in model.brute(list(texts.items()), percent=80).items() if d == c}
    assert docs.columns == documents.columns and {r.doc_id for r in docs.collect()} == want
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = benchmark(spark, docs, SF)
    left = {r.doc_id: r.text for r in docs.collect()}
    found = {d: hits(texts[d], items) for d in want}
    assert set(left) == {d for d, (n, hit, _) in found.items() if hit <= n / 2}
    assert all((left[d] == texts[d]) == (found[d][1] == 0) for d in left)
    docs = private(spark, docs, SF)
    clean = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == documents.columns and set(clean) == set(left)
    seen = {m for t in left.values() for m in re.findall(r"\S+@\S+\.com|\+1 \(\d+\) \d+-\d+", t)}
    assert seen and not any(m in t for t in clean.values() for m in seen)
    last = tokens(spark, docs, SF).collect()
    assert {r.doc_id for r in last} == set(clean) and all(r.exact for r in last)


def test_pipeline_keeps_one_of_near_copies(spark, documents, monkeypatch):
    """The stage links by five-word shingles and 80 per cent, on the tables and on texts just above and below that."""
    import test_llm_jaccard as model

    five_words = partial(model.shingle_set, size=5)
    monkeypatch.setattr(model, "shingle_set", five_words)
    words = [f"w{i}" for i in range(200)]
    changed = lambda *at: " ".join(f"v{i}" if i in at else w for i, w in enumerate(words))
    # A word inside a text is in five of its 196 shingles: four words leave 176 of 216, five leave 171 of 221.
    own = [(-4, changed()), (-3, changed(40, 80, 120, 160)), (-2, changed(20, 60, 100, 140, 180)), (-1, "other words than those of all the rest")]
    rows = [(r.doc_id, r.text) for r in documents.collect()] + own
    want = {d for d, (_, c) in model.brute(rows, percent=80).items() if d == c}
    assert want & {-4, -3, -2, -1} == {-4, -2, -1}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["copies"](spark, docs, SF).collect()} == want


@pytest.mark.parametrize("name", ["language", "benchmarks", "tokens"])
def test_stages_hand_python_few_rows_at_a_time(spark, documents, name):
    """Also while their reader writes the table that they return; the stages after them run in the same executors."""
    before = spark.conf.get(ARROW)
    spark.conf.set(ARROW, "10000")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    try:
        dict(corpus_pipeline.STAGES)[name](spark, documents, SF)
        found = spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]
    finally:
        spark.conf.set(ARROW, before)
    assert found <= ARROW_ROWS


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
