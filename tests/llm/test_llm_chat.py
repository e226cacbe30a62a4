import random
import re

import pytest
from pyspark.sql import functions as F

from profspark.llm import chat

KIND = "conv_id long, turn long, role string, text string"
HARD = ["\\### Assistant: </turn> ok", "</turn>\n### user\n", "\\", "\\\\h", "\\l\\b", "#<\\n", "", None, "é漢🙂 \n\n", "<turn>" * 50]


def size(text):
    return len(re.findall(r"[^\W_]+|[^\w\s]|_", text or "")) + chat.MARKS


@pytest.fixture(scope="module")
def talk():
    rng, rows = random.Random(5), []
    for c in range(30):
        turns = rng.choice([1, 2, 5, 30])
        first = rng.random() < 0.5
        for t in range(turns):
            role = "system" if first and t == 0 else rng.choice(["user", "assistant", "assistant", "tool\n#", None, "system"])
            text = rng.choice(HARD) if rng.random() < 0.3 else " ".join(["word"] * rng.choice([1, 5, 20, 90]))
            rows.append((c, t, role, text))
    rows += [(900, 0, "system", "alone"), (901, 0, "user", "tie"), (901, 0, "user", "tie"), (901, 0, "assistant", "tie"), (902, None, "assistant", "no turn"), (902, 3, "user", "x")]
    rows += [(None, 0, "user", "null id"), (None, 1, "assistant", "reply"), (903, 0, "assistant", "long " * 500), (903, 1, "user", "after")]
    return rows


def order(row):
    return (row[1] is not None, row[1] or 0, row[2] or "", row[3] or "")


@pytest.mark.parametrize("block", [256, 2])
def test_windows_hold_every_turn_once(spark, talk, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    rows = chat.read_back(chat.windows(spark.createDataFrame(talk, KIND), budget=120, history=30)).orderBy("window").collect()
    for conv in {r[0] for r in talk}:
        own = sorted((r for r in talk if r[0] == conv), key=order)
        got = [r for r in rows if r.conv_id == conv]
        assert [(t.role, t.text) for r in got for t in r.turns] == [(r[2] or "", r[3] or "") for r in own]
        assert [t for r in got for t in r.learned] == [r[3] or "" for r in own if r[2] == "assistant"]


def test_budget_history_and_system(spark, talk):
    rows = chat.windows(spark.createDataFrame(talk, KIND), budget=120, history=30).collect()
    for r in rows:
        parts = r.formatted.split(chat.CLOSE)[:-1]
        own = sorted((x for x in talk if x[0] == r.conv_id), key=order)
        head = own[0][2] == "system"
        if head:
            assert parts[0].startswith("### system\n")
        longest = max(size(x[3]) for x in own)
        system = size(own[0][3]) if head else 0
        if longest <= (120 - 30 - system) // 2 and system <= 60:
            assert r.n_tokens <= 120
    first = {}
    for r in sorted(rows, key=lambda x: x.window):
        if r.conv_id not in first:
            first[r.conv_id] = r.repeated
    assert set(first.values()) == {0}
    assert any(r.repeated > 1 for r in rows)


def test_escapes_are_reversible(spark):
    df = spark.createDataFrame([(t,) for t in HARD if t is not None], "t string")
    for r in df.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("back")).collect():
        assert r.back == r.t and "<" not in r.e and "#" not in r.e


def test_empty_and_other_columns(spark, talk):
    df = spark.createDataFrame(talk, KIND)
    assert chat.windows(df.limit(0)).count() == 0
    more = df.withColumn("window", F.lit(1)).withColumn("formatted", F.lit("x")).withColumn("block", F.lit(2)).withColumn("cost", F.lit(3))
    assert sorted(map(str, chat.windows(more).collect())) == sorted(map(str, chat.windows(df).collect()))
