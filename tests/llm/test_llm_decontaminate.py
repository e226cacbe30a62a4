import random
import re

import pytest

from profspark.llm import decontaminate


def norm(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, size=10):
    w = norm(text)
    hit, found = set(), set()
    for item, t in items:
        v = norm(t)
        n = min(size, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit.update(range(j, j + n))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.fixture
def case():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(30)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 9, 10, 11, 40])))) for i in range(15)] + [(None, "aa bb cc"), (3, None), (20, "Dd-ee, ff!")]
    docs = []
    for d in range(40):
        w = [word() for _ in range(rng.randrange(80))]
        if rng.random() < 0.6:
            w[10:10] = items[rng.randrange(15)][1].upper().split()
        docs.append((d, ", ".join(w)))
    return [*docs, (99, None), (100, ""), (101, "x aa bb cc dd ee ff y"), (101, "x aa bb cc dd ee ff y")], items


@pytest.mark.parametrize("blocks", [1, 3])
def test_equals_brute_force(spark, case, monkeypatch, blocks):
    docs, items = case
    if blocks > 1:
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 100)
        monkeypatch.setattr(decontaminate, "CHUNK_WORDS", 8)
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((r.doc_id, (r.n_words, r.n_hit, r["items"])) for r in found.collect())
    assert got == sorted((d, brute(t, items)) for d, t in docs)
    for r in found.where("n_hit > 0").collect():
        w = norm(r.text)
        for s in r.spans:
            assert norm(r.text.encode()[s.start : s.end].decode()) == w[s.first : s.last + 1]


def test_removal_and_edges(spark, edges, empty):
    items = spark.createDataFrame([(1, "quick brown fox"), (2, None), (2, "")], "item_id long, text string")
    cut = decontaminate.decontaminated(edges, items)
    assert cut.columns == edges.columns and cut.count() == edges.count()
    assert cut.where("doc_id = 2").first().text == "the  jumps over the lazy dog by the river bank today"
    assert decontaminate.decontaminated(edges, items, drop_share=0.0).count() == edges.count() - 3
    assert {r.n_hit for r in decontaminate.contamination(edges, items.limit(0)).collect()} == {0}
    assert decontaminate.contamination(empty, items).count() == 0
    assert len(set(decontaminate.contamination(edges, items).columns)) == len(set(edges.columns) | {"n_hit", "spans"})
