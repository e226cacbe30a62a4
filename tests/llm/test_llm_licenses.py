import random

from profspark.llm import licenses
from profspark.llm.words import ALNUM, encoded, words

LONG = licenses.TEMPLATES["mit-grant"]


def names(text, templates=licenses.TEMPLATES):
    return {m[0] for m in licenses.Index(templates).matches(words(encoded(text), ALNUM)[0], licenses.SHARE)}


def test_templates_inside_long_texts_are_found_wherever_they_stand():
    rng, index = random.Random(2), licenses.Index(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        for at in (0, 1, 7, 400, 4001):
            noise = [f"n{rng.randrange(5000)}" for _ in range(6000)]
            noise[at:at] = text.upper().split()
            found = index.matches(words(encoded(" ".join(noise)), ALNUM)[0], licenses.SHARE)
            assert [(m[0], m[1]) for m in found] == [(name, 1.0)], (name, at)


def test_near_copies_and_others():
    w = LONG.split()
    w[-1] = "docs"
    assert names("some words before " + " ".join(w)) == {"mit-grant"}
    w[5], w[12] = "paid", "thing"
    assert names(" ".join(w)) == set()
    assert names("all rights are reserved") == set() and names("All Rights RESERVED") == {"all-rights-reserved"}


def test_pieces_change_nothing(monkeypatch):
    text = " ".join(f"n{i % 997}" for i in range(3000)) + " " + LONG
    whole = licenses.Index(licenses.TEMPLATES).matches(words(encoded(text), ALNUM)[0], licenses.SHARE)
    monkeypatch.setattr(licenses, "PIECE", 10)
    assert licenses.Index(licenses.TEMPLATES).matches(words(encoded(text), ALNUM)[0], licenses.SHARE) == whole != []


def test_edges(edges, empty):
    found = licenses.scanned(edges)
    assert found.columns == [c for c in edges.columns if c != "n_words"] + ["n_words", "matches"]
    assert all(r.matches == [] for r in found.collect())
    assert licenses.scanned(empty).count() == 0
    own = licenses.scanned(edges, {"fox": "quick brown fox jumps over the lazy dog", "none": "!"})
    assert {r.doc_id for r in own.collect() if r.matches} == {1, 2}
