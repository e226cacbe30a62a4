import math
import re
from collections import Counter

from profspark.llm import rules


def repeats(w, size=5):
    grams = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
    count = Counter(grams)
    return len({k for i, g in enumerate(grams) if count[g] > 1 for k in range(i, i + size)})


def test_counts_equal_brute_force(spark):
    texts = ["a b c d e a b c d e", "a a a a a a a", "x y\nx y\n \n\nx y\nz", "# $$ ok | <b> & *", "one two three four five six one two three four five", "é" * 3 + " ß\t漢字 🙂", "", None, "  \n\n "]
    texts += ["a b c d e f " * k for k in range(1, 5)]
    for i, r in enumerate(rules.assessed(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")).orderBy("doc_id").collect()):
        t = texts[i] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeats(w))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (len(w) < 10 or 100 * want[4] > 20 * len(w))
        assert not (r.base_failed and r.kept) and 0 <= r.char_distance <= 1 and 0 <= r.word_distance <= 1


def test_divergence(spark):
    prose = "the house of the old man and a tree in the garden that is for you and it was as big as the sea by this road with on "
    junk = "#$% 12 <<>> || && ** 77 ^^ ~~ __ == ++ {{ }} [[ ]] @@ 99 %% $$ ## 31 " + "".join(f"{i}#|" for i in range(100))
    rows = [(i, " ".join(x + str(i) * (x == "tree") for x in prose.split()) + ".", "en") for i in range(40)] + [(99, " ".join(f"{x}{i}" for i in range(10) for x in junk.split()[:12]), "en"), (100, "short text in english of ten words and no more", None)]
    got = {r.doc_id: r for r in rules.assessed(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(40)) and not got[99].base_failed and not got[99].kept
    assert got[100].kept and got[100].word_distance == 0
    assert math.isclose(got[0].char_distance, got[0].char_distance) and got[99].char_distance > 0.5


def test_edges(edges, empty):
    found = rules.assessed(edges)
    assert found.columns == [c for c in edges.columns if c != "n_words"] + [*rules.COUNTS, "char_distance", "word_distance", "base_failed", "kept"]
    rows = found.collect()
    assert len(rows) == edges.count() and not any(r.kept for r in rows if not (r.text or "").strip())
    assert rules.assessed(empty).count() == 0


def test_every_language_has_its_own_reference(spark):
    """Prose of a fifth language beside much English is near its own histogram, and far from that of all rows."""
    english = "the house of the old man and a tree in the garden that is for you and it was as big as the sea by this road with on "
    russian = "старый дом стоял у реки, и дети каждый день ходили туда смотреть на воду и слушать рассказы своего деда о далёких городах. "
    mark = lambda text, i: " ".join(f"{x}{chr(97 + k % 26) * (k % 5)}{i}" for k, x in enumerate(text.split() * 3))
    rows = [(i, mark(english, i), "en") for i in range(30)] + [(100 + i, mark(russian, i), "ru") for i in range(3)] + [(200, mark(russian, 9), None)]
    got = {r.doc_id: r for r in rules.assessed(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[100 + i].kept and got[100 + i].char_distance < 0.1 and got[100 + i].word_distance == 0 for i in range(3))
    assert got[200].char_distance > rules.MOST_CHARS and not got[200].kept
