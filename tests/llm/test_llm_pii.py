import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from profspark.llm import pii

MENTIONS = [
    ("email", "jane.doe7@mail3.example.com"),
    ("email", "JANE.DOE7@MAIL3.EXAMPLE.COM"),
    ("email", "bob@mail3.example.com"),
    ("email", "éclair_9@post.example.fr"),
    ("ip", "192.168.10.7"),
    ("ip", "10.0.0.1"),
    ("card", "4111 1111 1111 1111"),
    ("card", "4111111111111111"),
    ("ssn", "078-05-1120"),
    ("phone", "+1 (545) 555-9193"),
    ("phone", "(545) 555-9193"),
    ("iban", "DE89 3704 0044 0532 0130 00"),
    ("secret", 'token = "b64b244acde2e3b0aa8f051af1ec018ebaba3add"'),
    ("name_f_latin", "Laura Schmidt"),
    ("name_m_latin", "Peter Novak"),
    ("name_f_cyrillic", "Ольга Петрова"),
    ("name_m_cyrillic", "Иван Петров"),
]


@pytest.fixture(scope="module")
def changed(spark):
    rows = [(i, f"before {m}, after") for i, (_, m) in enumerate(MENTIONS)] + [(100, " and ".join(m for _, m in MENTIONS))]
    got = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    return {i: got[i].text.removeprefix("before ").removesuffix(", after") for i in range(len(MENTIONS))}, got[100]


def test_every_mention_is_replaced_in_its_own_form(changed):
    by, whole = changed
    shape = lambda s: re.sub(r"[a-zà-ÿ]", "a", re.sub(r"[A-ZÀ-Ý]", "A", re.sub(r"\d", "9", s)))
    for i, (kind, mention) in enumerate(MENTIONS):
        assert by[i] != mention
        if kind in ("card", "ssn", "phone", "iban", "secret", "email"):
            a, b = shape(by[i]), shape(mention)
            assert (a, len(by[i])) == (b, len(mention)) or kind in ("secret", "iban", "email") and len(by[i]) == len(mention)
        if kind == "ip":
            assert all(1 <= int(x) <= 255 for x in by[i].split("."))
        if kind.startswith("name"):
            assert by[i].split()[0] in pii.NAMES[kind[5:]].split() and by[i].istitle()
    assert whole.n_entities == len(MENTIONS) and whole.text == " and ".join(by[i] for i in range(len(MENTIONS)))


def test_coreference_and_distinctness(changed):
    by, _ = changed
    assert by[1] == by[0].upper() and by[7] == by[6].replace(" ", "")
    assert by[0].split("@")[1] == by[2].split("@")[1]
    distinct = [i for i in range(len(MENTIONS)) if i not in (1, 7)]
    assert all(by[a] != by[b] for a, b in combinations(distinct, 2))


def test_collisions_are_resolved(spark):
    """All one-letter addresses of a domain: 26 entities for 26 surrogates of one letter, so that draws collide."""
    rows = [(i, f"{chr(97 + i)}@x.example.com") for i in range(26)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.text for r in pii.pseudonymised(df, "k").orderBy("doc_id").collect()]
    assert len(set(got)) == 26 and not set(got) & {t for _, t in rows}
    assert got == [r.text for r in pii.pseudonymised(df.orderBy("text").repartition(5), "k").orderBy("doc_id").collect()]
    assert got != [r.text for r in pii.pseudonymised(df, "other key").orderBy("doc_id").collect()]


def test_ordinary_text_stays(spark):
    keep = ["version 3.11 of 2024-05-06", "about 1,234,567 people at 10.5 per cent", "a@b", "the token economy = good", "call 112 now", "Anna went home", "x = 5 (12) 34-56"]
    df = spark.createDataFrame(list(enumerate(keep)), "doc_id long, text string")
    assert [r.text for r in pii.pseudonymised(df, "k").orderBy("doc_id").collect()] == keep


def test_edges(edges, empty):
    found = pii.pseudonymised(edges, "k")
    assert found.columns == [*edges.columns, "n_entities"]
    assert sorted(map(str, found.drop("n_entities").collect())) == sorted(map(str, edges.collect()))
    assert pii.pseudonymised(empty, "k").count() == 0


def test_no_python_on_the_way(documents):
    plan = pii.pseudonymised(documents, "k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_long_secrets_are_replaced_to_their_end(spark):
    """Secrets that agree in their first 128 characters, one of 300 and one of 50,000."""
    head = "0123456789abcdef" * 8
    values = [head + "A1b2C3" * 28 + "Wxyz", head + "A1b2C3" * 28 + "Wxyw", head * 390 + "ab" * 40]
    assert list(map(len, values)) == [300, 300, 50_000]
    rows = [(i, f'before token = "{v}", after') for i, v in enumerate(values)]
    got = pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "k").orderBy("doc_id").collect()
    new = [re.fullmatch(r'before token = "([A-Za-z0-9]+)", after', r.text)[1] for r in got]
    assert list(map(len, new)) == [300, 300, 50_000] and len(set(new)) == 3
    assert not any(v[at : at + 20] in n for v, n in zip(values, new, strict=True) for at in range(0, 300 - 20))
    assert all(r.n_entities == 1 for r in got)


def test_few_texts_are_searched_for_entities(spark):
    """The patterns are tried in texts that have a part of a match only, and find there what they find one after another."""
    plain = "(" + "|".join(f"(?:{p})" for p in pii.PATTERNS.values()) + ")"
    rng = random.Random(1)
    names = [n for v in pii.NAMES.values() for n in v.split()]
    bits = [*"0123456789 .-+()@=:\"aZéЯ_%", "12", "345", "6789", " +49 ", "token", "API-key", "password: ", "DE89", " 3704", "x.com", "abcdefgh", "Novak", "Петров-Ли", "ÉAnna"]
    mixed = ["".join(rng.choice([rng.choice(bits), rng.choice(names), rng.choice(MENTIONS)[1], " "]) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    mixed += [f"{n} Novak" for n in names] + [f"un{n} Novak" for n in names]
    found = spark.createDataFrame([(t,) for t in mixed], "text string").select(
        F.coalesce(pii.entities(F.col("text")), F.array().cast("array<string>")).alias("new"), F.regexp_extract_all("text", F.lit(plain), F.lit(1)).alias("old")
    )
    assert found.where("new != old").count() == 0 and found.where("size(old) > 1").count() > 500
    ordinary = "In 2024 about 1,234,567 people read: it is 10.5 per cent (or 12 of 100) more than in May 2023 = a record. " * 20
    kept = spark.createDataFrame([(ordinary,)], "text string").select(F.col("text").rlike(pii.POSSIBLE).alias("searched"))
    assert not kept.first().searched
