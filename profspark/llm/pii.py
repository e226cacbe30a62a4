"""Personal data: detected entities get keyed surrogates of their own type, with DataFrame functions only.

A dictionary over the whole corpus maps each entity (type and normal form) to one surrogate, so that equal entities stay
equal and different ones different, across texts. A surrogate is drawn from a keyed digest: digits stay digits, letters
stay letters of their script, names keep their gender and script, and case and separators of each mention are kept. If
two entities draw the same one, or one that occurs in the corpus, all but the first draw again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profspark.llm.rules import let
from profspark.llm.scratch import Scratch, packed

# Given names by gender and script; a surrogate is another one of the same list.
NAMES = {
    "f_latin": "Anna Maria Laura Julia Sofia Emma Clara Alice Marta Elena Sarah Emily Olivia Hannah Camille Lucie Carmen Ingrid Monika Claire",
    "m_latin": "Peter Paul Thomas Martin Daniel David Michael John James Robert Hans Klaus Pierre Michel Carlos Miguel Pablo Stefan Lukas Antoine",
    "f_cyrillic": "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна Екатерина Юлия",
    "m_cyrillic": "Иван Алексей Дмитрий Сергей Андрей Николай Михаил Павел Владимир Виктор",
}
SYLLABLES = {
    "latin": "ba be bo da de do ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве во".split(),
}
#: Types in the order of their precedence: where two patterns match at one place, the first counts.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)+",
    "secret": r"(?i:token|secret|password|api[_\-]?key)\s{0,3}[=:]\s{0,3}\"?[A-Za-z0-9_\-]{16,}+\"?",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d\-])\d(?:[ \-]?\d){12,18}(?![\d\-]*\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]*\d)",
    "phone": r"(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3}[ .\-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)|(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?!\d)",
    **{f"name_{k}": r"\b(?:" + "|".join(v.split()) + r") \p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?" for k, v in NAMES.items()},
}


def _by_first(names: list[str]) -> str:
    """The names by their first letter, so that few are tried at a place. A space comes after them, so order is free."""
    rest = {a: "|".join(n[1:] for n in names if n[0] == a) for a in dict.fromkeys(n[0] for n in names)}
    return "(?:" + "|".join(f"{a}(?:{r})" for a, r in rest.items()) + ")"


# What a match starts with, looked at before the rest of its pattern is tried. It rules out nothing that a pattern matches.
STARTS = {"email": r"[\p{L}\p{N}._%+\-]", "secret": "[tspaTSPA]", "iban": "[A-Z]", "phone": r"[+(\d]", **dict.fromkeys(("ip", "card", "ssn"), r"\d")}
NAMED = {f"name_{k}": r"(?=\p{Lu})" + PATTERNS[f"name_{k}"].replace("(?:" + "|".join(v.split()) + ")", _by_first(v.split())) for k, v in NAMES.items()}
ANY = "(" + "|".join(f"(?:(?={STARTS[k]})(?:{p}))" if k in STARTS else f"(?:{NAMED[k]})" for k, p in PATTERNS.items()) + ")"
# A part of every match, cheap to look for: the few texts that have one are searched for entities.
POSSIBLE = (
    r"@[\p{L}\p{N}\-]"
    r"|[=:]\s{0,3}\"?[A-Za-z0-9_\-]{16}"
    r"|(?=[\d(+])(?:(?:\d{1,3}\.){3}\d|\d(?:[ \-]?\d){12}|\d{3}-\d{2}-\d{4}|\d{2}(?: ?[A-Z0-9]{4}){3}"
    r"|\(\d{2,4}\)[ .\-]?\d{3}|\+\d{1,3}(?:[ .\-]?\d{2,4}){2}|\d{3}[.\-]\d{3}[.\-]\d{4})"
    r"|(?=\p{Lu})\b" + _by_first([n for v in NAMES.values() for n in v.split()]) + r" \p{Lu}"
)
ROUNDS = 64


def entities(text: Column) -> Column:
    return F.when(text.rlike(POSSIBLE), F.regexp_extract_all(text, F.lit(ANY), F.lit(1)))


def kind(entity: Column) -> Column:
    return reduce(lambda out, k: F.when(entity.rlike("^(?:" + PATTERNS[k] + ")$"), k).otherwise(out), reversed(PATTERNS), F.lit(None).cast("string"))


def normal(entity: Column, type_: Column) -> Column:
    """What mentions of one entity have in common: digits of numbers, else the text in lower case."""
    return (
        F.when(type_ == "ip", entity)
        .when(type_.isin("card", "ssn", "phone"), F.regexp_replace(entity, "[^0-9]", ""))
        .when(type_ == "secret", F.regexp_extract(entity, r"[=:]\s*\"?([A-Za-z0-9_\-]+)", 1))
        .when(type_ == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .otherwise(F.lower(entity))
    )


def _draw(digest: Column, i: Column, size: int) -> Column:
    """A number below `size` for position i; digest is 64 hexadecimal digits. Digits far apart make later positions."""
    at = F.pmod(i * 4, F.lit(61)) + 1
    return F.pmod(F.conv(F.substring(digest, at, F.lit(4)), 16, 10).cast("int") + i * 7, F.lit(size)).cast("int")


def _letters(first: str, last: str) -> str:
    return "".join(map(chr, range(ord(first), ord(last) + 1)))


LOWER = {"[a-f]": "abcdef", "[a-z]": _letters("a", "z"), "[а-я]": _letters("а", "я"), "[α-ρσ-ω]": _letters("α", "ρ") + _letters("σ", "ω"), "[à-öø-ÿ]": _letters("à", "ö") + _letters("ø", "ÿ")}


def _char(c: Column, i: Column, digest: Column, hexadecimal: Column) -> Column:
    """Another character of the same class; characters of scripts not listed become digits, marks stay."""

    def pick(chars: str) -> Column:
        return F.substring(F.lit(chars), _draw(digest, i, len(chars)) + 1, F.lit(1))

    out = F.when(c.rlike("[0-9]"), _draw(digest, i, 10).cast("string")).when(hexadecimal & c.rlike("[a-f]"), pick(LOWER["[a-f]"]))
    for pattern, chars in list(LOWER.items())[1:]:
        out = out.when(c.rlike(pattern), pick(chars))
    return out.when(c.rlike(r"\p{L}"), _draw(digest, i, 10).cast("string")).otherwise(c)


def _spelled(text: Column, digest: Column, hexadecimal: Column) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: _char(c, i, digest, hexadecimal)), "")


def _name(normal_form: Column, type_: Column, digest: Column, attempt: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, names in NAMES.items():
        listed = [n.lower() for n in names.split()]
        syllables = SYLLABLES[k[2:]]
        given = F.get(F.array(*map(F.lit, listed)), _draw(digest, F.lit(0), len(listed)))
        parts = [F.get(F.array(*map(F.lit, syllables)), _draw(digest, F.lit(i), len(syllables))) for i in range(1, 6)]
        # Later draws have longer names, so that there is always room for one more.
        surname = F.concat(*parts[:3], F.when(attempt > 1, parts[3]).otherwise(""), F.when(attempt > 3, parts[4]).otherwise(""))
        out = F.when(type_ == f"name_{k}", F.concat(given, F.lit(" "), surname)).otherwise(out)
    return out


def surrogate(type_: Column, normal_form: Column, key: str, attempt: Column) -> Column:
    """The surrogate's normal form: a function of the key, the entity and the number of the draw."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), type_, normal_form, attempt.cast("string")), 256)
    at = F.instr(normal_form, "@")
    local = F.substring(normal_form, F.lit(1), at - 1)
    domain = F.substring(normal_form, at + 1, F.length(normal_form))
    # One domain becomes one other domain in all addresses; its last part, as `com`, stays.
    last = F.regexp_extract(domain, r"\.[^.]+$", 0)
    own = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain), 256)
    # Later draws are longer, since the names of an address may be used up.
    more = F.when(attempt > 2, F.substring(F.translate(digest, "0123456789", "ghijklmnop"), F.lit(1), attempt)).otherwise("")
    email = F.concat(_spelled(local, digest, F.lit(False)), more, F.lit("@"), _spelled(F.substring(domain, F.lit(1), F.length(domain) - F.length(last)), own, F.lit(False)), last)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_draw(digest, i, 223) + 1).cast("string")), ".")
    iban = F.concat(F.substring(normal_form, 1, 2), F.upper(_spelled(F.lower(F.substring(normal_form, F.lit(3), F.length(normal_form))), digest, F.lit(False))))
    # A secret may be long: what all its characters share is computed once.
    drawn = lambda d, h: F.transform(F.split(normal_form, ""), lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(_char(F.lower(c), i, d, h))).otherwise(_char(c, i, d, h)))
    secret = let(digest, lambda d: let(~normal_form.rlike("[G-Zg-z_\\-]"), lambda h: F.array_join(drawn(d, h), "")))
    return (
        F.when(type_ == "email", email)
        .when(type_ == "ip", octets)
        .when(type_ == "iban", iban)
        .when(type_ == "secret", secret)
        .when(type_.startswith("name_"), _name(normal_form, type_, digest, attempt))
        .otherwise(_spelled(normal_form, digest, F.lit(False)))
    )


def written(entity: Column, type_: Column, normal_form: Column, own: Column) -> Column:
    """The surrogate in the form of a mention: its separators, its case, or what stands around a secret."""
    numbered = F.array_join(
        F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(own, F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)),
        "",
    )
    spaced = F.array_join(
        F.transform(F.split(entity, ""), lambda c, i: F.when(c != " ", F.substring(own, F.length(F.replace(F.substring(entity, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1))).otherwise(c)),
        "",
    )
    cased = F.when(F.upper(entity) == entity, F.upper(own)).otherwise(
        F.array_join(F.transform(F.split(own, ""), lambda c, i: F.when(F.substring(entity, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    )
    return (
        F.when(type_.isin("card", "ssn", "phone"), numbered)
        .when(type_ == "iban", spaced)
        .when(type_ == "secret", F.replace(entity, normal_form, own))
        .when(type_.startswith("name_"), F.when(F.upper(entity) == entity, F.upper(own)).otherwise(F.initcap(own)))
        .when(type_ == "email", cased)
        .otherwise(own)
    )


def dictionary(found: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(type, normal, own) of the distinct (type, normal) in `found`; own differs from every other own and every normal."""
    known = scratch.keep(found.select("type", "normal").distinct())
    todo, done = known.withColumn("attempt", F.lit(0)), []
    for _ in range(ROUNDS):
        drawn = todo.withColumn("own", surrogate(F.col("type"), F.col("normal"), key, F.col("attempt")))
        real = known.select("type", F.col("normal").alias("own"), F.lit(True).alias("taken"))
        taken = reduce(DataFrame.unionByName, [d.select("type", "own", F.lit(True).alias("taken")) for d in done], real)
        order = F.row_number().over(Window.partitionBy("type", "own").orderBy("normal"))
        ruled = drawn.withColumn("order", order).join(taken.distinct(), ["type", "own"], "left")
        ruled = scratch.keep(ruled.select("type", "normal", "attempt", "own", ((F.col("order") == 1) & F.col("taken").isNull()).alias("free")))
        done.append(ruled.where("free").select("type", "normal", "own"))
        if ruled.where("not free").isEmpty():
            return reduce(DataFrame.unionByName, done)
        todo = ruled.where("not free").select("type", "normal", (F.col("attempt") + 1).alias("attempt"))
    raise ValueError(f"no free surrogate in {ROUNDS} draws: a type has too few for its entities")


def pseudonymised(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """`df` with all entities in its text replaced, and n_entities (long), which replaces a column of that name.

    Entities: e-mail addresses, secrets (`token = ...`), IP addresses, account and card numbers, social security
    numbers, telephone numbers, and known given names with a surname, of either gender, in Latin or Cyrillic script.
    Null and empty texts stay, with no entities. Repeated rows are changed alike; ties between entities that draw the
    same surrogate go to the first in order, whatever the order of rows. Texts are read as a whole.
    """
    scratch = Scratch(df.sparkSession)
    rows = packed(df, text=F.col(text_col)).withColumn("found", F.coalesce(entities(F.col("text")), F.array().cast("array<string>")))
    split = scratch.keep(rows.where(F.size("found") > 0).withColumn("at", F.monotonically_increasing_id()))
    mentions = split.select("at", F.explode(F.array_distinct("found")).alias("entity"))
    typed = mentions.select("at", "entity", kind(F.col("entity")).alias("type")).withColumn("normal", normal(F.col("entity"), F.col("type")))
    typed = scratch.keep(typed)
    names = scratch.keep(dictionary(typed, key, scratch))
    replaced = typed.join(names, ["type", "normal"]).select("at", F.struct("entity", written(F.col("entity"), F.col("type"), F.col("normal"), F.col("own")).alias("new")).alias("pair"))
    maps = replaced.groupBy("at").agg(F.map_from_entries(F.collect_list("pair")).alias("map"))
    parts = F.split("text", ANY, -1)
    # The text between the entities, and the entities' surrogates, in turn.
    new = F.array_join(F.zip_with(parts, F.transform("found", lambda e: F.element_at("map", e)), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = split.join(maps, "at").select("row", new.alias("text"), F.size("found").cast("long").alias("n_entities"))
    same = rows.where(F.size("found") == 0).select("row", "text", F.lit(0).cast("long").alias("n_entities"))
    names_of = [f.name for f in rows.schema["row"].dataType.fields]
    out = [F.col("text").alias(n) if n == text_col else F.col("row").getField(n).alias(n) for n in names_of if n.lower() != "n_entities"]
    return changed.unionByName(same).select(*out, "n_entities")
