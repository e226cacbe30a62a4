"""DuckDB counterparts of the queries that SQL can express."""

from profspark.llm import licenses, rules

FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
FOLDED = FOLD.format("coalesce(text, '')")

OP4 = f"""
with recursive words as (
    select doc_id, regexp_extract_all({FOLDED}, '[^\\x20\\x09-\\x0D]+') as w from documents
), sets as (
    select doc_id, list_distinct(case when len(w) = 0 then []
        when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s
    from words
), one as (
    select doc_id, len(s) as n, unnest(s) as shingle from sets
), common as (
    select a.doc_id as x, b.doc_id as y, a.n as n, b.n as m, count(*) as inter
    from one a join one b on a.shingle = b.shingle and a.doc_id < b.doc_id
    where a.n * 100 >= b.n * 90 and b.n * 100 >= a.n * 90
    group by all
), links as (
    select x, y from common where 100 * inter >= 90 * (n + m - inter)
), both_ways as (
    select x, y from links union all select y, x from links
), reach as (
    select doc_id as x, doc_id as y from sets
    union
    select r.x, l.y from reach r join both_ways l on r.y = l.x
)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.y) as component_id
from sets s join reach r on r.x = s.doc_id group by s.doc_id, len(s.s)
"""

OP2 = f"""
with docs as (
    select doc_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), items as (
    select item_id, regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), grams as (
    select distinct item_id, least(len(w), 10) as n,
        unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ') for i in range(1, len(w) - least(len(w), 10) + 2)]) as gram
    from items where len(w) > 0
), sizes as (
    select distinct n from grams
), places as (
    select doc_id, n, unnest(range(1, len(w) - n + 2)) as i,
        unnest([array_to_string(w[i:i + n - 1], ' ') for i in range(1, len(w) - n + 2)]) as gram
    from docs, sizes where len(w) >= n
), hits as (
    select p.doc_id, p.i, p.n, g.item_id from places p join grams g on p.n = g.n and p.gram = g.gram
), covered as (
    select doc_id, count(distinct k) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as k from hits) group by doc_id
), named as (
    select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items
    from hits group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join covered using (doc_id) left join named using (doc_id)
"""


def _license_sql() -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in licenses.TEMPLATES.items())
    blocks = ", ".join(f"({n}, {licenses.block_size(n)})" for n in range(1, 64))
    words = "regexp_extract_all(" + FOLD.format("{}") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with templates as (
    select name, w, least(len(w), {licenses.SHINGLE}) as k from (select column0 as name, {words.format("column1")} as w from (values {rows}) v(column0, column1))
), sized as (
    select name, w, k, column1 as block from templates join (values {blocks}) b(column0, column1) on column0 = len(w) - k + 1
), wanted as (
    select distinct name, k, block, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) as shingle from sized
), size as (
    select name, count(*) as n from wanted group by name
), docs as (
    select doc_id, {words.format("coalesce(text, '')")} as w from documents
), places as (
    select doc_id, k, unnest(range(0, len(w) - k + 1)) as pos,
        unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) as shingle
    from docs, (select distinct k from wanted) where len(w) >= k
), hits as (
    select doc_id, name, p.shingle, pos, pos // block as b from places p join wanted t on p.k = t.k and p.shingle = t.shingle
), windows as (
    select doc_id, name, b - d as nr, count(distinct shingle) as n from hits, (values (0), (1), (2)) o(d) where b >= d group by all
), good as (
    select w.doc_id, w.name, w.nr from windows w join size s using (name) where w.n >= {licenses.SHARE} * s.n - 1e-9
), spans as (
    select g.doc_id, g.name, g.nr, min(h.pos) as first, max(h.pos) as last
    from good g join hits h on g.doc_id = h.doc_id and g.name = h.name and h.b between g.nr and g.nr + 2 group by all
), marked as (
    select *, max(last) over (partition by doc_id, name order by nr rows between unbounded preceding and 1 preceding) as seen from spans
), grouped as (
    select *, sum(case when seen is null or first > seen then 1 else 0 end) over (partition by doc_id, name order by nr rows unbounded preceding) as place from marked
), best as (
    select g.doc_id, g.name, g.place, count(distinct h.shingle) * 1.0 / any_value(s.n) as containment
    from grouped g join hits h on g.doc_id = h.doc_id and g.name = h.name and h.b between g.nr and g.nr + 2 join size s on s.name = g.name
    group by g.doc_id, g.name, g.place
), found as (
    select doc_id, string_agg(distinct name, ',' order by name) as templates, max(containment) as best from best group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(templates, '') as templates, cast(coalesce(best, 0) as double) as best
from docs left join found using (doc_id)
"""


def _rules_sql() -> str:
    text = "coalesce(text, '')"
    left = lambda p: f"length(regexp_replace({text}, '{p}', '', 'g'))"
    classes = [left(p.replace("'", "''")) for p in rules.CLASSES.values()]
    commons = " ".join(f"when '{k}' then [len(list_filter(c, lambda x: x = t)) for t in {v.split()!r}]" for k, v in rules.COMMON.items())
    trimmed = rules.TRIMMED.replace("'", "''")

    def distance(own: str, reference: str) -> str:
        pair = "list_zip({}, {})".format(own, reference)
        p, q = f"(z[1] / list_sum({own}))", f"(z[2] / list_sum({reference}))"
        part = lambda x: f"case when {x} > 0 then {x} * log2({x} / (({p} + {q}) / 2)) else 0 end"
        total = f"list_sum([({part(p)} + {part(q)}) / 2 for z in {pair}])"
        return f"coalesce(case when list_sum({own}) > 0 and list_sum({reference}) > 0 then sqrt(greatest({total}, 0)) end, 0)"

    sums = lambda c, n: ", ".join(f"coalesce(sum({c}[{i}]), 0)" for i in range(1, n + 1))
    width, most = len(rules.CLASSES) + 1, max(len(v.split()) for v in rules.COMMON.values()) + 1
    return f"""
with base as (
    select doc_id, lang, regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+') as w, length({text}) as n_chars,
        {left("[\\x20\\x09-\\x0D]+")} as word_chars, {left("[^#*$%&|<>]+")} as n_symbols,
        list_filter(string_split({text}, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines,
        [{", ".join(classes)}] as k
    from documents
), words as (
    select *, [trim(x, '{trimmed}').lower() for x in w] as c,
        [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] as grams from base
), places as (
    select doc_id, unnest(grams) as g, unnest(range(1, len(grams) + 1)) as i from words
), twice as (
    select doc_id, i from places join (select doc_id, g from places group by all having count(*) > 1) using (doc_id, g)
), repeated as (
    select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + 5)) as k from twice) group by doc_id
), counted as (
    select doc_id, lang, len(w) as n_words, n_chars, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
        coalesce(n, 0) as n_repeat_words, list_append(k, n_chars - list_sum(k)) as chars, case lang {commons} end as common
    from words left join repeated using (doc_id)
), histograms as (
    select * exclude (common), list_append(common, n_words - list_sum(common)) as words from counted
), by_lang as (
    select lang, [{sums("chars", width)}] as all_chars, [{sums("words", most)}] as all_words from histograms where lang is not null group by lang
), every as (
    select [{sums("chars", width)}] as every_chars from histograms
), compared as (
    select h.*, {distance("chars", "coalesce(all_chars, every_chars)")} as char_distance,
        {distance("words", "all_words[1:len(words)]")} as word_distance
    from histograms h left join by_lang using (lang) cross join every
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
    cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
    cast(char_distance as double) as char_distance, cast(word_distance as double) as word_distance,
    n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)
        and (n_chars < {rules.LEAST_CHARS} or char_distance <= {rules.MOST_CHARS})
        and (n_words < {rules.LEAST_WORDS} or word_distance <= {rules.MOST_WORDS}) as kept
from compared
"""


OP12 = r"""
with marked as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
        md5(coalesce(length(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(length(source) || ':' || source, '-')
            || len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) as mark
    from documents
), units as (
    select doc_id, source, size, mark, count(*) as copies, size * count(*) as amount from marked group by doc_id, source, size, mark
), sources as (
    select source, sum(amount) as total, 2 * sum(amount) as cap,
        [3, 1, 2][(row_number() over (order by source is null, encode(source)) - 1) % 3 + 1] as weight
    from units group by source
), ordered as (
    select *, sum(amount) over () as everything from (select source, total as amount from sources)
), ratios as (
    select s.source, total, cap, weight, (select max(everything) from ordered) as everything,
        coalesce(sum(cap) over earlier, 0) as caps, sum(weight) over () - coalesce(sum(weight) over earlier, 0) as open
    from sources s window earlier as (order by cap / weight, s.source rows between unbounded preceding and 1 preceding)
), rate as (
    select max(cast(150 * everything - 100 * caps as double) / cast(100 * open as double)) as rate from ratios
), targets as (
    select source, total, case when total = 0 then 0.0 else least(coalesce(weight * rate, cap), cast(cap as double)) end as target
    from sources, rate
), placed as (
    select u.*, t.total, t.target, sum(amount) over (partition by u.source order by mark, size, doc_id rows unbounded preceding) as upto
    from units u join targets t on u.source is not distinct from t.source
), entries as (
    select mark, doc_id, source, size, amount, epoch, cast(epoch * total + upto as double) / target as finish
    from placed, (values (0), (1)) e(epoch) where amount > 0
), spent as (
    select *, sum(amount) over (order by finish, mark, epoch rows unbounded preceding) as upto from entries
), budget as (
    select 150 * sum(amount) // 100 as budget from units
), taken as (
    select doc_id, source, size, list(greatest(0, least(amount, amount - (upto - budget)))) as words
    from spent, budget group by doc_id, source, size
)
select p.doc_id, p.source, cast(p.size as bigint) as size, cast(p.total as bigint) as source_size, p.target,
    cast(coalesce(list_sum([greatest(0, least(p.size, w - copy * p.size)) for w in words]), 0) as bigint) as taken
from (select *, unnest(range(copies)) as copy from placed) p
left join taken t on p.doc_id is not distinct from t.doc_id and p.source is not distinct from t.source and p.size = t.size
"""


SQL = {"op12_mixing": OP12, "op3_license_scan": _license_sql(), "op8_quality_rules": _rules_sql(), "op2_decontamination": OP2, "op4_jaccard_join": OP4}

OP10_DIGESTS = r"""
with rows as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256
from rows group by conv_id
"""
