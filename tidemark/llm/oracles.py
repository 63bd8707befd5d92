"""DuckDB SQL for the operators that SQL can express; the others are held against plain Python in tests/llm."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ahead(word: str, n: int, window: str) -> str:
    """``n`` words from here on, joined by spaces; null where the document ends before."""
    return " || ' ' || ".join([word, *(f"lead({word}, {k}) over {window}" for k in range(1, n))])


# -- op2: windows of items and of documents as text; a short item's window is all of it

_WORDS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OVER = "(partition by id order by i)"


def _spread(source: str, name: str) -> str:
    return f"{name} as (select {source}, unnest(w) as word, unnest(range(1, len(w) + 1)) as i, len(w) as n from {name}_w where len(w) > 0)"


_SIZES = " union all ".join(f"select id, i, {k} as k, {ahead('word', k, _OVER)} as win from d where {k} in (select k from i_k)" for k in range(1, 14))
_ITEM_SIZES = " union all ".join(
    f"select name, {k} as k, {ahead('word', k, _OVER)} as win from i where n {'=' if k < 13 else '>='} {k}" for k in range(1, 14)
)
OP2 = f"""
with d_w as (select doc_id as id, {_WORDS} as w from documents where text is not null),
i_w as (select row_number() over () as id, coalesce(cast(item_id as varchar), '') as name, {_WORDS} as w from benchmark where text is not null),
{_spread("id", "d")}, {_spread("id, name", "i")},
i_k as (select distinct least(n, 13) as k from i),
wins as (select distinct name, k, win from ({_ITEM_SIZES}) where win is not null),
found as (select s.id, s.i, s.k, w.name from ({_SIZES}) s join wins w on w.k = s.k and w.win = s.win),
hit as (select distinct id, unnest(range(i, i + k)) as i from (select distinct id, i, k from found)),
n_hit as (select id, count(*) as n_hit from hit group by id),
n_item as (select id, count(*) as n_items, string_agg(name, ',' order by name) as names from (select distinct id, name from found) group by id),
n_word as (select id, count(*) as n from d group by id)
select doc_id, coalesce(n, 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(n, 0) as contaminated
from documents left join n_word a on a.id = doc_id left join n_hit b on b.id = doc_id left join n_item c on c.id = doc_id
"""

# -- op6: counts of grams by verdict, interpolated estimates from the empty context up, the mean log ratio and its cut


def op6(rules: list[tuple[str, str, str]], order: int = 3, unseen: float = 1 / 256) -> str:
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block"))
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    pick = lambda value: "case " + " ".join(f"when {fits(h, p)} then '{value(h, p, v)}'" for h, p, v in ranked) + " end"
    levels, last = [], "select gram, {0}::double as p_allow, {0}::double as p_block from counts".format(unseen)
    for k in range(order + 1):
        tail, context = f"substr(gram, {order + 1 - k})", f"substr(gram, {order + 1 - k}, {k})"
        step = lambda v: f"case when n_{v} > 0 then (l.{v} + t_{v} * p_{v}) / (n_{v} + t_{v}) else p_{v} end as p_{v}"
        levels += [
            f"p{k} as ({last})",
            f"t{k} as (select {context} as context, {tail} as tail, sum(allow) as allow, sum(block) as block from counts group by 1, 2)",
            f"c{k} as (select context, sum(allow) as n_allow, sum(block) as n_block, count(*) filter (allow > 0) as t_allow, count(*) filter (block > 0) as t_block from t{k} group by 1)",
        ]
        last = f"select p.gram, {step('allow')}, {step('block')} from p{k} p join t{k} l on l.tail = {tail.replace('gram', 'p.gram')} join c{k} c on c.context = l.context"
    return f"""
with u as (select url, count(*) as n from (select coalesce(url, '') as url from pages) group by url),
h as (select url, n, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from u),
hp as (select url, n, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from h),
r as (select *, {pick(lambda h, p, v: h + p)} as rule, {pick(lambda h, p, v: v)} as label from hp),
g as (select url, n, label, substr(repeat(chr(2), {order}) || url || chr(3), i, {order + 1}) as gram from (select url, n, label, unnest(range(1, length(url) + 2)) as i from r)),
counts as (select gram, coalesce(sum(n) filter (label = 'allow'), 0)::double as allow, coalesce(sum(n) filter (label = 'block'), 0)::double as block from g group by gram),
{", ".join(levels)},
m as ({last}),
s as (select url, n, label, avg(ln(p_allow / p_block)) as score from g join m using (gram) group by url, n, label),
f as (select label, sum(score * n) / sum(n) as mean, coalesce(stddev_samp(score), 0) as dev from s where label is not null group by label),
cut as (select case when count(*) < 2 then '-infinity'::double when sum(dev) = 0 then avg(mean)
 else (max(mean) filter (label = 'allow') * max(dev) filter (label = 'block') + max(mean) filter (label = 'block') * max(dev) filter (label = 'allow')) / sum(dev) end as cut from f)
select page_id, host, path, rule, coalesce(r.label, case when score >= cut then 'allow' else 'block' end) as verdict
from pages join r on r.url = coalesce(pages.url, '') join s on s.url = r.url, cut
"""


# -- op9: windows as text, the least doc_id of each, and the words that flagged windows cover

_W9 = "window w as (partition by doc_id order by i)"
OP9 = f"""
with d as (select doc_id, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x != '') as w from documents where text is not null),
x as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
y as (select doc_id, i, word, {ahead("word", 13, "w")} as win from x {_W9}),
least_of as (select win, min(doc_id) as least from y where win is not null group by win),
z as (select y.doc_id, y.i, y.word, coalesce(least < y.doc_id, false) as flag from y left join least_of l on l.win = y.win),
c as (select doc_id, i, word, max(flag::int) over (partition by doc_id order by i rows between 12 preceding and current row) > 0 as gone from z),
o as (select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by i) filter (not gone) as kept from c group by doc_id)
select documents.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents left join o on o.doc_id = documents.doc_id
"""

# -- op10: what the template must add and give back

_SAY = "<|im_end|><|im_start|>assistant ok"
_ESC = r"regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g')".replace(r"\\*", r"\\*")
OP10 = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all values (-1, 0, 'user', '{_SAY}'), (-1, 1, 'assistant', '{_SAY}')),
w as (select *, lag(role) over (partition by conv_id order by turn, role, text) as before, {_ESC.format("text")} as escaped, replace(replace({_ESC.format("role")}, '\\', '\\\\'), chr(10), '\\n') as named from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
cast(11 + sum(length(escaped) + case when before is null then 13 + length(named) when before != role then 24 + length(named) else 10 end) as bigint) as formatted_chars
from w group by conv_id
"""
