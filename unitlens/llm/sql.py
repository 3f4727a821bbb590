"""DuckDB twins of the registered queries of this subpackage."""

from __future__ import annotations

from unitlens.llm import quality_rules as rules

_SPACES = r"[\x20\x09-\x0D]+"


def _rule_facts(documents: str = "documents") -> str:
    return rf"""
  words as (
    select doc_id, lang, coalesce(text, '') as t,
           list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACES}'), lambda w: w <> '') as w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
    from {documents}),
  windows as (
    select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
    from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from words where len(w) > 2)),
  covered as (
    select doc_id, count(distinct p) as n from (
      select doc_id, unnest([i, i + 1, i + 2]) as p
      from (select *, count(*) over (partition by doc_id, g) as c from windows) where c > 1)
    group by doc_id),
  facts as (
    select words.doc_id, coalesce('=' || lang, '') as stratum, len(w)::bigint as n_words,
           length(regexp_replace(t, '{_SPACES}', '', 'g'))::bigint as word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
           length(regexp_replace(t, '[^!]', '', 'g'))::bigint as n_exclaims,
           length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g'))::bigint as n_upper,
           len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
           coalesce(covered.n, 0)::bigint as n_repeat_words
    from words left join covered on words.doc_id = covered.doc_id),
  judged as (
    select *, n_words < {rules.MIN_WORDS} or 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words as base_failed
    from facts)"""


def _rule_cutoffs() -> str:
    over = " or ".join(f"{text.replace('0D', '0')} > {name}_cut" for name, (text, _) in rules.RULES.items())
    grid = ", ".join("(" + ", ".join(map(str, [i, *(f"{step[name]}::double" for name in rules.RULES)])) + ")" for i, step in enumerate(rules.steps()))
    names = ", ".join(f"{name}_cut" for name in rules.RULES)
    return f"""
  ladder(step, {names}) as (values {grid}),
  good as (
    select * from judged
    where not base_failed and doc_id in (select doc_id from labels where quality = 1)),
  strata as (select stratum, count(*) as n, {rules.ALPHA} / count(*) over () as level from good group by stratum),
  pools as (select stratum, level, case when (1 - {rules.LIMIT}) ** n <= level then stratum else '~' end as pool from strata),
  hits as (
    select pool, level, step, count(*) as n, count(*) filter ({over}) as k
    from good join pools using (stratum), ladder group by all),
  tails as (
    select *, case when k >= n * {rules.LIMIT} then 1.0 else list_sum(list_transform(range(0, k + 1), lambda j:
        exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rules.LIMIT}) + (n - j) * ln(1 - {rules.LIMIT})))) end as p
    from hits),
  passed as (select *, max(p) over (partition by pool order by step) as worst from tails),
  chosen as (select pool, max(step) as step from passed where worst <= level group by pool),
  over as (
    select distinct doc_id from judged join pools using (stratum) join chosen using (pool) join ladder using (step)
    where n_words > 0 and ({over}))"""


def op8() -> str:
    return f"""
with {_rule_facts()}, {_rule_cutoffs()}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and doc_id not in (select doc_id from over) as kept
from judged"""


ORACLES: dict[str, str] = {"op8_quality_rules": op8()}


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text: eight shifts a byte by the reflected polynomial."""
    shifts = "list_reduce([{0}] || range(8), lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)"
    byte = "xor(c, ascii(substr({0}, i::int, 1))::bigint)".format(text)
    return f"xor(list_reduce([4294967295::bigint] || range(1, length({text}) + 1), lambda c, i: {shifts.format(byte)}), 4294967295)"


def op12() -> str:
    """Left to right over the turns, a state at a time, with the least (cost, audit) and what it rebuilds."""
    return rf"""
with recursive
  known as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
           coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key, coalesce('=' || conv_id, '') as c
    from conversations),
  hit as (select *, {_crc32("key")} % 20 as h from known),
  rows as (
    select c, turn, case h when 4 then 'user' else role end as role,
           case h when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
           unnest(range(case h when 3 then 2 else 1 end)) as copy
    from hit where h <> 0),
  placed as (
    select *, row_number() over (partition by c order by turn nulls first, role, text, copy) as i,
           row_number() over (partition by c, role, text order by turn nulls first, copy) as seen,
           regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as last
    from rows),
  judged as (
    select *, left(role, 1) as initial,
           case when last = '' then 'b' when seen > 1 then 'd' when last not in ('.', '!', '?') then 't' else '' end as fault,
           lag(left(role, 1)) over (partition by c order by i) as before
    from placed),
  counts as (
    select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
           count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
           count(*) filter (before || initial not in ('su', 'ua', 'au')) as illegal
    from judged group by c),
  inserts(p, q, cost, edit, made) as (values
    (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']),
    (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:'])),
  steps(p, q, role) as (values (0, 1, 'system'), (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
  path(c, i, q, cost, audit, made) as (
    select distinct c, 0::bigint, inserts.q, inserts.cost, inserts.edit, inserts.made from judged, inserts where inserts.p = 0
    union all
    select c, i, q, b.cost, b.audit, b.made from (
      select x.c, x.i, y.q, min({{'cost': x.cost + y.cost, 'audit': x.audit || y.edit, 'made': list_concat(x.made, y.made)}}) as b
      from (
        select path.c, judged.i, s.q, path.cost + s.cost as cost, path.audit || s.edit as audit,
               case s.edit when 'D' then path.made when 'K' then list_append(path.made, judged.role || ':' || judged.text)
                    else list_append(path.made, s.role || ':' || judged.text) end as made
        from path join judged on judged.c = path.c and judged.i = path.i + 1
        join lateral (
          select path.q as q, 3 as cost, 'D' as edit, '' as role
          union all select steps.q, (judged.fault = 't')::int, 'K', '' from steps
            where steps.p = path.q and judged.initial = left(steps.role, 1) and judged.fault in ('', 't')
          union all select steps.q, 2 + (judged.fault = 't')::int, 'R', steps.role from steps
            where steps.p = path.q and steps.role <> 'system' and judged.fault in ('', 't')) s on true) x
      join inserts y on y.p = x.q
      group by x.c, x.i, y.q)),
  ends as (
    select path.c, min({{'cost': path.cost, 'audit': path.audit, 'made': path.made}}) as b
    from path join (select c, max(i) as n from judged group by c) t on t.c = path.c and path.i = t.n
    where path.q in (0, 3) group by path.c)
select distinct k.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank,
       coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
       coalesce(b.cost, 0)::bigint as cost, coalesce(b.audit, '') as audit,
       sha256(coalesce(array_to_string(b.made, chr(10)), '')) as repaired_sha256
from known k left join counts on counts.c = k.c left join ends on ends.c = k.c"""


ORACLES["op12_conversation_repair"] = op12()


def op13() -> str:
    """Nodes by their whole paths; what is below a node by all its descendants' paths."""
    return f"""
with
  known as (
    select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
           row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i
    from conversations where conv_id is not null),
  own as (select c, count(*) as n from known group by c),
  keyed as (select c, n, c - c % 100 as b, c::varchar as key from own),
  convs as (
    select k.c, k.n, k.b, {_crc32("key")} % 6 as h, coalesce(own.n, 0) as there from keyed k left join own on own.c = k.b),
  turns as (
    select convs.c, i as d, role, text from convs join known on known.c = convs.b and i <= h
    union all
    select convs.c, least(h, there) + i - h, role, text from convs join known on known.c = convs.c and i > h),
  paths as (
    select c, d, length(text) as chars,
           string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (partition by c order by d) as path
    from turns
    union all select c, 0, 0, '' from convs),
  nodes as (select d, path, min(c) as c, count(*) as n_convs, (count(*) - 1) * max(chars) as own from paths group by d, path),
  above as (
    select n.c, n.d, n.own, n.n_convs, n.path, p.d as pd, p.path as ppath from nodes n join paths p on p.c = n.c and p.d <= n.d),
  parents as (select a.c, a.d, m.c as parent_conv_id from above a join nodes m on m.d = a.pd and m.path = a.ppath where a.pd = a.d - 1),
  children as (select parent_conv_id as c, d - 1 as d, count(*) as n_children from parents group by all),
  sums as (
    select a.pd as d, a.ppath as path, sum(a.own) as saved_tokens, count(*) filter (k.n_children is null) as n_leaves
    from above a left join children k on k.c = a.c and k.d = a.d group by all),
  ends as (
    select d, path, string_agg(c::varchar, ',' order by c) as ids
    from (select *, max(d) over (partition by c) as last from paths) where d = last group by d, path)
select n.c as conv_id, n.d::bigint as depth, parent_conv_id, n.n_convs, coalesce(n_children, 0)::bigint as n_children, n_leaves::bigint as n_leaves,
       saved_tokens::bigint as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from nodes n left join parents p on p.c = n.c and p.d = n.d left join children k on k.c = n.c and k.d = n.d
join sums on sums.d = n.d and sums.path = n.path left join ends on ends.d = n.d and ends.path = n.path"""


ORACLES["op13_prefix_trie"] = op13()
