"""SQL forms of the longer corpus queries, for the comparison with another engine."""

from __future__ import annotations

from panelwright.llm import pii
from panelwright.llm import quality as Q

_LISTS = " ".join(
    f"when '{language}' then {words}" for language, words in sorted(Q.COMMON_WORDS.items())
)
_REFERENCE = " ".join(f"when '{x}' then {bins}" for x, bins in Q.CLASS_REFERENCE.items())
_WORDS = " ".join(f"when '{x}' then {[*b, 1000 - sum(b)]}" for x, b in Q.WORD_REFERENCE.items())
_CLASSES = ", ".join(
    "length(glued) - length(regexp_replace(glued, '" + p.replace("'", "''") + "', '', 'g'))"
    for p in Q.CLASSES
)


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two list columns of counts."""
    a, b = f"({p}[i] / list_sum({p})::double)", f"({q}[i] / list_sum({q})::double)"
    m = f"(({a} + {b}) / 2)"
    part = "case when {x} > 0 then {x} * log2({x} / {m}) else 0.0 end"
    term = f"{part.format(x=a, m=m)} + {part.format(x=b, m=m)}"
    return (
        f"case when list_sum({p}) > 0 and list_sum({q}) > 0 then "
        f"sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {term})) / 2, 0.0)) end"
    )


QUALITY = rf"""
with doc as (
    select doc_id, coalesce(text, '') as t,
        coalesce(lang, '{Q.OTHER}') as language,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
    from documents),
glue as (
    select *, array_to_string(w, '') as glued, list_transform(w, lambda x: lower(x)) as lw,
        case language {_LISTS} end as common,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
    from doc),
counted as (
    select doc_id, language, len(w)::bigint as n_words, length(glued)::bigint as word_chars,
        len(ls)::bigint - len(list_distinct(ls))::bigint as n_dup_lines, [{_CLASSES}]::bigint[] as c,
        list_transform(common, lambda k: len(list_filter(lw, lambda x: x = k))) as k
    from glue),
hist as (
    select *, list_append(c, word_chars - list_sum(c)::bigint) as ch,
        list_append(k, n_words - list_sum(k)::bigint) as wh from counted),
gram as (
    select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
    from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from doc where len(w) >= 3)),
again as (
    select doc_id, count(distinct p) as n from (
        select doc_id, unnest([i, i + 1, i + 2]) as p
        from (select *, count(*) over (partition by doc_id, g) as n from gram) where n > 1)
    group by 1),
based as (
    select h.*, coalesce(n, 0) as n_repeat_words, h.c[4] as n_symbols,
        case when 2 * (ch[1] + ch[2]) > word_chars then 'latin' when 2 * ch[-1] > word_chars then 'other'
            else 'all' end as script,
        n_words < {Q.MIN_WORDS} or 100 * coalesce(n, 0) > {Q.MAX_REPEAT_PERCENT} * n_words as base_failed
    from hist h left join again using (doc_id)),
ref as (
    select language, script, list(s order by i) as corpus_reference
    from (select language, script, i, sum(v)::bigint as s from (
            select language, unnest(list_distinct(['all', script])) as script, i, {Q.SHARE_PARTS} * ch[i] // word_chars as v
            from (select *, unnest(range(1, len(ch) + 1)) as i from based
                  where not base_failed and word_chars >= {Q.MIN_CLASS_CHARS}
                      and language not in ({', '.join(f"'{x}'" for x in Q.COMMON_WORDS)})))
          group by 1, 2, 3)
    group by 1, 2),
ruled as (
    select *, {_distance('ch', 'cr')} as class_distance, {_distance('wh', 'wr')} as word_distance
    from (select based.*, coalesce(case language {_REFERENCE} end, corpus_reference) as cr,
              case language {_WORDS} end as wr
          from based left join ref using (language, script)))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed
        and not coalesce(word_chars >= {Q.MIN_CLASS_CHARS} and class_distance > {Q.MAX_CLASS_DISTANCE}, false)
        and not coalesce(n_words >= {Q.MIN_COMMON_WORDS} and word_distance > {Q.MAX_WORD_DISTANCE}, false) as kept
from ruled
"""

NEAR_DUPLICATES = r"""
with recursive doc as (
    select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') as w
    from documents),
shingle as (
    select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from doc where len(w) > 0)),
size as (select doc_id, count(*) as n from shingle group by 1),
pair as (
    select a.doc_id as a, b.doc_id as b, count(*) as common
    from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (
    select a, b from pair join size x on x.doc_id = a join size y on y.doc_id = b
    where 100 * common >= 75 * (x.n + y.n - common)),
edge as (select a, b from link union all select b, a from link),
reach as (
    select a as doc_id, a as other from edge
    union
    select r.doc_id, e.b from reach r join edge e on e.a = r.other),
least as (select doc_id, min(other) as low from reach group by 1)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(low, doc_id) as component_id,
    coalesce(low, doc_id) = doc_id as kept
from doc left join size using (doc_id) left join least using (doc_id)
"""

_FOUND = """
select doc_id, '{kind}' as kind, {rank} as rank, m[i] as value,
    (list_sum(list_transform(p[1:i], lambda x: length(x)))
     + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint as start_at, t
from (select doc_id, t, m, p, unnest(range(1, len(m) + 1)) as i
      from (select doc_id, t, regexp_extract_all(t, '{pattern}') as m, string_split_regex(t, '{pattern}') as p
            from doc))
"""
# The plain patterns of the base kinds. The kinds after them are the added ones.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}",
    "social": r"[0-9]+(?:-[0-9]+)+",
    "access_key": r"(?:A[KS]IA[A-Z0-9]+|gh[pousr]_[A-Za-z0-9]+)",
    "secret": pii.SECRET_NAME + pii.SECRET_SIGN.replace("'", "\'\'") + pii.SECRET_VALUE,
}
_VALID = f"""case kind
    when 'email' then true
    when 'ip' then len(list_filter(string_split(value, '.'),
        lambda x: length(ltrim(x, '0')) > 3 or coalesce(try_cast(ltrim(x, '0') as int), 0) > 255)) = 0
    when 'card' then length(digits) between 12 and 19 and list_sum(list_transform(
        range(1, length(digits) + 1), lambda i: case when i % 2 = 1 then digits[-i]::int
            else digits[-i]::int * 2 - case when digits[-i]::int > 4 then 9 else 0 end end)) % 10 = 0
    when 'phone' then length(digits) between 9 and 15
    when 'social' then regexp_full_match(value, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') and value[1:3] not in ('000', '666')
        and value[1:3] < '900' and value[5:6] <> '00' and value[8:11] <> '0000'
    when 'access_key' then regexp_full_match(value, '{pii.ACCESS_KEY}')
        and not regexp_matches(substr(t, start_at, 1), '[A-Za-z0-9_]')
        and not regexp_matches(substr(t, start_at + length(value) + 1, 1), '[A-Za-z0-9_]')
    when 'secret' then length(bare) >= {pii.SECRET_SIZE} and regexp_matches(bare, '[0-9]') and regexp_matches(bare, '[A-Za-z]')
    else false end"""


def _digest(condition: str) -> str:
    return (
        "coalesce(string_agg(kind || ':' || start_at || ':' || (start_at + length(value)), ',' "
        f"order by start_at, rank) filter ({condition}), '')"
    )


_BASE = ", ".join(f"'{k.name}'" for k in pii.KINDS if k.base)
_LISTED = [name for names in pii.CODE_LENGTHS.values() for name in names.split()]
_ALONE = {k.name: k.base_score for k in pii.KINDS} | {"iban": 0.6}
_SCORE = (
    f"case when kind = 'iban' and not list_contains({_LISTED}, value[1:2]) then -10 else 0 end + case kind " + " ".join(
        f"when '{k.name}' then {round(100 * _ALONE[k.name])} + case when regexp_matches(nearby, '{k.context}') then 20 else 0 end"
        for k in pii.KINDS
    ) + " end"
)
_LENGTH = "case substr(run, 1, 2) " + " ".join(
    f"when '{name}' then {n}" for n, names in pii.CODE_LENGTHS.items() for name in names.split()
) + " end"

# An account code starts at a place without a letter or digit before it; each end of the run
# of code characters is tried.
PERSONAL_DATA = (
    "with doc as (select doc_id, coalesce(text, '') as t from documents),\nproposed as materialized ("
    + " union all ".join(
        _FOUND.format(kind=kind, rank=rank, pattern=pattern)
        for rank, (kind, pattern) in enumerate(_PLAIN.items())
    )
    + f"""),
place as (
    select doc_id, rank, start_at, t, substr(t, start_at + 1, 66) as win,
        regexp_extract(substr(t, start_at + 1, 66), '^[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}') as run
    from proposed where kind = 'iban' and not regexp_matches(substr(t, start_at, 1), '[A-Za-z0-9]')),
ending as (
    select *, substr(run, 1, e) as value, replace(substr(run, 1, e), ' ', '') as code
    from (select *, unnest(range(15, length(run) + 1))::int as e from place)),
account as (
    select doc_id, rank, start_at, any_value(t) as t, arg_max(value, e) as value
    from ending
    where substr(run, e, 1) <> ' ' and not regexp_matches(substr(win, e + 1, 1), '[A-Za-z0-9]')
        and length(code) = coalesce({_LENGTH}, length(code)) and length(code) between 15 and 34
        and list_reduce(list_prepend(0, list_transform(
            string_split(substr(code, 5) || substr(code, 1, 4), ''),
            lambda c: case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end)),
            lambda s, c: (s * case when c < 10 then 10 else 100 end + c) % 97) = 1
    group by 1, 2, 3),
valid as (
    select * exclude (digits, bare) from (
        select *, regexp_replace(value, '[^0-9]', '', 'g') as digits,
            regexp_extract(value, '{pii.SECRET_VALUE}$') as bare from proposed) where {_VALID}
    union all select doc_id, 'iban', rank, value, start_at, t from account),
scored as (
    select *, {_SCORE} as score from (
        select *, lower(substr(t, greatest(start_at - {pii.CONTEXT_CHARS}, 0) + 1, least(start_at, {pii.CONTEXT_CHARS}))) as nearby
        from valid)),
found as (select * from scored where kind in ({_BASE}) or score >= {round(100 * pii.KEEP_SCORE)})
select doc_id, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip,
    count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone,
    sha256({_digest(f"kind in ({_BASE})")}) as base_sha256, {_digest('kind is not null')} as spans,
    coalesce(string_agg(score::varchar, ',' order by start_at, rank), '') as scores
from doc left join found using (doc_id) group by doc_id
"""
)

# Rows are numbered and folded in order; each state keeps the least (cost, edits, repaired
# lines). CRC-32 is taken bit by bit over the characters of "conv_id:turn".
_STATES = range(4)
_NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def _inserts(state: int) -> list[tuple[int, int, str, str]]:
    steps, cost, edits, lines = [], 0, "", ""
    for _ in range(3):
        steps.append((state, cost, edits, lines))
        state, role = (3, "assistant") if state == 2 else (2, "user")
        cost, edits, lines = cost + 3, edits + "I", lines + f"|| '{role}:' || chr(10)"
    return steps


def _option(test: str, state: int, cost: str, edits: str, lines: str) -> str:
    return (
        f"case when {test} and v.s{state} is not null then {{'c': v.s{state}.c + {cost}, "
        f"'e': v.s{state}.e || '{edits}', 'l': v.s{state}.l {lines}}} end"
    )


def _state(target: int) -> str:
    """Least option that ends in ``target`` after one more row ``r``."""
    options = [_option("true", target, "4", "D", "")]
    for state in _STATES:
        for ready, cost, edits, lines in _inserts(state):
            for initial, end in _NEXT[ready].items():
                if end == target:
                    options.append(
                        _option(
                            f"not r.must and r.i = '{initial}'", state, f"{cost} + r.extra", edits + "K",
                            f"{lines} || r.role || ':' || r.text || chr(10)",
                        )
                    )
                    if initial != "s":
                        role = {"u": "user", "a": "assistant"}[initial]
                        options.append(
                            _option(
                                "not r.must", state, f"{cost} + 3 + r.extra", edits + "R",
                                f"{lines} || '{role}:' || r.text || chr(10)",
                            )
                        )
    return f"list_min(list_filter([{', '.join(options)}], lambda o: o is not null))"


def _end() -> str:
    options = []
    for state in _STATES:
        for ready, cost, edits, lines in _inserts(state):
            if ready in (0, 3):
                options.append(_option("true", state, str(cost), edits, lines))
    return f"list_min(list_filter([{', '.join(options)}], lambda o: o is not null))"


_CRC_BITS = """list_concat([4294967295::bigint], flatten(list_transform(
    string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''),
    lambda ch: list_transform(range(0, 8), lambda b: (ascii(ch)::bigint >> b) & 1))))"""

CONVERSATION_REPAIR = rf"""
with recursive hashed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        xor(list_reduce({_CRC_BITS}, lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 20 as kind
    from conversations),
damaged as (
    select conv_id, turn, case when kind = 4 then 'user' else role end as role,
        case when kind = 1 then '' when kind = 2 then replace(replace(replace(text, '.', ''), '!', ''), '?', '')
            else text end as text, unnest(range(0, case kind when 3 then 2 else 1 end)) as copy
    from hashed where kind <> 0),
numbered as (
    select *, left(role, 1) as i, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare,
        row_number() over w as n, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth,
        lag(left(role, 1)) over w as before
    from damaged
    window w as (partition by conv_id order by turn nulls first, role, text, copy)),
rowed as (
    select *, case when bare = '' then 'b' when nth > 1 then 'd'
        when right(bare, 1) not in ('.', '!', '?') then 't' else '' end as fault from numbered),
ruled as (
    select conv_id, n, i, role, text, fault in ('b', 'd') as must, case when fault = 't' then 3 else 0 end as extra
    from rowed),
walk as (
    select conv_id, 0::bigint as n, {{'c': 0::bigint, 'e': '', 'l': ''}} as s0,
        null::struct(c bigint, e varchar, l varchar) as s1, null::struct(c bigint, e varchar, l varchar) as s2,
        null::struct(c bigint, e varchar, l varchar) as s3
    from (select distinct conv_id from ruled)
    union all
    select v.conv_id, r.n, {', '.join(_state(s) for s in _STATES)}
    from walk v join ruled r on r.conv_id is not distinct from v.conv_id and r.n = v.n + 1),
done as (
    select conv_id, {_end()} as o from walk v
    where n = (select max(n) from ruled r where r.conv_id is not distinct from v.conv_id)),
facts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
        count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate,
        count(*) filter (fault = 't') as truncated,
        count(*) filter (before is not null and before || i not in ('su', 'ua', 'au')) as illegal
    from rowed group by conv_id),
named as (select distinct conv_id from conversations)
select m.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
    coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(o.c, 0)::bigint as cost,
    coalesce(o.e, '') as audit, sha256(coalesce(left(o.l, length(o.l) - 1), '')) as repaired_sha256
from named m left join facts f on f.conv_id is not distinct from m.conv_id
    left join done d on d.conv_id is not distinct from m.conv_id
"""
