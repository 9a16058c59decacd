"""DuckDB SQL for the rows of the operators that SQL can express.

Positions follow from the text between matches and the matches, as in ``spans``; patterns are the plain ones
of the contract, since RE2 has neither lookbehind nor possessive runs.
"""

from __future__ import annotations

from . import pii, resample, secrets, substring, vectorcodes


def _places(source: str, rules: list[tuple[str, int, str, str]], keep: str = "id, t") -> str:
    """(id, t, kind, rank, s, e, v) of every match of every (kind, rank, pattern, condition on v)."""
    parts = [
        f"""select {keep}, '{kind}' as kind, {rank} as rank,
              cast(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as bigint) as s, ms[i] as v
            from (select {keep}, regexp_extract_all(t, '{pattern}') as ms, string_split_regex(t, '{pattern}') as ps from {source}), lateral (select unnest(range(1, len(ms) + 1)) as i) where ({condition.replace("$v", "ms[i]")})"""
        for kind, rank, pattern, condition in (((k, r, p.replace("'", "''"), c) for k, r, p, c in rules))
    ]
    return "select *, s + length(v) as e from (" + " union all ".join(parts) + ")"


_DIGITS = "regexp_replace($v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: case when k % 2 = 1 then cast(substring(reverse({_DIGITS}), k, 1) as int) when cast(substring(reverse({_DIGITS}), k, 1) as int) > 4 then cast(substring(reverse({_DIGITS}), k, 1) as int) * 2 - 9 else cast(substring(reverse({_DIGITS}), k, 1) as int) * 2 end)) % 10 = 0"
_BYTE = "0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
_PII = [
    ("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", rf"regexp_full_match($v, '{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}')"),
    ("card", 2, r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) between 13 and 19 and {_LUHN}"),
    ("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 9 and 15"),
]
_TERM = [("term", 4, r"[\pL\pM\pN]+", "true")]

OP1 = f"""
with d as (select doc_id as id, coalesce(text, '') as t from documents),
u as (select row_number() over () as id, t, count(*) as copies from d group by t),
b as (select * from ({_places("u", _PII)})),
n as (select count(*) as n from d),
ents as (select distinct id, kind || ':' || lower(v) as entity from b),
-- Entities that overlap are one stretch; each is cut out and replaced by spaces.
edge as (select id, s, e, max(e) over (partition by id order by s, e rows between unbounded preceding and 1 preceding) as before from b),
stretch as (select id, min(s) as s, max(e) as e from (select *, sum(case when before is null or s >= before then 1 else 0 end) over (partition by id order by s, e rows unbounded preceding) as k from edge) group by id, k),
parts as (select id, s, e, coalesce(lag(e) over (partition by id order by s), 0) as prev from stretch),
clear as (select parts.id, string_agg(substring(t, prev + 1, s - prev) || repeat(' ', e - s), '' order by s) || substring(any_value(t), max(e) + 1) as t from parts join u using (id) group by parts.id),
w as (select id, lower(v) as term, s, e from ({_places("clear", _TERM)})),
here as (select distinct id, term from w),
n_c as (select entity, sum(copies) as n_c from ents join u using (id) group by 1),
spread as (select term, sum(copies) as n_t from (select id, copies, unnest(list_distinct(list_transform(regexp_extract_all(t, '[\\pL\\pM\\pN]+'), lambda x: lower(x)))) as term from u) group by 1),
common as (select entity, term, sum(copies) as n_ct from ents join here using (id) join u using (id) group by 1, 2 having count(*) >= {pii.SUPPORT}),
told as (select entity, term from (select *, log2(n * 1.0 * n_ct / (n_c * n_t)) as pmi from common join n_c using (entity) join spread using (term), n)
  where pmi > 0 and pmi >= {pii.DISCLOSURE} * log2(n * 1.0 / n_c) - 1e-9),
terms as (select distinct w.id, s, e from told join ents using (entity) join w on w.id = ents.id and w.term = told.term),
base as (select id, string_agg(kind || ':' || s || ':' || e, ',' order by rank, s) as t, count(*) filter (where kind = 'email') as n_email, count(*) filter (where kind = 'ip') as n_ip, count(*) filter (where kind = 'card') as n_card, count(*) filter (where kind = 'phone') as n_phone from b group by id),
more as (select id, string_agg('term:' || s || ':' || e, ',' order by s, e) as t from terms group by id)
select d.id as doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
  sha256(coalesce(base.t, '')) as base_sha256, concat_ws(',', base.t, more.t) as spans
from d join u on u.t = d.t left join base on base.id = u.id left join more on more.id = u.id
"""

_ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
_SECRETS = [
    ("assign", 0, _ASSIGN + "[A-Za-z0-9+/_.=-]+", "length(regexp_extract($v, '" + _ASSIGN.replace("'", "''") + "([A-Za-z0-9+/_.=-]+)', 1)) >= 8"),
    ("access", 1, "AKIA[A-Z0-9]+", "length($v) >= 16"),
    ("hex", 2, "[0-9a-f]+", "length($v) >= 32"),
    *[(kind, 3 + k, pattern.replace("}+", "}"), "true") for k, (kind, pattern, _) in enumerate(secrets.EXTRA)],
]

OP7 = f"""
with d as (select doc_id as id, coalesce(text, '') as t from documents),
u as (select row_number() over () as id, t from d group by t),
b as (select * from ({_places("u", _SECRETS)})),
g as (select id, coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (where rank < 3), '') as base,
  count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as whole from b group by id)
select d.id as doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(whole, '') as spans
from d join u on u.t = d.t left join g on g.id = u.id
"""

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP3 = f"""
with p as (select page_id, coalesce(html, '') as h from pages),
k as (select *, sha1(h) as x, strlen(h) as n from p), f as (select x, min(page_id) as first_id from k group by 1)
select page_id, n as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substring('{_B32}', cast((cast('0x' || substring(x, i // 4 * 5 + 1, 5) as bigint) >> (15 - i % 4 * 5)) & 31 as int) + 1, 1)), '') as payload_digest,
  case when page_id is not distinct from first_id then 'response' else 'revisit' end as record_type, case when page_id is distinct from first_id then first_id end as refers_to
from k join f using (x)
"""

OP5 = f"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, i, hash(w[i:i + {substring.WINDOW - 1}]) as h, w[i:i + {substring.WINDOW - 1}] as v from d, lateral (select unnest(range(1, len(w) - {substring.WINDOW - 2})) as i)),
r as (select doc_id, i from (select doc_id, i, min((doc_id, i)) over (partition by v) as first from win) where (doc_id, i) > first),
g as (select doc_id, list(distinct k) as gone from (select doc_id, unnest(range(i, i + {substring.WINDOW})) as k from r) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(len(gone), 0) as n_removed,
  sha256(array_to_string(case when gone is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda k: not list_contains(gone, k)), lambda k: w[k]) end, ' ')) as kept_sha256
from d left join g using (doc_id)
"""

ORACLE_SQL = {"op1_pii": OP1, "op3_warc": OP3, "op5_substring_dedup": OP5, "op7_secret_scan": OP7, "op12_vector_codes": vectorcodes.oracle(), "op13_resample": resample.oracle()}
