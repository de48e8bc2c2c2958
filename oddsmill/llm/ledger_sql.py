"""SQL of the manifest and of the spelling groups, for the tables of the driver."""

from __future__ import annotations

import string

#: The crc32 table of 256 values, made by its rule: a view of one row.
CRC_TABLE = "select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab"


def _crc32(bytes_hex: str) -> str:
    """Unsigned crc32 of bytes given as hex text, in a query that has CRC_TABLE's `tab`."""
    bytes_ = f"list_transform(range(length({bytes_hex}) // 2), lambda i: ('0x' || substr({bytes_hex}, (2 * i + 1)::int, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bytes_}), lambda c, x: xor(c >> 8, tab[xor(c, x) % 256 + 1])), 4294967295::bigint)"


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", n_chars, "text"])) + ")"


MANIFEST = f"""
with recursive crc as ({CRC_TABLE}),
d as (select *, hex(encode(doc_id::varchar)) as id_hex, {_leaf("n_chars")} as leaf, {_leaf("(n_chars + 1)")} as other from documents),
leaves as (
  select doc_id, leaf, case when doc_id is not null and {_crc32("id_hex")} % 7 = 0 then other else leaf end as shown, coalesce('=' || lang, '') as g,
    row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n
  from d, crc
),
tree as (
  select g, 0 as lvl, pos, leaf as h, n from leaves
  union all
  select g, lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2 from tree where n > 1 group by g, lvl, pos // 2, n
),
subroots as (select g, h as subroot, row_number() over (order by encode(g)) - 1 as pos, count(*) over () as n from tree where n = 1),
top as (
  select 0 as lvl, pos, subroot as h, n from subroots
  union all
  select lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2 from top where n > 1 group by lvl, pos // 2, n
),
every as (
  select l.g, l.pos, x.lvl, x.pos as own, s.h as sibling
  from leaves l join tree x on x.g = l.g and x.pos = l.pos >> x.lvl and x.n > 1 left join tree s on s.g = x.g and s.lvl = x.lvl and s.pos = xor(x.pos, 1)
  union all
  select l.g, l.pos, 1000 + x.lvl, x.pos, s.h
  from leaves l join subroots r on r.g = l.g join top x on x.pos = r.pos >> x.lvl and x.n > 1 left join top s on s.lvl = x.lvl and s.pos = xor(x.pos, 1)
),
proofs as (
  select g, pos, coalesce(string_agg(sibling, '' order by lvl), '') as siblings,
    list(case when sibling is null then '-' when own % 2 = 0 then 'R' || sibling else 'L' || sibling end order by lvl) as path
  from every group by g, pos
),
folded as (
  select l.doc_id, l.leaf, r.subroot, (select h from top where n = 1) as root, sha256(coalesce(p.siblings, '')) as proof_sha256,
    list_reduce(list_prepend(l.shown, coalesce(p.path, [])), lambda c, x: case x[1] when 'R' then sha256(c || x[2:]) when 'L' then sha256(x[2:] || c) else sha256(c) end) as folded_root
  from leaves l join subroots r using (g) left join proofs p on p.g = l.g and p.pos = l.pos
)
select *, folded_root = root as verified from folded
"""

SPELLING = f"""
with recursive crc as ({CRC_TABLE}),
runs as (
  select doc_id, run, count(*) as k from (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[A-Za-zÀ-ÿ]+')) as run from documents
  ) group by all
),
hashed as (select run, k, {_crc32("bytes_hex")} as h from (select *, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as bytes_hex from runs where length(run) >= 6), crc),
results as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k from hashed),
words as (select word, sum(k)::bigint as n from results where length(word) >= 6 group by word having sum(k) >= 5),
cut as (select word, n, i, substr(word, 1, i::int) || substr(word, i::int + 2) as rest from (select word, n, unnest(range(length(word))) as i from words)),
near as (
  select a.word as a, b.word as b from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union
  select a.word, b.word from cut a join words b on a.rest = b.word
  union
  select b.word, a.word from cut a join words b on a.rest = b.word
),
best as (
  select a as word, count(*) as n_near, first(b order by w.n desc, encode(b)) as form, first(w.n order by w.n desc, encode(b)) as form_n
  from near join words w on w.word = near.b group by a
),
formed as (
  select words.word, n, coalesce(n_near, 0)::bigint as n_near, case when form_n >= 5 * n then form end as form, case when form_n >= 5 * n then form_n end as form_n
  from words left join best using (word)
),
way as (
  select word, word as root, 0 as d from formed
  union all
  select way.word, formed.form, d + 1 from way join formed on formed.word = way.root where formed.form is not null
)
select word, form, root, n, n_near, form_n from formed join (select word, arg_max(root, d) as root from way group by word) using (word)
"""
