"""DuckDB SQL of the queries that SQL can express."""

FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
with d as (select row_number() over () r, doc_id, coalesce({WORDS.format('text')}, []) w from documents),
it as (select item_id, {WORDS.format('text')} w from benchmark where text is not null),
win as (select distinct item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: list_slice(w, i, i + 9))) g
        from it where len(w) > 0),
size as (select distinct len(g) n from win),
gram as (select r, i, n, list_slice(w, i, i + n - 1) g
         from (select d.r, d.w, size.n, unnest(range(1, len(d.w) - size.n + 2)) i from d, size where len(d.w) >= size.n)),
hit as (select r, i, n, item_id from gram join win using (g)),
word as (select r, count(distinct p) n_hit from (select r, unnest(range(i, i + n)) p from hit) group by r),
item as (select r, count(*) n_items, string_agg(name, ',' order by name) names
         from (select distinct r, cast(item_id as varchar) name from hit) group by r),
tok as (select r, t, p from (select r, unnest(w) t, unnest(range(1, len(w) + 1)) p from d)),
df as (select t, count(*) c from tok group by t),
wt as (select g, t, min(j) j from (select g, unnest(g) t, unnest(range(1, len(g) + 1)) j from (select distinct g from win)) group by g, t),
rare as (select g, count(*) n_terms, arg_min(t, (c, j)) t from wt left join df using (t) group by g having count(c) = count(*)),
nearby as (select g, a.r, a.p, n_terms from rare join tok a using (t) join wt using (g) join tok b on b.r = a.r and b.t = wt.t
          where abs(b.p - a.p) <= len(g) - 1 + 10 group by g, a.r, a.p, n_terms having count(distinct wt.t) = n_terms),
near as (select r, count(distinct item_id) n_near from nearby join win using (g) group by r)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(names, '')) items_sha256,
       coalesce(n_hit, 0) > 0 contaminated,
       coalesce(n_near, 0) n_near
from d left join word using (r) left join item using (r) left join near using (r)"""


CHAT = r"""
with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
           union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t as (select *, '<turn:' || replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') || '>'
             || replace(replace(text, '\', '\b'), '<', '\l') || '</turn>' formatted from c)
select conv_id, count(*) n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, formatted)) turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, formatted), '')) loss_sha256,
       cast(sum(length(formatted)) as bigint) formatted_chars
from t group by conv_id"""


LICENSES = r"""
with known(license, text) as (values {values}),
{folds},
k as (select sha256({respelled}) digest, min(license) license from known_folded where folded <> '' group by 1),
hit as (select u.r, u.whole, k.license from (select r, whole, sha256({respelled}) digest from unit_folded) u join k using (digest))
select d.doc_id, max(license) filter (whole) license, count(license) filter (not whole) n_notices,
       coalesce(string_agg(distinct license, ',' order by license) filter (not whole), '') notices
from d left join hit using (r) group by r, d.doc_id"""

_FOLD_SQL = """
known_folded as (select license, {known} folded from known),
d as (select row_number() over () r, doc_id, coalesce(text, '') text from documents),
unit as (select r, true whole, text from d union all select r, false, unnest(string_split(text, chr(10))) from d),
unit_folded as (select r, whole, {unit} folded from unit)"""


def licenses() -> str:
    from boxlens.llm import licenses as L

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    folded = lambda c: (f"trim(regexp_replace(regexp_replace(lower({c}), {quote(L.COPYRIGHT_LINE)}, ' ', 'g'), {quote(L.APART)}, ' ', 'g'), ' ')")
    text = "' ' || replace(folded, ' ', '  ') || ' '"
    for old, new in L.SPELLINGS:
        text = f"replace({text}, {quote(' ' + old.replace(' ', '  ') + ' ')}, {quote(' ' + new.replace(' ', '  ') + ' ')})"
    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in L.KNOWN)
    return LICENSES.format(values=values, folds=_FOLD_SQL.format(known=folded("text"), unit=folded("text")).strip(), respelled=f"trim(replace({text}, '  ', ' '), ' ')")


URLS = r"""
with u0 as (select page_id, url, cast(date '2024-01-01' + cast(page_id * 37 % 61 as int) as date) as day,
                  regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(url), '^(?:[a-z][a-z0-9+.-]*:)?//', ''),
                                 '^(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)', 1), '\.$', ''), '^www\.', '') host,
                  coalesce(nullif(regexp_extract(url, '^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?[^/?#]*(/[^?#]*)', 1), ''), '/') raw from pages),
u as (select *, array_to_string(list_reduce(list_transform(string_split(regexp_replace(raw, '/(\.\.?)$', '/\1/'), '/'), lambda s: [s]),
        lambda a, b: case when b[1] = '..' then list_slice(a, 1, greatest(len(a) - 1, 1)) when b[1] = '.' then a else list_concat(a, b) end), '/') path from u0),
e as (select 'list' || event_id % 5 list, event_id seq, event_id % 4 <> 0 active, cast(date '2024-01-01' + cast(event_id * 7 % 53 as int) as date) as day,
             case event_id % 3 when 0 then regexp_replace(host, '^[^.]*\.', '') when 1 then host else host || '/' || split_part(path, '/', 2) || '/' end pattern
      from events join u on user_id = page_id),
daily as (select list, pattern, day, arg_max(active, seq) active from e group by all),
span as (select list, pattern, active, day since, coalesce(lead(day) over (partition by list, pattern order by day), date '9999-01-01') until from daily),
p as (select page_id, unnest(list_distinct(list_concat(
             list_transform(range(1, case when regexp_matches(host, '^[0-9]+(\.[0-9]+){3}$|^\[') then 2 else len(string_split(host, '.')) + 1 end), lambda i: array_to_string(list_slice(string_split(host, '.'), i, 99), '.')),
             list_transform(range(2, len(string_split(path, '/'))), lambda i: host || array_to_string(list_slice(string_split(path, '/'), 1, i), '/') || '/')))) pattern
      from u where host <> ''),
hit as (select page_id, list, p.pattern from p join u using (page_id) join span s on s.pattern = p.pattern and active and since <= u.day and u.day < until)
select page_id, cast(any_value(day) as varchar) as day, any_value(host) host, count(list) n_matches, coalesce(string_agg(distinct list, ',' order by list), '') lists,
       coalesce(string_agg(distinct pattern, ',' order by pattern), '') patterns, count(list) > 0 blocked
from u left join hit using (page_id) group by page_id"""


TERMS = "regexp_extract_all(" + FOLD + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKING = f"""
with d as (select row_number() over () r, doc_id, {TERMS.format('text')} w from documents where text is not null),
tot as (select count(*) n_docs, sum(len(w)) n_terms from d where len(w) > 0),
it as (select row_number() over () i, item_id, {TERMS.format('text')} w from benchmark where text is not null),
q as (select i, t, count(*) q from (select i, unnest(w) t from it) group by i, t),
tf as (select r, t, count(*) tf from (select r, unnest(w) t from d) where t in (select t from q) group by r, t),
wt as (select t, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) w from tf, tot group by t, n_docs),
doc as (select r, doc_id, 75 + (25 * len(w) * n_docs) // n_terms m from d, tot),
hit as (select i, r, cast(sum(q * wt.w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) score
        from q join tf using (t) join wt using (t) join doc using (r) group by i, r),
top as (select i, doc_id, score, row_number() over (partition by i order by score desc, doc_id nulls last) rank from hit join doc using (r) where score > 0)
select item_id, cast(rank as integer) rank, doc_id, score from top join it using (i) where rank <= 20"""

