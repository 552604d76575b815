"""DuckDB SQL for the queries of this package that SQL can express."""

from perfcap.llm import chat, lines, urls

_ESC = "replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')"
_ROLE = f"replace({_ESC.format(c='role')}, chr(10), '&NewLine;')"
_TEXT = _ESC.format(c="text")

OP2 = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from (
    select conv_id, turn, role, text from conversations
    union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum({len(chat.TURN)} + length({_ROLE}) + 1 + length({_TEXT}) + {len(chat.END)})::bigint as formatted_chars
from rows group by conv_id"""


def _op7() -> str:
    """Listed rules, then the template tree level by level."""
    steps, last = [], "t0"
    for level in range(1, urls.DEPTH + 1):
        steps.append(f"""
s{level} as (select *, segments[{level}] as segment from {last}),
r{level} as (select *, dense_rank() over (partition by host, template order by segment nulls first) as number from s{level}),
w{level} as (select *, sum(pages) over br as n, sum(labelled) over br as l, sum(bad) over br as b,
  max(number) over node as branches, sum(pages) over node as nn,
  sum(labelled) over node - sum(labelled) over br as ol, sum(bad) over node - sum(bad) over br as ob
  from r{level} window node as (partition by host, template), br as (partition by host, template, segment)),
t{level} as (select host, shape, segments, pages, labelled, bad, case when segment is null then template else template || '/' || case
  when segment in ('{{n}}', '**') then segment
  when l > 0 and ol > 0 and b + ob > 0 and b + ob < l + ol
    and abs(b / l - ob / ol) > {urls.Z} * sqrt((b + ob) / (l + ol) * (1 - (b + ob) / (l + ol)) * (1 / l + 1 / ol)) then segment else '*' end end as template from w{level})""")
        last = f"t{level}"
    def fits(rule: str) -> str:
        host, slash, path = rule.partition("/")
        return f"(p.host = '{host}' or ends_with(p.host, '.{host}')) and starts_with(p.path, '{slash}{path}')"

    ordered = sorted(urls.RULES, key=lambda r: -len(r[0]))
    rule = " ".join(f"when {fits(r)} then '{r}'" for r, _ in ordered)
    says = " ".join(f"when {fits(r)} then '{v}'" for r, v in ordered)
    return f"""
with rest as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
hosts as (select page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') as host, coalesce(rest, '') as rest from rest),
parsed as (select page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') as path from hosts),
cut as (select *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
  lambda s: case when regexp_matches(s, '[0-9]') then '{{n}}' else s end) as segs from parsed),
shaped as (select page_id, host, path, array_to_string(
  case when len(segs) > {urls.DEPTH} then list_append(segs[1:{urls.DEPTH}], '**') else segs end, '/') as shape from cut),
known as (select doc_id as page_id, max(case when coalesce(toxic = 1, false) or coalesce(quality = 0, false) then 1 else 0 end) as bad
  from labels where doc_id is not null group by doc_id),
counted as (select host, shape, count(*)::double as pages, count(k.bad)::double as labelled, coalesce(sum(k.bad), 0)::double as bad
  from shaped s left join known k using (page_id) group by host, shape),
t0 as (select host, shape, string_split(shape, '/') as segments, pages, labelled, bad, '' as template from counted),
{",".join(steps)},
named as (select host, shape, labelled, bad, case when len(segments) > {urls.DEPTH} then template || '/**' else template end as template from {last}),
rates as (select *, (sum(bad) over (partition by host) + {urls.WEIGHT} * (select coalesce(sum(bad) / nullif(sum(labelled), 0), 0) from counted))
  / (sum(labelled) over (partition by host) + {urls.WEIGHT}) as host_rate from named),
pure as (select host, shape, template, (sum(bad) over (partition by host, template) + {urls.WEIGHT} * host_rate)
  / (sum(labelled) over (partition by host, template) + {urls.WEIGHT}) as purity from rates)
select p.page_id, p.host, p.path, case {rule} end as rule,
  coalesce(case {says} end, case when purity > {urls.LIMIT} then 'block' else 'allow' end) as verdict, template, purity
from shaped p join pure using (host, shape)"""


OP9 = f"""
with docs as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
sizes as (select (2 ^ unnest(range(0, 24)))::bigint as h),
starts as (select doc_id, ls, h, unnest(range(1, len(ls) - h + 2)) as i from docs, sizes where h <= len(ls)),
windows as (select doc_id, h, i, array_to_string(ls[i:i + h - 1], chr(10)) as body from starts),
later as (select doc_id, h, i from windows qualify row_number() over (partition by h, body order by doc_id, i) > 1),
marked as (select *, coalesce(i - lag(i) over of_length >= h, true)::int as new from later window of_length as (partition by doc_id, h order by i)),
numbered as (select *, sum(new) over (partition by doc_id, h order by i rows unbounded preceding) as run from marked),
runs as (select doc_id, min(i) as a, max(i) + h as b from numbered group by doc_id, h, run),
gone as (select distinct doc_id, unnest(range(a, b)) as i from runs join docs using (doc_id)
  where length(array_to_string(ls[a:b - 1], chr(10))) >= {lines.MIN_CHARS}),
counted as (select doc_id, count(*) as n, list(i) as numbers from gone group by doc_id)
select d.doc_id, coalesce(len(ls), 0)::bigint as n_lines, coalesce(c.n, 0)::bigint as n_deleted,
  sha256(array_to_string(list_filter(ls, lambda x, i: c.numbers is null or not list_contains(c.numbers, i)), chr(10))) as text_sha256
from docs d left join counted c using (doc_id)"""

OP6 = r"""
with recursive docs as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [w]
    else list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) end) as s from docs),
sizes as (select d.doc_id, count(s)::bigint as n from docs d left join shingles using (doc_id) group by d.doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
twice as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as other from sizes union select r.doc_id, t.b from reach r join twice t on t.a = r.other)
select s.doc_id, n as n_shingles, min(other) as component_id from sizes s join reach using (doc_id) group by all"""


OP11 = """
with words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ts from documents where text is not null),
docs as (select row_number() over () as d, doc_id, ts, len(ts)::bigint as n from words where len(ts) > 0),
total as (select count(*)::bigint as docs, sum(n)::bigint as words from docs),
tf as (select d, t, count(*)::bigint as tf from (select d, unnest(ts) as t from docs) group by d, t),
asked as (select distinct item_id, t from (select item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as t from benchmark where text is not null)),
weight as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w
  from (select t, count(*) as df from tf group by t), total),
scored as (
  select a.item_id, d.doc_id, d.d, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (50 + (50 * d.n * total.docs) // total.words))))::bigint as score
  from asked a join tf f on f.t = a.t join weight w on w.t = a.t join docs d on d.d = f.d, total group by all)
select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls first)::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 50"""

_CRC = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(1, length(c::varchar) + 1),
  lambda i: [ord((c::varchar)[i])::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda r, x: case when x >= 0 then xor(r, x) else xor(r >> 1, 3988292384 * (r & 1)) end), 4294967295)"""

OP12 = f"""
with t as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
seqs as (select c, list({{'role': role, 'text': text}} order by turn nulls first, role, md5(text)) as turns from t group by c),
h as (select c, turns, c - c % 100 as base, {_CRC} % 6 as h from seqs),
whole as (select a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) as turns from h a left join seqs b on b.c = a.base),
prefixes as (select c, len(turns) as n, d as depth, turns[1:d] as prefix from (select c, turns, unnest(range(0, len(turns) + 1)) as d from whole)),
nodes as (select depth, prefix, count(*) as n_convs, min(c) as conv_id,
  sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (n = depth), '')) as ends_sha256 from prefixes group by depth, prefix),
kids as (select depth - 1 as depth, prefix[1:depth - 1] as prefix, count(*) as n_children from nodes where depth > 0 group by all),
full_nodes as (select n.*, coalesce(k.n_children, 0) as n_children,
  (n_convs - 1) * case when n.depth = 0 then 0 else length(n.prefix[n.depth].text) end as own
  from nodes n left join kids k on k.depth = n.depth and k.prefix = n.prefix),
above as (select u.own, u.n_children, a as depth, u.prefix[1:a] as prefix from (select *, unnest(range(0, depth + 1)) as a from full_nodes) u),
below as (select depth, prefix, sum(own)::bigint as saved_tokens, count(*) filter (n_children = 0) as n_leaves from above group by depth, prefix)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
from full_nodes n join below b on b.depth = n.depth and b.prefix = n.prefix
left join nodes p on n.depth > 0 and p.depth = n.depth - 1 and p.prefix = n.prefix[1:n.depth - 1]"""

SQL = {"op6_ngram_jaccard": OP6, "op9_line_dedup": OP9, "op2_chat_formatting": OP2, "op7_url_filters": _op7(), "op11_ranked_search": OP11, "op12_prefix_trie": OP12}
