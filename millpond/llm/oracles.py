"""DuckDB text of the queries that SQL can express.

The others have none: trained labelers (1), a check sum DuckDB lacks (2, 8), 200-byte strings at every byte (7), merges by
rank (9), eigenvectors (12). Their tests compare them with plain Python.
"""

from __future__ import annotations

from . import clusters, passages, quality, urls

A_TO_Z = f"'{urls.UPPER}', '{urls.LOWER}'"


def _words(text: str, pattern: str) -> str:
    return f"list_filter(string_split_regex(translate(coalesce({text}, ''), {A_TO_Z}), '{pattern}'), lambda x: x <> '')"


SPACE = "[\\x09-\\x0D ]+"
TERMS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _after(url: str) -> str:
    return f"(case when strpos({url}, '://') > 0 then substr({url}, strpos({url}, '://') + 3) else '' end)"


def _host(url: str) -> str:
    return f"translate(regexp_extract({_after(url)}, '^([^/?#]*)', 1), {A_TO_Z})"


def _path(url: str) -> str:
    return f"regexp_extract({_after(url)}, '^[^/?#]*([^?#]*)', 1)"


def _rule(url: str, what: int) -> str:
    cases = "".join(
        f" when ({_host(url)} = '{host}' or ends_with({_host(url)}, '.{host}')) and starts_with({_path(url)}, '{path}')"
        f" then '{(host + path, verdict)[what]}'"
        for verdict, host, path in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"(case{cases} end)"


def _canonical(url: str) -> str:
    query = f"regexp_extract({_after(url)}, '^[^?#]*\\?([^#]*)', 1)"
    kept = f"array_to_string(list_filter(string_split({query}, '&'), lambda p: p <> '' and not regexp_matches(p, '^({urls.TRACKING})(=.*)?$')), '&')"
    return (
        f"(case when {_host(url)} <> '' then regexp_replace({_host(url)}, ':(80|443)$', '') || regexp_replace({_path(url)}, '/+$', '')"
        f" || (case when {kept} <> '' then '?' || {kept} else '' end) end)"
    )


URL_FILTER = f"""
with recursive tags as (
  select url, unnest(regexp_extract_all(html, '(?i)(<(?:link|meta)\\s[^<>]*>)', 1)) tag from pages where url is not null
), links as (
  select url, trim(regexp_extract(tag, '(?i)(?:href\\s*=\\s*["'']?|;\\s*url\\s*=\\s*[''"]?)([^\\s"''>]+)', 1)) link from tags
  where regexp_matches(tag, '(?i)rel\\s*=\\s*["'']?canonical|http-equiv\\s*=\\s*["'']?refresh')
), targets as (
  select url, case when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link
    when link like '//%' then split_part(url, '://', 1) || ':' || link
    when link like '/%' then split_part(url, '://', 1) || '://' || {_host("url")} || link
    else split_part(url, '://', 1) || '://' || {_host("url")} || coalesce(nullif(regexp_replace({_path("url")}, '[^/]*$', ''), ''), '/') || link end target
  from links where link <> ''
), members as (
  select {_canonical("url")} node, {_rule("url", 1)} verdict from pages
  union all select {_canonical("url")}, {_rule("url", 1)} from targets
  union all select {_canonical("target")}, {_rule("target", 1)} from targets
), edges as (
  select {_canonical("url")} a, {_canonical("target")} b from targets union select {_canonical("target")}, {_canonical("url")} from targets
), reach as (
  select distinct node, node other from members where node is not null
  union select r.node, e.b from reach r join edges e on r.other = e.a where e.b is not null
), spread as (
  select r.node, case when bool_or(m.verdict = 'block') and not coalesce(bool_or(m.verdict = 'allow'), false) then 'block' else 'allow' end verdict
  from reach r join members m on r.other = m.node group by 1
)
select page_id, coalesce({_host("url")}, '') host, coalesce({_path("url")}, '') path, {_rule("url", 0)} as "rule",
  coalesce({_rule("url", 1)}, s.verdict, 'allow') verdict
from pages left join spread s on s.node = {_canonical("url")}
"""

NGRAM_JACCARD = f"""
with recursive d as materialized (select row_number() over () r, doc_id, {_words("text", SPACE)} w from documents),
sets as materialized (
  select distinct r, case when len(w) < 5 then w else list_slice(w, i, i + 4) end s
  from d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) u(i) where len(w) > 0
), sizes as (select r, count(*) n from sets group by 1),
pairs as (select a.r x, b.r y, count(*) c from sets a join sets b on a.s = b.s and a.r < b.r group by 1, 2),
links as materialized (
  select x, y from pairs join sizes a on a.r = x join sizes b on b.r = y where 100 * c >= 75 * (a.n + b.n - c)
), both_ways as (select x, y from links union select y, x from links),
reach as (select r, r o from sizes union select reach.r, y from reach join both_ways on o = x),
low as (select reach.r, min(d.doc_id) component_id from reach join d on d.r = reach.o group by 1)
select doc_id, coalesce(n, 0) n_shingles, case when n is null then doc_id else component_id end component_id
from d left join sizes using (r) left join low using (r)
"""

_MENU = ", ".join(f"'{w.decode()}'" for w in quality.MENU_WORDS)
# The words that phrases take up in a line.
_SAID = " + ".join(
    f"(len(low) - len(replace(low, '{p.decode()}', ''))) // {len(p)} * {len(p.split())}" for p in quality.PHRASES
)
_ENDS = "".join(
    n.to_bytes(size, "big").decode() for ends, size in ((quality.WIDE_ENDS, 3), (quality.SLIM_ENDS, 2)) for n in map(int, ends)
)
# Bars and phrases fail a short line, and a long one by their share of its words.
_SHARE = f"(len(array_to_string(lw, '')) <= {quality.LONG_LINE} or 100 * %s >= {quality.SHARE_PERCENT} * len(lw))"

QUALITY = f"""
with d as materialized (
  select row_number() over () r, doc_id, coalesce(text, '') t,
    list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') w from documents
), grams as (select r, i, list_slice(w, i, i + 4) g from d, unnest(range(1, greatest(len(w) - 3, 1))) u(i)),
often as (select r, g from grams group by 1, 2 having count(*) > 1),
hit as (select r, count(distinct i + j) n from grams join often using (r, g), unnest(range(0, 5)) v(j) group by 1),
lines as (
  select r, line, translate(line, {A_TO_Z}) low, list_filter(string_split_regex(line, '{SPACE}'), lambda x: x <> '') lw
  from (select r, unnest(string_split(t, chr(10))) line from d) where regexp_matches(line, '[^\\x09-\\x0D ]')
), judged as (
  select r, line, len(array_to_string(lw, '')) chars,
    100 * len(regexp_replace(line, '[^!-/:-@\\[-`{{-~]', '', 'g')) > {quality.MARK_PERCENT} * len(array_to_string(lw, ''))
    or (len(lw) < {quality.SHORT_LINE} and not regexp_matches(lw[-1], '[.!?:;"''){_ENDS}]$')
      and len(regexp_replace(line, '[^\\x{{0800}}-\\x{{1FFF}}\\x{{3000}}-\\x{{D7FF}}]', '', 'g')) < {quality.WIDE_CHARS})
    or (len(lw) >= {quality.MENU_PARTS} and len(list_filter(string_split_regex(low, '{SPACE}'), lambda x: x <> '' and x not in ({_MENU}))) = 0)
    or (parts >= {quality.MENU_PARTS - 1} and {_SHARE % "parts"}) or (said > 0 and {_SHARE % "said"}) failed
  from (select *, len(regexp_replace(line, '[^|>»•]', '', 'g')) parts, {_SAID} said from lines)
), per as (
  select r, count(*) - count(distinct line) dup, coalesce(sum(chars) filter (where failed), 0) lost from judged group by 1
), counted as (
  select d.r, doc_id, len(w) n_words, len(array_to_string(w, '')) word_chars,
    len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, coalesce(dup, 0) n_dup_lines, coalesce(n, 0) n_repeat_words, coalesce(lost, 0) lost
  from d left join hit using (r) left join per using (r)
)
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines,
  n_repeat_words::bigint n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * lost <= {quality.LOST_PERCENT} * word_chars kept
from counted
"""

DECONTAMINATION = f"""
with items as (select coalesce(item_id::varchar, '') item, {_words("text", TERMS)} w from benchmark),
windows as materialized (
  select distinct item, least(13, len(w)) s, list_slice(w, i, i + least(13, len(w)) - 1) g
  from items, unnest(range(1, greatest(len(w) - least(13, len(w)), 0) + 2)) u(i) where len(w) > 0
), d as materialized (select row_number() over () r, doc_id, {_words("text", TERMS)} w from documents),
places as (
  select r, i, s, list_slice(w, i, i + s - 1) g
  from d, (select distinct s from windows) z, unnest(range(1, greatest(len(w) - s + 2, 1))) u(i)
), found as materialized (select r, i, p.s, item from places p join windows x on p.s = x.s and p.g = x.g),
hit as (select r, count(distinct i + j) n from found, unnest(range(0, s)) v(j) group by 1),
names as (select r, list_sort(list(distinct item)) items from found group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_hit, coalesce(len(items), 0)::bigint n_items,
  sha256(coalesce(array_to_string(items, ','), '')) items_sha256, coalesce(n, 0) > 0 and 20 * coalesce(n, 0) >= len(w) contaminated
from d left join hit using (r) left join names using (r)
"""

WARC = """
with p as (select page_id, sha256(coalesce(html, '')) digest, strlen(coalesce(html, '')) n from pages),
f as (select *, case when n >= 100 then min(page_id) over (partition by digest) end first from p)
select page_id, n::bigint payload_bytes, digest payload_digest,
  case when first is not null and page_id is distinct from first then 'revisit' else 'response' end record_type,
  case when page_id is distinct from first then first end refers_to
from f
"""



def _assign(n: int) -> str:
    square = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
    return f"""a{n} as materialized (
  select * from (select v.vec_id, v.x, c.c, {square} d from v, c{n} c) qualify row_number() over (partition by vec_id order by d, c) = 1
)"""


def _move(n: int) -> str:
    """Centroids after round `n`: floors of the means, also of negative sums."""
    return f"""s{n} as (select c, i, sum(x[i])::hugeint s, count(*)::hugeint n from a{n}, unnest(range(1, {clusters.SIZE + 1})) u(i) group by 1, 2),
m{n} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) x from s{n} group by 1),
c{n + 1} as materialized (select c, coalesce(m.x, o.x) x from c{n} o left join m{n} m using (c))"""


CLUSTERS = f"""
with v as materialized (
  select vec_id, list_transform(embedding, lambda x: floor({clusters.SCALE} * x::double)::bigint) x from embeddings
  where len(embedding) = {clusters.SIZE} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {clusters.SIZE}
), c0 as materialized (
  select (row_number() over (order by sha256('{clusters.SALT}' || vec_id)) - 1)::int c, x from v
  order by sha256('{clusters.SALT}' || vec_id) limit {clusters.K}
), {", ".join(f"{_assign(n)}, {_move(n)}" for n in range(clusters.ROUNDS))}, {_assign(clusters.ROUNDS)}
select vec_id, c::int "cluster", d distance, (sum(d) over (partition by c))::bigint cluster_inertia, (sum(d) over ())::bigint inertia,
  sha256(array_to_string(list_transform(f.x, lambda y: y::varchar), ',')) centroid_sha256
from a{clusters.ROUNDS} a join (select c, x from c{clusters.ROUNDS}) f using (c)
"""


def _repeats(length: int) -> str:
    return f"""r{length} as materialized (
  select * from (select *, min(doc_id) over (partition by g) low, max(doc_id) over (partition by g) high from w{length}) where low < high
)"""


def _double(length: int) -> str:
    return f"""w{2 * length} as (
  select a.r, a.doc_id, a.i, md5(a.g || b.g) g from r{length} a join r{length} b on a.r = b.r and b.i = a.i + {length}
), {_repeats(2 * length)}"""


# Lengths up to 25,600 words; the longest text of the tables has 20,000.
_LENGTHS = [passages.WINDOW << n for n in range(10)]
_FIRST = _LENGTHS[0]

PASSAGES = f"""
with d as materialized (
  select row_number() over () r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') w from documents
), w{_FIRST} as (
  select r, doc_id, i, md5(array_to_string(list_slice(w, i, i + {_FIRST - 1}), ' ')) g
  from d, unnest(range(1, greatest(len(w) - {_FIRST - 2}, 1))) u(i)
), {_repeats(_FIRST)}, {", ".join(_double(n) for n in _LENGTHS[:-1])},
gone as (select distinct r, i + j i from r{_FIRST}, unnest(range(0, {_FIRST})) v(j) where doc_id > low),
reach as (select r, max(n) longest from ({" union all ".join(f"select r, {n} n from r{n} where doc_id > low" for n in _LENGTHS)}) group by 1),
kept as (
  select r, count(*) n, string_agg(w[i], ' ' order by i) t
  from (select r, w, i from d, unnest(range(1, len(w) + 1)) u(i)) anti join gone using (r, i) group by 1
)
select doc_id, len(w)::bigint n_words, len(w)::bigint - coalesce(n, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256,
  coalesce(longest, 0)::bigint longest
from d left join kept using (r) left join reach using (r)
"""

ORACLES = {
    "op3_url_filter": URL_FILTER,
    "op4_ngram_jaccard": NGRAM_JACCARD,
    "op5_quality": QUALITY,
    "op6_decontamination": DECONTAMINATION,
    "op10_warc": WARC,
    "op11_clusters": CLUSTERS,
    "op13_passages": PASSAGES,
}
