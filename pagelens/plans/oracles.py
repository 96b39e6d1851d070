"""DuckDB SQL for the detection queries, over the same tables, the same overlay and the same rule rows."""

from __future__ import annotations

from pagelens.functions import channels as ch
from pagelens.functions import urls
from pagelens.operators import catalogue, matching, safety, scoring, sites
from pagelens.plans.queries import SPELLINGS, TYPED
from pagelens.sources.captures import overlay_sql, quoted


def values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else quoted(x) if isinstance(x, str) else str(x)
    return f"(select * from (values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) as t({names}))"


def rx(pattern: str) -> str:
    """A pattern as RE2 writes it."""
    return quoted(pattern.replace(r"\s", r"[\s\x0b]") if "[^" not in pattern and r"[\s" not in pattern and r"\s>" not in pattern and r"'\s" not in pattern else pattern)


CAPS = f"caps as ({overlay_sql()})"
SCHEME = "(case when regexp_matches(trim({0}), '" + urls.SCHEME + "') then trim({0}) else 'https://' || trim({0}) end)"


def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1))"


def authority(u: str) -> str:
    return f"regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"


def host(u: str) -> str:
    return f"lower(regexp_replace(regexp_replace({authority(u)}, '^.*@', ''), ':[0-9]*$', ''))"


def port(u: str) -> str:
    p = f"regexp_extract({authority(u)}, ':([0-9]+)$', 1)"
    return f"(case when ({scheme(u)} = 'http' and {p} = '80') or ({scheme(u)} = 'https' and {p} = '443') then '' else {p} end)"


def path(u: str) -> str:
    return f"coalesce(nullif(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"


def whole(u: str) -> str:
    u = SCHEME.format(u)
    return f"({scheme(u)} || '://' || {host(u)} || case when {port(u)} = '' then '' else ':' || {port(u)} end || {path(u)} || regexp_extract({u}, '^[^?#]*([?#].*)', 1))"


def resolved(link: str, base: str) -> str:
    origin = f"{scheme(base)} || '://' || {authority(base)}"
    return f"(case when regexp_matches({link}, '{urls.SCHEME}') then {link} when starts_with({link}, '//') then {scheme(base)} || ':' || {link} when starts_with({link}, '/') then {origin} || {link} when starts_with({link}, '?') then {origin} || {path(base)} || {link} else {origin} || regexp_replace({path(base)}, '[^/]*$', '') || {link} end)"


def normal(u: str) -> str:
    return f"({scheme(u)} || '://' || {host(u)} || case when {port(u)} = '' then '' else ':' || {port(u)} end || (case when length({path(u)}) > 1 then coalesce(nullif(regexp_replace({path(u)}, '/+$', ''), ''), '/') else {path(u)} end) || regexp_extract({u}, '^[^?#]*(\\?[^#]*)', 1))"


def every(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({text}, {quoted(pattern)}, {group})"


def kept(column: str) -> str:
    return f"{column} <> '' and " + " and ".join(f"not starts_with({column}, '{p}')" for p in ch.NOT_LOADED)


def low(headers: str = "headers") -> str:
    """Entries (k, v) of a header map with names in lower case; the first in alphabetical order of equals."""
    return f"list_transform(list_sort(list_distinct(list_transform(map_keys({headers}), lambda k: lower(k)))), lambda n: {{'k': n, 'v': {headers}[list_min(list_filter(map_keys({headers}), lambda k: lower(k) = n))]}})"


def head(name: str) -> str:
    return f"coalesce(headers[list_min(list_filter(map_keys(headers), lambda k: lower(k) = '{name}'))], '')"


def without_samples(html: str) -> str:
    for tag in ("style", "pre", "code"):
        html = f"regexp_replace({html}, '(?is)<{tag}[\\s>].*?</{tag}\\s*>', '', 'g')"
    return f"regexp_replace(regexp_replace({html}, {quoted(ch.FENCE)}, '', 'g'), {quoted(ch.JSON_LD)}, '', 'g')"


#: Every script element, without those whose opening tag has a src; blank bodies are left out.
SCRIPTS = "list_filter(list_transform(list_filter(regexp_extract_all({0}, '(?is)<script[^>]*>.*?</script\\s*>'), lambda e: not regexp_matches(regexp_extract(e, '(?is)^<script[^>]*>'), '(?i)\\bsrc\\s*=')), lambda e: regexp_extract(e, '(?is)^<script[^>]*>(.*?)</script\\s*>$', 1)), lambda b: regexp_replace(b, '\\s+', '', 'g') <> '')"


def loaded() -> str:
    zipped = f"list_zip({every('html', ch.LOADED, 1)}, {every('html', ch.LOADED, 2)})"
    return f"list_filter(list_transform({zipped}, lambda z: {{'tag': lower(z[1]), 'src': z[2]}}), lambda z: {kept('z.src')})"


def resources() -> str:
    sets = f"flatten(list_transform({every('html', ch.SRCSET)}, lambda s: list_transform(string_split(s, ','), lambda p: regexp_split_to_array(trim(p), '\\s+')[1])))"
    return f"list_concat(list_transform({loaded()}, lambda z: z.src), list_filter({sets}, lambda u: u <> '' and not starts_with(u, 'data:')))"


IFRAMES = f"list_transform(list_filter({loaded()}, lambda z: z.tag = 'iframe'), lambda z: z.src)"
IDS_CLASSES = f"list_concat({every('html', ch.IDS)}, {every('html', ch.CLASSES)})"
CUSTOM = "list_transform(regexp_extract_all(html, '(?i)<([a-z]+-[a-z0-9-]+)[\\s/>]'), lambda e: regexp_extract(e, '(?i)<([a-z]+-[a-z0-9-]+)', 1))"
HOOKS = f"list_concat(list_concat({every('html', ch.DATA_ATTRIBUTE, 0)}, {CUSTOM}), list_transform({every('html', ch.STYLE)}, lambda s: s[1:20000]))"
CODE = f"list_concat({SCRIPTS.format(without_samples('html'))}, bundles)"


def join(x: str, by: str = "chr(10)") -> str:
    return f"coalesce(array_to_string({x}, {by}), '')"


URL_ANATOMY = f"""
with {CAPS}, u as (select page_id, {SCHEME.format('final_url')} as url from caps),
p as (select page_id, {host('url')} as hostname, {scheme('url')} as protocol, lower({path('url')}) as path, {port('url')} as port from u)
select page_id, hostname, protocol, regexp_matches(hostname, '^([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}$') or contains(hostname, ':') as is_ip, starts_with(hostname, 'xn--') or contains(hostname, '.xn--') as is_punycode,
  greatest(0, len(list_filter(string_split(hostname, '.'), lambda x: x <> '')) - 2)::integer as subdomains,
  array_to_string(list_filter({[*urls.RISK_WORDS]}, lambda w: contains(hostname, w) or contains(path, w)), ',') as risk_words, port not in ('', '80', '443') as unusual_port from p
"""

NUMBER = "list_reduce(list_concat([0.0::double], list_transform(list_filter(string_split(case when starts_with({0}, '0x') then substr({0}, 3, 40) else substr({0}, 1, 40) end, ''), lambda c: c <> ''), lambda c: (strpos('0123456789abcdef', c) - 1)::double)), lambda t, d: t * (case when starts_with({0}, '0x') then 16 when starts_with({0}, '0') and length({0}) > 1 then 8 else 10 end) + d)"
VALIDATE = f"""
raw as (select page_id, url from pages union all select * from {values([(-1 - i, s) for i, s in enumerate(SPELLINGS)], 'page_id, url')}),
u as (select page_id, url as raw, trim(coalesce(url, '')) as t, {SCHEME.format("coalesce(url, '')")} as url from raw),
p as (select *, {scheme('url')} as scheme, {authority('url')} as authority, {port('url')} as port, regexp_extract({authority('url')}, ':([0-9]+)$', 1) as given, {host('url')} as written from u),
d as (select *, regexp_replace(case when contains(written, '%') and not contains(regexp_replace(written, '%[0-9a-f]{{2}}', '', 'g'), '%') then lower(url_decode(written)) else written end, '\\.$', '') as host, contains(written, ':') or starts_with(written, '[') as literal from p),
n as (select *, string_split(host, '.') as labels, regexp_matches(host, '{urls.IPV4}') as numeric from d),
a as (select *, numeric and len(list_filter(labels[1:-2], lambda x: {NUMBER.format('x')} > 255)) = 0 and {NUMBER.format('labels[-1]')} < pow(256.0, 5 - len(labels)) as address from n),
valid as (select page_id, raw as url, case
  when t = '' then {{'code': 'INVALID_URL', 'message': 'Empty URL'}} when length(t) > 2048 then {{'code': 'INVALID_URL', 'message': 'URL too long'}}
  when regexp_matches(t, '[\\s<>"''`]') then {{'code': 'INVALID_URL', 'message': 'URL contains invalid characters'}}
  when authority = '' or (not literal and (regexp_matches(host, {quoted(urls.FORBIDDEN)}) or (regexp_matches(host, '{urls.NUMERIC}') and not address))) or length(given) > 5 or (length(given) = 5 and given > '65535') then {{'code': 'INVALID_URL', 'message': 'Cannot parse URL'}}
  when contains(authority, '@') then {{'code': 'INVALID_URL', 'message': 'URLs with user credentials are not allowed'}} when scheme not in ('http', 'https') then {{'code': 'INVALID_URL', 'message': 'Unsupported scheme: ' || scheme || ':'}}
  when port not in ('', '80', '443') then {{'code': 'INVALID_URL', 'message': 'Non-standard port: ' || port}} when host = '' then {{'code': 'INVALID_URL', 'message': 'Missing hostname'}}
  when address or literal then {{'code': 'BLOCKED_TARGET', 'message': 'Direct IP access is not allowed'}}
  when regexp_matches(host, '{urls.RESERVED_HOSTS}') then {{'code': 'BLOCKED_TARGET', 'message': 'Private or reserved hostname'}} else {{'code': 'ok', 'message': null}} end as v from a)
"""


def codes_of(rows: str) -> str:
    """(url, code, message): the validation of other addresses than those of pages; `rows` selects them as url."""
    return f"(with {VALIDATE.replace('select page_id, url from pages union all', f'select row_number() over () as page_id, url from ({rows}) union all')} select url, v.code as code, v.message as message from valid where page_id > 0)"


TEXT_LENGTH = "length(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '<[^>]+>', '', 'g'), '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g'))"
PROFILE = f"""
with {CAPS}
select page_id, octet_length(encode(html))::integer as bytes, {TEXT_LENGTH}::integer as text_length,
  {TEXT_LENGTH} < 200 or regexp_matches(html, '(?i)<div[^>]+id=["''](?:root|app)["'']>\\s*</div>') or regexp_matches(html, '(?i)<body>\\s*</body>') as shell,
  len({every('html', ch.COMMENT)})::integer as comments, len({SCRIPTS.format(without_samples('html'))})::integer as inline_scripts,
  nullif(trim(regexp_extract(html, '(?i)<meta\\s+[^>]*http-equiv=["'']refresh["''][^>]*content=["''][0-9]+;\\s*url=([^"'']+)["'']', 1)), '') as refresh from caps
"""


def links_of(table: str, key: str) -> str:
    """CTEs ending in `links` (key, ord, link)."""
    origin = f"{scheme('url')} || '://' || {authority('url')}"
    return f"""
raw as (select {key}, url, unnest({every('html', ch.ANCHOR)}) as link, generate_subscripts({every('html', ch.ANCHOR)}, 1) as pos from {table}),
trimmed as (select {key}, url, pos, trim(link) as link from raw where trim(link) <> '' and not regexp_matches(trim(link), '^(mailto|tel|javascript):')),
abs as (select {key}, url as base, pos, case when regexp_matches(link, '{urls.SCHEME}') then link when starts_with(link, '//') then {scheme('url')} || ':' || link when starts_with(link, '/') then {origin} || link
  when starts_with(link, '?') then {origin} || {path('url')} || link else {origin} || regexp_replace({path('url')}, '[^/]*$', '') || link end as url from trimmed),
inner_ as (select {key}, pos, {normal('url')} as link from abs where regexp_matches(url, '^(?i:https?)://') and {host('url')} = {host('base')} and not regexp_matches(string_split(url, '?')[1], {quoted(urls.ASSET)})),
firsts as (select {key}, link, min(pos) as pos from inner_ group by all),
links as (select {key}, (row_number() over (partition by {key} order by pos) - 1)::integer as ord, link from firsts qualify ord < 100)"""


INTERNAL_LINKS = f"with {CAPS}, {links_of('caps', 'page_id')} select page_id, ord, link from links"
SEGMENT = "'/' || coalesce(list_filter(string_split({0}, '/'), lambda x: x <> '')[1], '/')"
DIVERSE = f"""
prefixed as (select *, {SEGMENT.format(path('url'))} as prefix from listed),
rounds as (select *, row_number() over (partition by site, prefix order by ord) as round, min(ord) over (partition by site, prefix) as group_ord from prefixed),
diverse as (select site, row_number() over (partition by site order by round, group_ord)::integer as place, url, prefix from rounds)"""
DIVERSE_SAMPLE = f"with listed as (select {host('url')} as site, page_id as ord, url from pages), {DIVERSE} select * from diverse where place <= 10"
SAMPLE_PLAN = f"""
with listed as (select {host('url')} as site, page_id as ord, url from pages), {DIVERSE},
home as (select distinct site, 'https://' || site || '/' as url from listed),
first_page as (select {host('url')} as site, arg_min(url, page_id) as url, arg_min(html, page_id) as html from pages group by 1), {links_of('first_page', 'site')},
known as (select site, 1 as source, ord, {normal('url')} as url from listed union all select site, 2, ord, {normal('link')} from links),
every_ as (select site, 0 as source, 0 as ord, {normal('url')} as url from home union all select site, 1, place, {normal('url')} from diverse where place <= 15 union all select site, 2, ord, {normal('link')} from links union all select site, 3, 0, {normal("(url || 'extra/')")} from home),
once as (select site, url, min({{'source': source, 'ord': ord}}) as k from every_ group by all),
sample as (select *, row_number() over (partition by site order by k) as place from once qualify place <= 15),
known_once as (select site, url, min({{'source': source, 'ord': ord}}) as k from known group by all),
rest as (select *, row_number() over (partition by site order by k) + 15 as place from known_once anti join sample using (site, url) qualify place <= 30),
found as (select site, greatest((select count(*) from known where known.site = s.site and source = 1), (select count(*) from known where known.site = s.site and source = 2), count(*)) as found from sample s group by site)
select site, place::integer as place, url, k.source as source, scanned, found from (select *, true as scanned from sample union all by name select *, false as scanned from rest) join found using (site)
"""

REFS = f"list_filter(list_zip({every('html', ch.RESOURCE, 1)}, {every('html', ch.RESOURCE, 2)}), lambda z: {kept('z[2]')})"
ATTR = "case lower(r[1]) when 'link' then 'href' when 'form' then 'action' else 'src' end"
RESOURCE_REFS = f"with {CAPS}, refs as (select page_id, unnest({REFS}) as r, generate_subscripts({REFS}, 1) - 1 as ord from caps) select page_id, ord::integer as ord, lower(r[1]) as tag, {ATTR} as attr, r[2] as src from refs"
METAS = f"list_zip({every('html', ch.META, 1)}, {every('html', ch.META, 2)})"
SECURITY_CHANNELS = f"""
with {CAPS}
select page_id, {join(resources())} as resources, {join(IFRAMES)} as iframes, {join(SCRIPTS.format(without_samples('html')))} as scripts, {join(f"list_transform({METAS}, lambda z: z[1] || '=' || z[2])")} as metas,
  {join(IDS_CLASSES, "' '")} as dom, {join(every('html', ch.SITEKEYS))} as sitekeys, {join(every('html', ch.COMMENT))} as comments, {head('content-security-policy')} as csp from caps
"""
ATTRIBUTE_HOOKS = f"with {CAPS}, h as (select page_id, unnest({HOOKS}) as hook, generate_subscripts({HOOKS}, 1) - 1 as ord from caps) select page_id, ord::integer as ord, hook from h"

CORE_RULES = values([r[:17] for r in catalogue.core_rows()], "tech_ord, tech_id, tech_name, category, excludes, veto, sig_ord, type, header, weight, strength, version_group, pattern, channel, family, specificity, description")


def _channel(name: str, items: str, n: str = "''", v: str = "x", alt: str = "null") -> str:
    return f"select page_id, '{name}' as channel, {n} as name, ord, {v} as value, {alt} as alt from (select page_id, unnest({items}) as x, generate_subscripts({items}, 1) as ord from caps)"


_ENTRIES = "list_transform(map_keys({0}), lambda k: {{'k': k, 'v': {0}[k]}})"
CHANNELS = " union all ".join([
    _channel("generator", every("html", ch.GENERATOR)), "select page_id, 'usage', '', 0, " + f"regexp_replace(regexp_replace({without_samples('html')}, '(?is)<div[^>]*class=[\"''][^\"'']*(code-wrapper|codeblock|code-sample|gatsby-highlight|prettyprint|codehilite|highlighter-)[^\"'']*[\"''][^>]*>.*?</div\\s*>', '', 'g'), '(?is)<figure[^>]*class=[\"''][^\"'']*(code-wrapper|codeblock|code-sample)[^\"'']*[\"''][^>]*>.*?</figure\\s*>', '', 'g')" + ", null from caps",
    _channel("resource", REFS, f"lower(x[1]) || '[' || {ATTR.replace('r[1]', 'x[1]')} || ']'", "x[2]"), _channel("href", every("html", ch.HREF)),
    _channel("header", low(), "x.k", "x.v"), _channel("cookie", "cookies"), _channel("probe", _ENTRIES.format("probes"), "x.k", "x.v"),
])
_USAGE = "type in ('html-path', 'html-regex')"
EVIDENCE = f"""
{CAPS}, rules as {CORE_RULES}, channels as ({CHANNELS}),
hits as (
  select c.page_id, r.*, c.name as cname, c.value as cvalue, row_number() over (partition by c.page_id, r.tech_id, r.sig_ord order by c.ord) as nth
  from channels c join rules r on c.channel = r.channel and (r.channel not in ('header', 'probe') or r.header = c.name)
  where regexp_replace(c.value, '\\s+', '', 'g') <> '' and case when r.channel = 'probe' then contains(c.value, r.pattern) else regexp_matches(c.value, '(?i)' || r.pattern) end),
firsts as (select * from hits h where nth = 1 and exists (select 1 from hits o where o.page_id = h.page_id and o.tech_id = h.tech_id and o.type <> 'probe')
  and not (veto <> '' and exists (select 1 from caps where caps.page_id = h.page_id and regexp_matches(caps.html, '(?i)' || h.veto)))),
marked as (select *, case when {_USAGE} then regexp_extract(cvalue, '(?i)' || pattern) else '' end as whole from firsts),
placed as (select *, whole[1:80] as marker, case when {_USAGE} then strpos(cvalue, whole) - 1 else 0 end as pos, cvalue[1:120] as cut, lower(regexp_extract(cvalue, '^(?i:https?:)?//([^/?#:]+)', 1)) as rhost from marked),
shown as (select *, trim(regexp_replace(substr(cvalue, greatest(0, pos - 24) + 1, pos + 56 - greatest(0, pos - 24)), '[\\s\\x0b]+', ' ', 'g'))[1:80] as context from placed),
evidence as (select page_id, tech_ord, tech_id, tech_name, category, excludes, sig_ord, type,
  case when {_USAGE} then marker when type = 'script-host' then coalesce(nullif(rhost, ''), pattern) when type = 'meta-generator' then 'generator' when type = 'stylesheet-url' then cvalue[1:80] when type = 'cookie-name' then cvalue else header end as name,
  case when {_USAGE} then coalesce(nullif(context, ''), marker) when type = 'probe' then 'success signal ' || pattern when type = 'cookie-name' then cvalue else cut end as value,
  case when {_USAGE} then 'html: "' || marker || '"' when type = 'script-host' then cname || ': "' || cut || '"' when type = 'meta-generator' then 'meta[generator]: "' || cvalue || '"' when type = 'stylesheet-url' then 'stylesheet: "' || cut || '"'
    when type = 'header' then 'header[' || header || ']: "' || cut || '"' when type = 'cookie-name' then 'cookie: "' || cvalue || '"' else 'probe[' || header || ']' end as artifact,
  case when version_group = 1 then nullif(regexp_extract(cvalue, '(?i)' || pattern, 1), '') end as version, weight, strength, family, specificity, description from shown)
"""
CORE_EVIDENCE = f"with {EVIDENCE} select page_id, tech_id, sig_ord, type, name, value, artifact, version, weight, strength, family, specificity::double as specificity, description from evidence"


def saturating(weights: str) -> str:
    return f"list_reduce(list_concat([0.0::double], {weights}), lambda t, w: least(100.0, t + floor(w * (1 - t / 100) + 0.5)))::integer"


DETECTIONS = f"""{EVIDENCE},
summed as (select page_id, tech_ord, tech_id, tech_name, category, {saturating('list(weight::double order by sig_ord)')} as confidence, (list(version order by sig_ord) filter (version is not null))[1] as version, count(*)::integer as signals from evidence group by all),
gone as (select distinct page_id, unnest(string_split(excludes, ',')) as tech_id from evidence where excludes <> ''),
detections as (select page_id, tech_ord, tech_id, tech_name, category, confidence, case when confidence >= 90 then 'confirmed' when confidence >= 70 then 'likely' else 'possible' end as label, version, signals from summed s anti join gone g using (page_id, tech_id))
"""
CORE_CONFIDENCE = f"with {DETECTIONS} select * exclude (tech_ord) from detections"
_URL = "((?:[a-z0-9-]+\\.)+[a-z]{2,})(:\\d+)?(/[a-z0-9_~.-]*)?"
EXPLAINED = f"""
keyed as (select *, least(100, greatest(0, weight)) / 100.0::double * specificity::double as adjusted, lower(trim(value)) as raw from evidence),
keys as (select *, case when raw = '' then 't::' || family || '::' || name when regexp_extract(raw, '{_URL}', 1) <> '' then 'u::' || regexp_replace(regexp_extract(raw, '{_URL}', 1), '^www\\.', '') || regexp_replace(regexp_extract(raw, '{_URL}', 3), '/+$', '')
  else 't::' || family || '::' || regexp_replace(regexp_replace(regexp_replace(raw, '^https?://', ''), '^//', ''), '[/?#\\s"''<>.,;:]+$', '') end as key from keyed),
ranked as (select *, min(sig_ord) over (partition by page_id, tech_id, key) as first_ord, row_number() over (partition by page_id, tech_id, key order by adjusted desc, sig_ord) = 1 as stands from keys),
explained as (select *, stands and row_number() over (partition by page_id, tech_id, family, stands order by adjusted desc, first_ord) = 1 as wins from ranked)
"""
EXPLAIN = f"with {EVIDENCE}, {EXPLAINED} select page_id, tech_id, sig_ord, key, adjusted, stands, wins from explained"
SCORES = f"""{EXPLAINED},
fams as (select page_id, tech_ord, tech_id, tech_name, category, family, max(adjusted) as best, min(first_ord) as at_, max((strength = 'definitive')::int) as definitive, max((strength <> 'weak')::int) as strong from explained where stands group by all),
alls as (select page_id, tech_ord, tech_id, tech_name, category, list_reduce(list_concat([0.0::double], list(best order by at_, family)), lambda c, v: 1 - (1 - c) * (1 - v)) as combined, count(*)::integer as families, max(definitive) as definitive, max(strong) as strong from fams group by page_id, tech_ord, tech_id, tech_name, category),
scores as (select page_id, tech_ord, tech_id, tech_name, category, greatest(0, least(floor(combined * 100 + {scoring.BONUS}[least(families, 4) + 1] + 0.5), case when strong = 0 then {scoring.WEAK_CEILING} else 100 end, case when definitive = 0 then {scoring.NO_DEFINITIVE_CEILING} else 100 end))::integer as score, families from alls)
"""
LABEL5 = "case when score >= 90 then 'VERY HIGH' when score >= 75 then 'HIGH' when score >= 60 then 'MEDIUM' when score >= 40 then 'LOW' else 'INSUFFICIENT' end"
CORE_SCORE = f"with {EVIDENCE}, {SCORES} select * exclude (tech_ord), {LABEL5} as label from scores"
CORE_DETECT = f"""with {DETECTIONS}, {SCORES},
known as (select s.*, d.confidence, d.label, d.version from scores s join detections d using (page_id, tech_id)),
placed_ as (select *, category in ('cms', 'builder', 'ecommerce') as platform, row_number() over w as place, first(tech_id) over w as winner, first(score) over w as top from known window w as (partition by page_id, category in ('cms', 'builder', 'ecommerce') order by score desc, tech_ord)),
fought as (select *, platform and place > 1 and top >= {scoring.CONTEST_MIN} as lost from placed_),
final as (select page_id, tech_ord, tech_id, tech_name, category, confidence, label, version, (case when lost then greatest(0, score - floor({scoring.CONTEST_PENALTY} * top / 100 + 0.5)) else score end)::integer as score, families, case when lost then winner end as lost_to from fought where category <> 'analytics')
select * exclude (tech_ord), {LABEL5} as score_label, row_number() over (partition by page_id order by confidence desc, tech_ord)::integer as rank, score >= {scoring.DISPLAY_MIN} as shown from final"""


def hays(rules: list[tuple], look: dict, containers: tuple) -> str:
    places = [(t, c, i) for t, cs in look.items() for i, c in enumerate(cs)] + [(t, "container", 90) for t in containers]
    sanitised = "regexp_replace(regexp_replace(regexp_replace(x.js, '\"name\"\\s*:\\s*\"(?:[^\"\\\\]|\\\\.)*\"', '\"name\":\"\"', 'g'), '(?s)/\\*.*?\\*/', ' ', 'g'), '(^|[^:/])//[^\\n]*', '\\1 ', 'g')"
    return f"""{CAPS},
page as (select page_id, html, cookies, list_transform(containers[1:3], lambda c: {{'id': c.id, 'js': c.js[1:400000]}}) as containers, globals, requests, storage_keys, {join(CODE)} as code, {join(IDS_CLASSES, "' '")} as dom, {join(every('html', ch.COMMENT))} as comments, {head('content-security-policy')} as csp from caps),
hays as (
  select page_id, 'resource' as channel, '' as name, {join(f'list_concat({resources()}, requests)')} as text from page union all select page_id, 'code', '', code from page union all select page_id, 'global', '', {join('list_concat(globals, [code])')} from page union all select page_id, 'dom', '', dom from page
  union all select page_id, 'attr', '', {join(f'list_concat({HOOKS}, [dom])')} from page union all select page_id, 'cookie', '', {join('list_concat(cookies, storage_keys)', "' '")} from page union all select page_id, 'comments', '', comments from page
  union all select page_id, 'weak', '', csp || chr(10) || comments from page union all select page_id, 'iframe', '', {join(IFRAMES)} from page
  union all select page_id, 'container', lpad((ord - 1)::varchar, 4, '0') || ' ' || x.id, {sanitised} from (select page_id, unnest(containers) as x, generate_subscripts(containers, 1) as ord from page)),
rules as {values(rules, 'tech_ord, tech_id, tech_name, category, rule_ord, type, weight, product, pattern, description, launch_only')}, places as {values(places, 'type, channel, place')},
found as (select h.page_id, r.*, p.place, h.channel, h.name, trim(regexp_replace(regexp_extract(h.text, '(?i)' || r.pattern), '[\\s\\x0b]+', ' ', 'g')) as flat from hays h join places p using (channel) join rules r on r.type = p.type where h.text <> '' and (p.channel <> 'container' or r.weight >= 0.35) and regexp_matches(h.text, '(?i)' || r.pattern)),
direct as (select page_id, tech_ord, tech_id, tech_name, category, rule_ord, type, weight::double as weight, product, arg_min(channel, place) in ('weak', 'comments') as header_only, any_value(launch_only) as launch_only, any_value(description) as detail, arg_min(flat, place) as value, null::varchar as container from found where channel <> 'container' group by page_id, tech_ord, tech_id, tech_name, category, rule_ord, type, weight, product),
via as (select page_id, tech_ord, tech_id, tech_name, category, 1000 + name[1:4]::integer as rule_ord, 'via-gtm' as type, 0.7::double as weight, arg_min(product, rule_ord) as product, false as header_only, arg_min(launch_only, rule_ord) as launch_only, 'Found in GTM container ' || name[6:] || ': ' || arg_min(description, rule_ord) as detail, arg_min(flat, rule_ord) as value, name[6:] as container from found where channel = 'container' group by page_id, tech_ord, tech_id, tech_name, category, name)"""


_TAG = next(r for r in catalogue.growth_rows()[0] if r[1] == "google-tag-manager")
GROWTH_HITS = f"""{hays(catalogue.growth_rows()[0], matching.GROWTH_LOOK, ('script-host', 'sdk-init'))},
hits as (select * from direct union all select * from via union all
  select page_id, {_TAG[0]}, {quoted(_TAG[1])}, {quoted(_TAG[2])}, {quoted(_TAG[3])}, 500, 'script-host', 0.9, '', false, false, {quoted(_TAG[2])} || ' container (' || array_to_string(list_transform(containers, lambda c: c.id), ', ') || ') deployed', containers[1].id, null from caps where len(containers) > 0 and page_id not in (select page_id from direct where tech_id = 'google-tag-manager'))"""
COMBINED = """
typed as (select *, min(rule_ord) over (partition by page_id, tech_id, type) as at_, row_number() over (partition by page_id, tech_id, type order by weight desc, rule_ord) as nth from hits),
combined as (select page_id, tech_ord, tech_id, tech_name, category, 1 - list_reduce(list_concat([1.0::double], list(weight order by at_)), lambda p, w: p * (1 - w)) as p, array_to_string(list(type order by at_), ',') as types, list(type) as kinds, bool_and(header_only) as header_only, bool_and(launch_only) as launch_only, bool_or(type <> 'via-gtm') as direct from typed where nth = 1 group by page_id, tech_ord, tech_id, tech_name, category)"""


def cap(p: str, cond: str, most: float) -> str:
    return f"case when {cond} then least({p}, {most}::double) else {p} end"


_G = cap(cap(cap(cap("p", f"not list_has_any(kinds, {scoring.GROWTH_STRONG})", scoring.NO_STRONG), "header_only", scoring.HEADER_ONLY), "launch_only", scoring.LAUNCH_ONLY), "not direct", scoring.CONTAINER_ONLY)
IDS = f"""text as (select page_id, array_to_string(list(text order by channel = 'code'), chr(10)) as text from hays where channel in ('resource', 'code') and text <> '' group by page_id),
found_ids as ({' union all '.join(f"select page_id, {quoted(r[1])} as tech_id, {r[2]} as rule_ord, {quoted(r[3])} as kind, generate_subscripts(regexp_extract_all(text, {quoted(r[4])}, 1), 1) as pos, unnest(regexp_extract_all(text, {quoted(r[4])}, 1)) as value from text" for r in catalogue.growth_rows()[1])}
  union all select page_id, 'google-tag-manager', -1, 'GTM container ID', generate_subscripts(containers, 1), unnest(list_transform(containers, lambda c: c.id)) from caps),
good as (select page_id, tech_id, kind, trim(value) as value, min({{'r': rule_ord, 'p': pos}}) as k from found_ids where trim(value) <> '' and length(trim(value)) <= 128 and (kind <> 'GTM container ID' or regexp_matches(trim(value), '^GTM-[A-Z0-9]{{4,15}}$')) and (kind <> 'GA4 measurement ID' or regexp_matches(trim(value), '^G-[A-Z0-9]{{4,15}}$')) group by page_id, tech_id, kind, trim(value)),
ids as (select page_id, tech_id, row_number() over (partition by page_id, tech_id order by k)::integer as place, kind, value from good qualify place <= 10)"""
_BY_SCORE = "row_number() over (partition by page_id order by score desc, tech_name collate en, tech_ord)::integer as place"
GROWTH_SCORES = f"""{GROWTH_HITS}, {COMBINED}, {IDS},
products as (select page_id, tech_id, case when count(*) = 1 then 'Matched product: ' else 'Matched products: ' end || array_to_string(list(product order by at_), ', ') || '.' as products from (select page_id, tech_id, product, min(rule_ord) as at_ from hits where tech_id = 'salesforce' and product <> '' group by all) group by page_id, tech_id),
legacy as (select page_id, tech_id, 'Universal Analytics (legacy) ' || array_to_string(list(value order by place) filter (kind = '{scoring.UA}'), ', ') || '; GA4 (G-…) not seen.' as legacy from ids where tech_id = 'google-analytics' group by page_id, tech_id having bool_or(kind = '{scoring.UA}') and not bool_or(kind = '{scoring.GA4}')),
scored as (select page_id, tech_ord, tech_id, tech_name, category, floor(({_G}) * 100 + 0.5)::integer as score, types from combined),
final as (select s.*, case when score >= 90 then 'very-high' when score >= 75 then 'high' when score >= 60 then 'medium' else 'low' end as band, coalesce(p.products, l.legacy) as note, {_BY_SCORE} from scored s left join products p using (page_id, tech_id) left join legacy l using (page_id, tech_id) where score >= {scoring.GROWTH_MIN})"""
GROWTH_DETECT = f"with {GROWTH_SCORES} select page_id, tech_id, tech_name, category, score, band, types, note, place, website, variant_note from final left join {values(catalogue.growth_details(), 'tech_id, website, variant_note')} using (tech_id)"
_FAMILY = "case type " + " ".join(f"when '{k}' then '{v}'" for k, v in scoring.FAMILIES.items()) + " end"
GROWTH_EVIDENCE = f"""with {GROWTH_SCORES},
won as (select page_id, tech_id, detail as won from typed where nth = 1 and type = 'via-gtm'),
listed_ as (select page_id, tech_id, 0 as extra, at_, rule_ord, type, detail, value from typed where nth = 1 union all
  select page_id, tech_id, 1, rule_ord, rule_ord, type, detail, value from hits join won using (page_id, tech_id) where type = 'via-gtm' and detail <> won)
select page_id, tech_id, row_number() over (partition by page_id, tech_id order by extra, at_, rule_ord)::integer as place, type, detail, nullif(case when length(value) > 140 then value[1:137] || '…' else value end, '') as value, {_FAMILY} as family from listed_ semi join final using (page_id, tech_id)"""


def grouped(categories: list[str]) -> str:
    return f"""grid as (select page_id, category_ord, category from pages, {values(list(enumerate(categories)), 'category_ord, category')})
select page_id, category_ord, category, coalesce(array_to_string(list(tech_name order by score desc, tech_name) filter (tech_name is not null), ', '), '') as technologies, count(tech_name)::bigint as n from grid left join (select page_id, category, tech_name, score from final) using (page_id, category) group by page_id, category_ord, category"""


GROWTH_BY_CATEGORY = f"with {GROWTH_SCORES}, {grouped(catalogue.GROWTH_CATEGORIES)}"
GROWTH_VIA = f"with {GROWTH_HITS} select page_id, tech_id, container, weight from hits where type = 'via-gtm'"
GROWTH_IDS = f"with {hays(catalogue.growth_rows()[0], matching.GROWTH_LOOK, ())}, {IDS} select * from ids"
SERVER_SIDE = f"""with {CAPS}, t as (select page_id, lower(coalesce(html, '')[1:200000] || chr(10) || coalesce(array_to_string(bundles, chr(10)), '')[1:200000]) as text from caps)
select page_id, contains(text, '/cdn-cgi/zaraz/') or contains(text, 'zaraz.track') or contains(text, 'sgtm.') or contains(text, '/g/collect?') as warning from t"""
_S = cap(cap("p", f"not list_has_any(kinds, {scoring.SECURITY_STRONG})", scoring.SECURITY_NO_STRONG), "header_only", scoring.SECURITY_HEADER_ONLY)
SECURITY = f"""{hays(catalogue.security_rows(), matching.SECURITY_LOOK, ('script-host', 'sdk-init', 'network-host', 'iframe', 'runtime-global'))}, hits as (select * from direct union all select * from via), {COMBINED},
demo as (select page_id from caps where len(list_filter({every('html', ch.SITEKEYS)}, lambda k: length(k) < 30 and regexp_matches(k, {quoted(scoring.PLACEHOLDER)}))) > 0),
limited as (select *, {_S} as q from combined),
final as (select page_id, tech_ord, tech_id, tech_name, category, floor(q * 100 + 0.5) / 100 as score, floor(floor(q * 100 + 0.5) / 100 * 100 + 0.5)::integer as score100, case when floor(q * 100 + 0.5) / 100 >= 0.85 then 'high' when floor(q * 100 + 0.5) / 100 >= 0.6 then 'medium' else 'low' end as label, types
  from limited where q >= {scoring.SECURITY_MIN} and not (tech_id in ('recaptcha', 'hcaptcha', 'cloudflare-turnstile') and page_id in (select page_id from demo)))"""
SECURITY_DETECT = f"with {SECURITY} select page_id, tech_id, tech_name, category, score, score100, label, types, row_number() over (partition by page_id order by score desc, tech_name collate en, tech_ord)::integer as place from final"
SECURITY_BY_CATEGORY = f"with {SECURITY}, {grouped(catalogue.SECURITY_CATEGORIES)}"
CHALLENGE = f"(regexp_matches(html[1:8000], {quoted(safety.CHALLENGE)}) or status in (401, 403, 407, 429, 503))"
BOT_CHALLENGE = f"with {CAPS} select page_id, status, {CHALLENGE} as challenge from caps"
_VALUE = "coalesce(list_filter(h, lambda e: e.k = regexp_extract(channel, 'header:([^+]+)', 1))[1].v, '')"
BOT_PROVIDER = f"""with {CAPS}, page as (select page_id, {low()} as h, cookies, html[1:20000] as body from caps), rules as {values(catalogue.protection_rows(), 'provider_ord, provider_id, provider, rule_ord, strength, channel, label, pattern')},
hits as (select page_id, provider_ord, provider, rule_ord, strength, label, case when strength = 'strong' then 55.0::double else 25.0::double end as points from page, rules
  where case when channel = 'cookie' then len(list_filter(cookies, lambda c: regexp_matches(c, pattern))) > 0 when contains(channel, '+') then {_VALUE} <> '' and regexp_matches(body[1:8000], pattern) when starts_with(channel, 'header') then regexp_matches({_VALUE}, pattern) else regexp_matches(body, pattern) end),
rows_ as (select page_id, provider_ord, provider, {saturating('list(points order by rule_ord)')} as score, bool_or(strength = 'strong') as strong, array_to_string(list(label order by rule_ord), ' | ') as evidence from hits group by page_id, provider_ord, provider)
select page_id, arg_min(provider, {{'a': -score, 'b': provider_ord}}) as provider, least(98, max(score)) / 100 as confidence, arg_min(evidence, {{'a': -score, 'b': provider_ord}}) as evidence from rows_ where score >= 40 and strong group by page_id"""
RELEVANT = f"with {CAPS}, h as (select page_id, unnest({low()}) as e from caps) select page_id, e.k as header, e.v[1:200] as value from h where regexp_matches(e.k, '{safety.RELEVANT}')"

_CSP, _HSTS = head("content-security-policy"), head("strict-transport-security")
_HAS = f"(trim({_CSP}) <> '')"
AUDIT = f"""audit as (select page_id, url, final_url, html, redirect_chain, {_HAS} as csp, {_HAS} and contains({_CSP}, '''unsafe-inline''') as unsafe_inline, {_HAS} and contains({_CSP}, '''unsafe-eval''') as unsafe_eval, trim({_HSTS}) <> '' as hsts,
  coalesce(try_cast(nullif(regexp_extract({_HSTS}, '(?i)max-age=(\\d+)', 1), '') as bigint), 0) as hsts_age, contains(lower({_HSTS}), 'includesubdomains') as hsts_subdomains, contains(lower({_HSTS}), 'preload') as hsts_preload,
  lower(trim({head('x-content-type-options')})) = 'nosniff' as nosniff, ({_HAS} and contains({_CSP}, 'frame-ancestors')) or upper(trim({head('x-frame-options')})) in ('DENY', 'SAMEORIGIN') as framing,
  len(list_filter({safety.REFERRER_POLICIES}, lambda p: contains(lower(trim({head('referrer-policy')})), p))) > 0 as referrer, coalesce(nullif({head('permissions-policy')}, ''), {head('feature-policy')}) <> '' as permissions,
  regexp_matches({head('server')}, '\\d+\\.\\d+') or regexp_matches({head('x-powered-by')}, '\\d+\\.\\d+') as exposes_version from caps)"""
HEADER_AUDIT = f"with {CAPS}, {AUDIT} select * exclude (url, final_url, html, redirect_chain), case when not hsts then 'Missing HSTS' else (case when hsts_age >= {safety.YEAR} then 'Enforced (max-age: ' else 'Short duration (max-age: ' end) || floor(hsts_age / 86400 + 0.5)::bigint || ' days)' end as hsts_summary from audit"
MIXED_ROWS = f"""mixed_rows as (select page_id, url_, resource, min(pos) as pos from (select page_id, {{0}} as url_, unnest({every('html', safety.MIXED)}) as resource, generate_subscripts({every('html', safety.MIXED)}, 1) as pos from caps) where lower(regexp_extract({SCHEME.format('url_')}, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) = 'https' group by page_id, url_, resource)"""
MIXED = f"with {CAPS}, {MIXED_ROWS.format('url')} select page_id, (row_number() over (partition by page_id order by pos) - 1)::integer as ord, resource from mixed_rows qualify ord < 10"
HOPS = f"""
h0 as (select page_id, url, final_url, case when len(redirect_chain) > 0 then redirect_chain else [url] end as c from caps), h1 as (select *, case when c[1] <> url then list_concat([url], c) else c end as d from h0), h2 as (select page_id, url, case when d[-1] <> final_url and final_url <> '' then list_concat(d, [final_url]) else d end as hops from h1),
redirects as (select page_id, (len(hops) - 1)::integer as hops, len(list_filter(hops, lambda u: {host('url')} <> '' and {host('u')} <> '' and {host('u')} <> {host('url')} and not ends_with({host('u')}, '.' || {host('url')}))) > 0 as cross_domain,
  len(list_filter(range(1, len(hops)), lambda i: {scheme('hops[i]')} = 'https' and {scheme('hops[i + 1]')} = 'http')) > 0 as downgrade, len(hops) - 1 > 3 as excessive from h2)"""
REDIRECTS = f"with {CAPS}, {HOPS} select * from redirects"
_F = lambda cond, name, area, status, severity: f"select page_id, '{name}' as finding, '{area}' as area, '{status}' as status, '{severity}' as severity from facts where {cond}"
FINDINGS = f"""{CAPS}, {AUDIT}, {HOPS}, {MIXED_ROWS.format("coalesce(nullif(final_url, ''), url)")},
anat as ({URL_ANATOMY.strip().removeprefix(f'with {CAPS},').strip().join(['with ', ''])}),
facts as (select a.*, r.*, t.protocol = 'https' as https, t.is_punycode, t.is_ip, t.risk_words, a.page_id in (select page_id from mixed_rows) as mixed from audit a join redirects r using (page_id) join anat t using (page_id)),
findings as ({' union all '.join([
    _F('https', 'conn-https-valid', 'connection', 'pass', 'none'), _F('not https', 'conn-https-missing', 'connection', 'threat', 'high'),
    _F(f'hsts and hsts_age >= {safety.YEAR}', 'conn-hsts', 'connection', 'pass', 'none'), _F(f'hsts and hsts_age < {safety.YEAR}', 'conn-hsts', 'connection', 'concern', 'low'), _F('not hsts', 'conn-hsts-missing', 'connection', 'concern', 'medium'),
    _F('mixed', 'conn-mixed-content', 'connection', 'threat', 'high'), _F('not mixed and https', 'conn-mixed-clean', 'connection', 'pass', 'none'),
    _F('csp and unsafe_inline', 'hdr-csp', 'headers', 'concern', 'low'), _F('csp and not unsafe_inline', 'hdr-csp', 'headers', 'pass', 'none'), _F('not csp', 'hdr-csp-missing', 'headers', 'concern', 'medium'),
    _F('nosniff', 'hdr-xcto', 'headers', 'pass', 'none'), _F('not nosniff', 'hdr-xcto-missing', 'headers', 'concern', 'low'), _F('framing', 'hdr-xfo', 'headers', 'pass', 'none'), _F('not framing', 'hdr-xfo-missing', 'headers', 'concern', 'medium'),
    _F('referrer', 'hdr-referrer', 'headers', 'pass', 'none'), _F('not referrer', 'hdr-referrer-concern', 'headers', 'concern', 'low'), _F('exposes_version', 'hdr-server-version', 'headers', 'concern', 'low'),
    _F('downgrade', 'redir-downgrade', 'redirects', 'threat', 'critical'), _F('cross_domain', 'redir-cross-domain', 'redirects', 'concern', 'medium'), _F('excessive', 'redir-excessive', 'redirects', 'concern', 'low'),
    _F('is_punycode', 'url-punycode', 'url_anatomy', 'concern', 'medium'), _F('is_ip', 'url-ip-host', 'url_anatomy', 'concern', 'medium'), _F("risk_words <> ''", 'url-suspicious-keywords', 'url_anatomy', 'concern', 'medium'),
])})"""  # fmt: skip
SAFETY_FINDINGS = f"with {FINDINGS} select * from findings"
SAFETY_SCORE = f"""with {FINDINGS},
lost as (select page_id, greatest(10, least(100, 100 - sum(case status when 'threat' then case severity when 'critical' then 50 when 'high' then 25 else 15 end when 'concern' then case severity when 'medium' then 8 when 'low' then 4 else 2 end else 0 end)))::integer as score,
  sum((status = 'pass')::int)::bigint as n_pass, sum((status = 'concern')::int)::bigint as n_concern, sum((status = 'threat')::int)::bigint as n_threat, sum((status = 'unavailable')::int)::bigint as n_unavailable, bool_or(finding = 'conn-https-missing') as plain from findings group by page_id)
select page_id, score, case when n_threat > 0 then 'known_threat' when n_concern > 0 or score < 80 or plain then 'potential' else 'none' end as verdict, case when n_threat > 0 then 'High' when n_concern > 0 or score < 80 or plain then 'Moderate' else 'Low' end as rating, n_pass, n_concern, n_threat, n_unavailable from lost"""


def firsts(items: str, alias: str, limit: int | None = None, where: str = "true", table: str = "caps") -> str:
    """Different items of each page in order of appearance."""
    more = f" qualify ord < {limit}" if limit else ""
    return f"with {CAPS}, u as (select page_id, x as {alias}, min(pos) as pos from (select page_id, unnest({items}) as x, generate_subscripts({items}, 1) as pos from {table}) where {where} group by page_id, x) select page_id, (row_number() over (partition by page_id order by pos) - 1)::integer as ord, {alias} from u{more}"


PLUGINS = firsts(f"list_transform({every('html', sites.PLUGIN)}, lambda s: lower(s))", "plugin", 8, f"regexp_matches(x, '^[a-z0-9][a-z0-9_-]{{1,60}}$') and x not in ({', '.join(map(quoted, sites.NOT_PLUGINS))})")
_CSS = lambda name, value=".+": f"nullif(trim(regexp_extract(coalesce(style_css, '')[1:15000], '(?im)^{name}:[ \\t]*({value})$', 1)), '')"
_OF = lambda what, slug: "map([" + ", ".join(map(quoted, sites.BLOG_THEMES)) + "], [" + ", ".join(quoted(v[what]) for v in sites.BLOG_THEMES.values()) + f"])[regexp_replace(lower({slug}), '-child$', '')]"
WP_THEME = f"""with {CAPS}, s as (select page_id, style_css, x, min(pos) as pos from (select page_id, style_css, unnest({every('html', sites.THEME)}) as x, generate_subscripts({every('html', sites.THEME)}, 1) as pos from caps) group by page_id, style_css, x),
g as (select page_id, style_css, list(x order by pos) as slugs from s group by page_id, style_css), p as (select *, coalesce(list_filter(slugs, lambda z: ends_with(lower(z), '-child'))[1], slugs[1]) as slug from g),
q as (select *, list_filter(slugs, lambda z: z <> slug)[1] as other, {_CSS('Template')} as template, {_CSS('Theme Name')} as given, {_CSS('Template')} is not null or ends_with(lower(slug), '-child') as child from p),
r as (select *, coalesce(template, case when child then other end) as parent_slug from q)
select page_id, coalesce(given, {_OF('name', 'slug')} || case when child then ' Child' else '' end, array_to_string(list_transform(regexp_split_to_array(slug, '[-_]+'), lambda w: upper(w[1]) || w[2:]), ' ')) as theme, coalesce({_CSS('Author')}, case when given is null then {_OF('author', 'slug')} end) as author,
  {_CSS('Author UR[Ii]', 'https?://[^[:space:]]+')} as author_uri, coalesce({_CSS('Theme UR[Ii]', 'https?://[^[:space:]]+')}, case when given is null then {_OF('url', 'slug')} end) as theme_uri, {_CSS('Version')} as version, coalesce({_OF('name', 'parent_slug')}, parent_slug) as parent, slug, child, {_OF('name', 'slug')} is not null as known from r"""
_STORE = "map([" + ", ".join(map(str, sites.STORE_THEMES)) + "], [" + ", ".join(map(quoted, sites.STORE_THEMES.values())) + "])"
_FIELD = lambda pattern, text="o": f"nullif(trim(regexp_extract({text}, {quoted(pattern)}, 1)), '')"
_KNOWN = "(" + ", ".join(map(quoted, sites.SHOP_THEMES)) + ")"
_OF_JSON = lambda value, pattern: f"nullif(case when json_valid(o) then {value} else trim(regexp_extract(o, {quoted(pattern)}, 1)) end, '')"
_TEXT_AT = lambda key: f"case when json_type(o, '$.{key}') = 'VARCHAR' then json_extract_string(o, '$.{key}') end"
SHOP_THEME = f"""with {CAPS}, o as (select page_id, html, regexp_extract(html, '(?i)Shopify\\.theme\\s*=\\s*(\\{{[^;]+?\\}});', 1) as o from caps),
f as (select page_id, coalesce({_OF_JSON(f"trim({_TEXT_AT('name')})", r'''(?i)["']name["']\s*:\s*["']([^"']+)["']''')}, {_FIELD(r'''(?i)Shopify\.theme\.name\s*=\s*["']([^"']+)["']''', 'html')}, {_FIELD(r'''(?i)BOOMR\.themeName\s*=\s*["']([^"']+)["']''', 'html')}) as name,
  coalesce({_OF_JSON("json_extract_string(o, '$.id')", r'''(?i)["']id["']\s*:\s*(\d+)''')}, {_FIELD(r'(?i)BOOMR\.themeId\s*=\s*(\d+)', 'html')}, {_FIELD(r'''(?i)["']theme_id["']\s*:\s*(\d+)''', 'html')}, {_FIELD(r'''(?i)data-theme-id=["'](\d+)["']''', 'html')}) as id,
  {_OF_JSON("case when json_type(o, '$.theme_store_id') in ('UBIGINT', 'BIGINT') then json_extract_string(o, '$.theme_store_id') end", r'''(?i)["']theme_store_id["']\s*:\s*(\d+)''')}::integer as store_id, {_OF_JSON(_TEXT_AT('role'), r'''(?i)["']role["']\s*:\s*["']([^"']+)["']''')} as role,
  {_FIELD(r'''(?i)BOOMR\.themeVersion\s*=\s*["']([^"']+)["']''', 'html')} as version from o),
n as (select *, {_STORE}[store_id] as store_name, coalesce(name, {_STORE}[store_id]) as theme from f),
k as (select *, lower(trim(theme)) as low, regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(store_name, theme))), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), '-\\d+.*$', '') as part from n)
select page_id, theme, id, store_id, store_name, case when part in {_KNOWN} then 'https://themes.shopify.com/themes/' || part end as store_url, version, role,
  coalesce(low in {_KNOWN} or trim(regexp_replace(low, '[\\s\\-_v]*\\d+(\\.\\d+)*\\s*$', '')) in {_KNOWN}, false) or store_name is not null as known from k where coalesce(name, id, store_name) is not null"""
CNAME = f"""with {DETECTIONS}, suffixes as {values([(i, *c) for i, c in enumerate(sites.CNAMES)], 'ord, suffix, tech_id, tech_name')}, t as (select page_id, lower(regexp_replace(cname, '\\.$', '')) as cname from caps where cname is not null)
select page_id, cname, arg_min(s.tech_id, ord) as tech_id, arg_min(s.tech_name, ord) as tech_name from t join suffixes s on ends_with(cname, suffix) where page_id not in (select page_id from detections where category = 'hosting') group by page_id, cname"""
CONTAINER_IDS = firsts("regexp_extract_all(array_to_string(list_concat([html], bundles), chr(10)), 'GTM-[A-Z0-9]+')", "id")
LOADER_IDS = f"""with l as ({firsts(every("array_to_string(list_concat([html], bundles), chr(10))", r"(?i)googletagmanager\.com/gtag/js\?id=(G-[A-Z0-9]+|AW-[A-Z0-9/_-]+|GT-[A-Z0-9]+|UA-[0-9]+-[0-9]+)"), "id")})
select page_id, case when starts_with(id, 'G-') then 'ga4' when starts_with(id, 'AW-') then 'ads' when starts_with(id, 'GT-') then 'generic' else 'legacy' end as kind, ord, id from l"""
SANITIZE = f"""with {CAPS} select page_id, x.id as id, regexp_replace(regexp_replace(regexp_replace(x.js, '"name"\\s*:\\s*"(?:[^"\\\\]|\\\\.)*"', '"name":""', 'g'), '(?s)/\\*.*?\\*/', ' ', 'g'), '(^|[^:/])//[^\\n]*', '\\1 ', 'g') as js from (select page_id, unnest(containers) as x from caps)"""
COOKIES = f"""with {CAPS}, parts as (select page_id, regexp_split_to_array(regexp_replace(set_cookie, ',([^;,=\\s]+\\s*=)', chr(1) || '\\1', 'g'), chr(1)) as p from caps where set_cookie is not null), n as (select page_id, list_filter(list_transform(p, lambda x: trim(string_split(string_split(x, ';')[1], '=')[1])), lambda x: x <> '') as names from parts)
select page_id, (generate_subscripts(names, 1) - 1)::integer as ord, unnest(names) as cookie from n"""
FRAMEWORK = "with " + CAPS + ", f as (" + " union all ".join(f"select page_id, '{k}' as framework, regexp_extract(html, {quoted(p)}, 1)[1:10000] as data from caps" for k, p in (("__NEXT_DATA__", r"""(?is)<script\s+[^>]*id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""), ("__NUXT__", r"(?is)window\.__NUXT__\s*=\s*(\{.*?\});"), ("__remixContext", r"(?is)window\.__remixContext\s*=\s*(\{.*?\});"))) + ") select * from f where data <> ''"
ROBOTS_RULES = """l as (select page_id, generate_subscripts(string_split(robots, chr(10)), 1) as pos, trim(string_split(trim(unnest(string_split(robots, chr(10)))), '#')[1]) as line from caps where robots is not null),
w as (select *, last_value(case when regexp_matches(line, '(?i)^user-agent\\s*:') then regexp_matches(line, '(?i)^\\s*user-agent\\s*:\\s*\\*\\s*$') end ignore nulls) over (partition by page_id order by pos) as wild from l),
forbidden as (select page_id, trim(regexp_replace(line, '^[^:]*:', '')) as rule from w where wild and regexp_matches(line, '(?i)^disallow\\s*:')),
allowed as (select page_id, path, not exists (select 1 from forbidden r where r.page_id = p.page_id and rule <> '' and (rule = '/' or starts_with(path, rule))) as allowed from (select page_id, PATH as path from caps) p)""".replace("PATH", path("url"))
ROBOTS = f"with {CAPS}, {ROBOTS_RULES} select page_id, path, allowed from allowed"
_SCANNED = CAPS.replace("caps as", "raw as", 1) + f""",
looked as (select *, case when (contains(lower(coalesce(content_type, '')), 'text/html') or contains(lower(coalesce(content_type, '')), 'application/xhtml') or coalesce(content_type, '') = '') and status < 400 then html[1:100000] else '' end as seen,
  case when len(redirect_chain) > 0 and {whole("redirect_chain[1]")} = {whole("url")} then redirect_chain[2:] else redirect_chain end as hops_ from raw),
scan_codes as {codes_of("select distinct unnest(list_concat([url], redirect_chain)) as url from raw")}, scan_known as (select map_from_entries(list({{'k': url, 'v': code}})) as code_of from scan_codes),
judged as (select * exclude (code_of), case when code_of[url] <> 'ok' then 'Rejected: ' || code_of[url] when len(list_filter(hops_, lambda u: code_of[u] <> 'ok')) > 0 then 'Redirect rejected: ' || list_filter(list_transform(hops_, lambda u: code_of[u]), lambda c: c <> 'ok')[1] when len(hops_) > 3 then 'Too many redirects' when status is null then 'Fetch failed'
  when {CHALLENGE.replace('html', 'seen')} then 'Blocked: bot-protection challenge — headers and cookies only' end as scan_error from looked, scan_known),
caps as (select * exclude (seen, hops_) replace (case when scan_error is null then seen else '' end as html, case when scan_error is not null and not starts_with(scan_error, 'Blocked') then map([]::varchar[], []::varchar[]) else headers end as headers, case when scan_error is not null and not starts_with(scan_error, 'Blocked') then []::varchar[] else cookies end as cookies) from judged)"""
SCAN = lambda query: query.replace(CAPS, _SCANNED, 1)
SCAN_PAGES = f"with {_SCANNED} select page_id, scan_error, octet_length(encode(html))::integer as bytes, cardinality(headers)::integer as headers from caps"
SITE_PAGES = f"{ROBOTS_RULES}, site_pages as (select page_id, {host('url')} as site, scan_error is null and allowed as ok, cross_domain from caps join redirects using (page_id) join allowed using (page_id))"
_COVER = "(case when {c} <= 0 or {d} / {c} >= 1 then {s} when {d} / {c} < 0.5 then least({s}, 39) else floor({s} * (0.6 + 0.4 * ({d} / {c})) + 0.5) end)::integer"
ROLLUP = f"""with {SCAN(EVIDENCE)}, {HOPS}, {SITE_PAGES}, good as (select page_id, site from site_pages where ok), checked as (select site, count(*) as checked from good group by site),
r as (select e.*, site, case strength when 'definitive' then 0 when 'strong' then 1 else 2 end as rank from evidence e join good using (page_id) where category <> 'analytics'),
signals as (select site, tech_id, tech_name, category, type, name, min(rank) as rank, count(distinct page_id) as pages, min(family) as family from r group by all), on_ as (select site, tech_id, count(distinct page_id) as detected_on from r group by all),
tech as (select site, tech_id, tech_name, category, sum((rank = 0)::int) as d, sum((rank = 1)::int) as s, sum((rank = 2)::int) as w, count(distinct family) as families,
  array_to_string(list(name order by rank, case type when 'header' then 0 when 'cookie-name' then 0 when 'html-regex' then 1 when 'meta-generator' then 1 when 'html-path' then 2 when 'script-host' then 2 when 'probe' then 3 else 4 end, -pages, encode(name)), ' | ') as signals from signals group by all),
j as (select * from tech join on_ using (site, tech_id) join checked using (site))
select site, tech_id, tech_name, category, detected_on, checked, case when detected_on / checked < 0.5 then 'Low' when d >= 1 or s >= 2 then case when detected_on < checked then 'Medium' else 'High' end when s = 1 or w >= 2 then 'Medium' else 'Low' end as confidence,
  {_COVER.format(c='checked', d='detected_on', s=f'{scoring.BONUS}[least(families, 4) + 1]')} as score, signals from j"""
ROLLUP = f"select *, {LABEL5} as score_label from ({ROLLUP})"
_LINES = f"""with {SCAN(EVIDENCE)}, {HOPS}, {SITE_PAGES}, good as (select page_id, site from site_pages where ok),
r as (select e.*, site, case strength when 'definitive' then 0 when 'strong' then 1 else 2 end as rank, coalesce(nullif(name, ''), type) as line, coalesce(nullif(value, ''), artifact) as shown from evidence e join good using (page_id) where category <> 'analytics'),
lines as (select site, tech_id, type, line as name, arg_min({{'strength': strength, 'sample': shown}}, {{'r': rank, 'p': page_id, 's': sig_ord}}) as s, min(rank) as rank, count(distinct page_id) as pages from r group by site, tech_id, type, line)"""
SITE_EVIDENCE = f"""{_LINES} select site, tech_id, row_number() over (partition by site, tech_id order by rank, case type when 'header' then 0 when 'cookie-name' then 0 when 'html-regex' then 1 when 'meta-generator' then 1 when 'html-path' then 2 when 'script-host' then 2 when 'probe' then 3 else 4 end, pages desc, encode(name), type)::integer as place, type, name, s.sample as sample, pages, s.strength as strength from lines"""
_FRAMEWORKS = "(" + ", ".join(map(quoted, sites.FRAMEWORKS)) + ")"
SITE_KINDS = f"""with {SCAN(DETECTIONS)}, {HOPS}, {SITE_PAGES}, good as (select page_id, site from site_pages where ok), own as (select * from detections where category <> 'analytics'),
best_of as (select page_id, arg_min(tech_name, {{'c': -confidence, 'o': tech_ord}}) filter (category in {_FRAMEWORKS}) as framework, arg_min(tech_name, {{'c': -confidence, 'o': tech_ord}}) filter (category = 'hosting') as provider from own group by page_id),
first_pages as (select site, tech_id, arg_min({{'n': tech_name, 'c': category, 'f': framework, 'p': provider}}, page_id) as x from own join good using (page_id) join best_of using (page_id) group by site, tech_id)
select site, tech_id, case when x.n = x.f and x.c in {_FRAMEWORKS} then 'framework' when x.n = x.p and x.c = 'hosting' then 'hosting' else 'other' end as kind from first_pages"""
CONSISTENCY = f"""with {SCAN(DETECTIONS)}, {HOPS}, {SITE_PAGES},
best as (select page_id, arg_min(tech_name, {{'c': -confidence, 'o': tech_ord}}) filter (category in ('cms', 'builder', 'ecommerce', 'framework')) as f, arg_min(tech_name, {{'c': -confidence, 'o': tech_ord}}) filter (category = 'hosting') as p from detections group by page_id),
pg as (select s.*, coalesce(f, 'Unknown') as framework, coalesce(p, 'Unknown') as provider from site_pages s left join best using (page_id)),
mf as (select site, arg_min(framework, {{'n': -n, 'a': a}}) as bf from (select site, framework, count(*) as n, min(page_id) as a from pg where ok group by all) group by site), mp as (select site, arg_min(provider, {{'n': -n, 'a': a}}) as bp from (select site, provider, count(*) as n, min(page_id) as a from pg where ok group by all) group by site),
st as (select site, count(*) as n, sum(ok::int) as good, sum((ok and (framework <> bf or provider <> bp or cross_domain))::int) as odd, sum((ok and provider not in ('Unknown', 'Unscanned'))::int) as named, count(distinct case when ok and provider not in ('Unknown', 'Unscanned') then provider end) as providers, coalesce(any_value(bf), 'Unknown') as framework, coalesce(any_value(bp), 'Unknown') as provider from pg left join mf using (site) left join mp using (site) group by site)
select site, case when good > 0 and n = good and odd = 0 then 'consistent' else 'mixed' end as verdict, framework, provider, case when good > 0 and n = good and odd = 0 then good || '/' || n || ' pages run ' || framework || ' + ' || provider when good = 0 then '0 of ' || n || ' pages could be scanned'
  when n > good then good || ' of ' || n || ' pages scanned (' || (n - good) || ' unscanned or failed' || case when odd > 0 then ', ' || odd || ' differ' else '' end || ')' else odd || ' of ' || n || ' path' || case when n = 1 then '' else 's' end || ' differ' end as verdict_line, named > 0 and named = good and providers = 1 as front_door from st"""
COVERAGE = f"""with {EVIDENCE}, {SCORES}, p as (select page_id, {host('url')} as site from pages), c as (select site, count(*) as checked from p group by site), r as (select site, tech_id, max(score) as score, count(distinct page_id) as detected_on from scores join p using (page_id) group by all)
select site, tech_id, score, detected_on, checked, {_COVER.format(c='checked', d='detected_on', s='score')} as adjusted from r join c using (site)"""
RATE = "select event_id, user_id as key, count(*) over w as recent, count(*) over w > 2 as limited from events window w as (partition by user_id order by epoch_us(ts) range between 3599999999 preceding and current row)"
_ALL = [("core", r[3], r[1]) for r in catalogue.core_rows()] + [("growth", r[3], r[1]) for r in catalogue.growth_rows()[0]] + [("security", r[3], r[1]) for r in catalogue.security_rows()]
STATS = f"""with known as (select catalogue, category, count(distinct tech_id) as technologies, count(*) as rules from {values(_ALL, 'catalogue, category, tech_id')} group by all),
shown as (select 'core' as catalogue, category, tech_id, page_id from (with {EVIDENCE} select * from evidence) union all select 'growth', category, tech_id, page_id from (with {GROWTH_HITS} select * from hits) union all select 'security', category, tech_id, page_id from (with {SECURITY} select * from hits)),
counted as (select catalogue, category, count(distinct tech_id) as seen, count(distinct page_id) as pages from shown group by all)
select catalogue, category, technologies, rules, coalesce(seen, 0) as seen, coalesce(pages, 0) as pages from known left join counted using (catalogue, category)"""
FAMILY_FLOOR = f"with {EVIDENCE} select page_id, tech_id, sig_ord, family from evidence qualify len(list(distinct family) over (partition by page_id, tech_id)) >= 2"
SCAN_RESULTS = f"""with {SCAN(DETECTIONS)}, own as (select * from detections where category <> 'analytics'),
best_of as (select page_id, arg_min({{'i': tech_id, 'n': tech_name, 'l': label}}, {{'c': -confidence, 'o': tech_ord}}) filter (category in {_FRAMEWORKS}) as f, arg_min({{'i': tech_id, 'n': tech_name, 'l': label}}, {{'c': -confidence, 'o': tech_ord}}) filter (category = 'hosting') as p from own group by page_id),
lines as (select page_id, tech_id, list(artifact order by sig_ord)[1:2] as artifacts from evidence where category <> 'analytics' group by page_id, tech_id)
select b.page_id, coalesce(f.n, 'Unknown') as framework, f.i as framework_id, coalesce(p.n, 'Unknown') as provider, p.i as provider_id, case coalesce(f.l, p.l, 'possible') when 'confirmed' then 'High' when 'likely' then 'Medium' when 'possible' then 'Low' end as confidence,
  case when f is null and p is null then 'No distinctive fingerprint matched' else array_to_string(list_concat(coalesce(x.artifacts, []), coalesce(y.artifacts, [])), ' | ') end as evidence
from best_of b left join lines x on x.page_id = b.page_id and x.tech_id = f.i left join lines y on y.page_id = b.page_id and y.tech_id = p.i"""
ERRORS = f"with {VALIDATE} select code, http_status, retryable, count(page_id) as n from {values(catalogue.ERRORS, 'code, http_status, retryable')} left join (select page_id, v.code as code from valid) using (code) group by all"
CACHE = f"with {CAPS} select {host('final_url')} || regexp_replace({path('final_url')}, '/+$', '') as cache_key, min(page_id) as page_id, count(*) as n from caps group by 1"


CACHE_QUERY = f"""with {CAPS}, {{outcome}} select {host('final_url')} || regexp_replace({path('final_url')}, '/+$', '') || regexp_extract(final_url, '^[^?#]*(\\?[^#]*)', 1) as cache_key, min(page_id) as page_id, count(*) as n
from caps join outcome using (page_id) where ok and not truncated group by 1"""
def fetch_code(error: str) -> str:
    return f"(case when contains({error}, 'abort') then 'TIMEOUT' when regexp_matches({error}, 'DNS|ENOTFOUND|EAI_AGAIN') then 'DNS_FAILED' when regexp_matches({error}, 'certificate|SSL|TLS') then 'TLS_ERROR' else 'HTTP_ERROR' end)"


def outcome(table: str, keep: str = "", error: str = "null::varchar") -> str:
    """The ladder over a relation of captures, as the relation `outcome`."""
    return f"""codes as {codes_of(f"select distinct unnest(list_concat([url], redirect_chain)) as url from {table}")},
known as (select map_from_entries(list({{'k': url, 'v': code}})) as code_of from codes),
chains as (select c.*, {error} as err, case when len(redirect_chain) > 0 and {whole("redirect_chain[1]")} = {whole("url")} then redirect_chain[2:] else redirect_chain end as hops from {table} c),
checked_ as (select *, code_of[url] as own, len(list_filter(hops, lambda u: code_of[u] <> 'ok')) > 0 as refused, list_concat([{whole("url")}], list_transform(hops, lambda u: {whole("u")})) as reached from chains, known),
laddered as (select *, case when own <> 'ok' then own when err is not null then {fetch_code("err")} when refused then 'BLOCKED_TARGET' when len(list_distinct(reached)) < len(reached) or len(reached) > 6 or status is null or status >= 500 then 'HTTP_ERROR'
  when status in (401, 403, 407, 429, 503) then 'TARGET_BLOCKED' when not (contains(lower(coalesce(content_type, '')), 'text/html') or contains(lower(coalesce(content_type, '')), 'application/xhtml') or contains(lower(html[1:1024]), '<!doctype html') or contains(lower(html[1:1024]), '<html')) then 'NOT_HTML' when {CHALLENGE} then 'TARGET_BLOCKED' end as code,
  octet_length(encode(html)) > 500000 or len(list_filter(bundles, lambda b: octet_length(encode(b)) > 250000)) > 0 or len(list_filter(containers, lambda c: octet_length(encode(c.js)) > 400000)) > 0 as cut from checked_),
outcome as (select page_id{keep}, l.code is null as ok, case when l.code is not null then 'failed' when cut then 'partial' else 'complete' end as scan, l.code as error_code, (case when l.code = 'HTTP_ERROR' and err is null and not refused and status >= 500 then status else e.http_status end)::integer as http_status, coalesce(e.retryable, false) as retryable, cut as truncated
  from laddered l left join {values(catalogue.ERRORS, 'code, http_status, retryable')} e on e.code = l.code)"""


OUTCOME = outcome("caps")
CAPTURE_OUTCOME = f"with {CAPS}, {OUTCOME} select * from outcome"
SCAN_LOG = f"""with {CAPS}, {OUTCOME} select {host('url')} as host, coalesce(error_code, 'ok') as outcome, count(*) as scans, sum((page_id % 200)::double) as duration_ms, sum(len(redirect_chain) + 1)::bigint as subrequests, sum(truncated::int)::bigint as truncated, sum(((page_id % 200)::double * 0.08 >= 8)::int)::bigint as high_cpu
from caps join outcome using (page_id) group by 1, 2"""
_TAGS = "list_filter(regexp_extract_all(html, '(?i)<link\\s+[^>]*>'), lambda t: regexp_matches(t, '(?i)rel=[\"''](?:[^\"'']*\\s+)?modulepreload(?:\\s+[^\"'']*)?[\"'']') or (regexp_matches(t, '(?i)rel=[\"''](?:[^\"'']*\\s+)?preload(?:\\s+[^\"'']*)?[\"'']') and regexp_matches(t, '(?i)as=[\"'']script[\"'']')))"
_GIVEN = f"list_concat(regexp_extract_all(html, '(?i)<script[^>]+src=[\"'']([^\"'']+)[\"'']', 1), list_transform({_TAGS}, lambda t: regexp_extract(t, '(?i)href=[\"'']([^\"'']+)[\"'']', 1)))"
CANDIDATES = f"""with {CAPS}, g as (select page_id, url as base, unnest({_GIVEN}) as link, generate_subscripts({_GIVEN}, 1) as pos from caps),
r as (select page_id, base, pos, case when regexp_matches(link, '{urls.SCHEME}') then link when starts_with(link, '//') then {scheme('base')} || ':' || link when starts_with(link, '/') then {scheme('base')} || '://' || {authority('base')} || link else {scheme('base')} || '://' || {authority('base')} || regexp_replace({path('base')}, '[^/]*$', '') || link end as script
  from g where link <> '' and not regexp_matches(link, '^(data|blob|javascript):')),
o as (select page_id, script, min(pos) as pos from r where {scheme('script')} = {scheme('base')} and {host('script')} = {host('base')} and {port('script')} = {port('base')} group by page_id, script)
select page_id, (row_number() over (partition by page_id order by pos) - 1)::integer as ord, script from o qualify ord < 20"""
BUNDLES = f"""with a as ({CANDIDATES}), m as (select *, length(script) as n, row_number() over (partition by page_id order by length(script) * 37 % 11 desc, ord)::integer as place from a)
select page_id, place, script, '// ' || script as body, false as truncated from m where place <= 2 and n % 5 <> 0 and n % 3 <> 0"""
MISSING = f"""with f as ({CONTAINER_IDS}), {CAPS} select f.page_id, f.ord, f.id, list_contains(list_transform(containers, lambda c: c.id), f.id) as fetched from f join caps using (page_id) where ord < 3"""
CAPPED = f"""with {CAPS}, c as (select page_id, html, octet_length(encode(html)) > 4000 as truncated from caps),
k as (select page_id, truncated, case when truncated then html[1:list_max(list_filter(range(1000, 4001), lambda k: octet_length(encode(html[1:k])) <= 4000))] else html end as cut from c)
select page_id, truncated, octet_length(encode(cut))::integer as bytes, md5(cut) as digest from k"""
SITEMAP = """with t as (select page_id, regexp_extract_all('<urlset><url><loc> ' || url || ' </loc></url><loc>https://a.example.com/Sitemap-2.xml</loc><LOC>' || url || '?p=2</LOC></urlset>', '(?i)<loc>\\s*([^<\\s]+)\\s*</loc>', 1) as l from pages),
k as (select page_id, list_filter(l, lambda x: not regexp_matches(x, '(?i)sitemap.*\\.xml$'))[1:500] as l from t) select page_id, (generate_subscripts(l, 1) - 1)::integer as ord, unnest(l) as loc from k"""
DOMAINS = f"""with t as (select page_id, lower(trim(url)) as x from (select page_id, url from pages union all select * from {values([(-1 - i, s) for i, s in enumerate(TYPED)], 'page_id, url')})),
d as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), '^www\\.', ''), ':[0-9]+$', ''), '^\\.+|\\.+$', '', 'g') as x from t)
select page_id, case when regexp_matches(x, '^([a-z0-9]([a-z0-9-]*[a-z0-9])?\\.)+[a-z]{{2,}}$') then x end as domain from d"""


def all_sql() -> dict[str, str]:
    return {
        "url_anatomy": URL_ANATOMY, "url_validate": f"with {VALIDATE} select page_id, url, v.code as code, v.message as message from valid", "page_profile": PROFILE, "internal_links": INTERNAL_LINKS, "diverse_sample": DIVERSE_SAMPLE, "sample_plan": SAMPLE_PLAN, "resource_refs": RESOURCE_REFS,
        "security_channels": SECURITY_CHANNELS, "attribute_hooks": ATTRIBUTE_HOOKS, "core_evidence": CORE_EVIDENCE, "core_confidence": CORE_CONFIDENCE, "core_score": CORE_SCORE, "core_detect": CORE_DETECT, "explain_detections": EXPLAIN, "growth_detect": GROWTH_DETECT, "growth_evidence": GROWTH_EVIDENCE, "growth_by_category": GROWTH_BY_CATEGORY,
        "growth_ids": GROWTH_IDS, "growth_via_container": GROWTH_VIA, "server_side_warning": SERVER_SIDE, "security_detect": SECURITY_DETECT, "security_by_category": SECURITY_BY_CATEGORY, "bot_challenge": BOT_CHALLENGE, "bot_provider": BOT_PROVIDER, "relevant_headers": RELEVANT, "header_audit": HEADER_AUDIT,
        "mixed_content": MIXED, "redirect_audit": REDIRECTS, "safety_findings": SAFETY_FINDINGS, "safety_score": SAFETY_SCORE, "wp_plugins": PLUGINS, "wp_theme": WP_THEME, "shop_theme": SHOP_THEME, "cname_hint": CNAME, "container_ids": CONTAINER_IDS, "loader_ids": LOADER_IDS, "container_sanitize": SANITIZE,
        "cookie_names": COOKIES, "framework_data": FRAMEWORK, "robots_filter": ROBOTS, "scan_pages": SCAN_PAGES, "site_tech_rollup": ROLLUP, "site_tech_evidence": SITE_EVIDENCE, "site_tech_kinds": SITE_KINDS, "scan_results": SCAN_RESULTS, "family_floor": FAMILY_FLOOR, "chosen_bundles": BUNDLES, "site_consistency": CONSISTENCY, "coverage_penalty": COVERAGE, "rate_limit": RATE, "catalogue_stats": STATS, "error_codes": ERRORS, "cache_keys": CACHE, "cache_keys_with_query": CACHE_QUERY.replace("{outcome}", OUTCOME), "capture_outcome": CAPTURE_OUTCOME, "script_candidates": CANDIDATES, "missing_containers": MISSING, "capped_html": CAPPED, "scan_log": SCAN_LOG, "sitemap_locs": SITEMAP, "domains": DOMAINS,
    }
