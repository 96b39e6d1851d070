"""Queries over what other services say about pages, with their SQL.  The long tables are derived from pages (`sources.lookups`)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.functions import urls
from pagelens.operators import network, outcomes, safety
from pagelens.plans import oracles as sql
from pagelens.plans.queries import Query, captures, pages
from pagelens.sources import lookups
from pagelens.sources.captures import quoted
from pagelens.streaming import containers, scans

#: The second feed is set up, the third is not; what the third lists counts for nothing.
FEEDS = [("safe-browsing", True), ("urlhaus", False)]


def _feeds(spark, available=FEEDS):
    return spark.createDataFrame(available, "feed string, available boolean")


def dns_audit(spark, sf_dir):
    page = pages(spark, sf_dir)
    found = network.dns_reports(lookups.hosts(page), lookups.answers(page))
    join = lambda c: F.array_join(c, "; ").alias(c)
    return found.select("host", "resolves", join("ip_addresses"), "dnssec", "validated", "caa", join("caa_records"))


def cname_chain(spark, sf_dir):
    page = pages(spark, sf_dir)
    found = network.cname_chains(lookups.hosts(page), lookups.answers(page))
    return found.withColumn("chain", F.array_join("chain", " > "))


def threat_audit(spark, sf_dir):
    page = pages(spark, sf_dir)
    return network.threat_reports(page, lookups.answers(page), lookups.entries(page), _feeds(spark))


def threat_audit_all_feeds(spark, sf_dir):
    """The same with every feed set up."""
    page = pages(spark, sf_dir)
    return network.threat_reports(page, lookups.answers(page), lookups.entries(page), _feeds(spark, [(f, True) for f, _ in FEEDS]))


def http_probe(spark, sf_dir):
    page = pages(spark, sf_dir)
    return network.http_redirects(lookups.hosts(page), lookups.plain_responses(page))


def network_safety(spark, sf_dir):
    """Score and verdict with DNS and feeds among the findings."""
    page = pages(spark, sf_dir)
    return safety.verdicts(safety.findings(network.with_network(captures(spark, sf_dir), lookups.answers(page), lookups.entries(page), _feeds(spark), lookups.plain_responses(page))))


def network_findings(spark, sf_dir):
    """The findings that DNS, feeds and plain HTTP give."""
    page = pages(spark, sf_dir)
    found = safety.findings(network.with_network(captures(spark, sf_dir), lookups.answers(page), lookups.entries(page), _feeds(spark), lookups.plain_responses(page)))
    return found.where("area in ('dns', 'threat_intel') or finding like 'conn-http-%'").drop("at")


def redirect_resolution(spark, sf_dir):
    page = pages(spark, sf_dir)
    return network.follow(page, lookups.responses(page)).withColumn("chain", F.array_join("chain", " > "))


def pinned_resolution(spark, sf_dir):
    """The same for fetches that must stay on one host: that of the smallest address."""
    page = pages(spark, sf_dir)
    host = page.agg(F.min(urls.host_of(F.col("url"))).alias("h")).first()["h"] or "none"
    return network.follow(page.where(urls.host_of(F.col("url")) == host), lookups.responses(page), max_hops=2, pin_host=host).withColumn("chain", F.array_join("chain", " > "))


def capture_attempts(spark, sf_dir):
    return outcomes.folded_attempts(lookups.attempts(pages(spark, sf_dir)))


def page_containers(spark, sf_dir):
    """Tag containers of pages from a log of fetches: ids, scripts and warnings."""
    page = pages(spark, sf_dir)
    found = containers.expanded(lookups.timed(captures(spark, sf_dir)), lookups.container_fetches(page))
    return found.select("page_id", F.array_join(F.transform("containers", lambda c: F.concat(c["id"], F.lit("="), c["js"])), " ").alias("containers"), F.array_join("warnings", " ").alias("warnings"))


def scan_minutes(spark, sf_dir):
    """Scans, failures and the share of costly ones by hour and host."""
    found = scans.scan_minutes(lookups.scans(spark.read.parquet(f"{sf_dir}/events.parquet")), minutes=60)
    return found.select(F.unix_seconds("minute").alias("second"), "host", "scans", "failed", "truncated", "high_cpu", F.round("high_cpu_share", 9).alias("high_cpu_share"), F.round("duration_ms", 3).alias("duration_ms"))


ANSWERS = f"answers as ({lookups.answers_sql(sql.host('url'))})"
_IP = quoted(network.IP_LITERAL)
REPORTS = f"""{ANSWERS}, asked as (select distinct {sql.host('url')} as host from pages where {sql.host('url')} <> ''),
folded as (select question as host, bool_or(a) as resolves, list(data order by ord) filter (a and rtype = 1 and data <> '') as ips, bool_or(a and rtype = 46) as dnssec, bool_or(a and ad) as validated, bool_or(c) as caa, list(data order by ord, data) filter (c) as records
  from (select *, g and qtype = 'A' as a, g and qtype = 'CAA' and rtype = 257 and coalesce(data, '') <> '' as c from (select *, resolver = 'plain' and status = 0 and rtype is not null as g from answers)) where not regexp_matches(question, {_IP}) group by question),
reports as (select host, coalesce(resolves, false) as resolves, array_to_string(coalesce(ips, []), '; ') as ip_addresses, coalesce(dnssec, false) as dnssec, coalesce(validated, false) as validated, coalesce(caa, false) as caa, array_to_string(coalesce(records, []), '; ') as caa_records from asked left join folded using (host))"""
DNS_AUDIT = f"with {REPORTS} select * from reports"
_PROVIDER = f"select s.*, n.host, n.step, n.name from names n join {sql.values([(i, *c) for i, c in enumerate(network.CNAMES)], 'ord, suffix, tech_id, tech_name')} s on ends_with(n.name, s.suffix)"
CNAME_CHAIN = f"""with recursive {ANSWERS},
pointers as (select regexp_replace(lower(name), '\\.$', '') as here, arg_min(regexp_replace(lower(data), '\\.$', ''), {{'o': ord, 'd': data}}) as target from answers where resolver = 'plain' and qtype = 'CNAME' and rtype = 5 group by 1),
walk(host, here, chain, loops) as (
  select distinct {sql.host('url')}, {sql.host('url')}, []::varchar[], false from pages where {sql.host('url')} <> ''
  union all
  select host, case when list_contains(chain, target) or target = host then here else target end, case when list_contains(chain, target) or target = host then chain else list_append(chain, target) end, list_contains(chain, target) or target = host
  from walk join pointers using (here) where not loops and len(chain) < {network.MAX_POINTERS}),
ended as (select host, arg_max(chain, {{'n': len(chain), 'l': loops}}) as chain, bool_or(loops) as loops from walk group by host having max(len(chain)) > 0),
names as (select host, unnest(chain) as name, generate_subscripts(chain, 1) as step from ended),
first as (select host, min({{'step': step, 'ord': ord, 'tech_id': tech_id, 'tech_name': tech_name, 'name': name}}) as f from ({_PROVIDER}) group by host)
select e.host, array_to_string(chain, ' > ') as chain, loops, f.tech_id as tech_id, f.tech_name as tech_name, f.name as cname from ended e left join first using (host)"""


def threats(available: list[tuple[str, bool]], table: str = "pages", url: str = "url") -> str:
    """The relation `threats`; expressions by a join with the numbers of labels and folders instead of nested arrays."""
    on, u = dict(available), sql.SCHEME.format(url)
    h, p, q = sql.host(u), sql.path(u), f"regexp_extract({u}, '^[^?#]*(\\?[^#]*)', 1)"
    clean, missing = network.CLEAN, network.MISSING
    rows = []
    for place, (feed, checked, threat, said) in enumerate([
        ("dns-filter", "f.host is not null", f"case when gone then '{network.BLOCKED[0]}' when zero then '{network.SINKHOLE[0]}' end", f"case when gone then '{network.BLOCKED[1]}' else '{network.SINKHOLE[1]}' end"),
        ("safe-browsing", str(on["safe-browsing"]).lower(), "url_threat", "'Flagged as ' || url_threat"),
        ("urlhaus", str(on["urlhaus"]).lower(), "host_threat", "'Listed for active malware distribution (1 URLs recorded)'"),
    ]):
        listed = f"({checked}) and ({threat}) is not null"
        rows.append(f"select page_id, {place} as place, {quoted(network.SOURCES[feed])} as source, {checked} as checked, {listed} as listed, case when {listed} then {threat} end as threat, case when not ({checked}) then {quoted(missing[feed])} when {listed} then {said} else {quoted(clean[feed])} end as said from joined j left join filtered f using (host)")
    return f"""entries as ({lookups.entries_sql(sql.host('url'), sql.path('url'))}), {ANSWERS},
filtered as (select question as host, bool_or(status = 3) as gone, coalesce(bool_or(status = 0 and data = '0.0.0.0'), false) as zero from answers where resolver = 'filter' and qtype = 'A' and not regexp_matches(question, {_IP}) group by 1),
addresses as (select page_id, {url} as url, {h} as host, {p} as path, {q} as query from {table}),
named as (select distinct url, host, path, query, string_split(host, '.') as labels, list_filter(string_split(regexp_replace(path, '[^/]*$', ''), '/'), lambda x: x <> '') as folders from addresses where host <> ''),
suffixes as (select url, host as h from named union select url, array_to_string(labels[-k:], '.') from named, range(2, {network.LABELS + 1}) t(k) where k < len(labels) and not regexp_matches(host, {_IP})),
prefixes as (select url, path as p from named union select url, path || query from named union select url, '/' || array_to_string(folders[1:k], '/') || case when k > 0 then '/' else '' end from named, range({network.FOLDERS}) t(k) where k <= len(folders)),
by_url as (select url, min(threat) as url_threat from suffixes join prefixes using (url) join entries on hash = sha256(h || p) and kind = 'url' group by url),
by_host as (select host, min(threat) as host_threat from (select distinct host from named) join entries on hash = sha256(host) and kind = 'host' group by host),
joined as (select page_id, a.host, url_threat, host_threat from addresses a left join by_url using (url) left join by_host h on h.host = a.host),
threats as ({' union all '.join(rows)})"""


PROBED = f"""plain as ({lookups.plain_responses_sql(sql.host('url'))}),
probed as (select host, case when p.error is not null or regexp_matches(host, {_IP}) then null when p.status between 301 and 308 then regexp_matches(trim(coalesce(p.location, '')), '(?i)^https://') when p.status = 200 then false end as http_redirects from (select distinct {sql.host('url')} as host from pages where {sql.host('url')} <> '') h left join plain p on p.url = 'http://' || h.host || '/')"""
_FINAL = "coalesce(nullif(final_url, ''), url)"
_MORE = f"""{threats(FEEDS, 'caps', _FINAL)}, {REPORTS.partition(', asked as')[2].join(['asked as', ''])},
{{PROBED}}, told as (select page_id, r.* from (select page_id, {sql.host(sql.SCHEME.format(_FINAL))} as host from caps) c join reports r using (host)),
more as (
  select page_id, case when checked and listed then 'threat-' when checked then 'clean-' else 'avail-' end || lower(regexp_replace(source, '\\s+', '-', 'g')) as finding, 'threat_intel' as area, case when checked and listed then 'threat' when checked then 'pass' else 'unavailable' end as status, case when checked and listed then 'critical' else 'none' end as severity from threats
  union all select page_id, 'dns-resolves', 'dns', 'pass', 'none' from told where resolves union all select page_id, 'dns-dnssec', 'dns', 'pass', 'none' from told where validated union all select page_id, 'dns-caa', 'dns', 'pass', 'none' from told where caa
  union all select page_id, case when http_redirects then 'conn-http-redirect' else 'conn-http-no-redirect' end, 'connection', case when http_redirects then 'pass' else 'concern' end, case when http_redirects then 'none' else 'medium' end from told join probed using (host) where http_redirects is not null)""".replace("{PROBED}", PROBED)
NETWORK_FINDINGS = f"with {sql.CAPS}, {_MORE} select * from more"
NETWORK_SAFETY = sql.SAFETY_SCORE.replace("\nlost as", f"\n{_MORE}, every as (select * from findings union all select * from more),\nlost as", 1).replace("as plain from findings group by", "as plain from every group by")
_PREPARED = f"""responses as ({lookups.responses_sql(sql.whole('url'), sql.scheme('u'), sql.authority('u'), sql.host('u'))}),
one as (select url, arg_min({{'status': status, 'location': location, 'error': error}}, {{'a': coalesce(status, 999), 'b': coalesce(location, ''), 'c': coalesce(error, '')}}) as r from responses group by url),
moved as (select url, r.status as status, r.location as location, r.error as error, coalesce(r.status between 301 and 308, false) as redirect, {sql.resolved('trim(r.location)', 'url')} as target from one),
checks as {sql.codes_of("select distinct target as url from moved where target is not null")},
starts as {sql.codes_of("select distinct url from pages")},
prepared as (select m.url, case when error is not null then {sql.fetch_code('error')} when status is null then 'HTTP_ERROR' when redirect and coalesce(location, '') = '' then 'HTTP_ERROR' when redirect and (trim(location) = '' or c.code <> 'ok') then 'BLOCKED_TARGET' when status >= 500 then 'HTTP_ERROR' end as code,
  case when error is not null then case {sql.fetch_code('error')} when 'TIMEOUT' then 'The request timed out.' when 'DNS_FAILED' then 'Could not resolve domain name.' when 'TLS_ERROR' then 'TLS certificate verification failed.' else 'Network connection failed.' end when status is null then 'Network connection failed.'
    when redirect and coalesce(location, '') = '' then 'Redirect response missing Location header.' when redirect and trim(location) = '' then 'Empty redirect location' when redirect and c.code <> 'ok' then c.message when status >= 500 then 'Server returned HTTP status ' || status || '.' end as message,
  case when error is null then status end as status, case when redirect and error is null and trim(coalesce(location, '')) <> '' and c.code = 'ok' then {sql.whole('target')} end as next from moved m left join checks c on c.url = m.target)"""


def followed(where: str = "true", max_hops: int = 5, pin: str = "null::varchar") -> str:
    return f"""with recursive {_PREPARED}, pin as (select {pin} as pin_host),
walk(url, here, chain, code, message, http_status, ended) as (
  select url, {sql.whole('url')}, [{sql.whole('url')}], case when code <> 'ok' then code end, message, case when code = 'BLOCKED_TARGET' then 403 when code <> 'ok' then 400 end, code <> 'ok' from starts, pin where {where}
  union all
  select w.url, case when moves then p.next else w.here end, case when moves then list_append(w.chain, p.next) else w.chain end, s.code, s.message, p.status, not moves
  from walk w left join prepared p on p.url = w.here cross join pin,
    lateral (select case when p.url is null then 'HTTP_ERROR' when p.code is not null then p.code when p.next is not null and pin_host is not null and {sql.host('p.next')} <> pin_host then 'BLOCKED_TARGET' when list_contains(w.chain, p.next) then 'HTTP_ERROR' end as code,
      case when p.url is null then 'Network connection failed.' when p.code is not null then p.message when p.next is not null and pin_host is not null and {sql.host('p.next')} <> pin_host then 'Container fetch must not follow redirects off ' || pin_host || '.' when list_contains(w.chain, p.next) then 'Redirect loop detected.' end as message) s,
    lateral (select s.code is null and p.next is not null as moves) m
  where not w.ended and len(w.chain) <= {max_hops + 1}),
last as (select url, arg_max({{'here': here, 'chain': chain, 'code': code, 'message': message, 'http_status': http_status, 'ended': ended}}, 2 * len(chain) + ended::int) as w from walk group by url)
select url, w.ended and w.code is null as ok, case when w.ended and w.code is null then w.here end as final_url, array_to_string(w.chain, ' > ') as chain, (len(w.chain) - 1)::integer as hops, case when w.ended then w.code else 'HTTP_ERROR' end as error_code,
  case when w.ended then w.message else 'Exceeded maximum redirect limit ({max_hops}).' end as message, case when w.ended then w.http_status end::integer as http_status from last"""


ATTEMPTS = f"""with {sql.CAPS}, tried as ({lookups.attempts_sql('caps')}), {sql.outcome('tried', ', attempt', 'error')},
firsts as (select * from outcome where attempt = 1), seconds as (select * from outcome where attempt = 2), picked as (select f.page_id, 1 + (s.page_id is not null)::int as attempts, f.error_code = 'HTTP_ERROR' and s.page_id is not null as retried, f as a, s as b from firsts f left join seconds s using (page_id))
select page_id, attempts::bigint as attempts, coalesce(retried, false) as retried, {', '.join(f'case when coalesce(retried, false) then b.{c} else a.{c} end as {c}' for c in ('ok', 'scan', 'error_code', 'http_status', 'retryable', 'truncated'))} from picked"""


_CONTAINER_IDS = "list_filter(list_transform(range(1, len(ids) + 1), lambda i: case when list_position(ids, ids[i]) = i then ids[i] end), lambda x: x is not null)[1:3]"
PAGE_CONTAINERS = f"""with {sql.CAPS}, fetches as ({lookups.container_fetches_sql()}),
found as (select page_id, page_id * 20 as second, regexp_extract_all(array_to_string(list_concat([html], bundles), chr(10)), 'GTM-[A-Z0-9]+') as ids from caps),
asked as (select page_id, second, unnest({_CONTAINER_IDS}) as id, generate_subscripts({_CONTAINER_IDS}, 1) as ord from found where len(ids) > 0),
latest as (select a.page_id, a.ord, a.id, max({{'t': f.fetched_at, 's': f.status, 'c': f.content_type, 'j': f.js, 'e': f.error}}) filter (f.id is not null) as f from asked a left join fetches f on f.id = a.id and f.fetched_at <= a.second and a.second < f.fetched_at + {containers.VALID} group by all),
judged as (select *, coalesce(f.e is null and f.s between 200 and 299 and regexp_matches(f.c, 'javascript|ecmascript|text'), false) as good from latest)
select page_id, coalesce(string_agg(id || '=' || f.j, ' ' order by ord) filter (good), '') as containers,
  coalesce(string_agg('GTM container ' || id || case when f is null then ' fetch failed; kept normal results.' when f.e is not null then ' unavailable (' || f.e || ')' else ' returned an unexpected response.' end, ' ' order by ord) filter (not good), '') as warnings from judged group by page_id"""
SCAN_MINUTES = """select floor(epoch(ts) / 3600)::bigint * 3600 as second, 'h' || (user_id % 7) || '.shop.com' as host, count(*) as scans, sum((event_type <> 'click')::int)::bigint as failed, sum((event_id % 10 = 0)::int)::bigint as truncated, sum((abs(value) * 0.08 >= 8)::int)::bigint as high_cpu,
  round(sum((abs(value) * 0.08 >= 8)::int) / count(*), 9) as high_cpu_share, round(sum(abs(value)), 3) as duration_ms from events group by 1, 2"""


def all_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (dns_audit, cname_chain, threat_audit, threat_audit_all_feeds, network_findings, network_safety, http_probe, redirect_resolution, pinned_resolution, capture_attempts, page_containers, scan_minutes)}


def all_sql() -> dict[str, str]:
    smallest = f"(select min({sql.host('url')}) from pages)"
    return {
        "dns_audit": DNS_AUDIT, "cname_chain": CNAME_CHAIN, "threat_audit": f"with {threats(FEEDS)} select * from threats", "threat_audit_all_feeds": f"with {threats([(f, True) for f, _ in FEEDS])} select * from threats", "network_findings": NETWORK_FINDINGS, "network_safety": NETWORK_SAFETY, "http_probe": f"with {PROBED} select * from probed",
        "redirect_resolution": followed(), "pinned_resolution": followed(f"{sql.host('url')} = pin_host", 2, smallest), "capture_attempts": ATTEMPTS, "page_containers": PAGE_CONTAINERS, "scan_minutes": SCAN_MINUTES,
    }
