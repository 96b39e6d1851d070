"""What a scanner asks other services about pages, as long tables: DNS answers, feed entries, single HTTP responses and attempts.

The readers of a real log need nothing but these columns.  The functions here derive such tables from plain pages, as a pure
function of page_id, as the overlay of captures does; they are test data, stated once as templates and rendered both as
Spark columns and as SQL.  In a template `{h}` is the host, `{u}` the address, `{o}` its origin and `{k}` a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import urls
from pagelens.sources.captures import overlay, quoted

#: One row for each record of an answer; an answer without records is a row without rtype.
ANSWERS = "question string, resolver string, qtype string, status int, ad boolean, ord int, name string, rtype int, data string"
#: One row for each listed expression: SHA-256 in hex of host and path, or of a host.
ENTRIES = "feed string, kind string, hash string, threat string"
#: One row for each address that was asked for; `error` holds what went wrong instead of a response.
RESPONSES = "url string, status int, location string, error string"

#: Synthetic answers by the smallest page_id of a host % 8: resolver, question, type, status, AD, ord, name, type, data.
_ANSWERS: list[tuple] = [
    (0, "plain", "{h}", "A", 0, True, 0, "{h}", 1, "192.0.2.{k}"), (0, "plain", "{h}", "A", 0, True, 1, "{h}", 46, "A 13 2 300 20270101000000 20261201000000 34505 {h}. c2ln"), (0, "plain", "{h}", "CAA", 0, False, 0, "{h}", 257, '0 issue "letsencrypt.org"'), (0, "filter", "{h}", "A", 0, False, 0, "{h}", 1, "192.0.2.{k}"),
    (1, "plain", "{h}", "A", 0, False, 0, "{h}", 5, "edge.{h}."), (1, "plain", "{h}", "A", 0, False, 1, "edge.{h}", 5, "D{k}.CloudFront.net."), (1, "plain", "{h}", "A", 0, False, 2, "d{k}.cloudfront.net", 1, "198.51.100.{k}"), (1, "plain", "{h}", "CNAME", 0, False, 0, "{h}", 5, "edge.{h}."), (1, "plain", "edge.{h}", "CNAME", 0, False, 0, "edge.{h}", 5, "D{k}.CloudFront.net."), (1, "filter", "{h}", "A", 0, False, 0, "{h}", 1, "0.0.0.0"),
    (2, "plain", "{h}", "A", 3, False, None, None, None, None), (2, "filter", "{h}", "A", 3, False, None, None, None, None),
    (3, "plain", "{h}", "A", 2, False, None, None, None, None), (3, "plain", "{h}", "CAA", 0, True, 0, "{h}", 257, '0 issue "pki.goog"'), (3, "plain", "{h}", "CAA", 0, True, 1, "{h}", 257, '0 iodef "mailto:a@example.com"'),
    (5, "plain", "{h}", "CNAME", 0, False, 0, "{h}", 5, "a.{h}."), (5, "plain", "a.{h}", "CNAME", 0, False, 0, "a.{h}", 5, "{h}."), (5, "filter", "{h}", "A", 2, False, None, None, None, None),
    (6, "plain", "{h}", "CNAME", 0, False, 0, "{h}", 5, "{h}.wpengine.com."), (6, "plain", "{h}", "CAA", 0, False, 0, "{h}", 257, ""), (6, "filter", "{h}", "A", 0, False, None, None, None, None),
    (7, "plain", "{h}", "A", 0, False, 0, "{h}", 1, "203.0.113.1"), (7, "plain", "{h}", "A", 0, False, 1, "{h}", 1, "203.0.113.2"), (7, "plain", "{h}", "A", 0, False, 2, "{h}", 1, "203.0.113.3"), (7, "plain", "{h}", "A", 0, False, 3, "{h}", 1, "203.0.113.4"), (7, "plain", "{h}", "A", 0, False, 4, "{h}", 46, "A 8 2 300 sig"), (7, "filter", "{h}", "A", 0, False, 0, "{h}", 1, "203.0.113.1"),
]
#: Synthetic responses by the smallest page_id of an address % 12: address, status, location, error.
_RESPONSES: list[tuple] = [
    *((v, "{u}", 200, None, None) for v in (0, 1)), (2, "{u}", 301, "/g/1/{k}", None), *((2, f"{{o}}/g/{i}/{{k}}", 302, f"/g/{i + 1}/{{k}}", None) for i in range(1, 5)), (2, "{o}/g/5/{k}", 200, None, None),
    (3, "{u}", 301, "/moved/{k}?x=1", None), (3, "{o}/moved/{k}?x=1", 200, None, None), (4, "{u}", 302, "", None), (5, "{u}", 301, "ftp://b.com/", None), (6, "{u}", 301, "/loop/{k}", None), (6, "{o}/loop/{k}", 302, "{u}", None),
    (7, "{u}", 503, None, None), (8, "{u}", None, None, "getaddrinfo ENOTFOUND {h}"), (9, "{u}", 301, "/h/1/{k}", None), *((9, f"{{o}}/h/{i}/{{k}}", 308, f"/h/{i + 1}/{{k}}", None) for i in range(1, 6)), (9, "{o}/h/6/{k}", 200, None, None),
    (10, "{u}", 307, "//other{k}.shop.com:443/in", None), (10, "https://other{k}.shop.com/in", 404, None, None), (10, "http://other{k}.shop.com:443/in", 404, None, None), (11, "{u}", 301, "  ", None),
]


def _filled(template: str | Column, names: dict[str, Column]) -> Column:
    out = template if isinstance(template, Column) else F.col(template)
    for name, value in names.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def _filled_sql(template: str, names: dict[str, str]) -> str:
    for name, value in names.items():
        template = f"replace({template}, '{{{name}}}', {value})"
    return template


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else quoted(x) if isinstance(x, str) else str(x)
    return f"(select * from (values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) as t({names}))"


def hosts(pages: DataFrame) -> DataFrame:
    """(host, k): the different hosts of pages and their smallest page_id."""
    return pages.select(urls.host_of(F.col("url")).alias("host"), "page_id").where("host <> ''").groupBy("host").agg(F.min("page_id").alias("k"))


def answers(pages: DataFrame) -> DataFrame:
    """Synthetic DNS answers (ANSWERS) for the hosts of pages."""
    rows = pages.sparkSession.createDataFrame(_ANSWERS, "variant long, resolver string, question string, qtype string, status int, ad boolean, ord int, name string, rtype int, data string")
    named = hosts(pages).withColumn("variant", F.col("k") % 8).join(F.broadcast(rows), "variant")
    fill = lambda c: _filled(c, {"h": F.col("host"), "k": (F.col("k") % 200).cast("string")}).alias(c)
    return named.select(fill("question"), "resolver", "qtype", "status", "ad", "ord", fill("name"), "rtype", fill("data"))


def answers_sql(host: str) -> str:
    fill = lambda c: f"{_filled_sql(c, {'h': 'host', 'k': '(k % 200)::varchar'})} as {c}"
    rows = _values(_ANSWERS, "variant, resolver, question, qtype, status, ad, ord, name, rtype, data")
    return f"select {fill('question')}, resolver, qtype, status, ad, ord, {fill('name')}, rtype, {fill('data')} from (select {host} as host, min(page_id) as k from pages where {host} <> '' group by 1) h join {rows} r on h.k % 8 = r.variant"


def responses(pages: DataFrame) -> DataFrame:
    """Synthetic single responses (RESPONSES) for the addresses of pages and where they lead."""
    rows = pages.sparkSession.createDataFrame(_RESPONSES, "variant long, url string, status int, location string, error string")
    first = pages.select(urls.whole(F.col("url")).alias("u"), "page_id").groupBy("u").agg(F.min("page_id").alias("k"))
    named = first.withColumn("variant", F.col("k") % 12).join(F.broadcast(rows), "variant")
    names = {"u": F.col("u"), "o": F.concat(urls.scheme_of(F.col("u")), F.lit("://"), urls.authority_of(F.col("u"))), "h": urls.host_of(F.col("u")), "k": F.col("k").cast("string")}
    return named.select(_filled("url", names).alias("url"), "status", _filled("location", names).alias("location"), _filled("error", names).alias("error"))


def responses_sql(whole: str, scheme: str, authority: str, host: str) -> str:
    """SQL; the arguments are expressions of `u`, but the first, which is one of `url`."""
    names = {"u": "u", "o": f"({scheme} || '://' || {authority})", "h": host, "k": "k::varchar"}
    fill = lambda c: f"{_filled_sql(c, names)} as {c}"
    return f"select {fill('url')}, status, {fill('location')}, {fill('error')} from (select {whole} as u, min(page_id) as k from pages group by 1) f join {_values(_RESPONSES, 'variant, url, status, location, error')} r on f.k % 12 = r.variant"


#: Synthetic responses to plain HTTP by the smallest page_id of a host % 5: status, location, error.
_PLAIN: list[tuple] = [(0, 301, "  HTTPS://{h}/", None), (1, 200, None, None), (2, 302, "http://www.{h}/", None), (3, None, None, "connect ECONNREFUSED")]


def plain_responses(pages: DataFrame) -> DataFrame:
    """Synthetic responses (RESPONSES) of hosts that are asked without encryption."""
    rows = pages.sparkSession.createDataFrame(_PLAIN, "variant long, status int, location string, error string")
    named = hosts(pages).withColumn("variant", F.col("k") % 5).join(F.broadcast(rows), "variant")
    return named.select(F.concat(F.lit("http://"), "host", F.lit("/")).alias("url"), "status", _filled("location", {"h": F.col("host")}).alias("location"), "error")


def plain_responses_sql(host: str) -> str:
    return f"select 'http://' || host || '/' as url, status, {_filled_sql('location', {'h': 'host'})} as location, error from (select {host} as host, min(page_id) as k from pages where {host} <> '' group by 1) h join {_values(_PLAIN, 'variant, status, location, error')} r on h.k % 5 = r.variant"


def entries(pages: DataFrame) -> DataFrame:
    """Synthetic feed entries (ENTRIES): the first folder of some pages, and the hosts of some others."""
    url = F.col("url")
    folder = F.concat(urls.host_of(url), F.regexp_extract(urls.path_of(url), "^(/(?:[^/]*/)?)", 1))
    row = lambda feed, kind, text, threat: F.struct(F.lit(feed).alias("feed"), F.lit(kind).alias("kind"), F.sha2(text, 256).alias("hash"), F.lit(threat).alias("threat"))
    listed = F.array_compact(F.array(F.when(F.col("page_id") % 40 == 5, row("safe-browsing", "url", folder, "SOCIAL_ENGINEERING")), F.when(F.col("page_id") % 90 == 7, row("urlhaus", "host", urls.host_of(url), "malware_download"))))
    return pages.select(F.explode(listed).alias("e")).select("e.*").distinct()


def entries_sql(host: str, path: str) -> str:
    return (
        f"select distinct 'safe-browsing' as feed, 'url' as kind, sha256({host} || regexp_extract({path}, '^(/(?:[^/]*/)?)', 1)) as hash, 'SOCIAL_ENGINEERING' as threat from pages where page_id % 40 = 5 "
        f"union all select distinct 'urlhaus', 'host', sha256({host}), 'malware_download' from pages where page_id % 90 = 7"
    )


def attempts(pages: DataFrame) -> DataFrame:
    """Synthetic captures with `attempt` and `error`: some first attempts fail, and second ones that a scanner would not have made."""
    capture = overlay(pages).withColumn("error", F.lit(None).cast("string"))
    k = F.col("page_id") % 10
    first = capture.withColumn("attempt", F.lit(1)).withColumn("error", F.when(k == 8, "The operation was aborted").when(k == 2, "read ECONNRESET").when(k == 5, "self-signed certificate").otherwise(F.col("error"))).withColumn("status", F.when(k.isin(4, 6), 503).otherwise(F.col("status")))
    second = capture.where(k.isin(2, 4, 6, 8)).withColumn("attempt", F.lit(2)).withColumn("status", F.when(k == 6, 502).otherwise(F.col("status")))
    return first.unionByName(second)


def attempts_sql(captures: str) -> str:
    return (
        f"select * replace (case when page_id % 10 in (4, 6) then 503 else status end as status), 1 as attempt, case page_id % 10 when 8 then 'The operation was aborted' when 2 then 'read ECONNRESET' when 5 then 'self-signed certificate' end as error from {captures} "
        f"union all select * replace (case when page_id % 10 = 6 then 502 else status end as status), 2, null from {captures} where page_id % 10 in (2, 4, 6, 8)"
    )


def timed(captures: DataFrame) -> DataFrame:
    """Captures with a synthetic time `at`: one each 20 seconds."""
    return captures.withColumn("at", F.timestamp_seconds(F.col("page_id") * 20))


def container_fetches(pages: DataFrame) -> DataFrame:
    """A synthetic log of container fetches (`streaming.containers.FETCHES`), up to ten minutes before some of the pages."""
    k = F.col("page_id")
    rows = pages.where("page_id % 12 in (3, 4)")
    return rows.select(
        F.when(k % 12 == 3, "GTM-BUNDLE9").otherwise("GTM-ABC123").alias("id"), F.timestamp_seconds(k * 20 - (k * 7) % 600).alias("fetched_at"), F.when(k % 5 == 0, 404).otherwise(200).alias("status"), F.when(k % 7 == 0, "image/png").otherwise("text/javascript").alias("content_type"),
        F.concat(F.lit("v"), k.cast("string")).alias("js"), F.when(k % 11 == 0, "Request timed out").alias("error"),
    )


def container_fetches_sql() -> str:
    return (
        "select case when page_id % 12 = 3 then 'GTM-BUNDLE9' else 'GTM-ABC123' end as id, page_id * 20 - (page_id * 7) % 600 as fetched_at, case when page_id % 5 = 0 then 404 else 200 end as status, case when page_id % 7 = 0 then 'image/png' else 'text/javascript' end as content_type, "
        "'v' || page_id as js, case when page_id % 11 = 0 then 'Request timed out' end as error from pages where page_id % 12 in (3, 4)"
    )


def scans(events: DataFrame) -> DataFrame:
    """A synthetic log of scans from a table of events: who scanned is the host, the value how long it took, the type what came of it."""
    took = F.abs(F.col("value"))
    # A time without a zone is meant in UTC, whatever the session's zone is.
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") if dict(events.dtypes)["ts"] == "timestamp_ntz" else F.unix_micros("ts")
    return events.select(F.timestamp_micros(micros).alias("at"), F.concat(F.lit("https://h"), (F.col("user_id") % 7).cast("string"), F.lit(".shop.com/")).alias("url"), F.when(F.col("event_type") == "click", "ok").otherwise(F.col("event_type")).alias("outcome"), took.alias("duration_ms"), (took * 0.08).alias("cpu_ms"), (F.col("event_id") % 10 == 0).alias("truncated"))
