"""What other services say about pages: DNS reports, CNAME chains, threat feeds and redirects resolved hop by hop.

Every input is a long table (`sources.lookups` names the columns); nothing is fetched here.  Hosts, addresses and feed
expressions are made distinct before they meet a table, so a host that most pages share is looked up once, and what was found
goes back to the pages by a join that is broadcast only if its size was checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import urls
from pagelens.operators.outcomes import MAX_HOPS, fetch_error
from pagelens.operators.sites import CNAMES

MAX_SMALL = 1_000_000
#: Record types, and the longest chain of pointers that is followed.
A, CNAME, RRSIG, CAA = 1, 5, 46, 257
MAX_POINTERS = 8
IP_LITERAL = r"^(\d{1,3}\.){3}\d{1,3}$"
#: The feeds in order, and what they say.
SOURCES = {"dns-filter": "Cloudflare Security Threat Intelligence (1.1.1.2)", "safe-browsing": "Google Safe Browsing v4", "urlhaus": "URLhaus Malware Intelligence (Abuse.ch)"}
CLEAN = {"dns-filter": "Clean (no active threat listing detected)", "safe-browsing": "Clean (no active threat matches reported by Google)", "urlhaus": "Clean (host not listed in URLhaus malware database)"}
MISSING = {"dns-filter": "Check unavailable", "safe-browsing": "Provider lookup timed out or unavailable", "urlhaus": "Provider lookup timed out or unavailable"}
BLOCKED, SINKHOLE = ("Blocked Domain / Malware / Phishing", "Flagged as malicious by Cloudflare Security feed"), ("Malware Distribution / Sinkholed", "Blocked by Cloudflare automated threat filter")
#: Hex digits of a hash by which feeds are indexed, labels of the longest host suffix and folders of the longest path prefix.
PREFIX, LABELS, FOLDERS = 8, 5, 4


def small(df: DataFrame, rows: int = MAX_SMALL) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dns_reports(hosts: DataFrame, answers: DataFrame) -> DataFrame:
    """(host, resolves, ip_addresses, dnssec, validated, caa, caa_records) of each host, by conditional aggregates over its answers.

    A host resolves if its A query gave records; RRSIG records among them mean DNSSEC is enabled, the AD flag that it was
    validated.  An address, or a host that nobody asked for, has an empty report.
    """
    c = F.col
    good = (c("resolver") == "plain") & (c("status") == 0) & c("rtype").isNotNull()
    a, caa = good & (c("qtype") == "A"), good & (c("qtype") == "CAA") & (c("rtype") == CAA) & (F.coalesce("data", F.lit("")) != "")
    of = lambda cond: F.coalesce(F.max(cond), F.lit(False))
    listed = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "data")))), lambda x: x["data"])
    folded = answers.groupBy(c("question").alias("host")).agg(
        of(a).alias("resolves"), listed(a & (c("rtype") == A) & (F.coalesce("data", F.lit("")) != "")).alias("ip_addresses"), of(a & (c("rtype") == RRSIG)).alias("dnssec"), of(a & c("ad")).alias("validated"), of(caa).alias("caa"), listed(caa).alias("caa_records"),
    )
    asked = hosts.select("host").distinct()
    rows = asked.join(folded.where(~c("host").rlike(IP_LITERAL)), "host", "left")
    none, no = F.array().cast("array<string>"), F.lit(False)
    return rows.select("host", F.coalesce("resolves", no).alias("resolves"), F.coalesce("ip_addresses", none).alias("ip_addresses"), F.coalesce("dnssec", no).alias("dnssec"), F.coalesce("validated", no).alias("validated"), F.coalesce("caa", no).alias("caa"), F.coalesce("caa_records", none).alias("caa_records"))


def tidy(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"\.$", "")


def cname_chains(hosts: DataFrame, answers: DataFrame) -> DataFrame:
    """(host, chain, loops, tech_id, tech_name, cname): pointers followed to their end, and the first provider on the way.

    A chain ends where no pointer leads on, at a name it has been at (loops), or after MAX_POINTERS steps.
    """
    named = answers.where(f"resolver = 'plain' and qtype = 'CNAME' and rtype = {CNAME}")
    pointers = small(named.groupBy(tidy(F.col("name")).alias("at")).agg(F.min_by(tidy(F.col("data")), F.struct("ord", "data")).alias("to")))
    rows = hosts.select("host").distinct().select("host", F.lower("host").alias("at"), F.array().cast("array<string>").alias("chain"), F.lit(False).alias("loops"))
    for _ in range(MAX_POINTERS):
        met = rows.join(pointers, "at", "left")
        again = F.array_contains("chain", F.col("to")) | (F.col("to") == F.lower("host"))
        moves = F.col("to").isNotNull() & ~F.col("loops")
        rows = met.select("host", F.when(moves & ~again, F.col("to")).otherwise(F.col("at")).alias("at"), F.when(moves & ~again, F.concat("chain", F.array("to"))).otherwise(F.col("chain")).alias("chain"), (F.col("loops") | (moves & again)).alias("loops"))
    provider = F.array(*(F.struct(F.lit(s).alias("suffix"), F.lit(i).alias("tech_id"), F.lit(n).alias("tech_name")) for s, i, n in CNAMES))
    of = lambda name: F.get(F.filter(provider, lambda p: F.endswith(name, p["suffix"])), 0)
    met = F.filter(F.transform("chain", lambda x: F.struct(x.alias("cname"), of(x).alias("p"))), lambda x: x["p"].isNotNull())
    return rows.where(F.size("chain") > 0).withColumn("hit", F.get(met, 0)).select("host", "chain", "loops", F.col("hit.p.tech_id").alias("tech_id"), F.col("hit.p.tech_name").alias("tech_name"), F.col("hit.cname").alias("cname"))


def host_suffixes(host: Column) -> Column:
    """The host, and what its last five labels and fewer spell, down to two; an address alone."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    lengths = F.when(n > 2, F.sequence(F.least(F.lit(LABELS), n - 1), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.when(host.rlike(IP_LITERAL), F.array(host)).otherwise(F.concat(F.array(host), F.transform(lengths, lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))))


def path_prefixes(path: Column, query: Column) -> Column:
    """The path with and without its query, and its first folders from the root on."""
    folders = F.filter(F.split(F.regexp_replace(path, "[^/]*$", ""), "/"), lambda x: x != "")
    depth = F.sequence(F.lit(0), F.least(F.lit(FOLDERS - 1), F.size(folders)))
    upto = F.transform(depth, lambda k: F.concat(F.lit("/"), F.array_join(F.slice(folders, 1, k), "/"), F.when(k > 0, "/").otherwise("")))
    return F.array_distinct(F.concat(F.when(query != "", F.array(F.concat(path, query))).otherwise(F.array().cast("array<string>")), F.array(path), upto))


def expressions(url: Column) -> Column:
    """Every host suffix with every path prefix of an address, as feeds list them."""
    url = urls.with_scheme(url)
    host, paths = urls.host_of(url), path_prefixes(urls.path_of(url), F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(host_suffixes(host), lambda h: F.transform(paths, lambda p: F.concat(h, p)))))


def listed_texts(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, feed, threat) for keys one of whose `texts` is listed: joined on a prefix of the hash, confirmed by the whole of it."""
    index = small(entries.select("feed", F.col("hash").alias("full"), "threat", F.substring("hash", 1, PREFIX).alias("prefix")).distinct())
    hashed = texts.select("key", F.explode("texts").alias("text")).select("key", F.sha2("text", 256).alias("hash")).withColumn("prefix", F.substring("hash", 1, PREFIX))
    return hashed.join(index, (hashed["prefix"] == index["prefix"]) & (hashed["hash"] == index["full"])).groupBy("key", "feed").agg(F.min("threat").alias("threat"))


def threat_reports(pages: DataFrame, answers: DataFrame, entries: DataFrame, feeds: DataFrame) -> DataFrame:
    """(page_id, place, source, checked, listed, threat, said): what each of the three feeds says of a page (page_id, url).

    The DNS filter has checked a host if the filtering resolver answered; a name that does not exist or that leads to 0.0.0.0 is
    listed.  The others have checked everything if `feeds` (feed, available) says so; `safe-browsing` lists expressions of
    addresses, `urlhaus` hosts.
    """
    page = pages.select("page_id", "url", urls.host_of(urls.with_scheme(F.col("url"))).alias("host"))
    asked = answers.where("resolver = 'filter' and qtype = 'A'").where(~F.col("question").rlike(IP_LITERAL))
    zero = F.coalesce(F.max((F.col("status") == 0) & (F.col("data") == "0.0.0.0")), F.lit(False))
    filtered = small(asked.groupBy(F.col("question").alias("host")).agg(F.max(F.col("status") == 3).alias("gone"), zero.alias("zero")))
    address = page.where("host <> ''").select("url").distinct().select(F.col("url").alias("key"), expressions(F.col("url")).alias("texts"))
    by_url = listed_texts(address, entries.where("feed = 'safe-browsing' and kind = 'url'")).select(F.col("key").alias("url"), F.col("threat").alias("url_threat"))
    names = page.where("host <> ''").select("host").distinct().select(F.col("host").alias("key"), F.array("host").alias("texts"))
    by_host = listed_texts(names, entries.where("feed = 'urlhaus' and kind = 'host'")).select(F.col("key").alias("host"), F.col("threat").alias("host_threat"))
    rows = page.join(filtered, "host", "left").join(small(by_url), "url", "left").join(small(by_host), "host", "left")
    # Two names at most are asked for, however long the table is.
    ready = {r["feed"] for r in feeds.where(F.col("available") & F.col("feed").isin("safe-browsing", "urlhaus")).select("feed").distinct().collect()}

    def report(place: int, feed: str, checked: Column, threat: Column, said: Column) -> Column:
        listed = checked & threat.isNotNull()
        text = F.when(~checked, MISSING[feed]).when(listed, said).otherwise(CLEAN[feed])
        return F.struct(F.lit(place).alias("place"), F.lit(SOURCES[feed]).alias("source"), checked.alias("checked"), listed.alias("listed"), F.when(listed, threat).alias("threat"), text.alias("said"))

    kind = F.when(F.col("gone"), BLOCKED[0]).when(F.col("zero"), SINKHOLE[0])
    every = F.array(
        report(0, "dns-filter", F.col("gone").isNotNull(), kind, F.when(F.col("gone"), BLOCKED[1]).otherwise(SINKHOLE[1])),
        report(1, "safe-browsing", F.lit("safe-browsing" in ready), F.col("url_threat"), F.concat(F.lit("Flagged as "), "url_threat")),
        report(2, "urlhaus", F.lit("urlhaus" in ready), F.col("host_threat"), F.lit("Listed for active malware distribution (1 URLs recorded)")),
    )
    return rows.select("page_id", F.explode(every).alias("r")).select("page_id", "r.*")


def http_redirects(hosts: DataFrame, responses: DataFrame) -> DataFrame:
    """(host, http_redirects): whether a host sends plain HTTP on to HTTPS; null where nobody can say.

    A redirect counts by where it leads, a page served without encryption is none, and any other answer says nothing.
    """
    asked = hosts.select("host").distinct().withColumn("url", F.concat(F.lit("http://"), "host", F.lit("/")))
    location = F.trim(F.coalesce("location", F.lit("")))
    verdict = F.when(F.col("error").isNotNull() | F.col("host").rlike(IP_LITERAL), None).when(F.col("status").between(301, 308), location.rlike("(?i)^https://")).when(F.col("status") == 200, False)
    one = responses.groupBy("url").agg(F.min_by(F.struct("status", "location", "error"), F.struct("status", "location", "error")).alias("r")).select("url", "r.*")
    return asked.join(one, "url", "left").select("host", verdict.cast("boolean").alias("http_redirects"))


def with_network(captures: DataFrame, answers: DataFrame, entries: DataFrame, feeds: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """Captures with the columns that `safety.findings` reads: threats, resolves, dnssec, caa and, with responses, http_redirects."""
    url = F.coalesce(F.nullif(F.col("final_url"), F.lit("")), "url")
    page = captures.select("page_id", url.alias("url"))
    told = threat_reports(page, answers, entries, feeds).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("place", "source", "checked", "listed"))).alias("t"))
    told = told.select("page_id", F.transform("t", lambda x: F.struct(x["source"].alias("source"), x["checked"].alias("checked"), x["listed"].alias("listed"))).alias("threats"))
    host = page.select("page_id", urls.host_of(urls.with_scheme(F.col("url"))).alias("host"))
    report = dns_reports(host, answers).select("host", "resolves", F.col("validated").alias("dnssec"), "caa")
    if responses is not None:
        report = report.join(http_redirects(host, responses), "host")
    return captures.join(told, "page_id").join(host.join(small(report), "host").drop("host"), "page_id")


def prepared(responses: DataFrame) -> DataFrame:
    """(url, code, message, http_status, next): what one response leads to, whoever follows it."""
    status, location, check = F.col("status"), F.col("location"), F.col("check")
    one = responses.groupBy("url").agg(F.min_by(F.struct("status", "location", "error"), F.struct(F.coalesce("status", F.lit(999)), F.coalesce("location", F.lit("")), F.coalesce("error", F.lit("")))).alias("r")).select("url", "r.*")
    aimed = one.select("*", urls.resolved(F.trim(location), F.col("url")).alias("target")).select("*", urls.validation(F.col("target")).alias("check"), F.coalesce(status.between(301, 308), F.lit(False)).alias("redirect"))
    named = lambda code, message: F.struct(F.lit(code).alias("code"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))
    told = (
        F.when(F.col("error").isNotNull(), fetch_error(F.col("error"))).when(status.isNull(), named("HTTP_ERROR", "Network connection failed.")).when(F.col("redirect") & (F.coalesce(location, F.lit("")) == ""), named("HTTP_ERROR", "Redirect response missing Location header."))
        .when(F.col("redirect") & (F.trim(location) == ""), named("BLOCKED_TARGET", "Empty redirect location")).when(F.col("redirect") & (check["code"] != "ok"), named("BLOCKED_TARGET", check["message"])).when(status >= 500, named("HTTP_ERROR", F.concat(F.lit("Server returned HTTP status "), status.cast("string"), F.lit("."))))
    )
    out = aimed.select("url", "target", "redirect", told.alias("told"), F.when(F.col("error").isNull(), status).alias("p_status"))
    return out.select("url", F.col("told.code").alias("p_code"), F.col("told.message").alias("p_message"), "p_status", F.when(F.col("redirect") & F.col("told").isNull(), urls.whole(F.col("target"))).alias("next"))


def follow(starts: DataFrame, responses: DataFrame, max_hops: int = MAX_HOPS, pin_host: str | None = None) -> DataFrame:
    """(url, ok, final_url, chain, hops, error_code, message, http_status): each different address followed through single responses.

    `chain` starts with the address itself.  An address that was visited, more than `max_hops` hops, an answer that is missing
    and 5xx are HTTP_ERROR; a hop that validation refuses, or that leaves `pin_host`, is BLOCKED_TARGET.  Each round is one
    join by the address that a row has reached; rows that have ended keep theirs, so they stay spread.
    """
    check = urls.validation(F.col("url"))
    rows = starts.select("url").distinct().select("url", check.alias("v"), urls.whole(F.col("url")).alias("at"))
    bad = F.col("v.code") != "ok"
    rows = rows.select("url", "at", F.array("at").alias("chain"), F.when(bad, F.col("v.code")).alias("code"), F.when(bad, F.col("v.message")).alias("message"), F.when(bad, F.when(F.col("v.code") == "BLOCKED_TARGET", 403).otherwise(400)).alias("http_status"), bad.alias("ended"))
    answers = prepared(responses).withColumnRenamed("url", "at").withColumn("known", F.lit(True))
    named = lambda code, message: F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))
    off = (urls.host_of(F.col("next")) != pin_host) if pin_host else F.lit(False)
    why = (
        F.when(F.col("known").isNull(), named("HTTP_ERROR", "Network connection failed.")).when(F.col("p_code").isNotNull(), F.struct(F.col("p_code").alias("code"), F.col("p_message").alias("message")))
        .when(F.col("next").isNotNull() & off, named("BLOCKED_TARGET", f"Container fetch must not follow redirects off {pin_host}.")).when(F.array_contains("chain", F.col("next")), named("HTTP_ERROR", "Redirect loop detected."))
    )
    old = F.struct("code", "message", "http_status")
    for _ in range(max_hops + 1):
        met = rows.join(answers, "at", "left").select("url", "at", "chain", "ended", "next", why.alias("why"), old.alias("old"), "p_status")
        moves = ~F.col("ended") & F.col("why").isNull() & F.col("next").isNotNull()
        of = F.when(F.col("ended"), F.col("old")).otherwise(F.struct(F.col("why.code").alias("code"), F.col("why.message").alias("message"), F.col("p_status").alias("http_status")))
        gone = met.select("url", "at", "chain", "ended", "next", moves.alias("moves"), of.alias("of"))
        rows = gone.select("url", F.when(F.col("moves"), F.col("next")).otherwise(F.col("at")).alias("at"), F.when(F.col("moves"), F.concat("chain", F.array("next"))).otherwise(F.col("chain")).alias("chain"), "of.*", (~F.col("moves")).alias("ended"))
    over = ~F.col("ended")
    code = F.when(over, "HTTP_ERROR").otherwise(F.col("code"))
    return rows.select("url", code.isNull().alias("ok"), F.when(code.isNull(), F.col("at")).alias("final_url"), "chain", (F.size("chain") - 1).alias("hops"), code.alias("error_code"), F.when(over, f"Exceeded maximum redirect limit ({max_hops}).").otherwise(F.col("message")).alias("message"), F.when(~over, F.col("http_status")).alias("http_status"))
