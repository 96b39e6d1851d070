"""The page safety audit: headers, mixed content, redirects, findings, score and verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import urls
from pagelens.functions.channels import every, lowered_headers

#: Fixed values of the audit.
MIXED = r"""(?i)<(?:script|link|iframe|img|audio|video|source|embed)[^>]*?(?:src|href)=["'](http://[^"']+)["']"""
REFERRER_POLICIES = ["strict-origin-when-cross-origin", "no-referrer", "strict-origin", "same-origin"]
YEAR = 31_536_000
CHALLENGE = r"(?i)challenge|captcha|security check|ddos protection|just a moment|verify you are human|access denied|request blocked|perimeterx|datadome|kasada|shape\.sh|incapsula"
_WORDS = CHALLENGE.removeprefix("(?i)").split("|")
#: The same for Java, which is slow at trying all words everywhere: only where three letters may begin one are they tried.
CHALLENGE_WORDS = f"(?i)(?={''.join(f'[{letters}]' for letters in (''.join(sorted({w[i] for w in _WORDS})) for i in range(3)))})(?:{'|'.join(_WORDS)})"
CHALLENGE_STATUS = [401, 403, 407, 429, 503]
PENALTY = {"threat": {"critical": 50, "high": 25, "other": 15}, "concern": {"medium": 8, "low": 4, "other": 2}}
RELEVANT = r"^(server|via|x-cache|x-served-by|x-cdn|x-iinfo|cf-ray|cf-mitigated|cf-cache-status|x-dd-b|x-amzn-requestid|x-amz-cf-id|retry-after)$"


def is_challenge(status: Column, html: Column) -> Column:
    return F.substring(html, 1, 8000).rlike(CHALLENGE_WORDS) | status.isin(*CHALLENGE_STATUS)


def relevant_headers(headers: Column) -> Column:
    kept = F.map_filter(lowered_headers(headers), lambda k, v: k.rlike(RELEVANT))
    return F.transform_values(kept, lambda k, v: F.substring(v, 1, 200))


def header_audit(headers: Column) -> dict[str, Column]:
    h = lowered_headers(headers)
    get = lambda name: F.coalesce(h[name], F.lit(""))
    csp, hsts, frame, referrer = get("content-security-policy"), get("strict-transport-security"), F.upper(F.trim(get("x-frame-options"))), F.lower(F.trim(get("referrer-policy")))
    has_csp, has_hsts = F.trim(csp) != "", F.trim(hsts) != ""
    age = F.coalesce(F.try_to_number(F.nullif(F.substring(F.regexp_extract(hsts, r"(?i)max-age=(\d+)", 1), 1, 18), F.lit("")), F.lit("9" * 18)).cast("long"), F.lit(0))
    ancestors = has_csp & csp.contains("frame-ancestors")
    recommended = F.exists(F.array(*map(F.lit, REFERRER_POLICIES)), lambda p: referrer.contains(p))
    days = F.floor(age / 86_400 + 0.5).cast("string")
    return {
        "csp": has_csp,
        "unsafe_inline": has_csp & csp.contains("'unsafe-inline'"),
        "unsafe_eval": has_csp & csp.contains("'unsafe-eval'"),
        "hsts": has_hsts,
        "hsts_age": age,
        "hsts_subdomains": F.lower(hsts).contains("includesubdomains"),
        "hsts_preload": F.lower(hsts).contains("preload"),
        "hsts_summary": F.when(~has_hsts, "Missing HSTS").otherwise(F.concat(F.when(age >= YEAR, "Enforced (max-age: ").otherwise("Short duration (max-age: "), days, F.lit(" days)"))),
        "nosniff": F.lower(F.trim(get("x-content-type-options"))) == "nosniff",
        "framing": ancestors | frame.isin("DENY", "SAMEORIGIN"),
        "referrer": recommended,
        "permissions": F.coalesce(F.nullif(get("permissions-policy"), F.lit("")), get("feature-policy")) != "",
        "exposes_version": get("server").rlike(r"\d+\.\d+") | get("x-powered-by").rlike(r"\d+\.\d+"),
    }


def mixed_content(html: Column, url: Column) -> Column:
    """Up to ten different insecure resources of an https page."""
    found = F.slice(F.array_distinct(every(F.coalesce(html, F.lit("")), MIXED)), 1, 10)
    return F.when(urls.scheme_of(urls.with_scheme(url)) == "https", found).otherwise(F.array().cast("array<string>"))


def redirect_audit(first: Column, final: Column, chain: Column) -> dict[str, Column]:
    hops = F.when(F.size(chain) > 0, chain).otherwise(F.array(first))
    hops = F.when(F.get(hops, 0) != first, F.concat(F.array(first), hops)).otherwise(hops)
    hops = F.when((F.element_at(hops, -1) != final) & (final != ""), F.concat(hops, F.array(final))).otherwise(hops)
    start = urls.host_of(first)
    other = F.exists(hops, lambda u: (start != "") & (urls.host_of(u) != "") & (urls.host_of(u) != start) & ~F.endswith(urls.host_of(u), F.concat(F.lit("."), start)))
    steps = F.arrays_zip(hops.alias("a"), F.slice(hops, 2, 1000).alias("b"))
    down = F.exists(steps, lambda s: (urls.scheme_of(s["a"]) == "https") & (urls.scheme_of(s["b"]) == "http"))
    return {"hops": F.size(hops) - 1, "cross_domain": other, "downgrade": F.coalesce(down, F.lit(False)), "excessive": F.size(hops) - 1 > 3}


def findings(captures: DataFrame) -> DataFrame:
    """One row for each finding of a page: id, area, status and severity.

    Optional columns feed the checks that need the network: threats (array of source, checked, listed),
    http_redirects (boolean), resolves, dnssec and caa (booleans); without them these checks give no finding.
    """
    have = set(captures.columns)
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in have else F.lit(False)
    head = header_audit(F.col("headers"))
    url = F.coalesce(F.nullif(F.col("final_url"), F.lit("")), "url")
    look = urls.anatomy(url)
    hops = redirect_audit(F.col("url"), F.col("final_url"), F.col("redirect_chain"))
    page = captures.select("page_id", *(c for c in ("threats", "http_redirects", "resolves", "dnssec", "caa") if c in have), (urls.scheme_of(urls.with_scheme(url)) == "https").alias("https"), (F.size(mixed_content(F.col("html"), url)) > 0).alias("mixed"), *(v.alias(k) for k, v in (head | look | hops).items()))
    c = F.col
    row = lambda name, area, status, severity: F.struct(F.lit(name).alias("finding"), F.lit(area).alias("area"), F.lit(status).alias("status"), F.lit(severity).alias("severity"))
    good = lambda name, area: row(name, area, "pass", "none")
    redirects = c("http_redirects") if "http_redirects" in have else F.lit(None).cast("boolean")
    strong = (c("hsts_age") >= YEAR)
    fixed = F.array_compact(F.array(
        F.when(c("https"), good("conn-https-valid", "connection")).otherwise(row("conn-https-missing", "connection", "threat", "high")),
        F.when(redirects, good("conn-http-redirect", "connection")).when(~redirects, row("conn-http-no-redirect", "connection", "concern", "medium")),
        F.when(c("hsts") & strong, good("conn-hsts", "connection")).when(c("hsts"), row("conn-hsts", "connection", "concern", "low")).otherwise(row("conn-hsts-missing", "connection", "concern", "medium")),
        F.when(c("mixed"), row("conn-mixed-content", "connection", "threat", "high")).when(c("https"), good("conn-mixed-clean", "connection")),
        F.when(c("csp") & c("unsafe_inline"), row("hdr-csp", "headers", "concern", "low")).when(c("csp"), good("hdr-csp", "headers")).otherwise(row("hdr-csp-missing", "headers", "concern", "medium")),
        F.when(c("nosniff"), good("hdr-xcto", "headers")).otherwise(row("hdr-xcto-missing", "headers", "concern", "low")),
        F.when(c("framing"), good("hdr-xfo", "headers")).otherwise(row("hdr-xfo-missing", "headers", "concern", "medium")),
        F.when(c("referrer"), good("hdr-referrer", "headers")).otherwise(row("hdr-referrer-concern", "headers", "concern", "low")),
        F.when(c("exposes_version"), row("hdr-server-version", "headers", "concern", "low")),
        F.when(c("downgrade"), row("redir-downgrade", "redirects", "threat", "critical")),
        F.when(c("cross_domain"), row("redir-cross-domain", "redirects", "concern", "medium")),
        F.when(c("excessive"), row("redir-excessive", "redirects", "concern", "low")),
        F.when(c("is_punycode"), row("url-punycode", "url_anatomy", "concern", "medium")),
        F.when(c("is_ip"), row("url-ip-host", "url_anatomy", "concern", "medium")),
        F.when(c("risk_words") != "", row("url-suspicious-keywords", "url_anatomy", "concern", "medium")),
        F.when(flag("resolves"), good("dns-resolves", "dns")), F.when(flag("dnssec"), good("dns-dnssec", "dns")), F.when(flag("caa"), good("dns-caa", "dns")),
    ))
    if "threats" in have:
        slug = lambda t: F.lower(F.regexp_replace(t["source"], r"\s+", "-"))
        named = lambda t, prefix, status, severity: F.struct(F.concat(F.lit(prefix), slug(t)).alias("finding"), F.lit("threat_intel").alias("area"), F.lit(status).alias("status"), F.lit(severity).alias("severity"))
        feeds = F.transform(F.coalesce(c("threats"), F.array().cast("array<struct<source:string,checked:boolean,listed:boolean>>")), lambda t: F.when(t["checked"] & t["listed"], named(t, "threat-", "threat", "critical")).when(t["checked"], named(t, "clean-", "pass", "none")).otherwise(named(t, "avail-", "unavailable", "none")))
        fixed = F.concat(feeds, fixed)
    return page.select("page_id", F.posexplode(fixed).alias("at", "f")).select("page_id", "at", "f.*")


def verdicts(found: DataFrame) -> DataFrame:
    """Penalty score, verdict and rating of each page, with counts of findings by status."""
    severity = F.col("severity")
    threat = F.when(severity == "critical", 50).when(severity == "high", 25).otherwise(15)
    concern = F.when(severity == "medium", 8).when(severity == "low", 4).otherwise(2)
    loss = F.sum(F.when(F.col("status") == "threat", threat).when(F.col("status") == "concern", concern).otherwise(0))
    count = lambda status: F.sum((F.col("status") == status).cast("int")).alias(f"n_{status}")
    rows = found.groupBy("page_id").agg(F.greatest(F.lit(10), F.least(F.lit(100), 100 - loss)).cast("int").alias("score"), count("pass"), count("concern"), count("threat"), count("unavailable"), F.max((F.col("finding") == "conn-https-missing").cast("int")).alias("plain"))
    danger, doubt = F.col("n_threat") > 0, (F.col("n_concern") > 0) | (F.col("score") < 80) | (F.col("plain") == 1)
    return rows.select("page_id", "score", F.when(danger, "known_threat").when(doubt, "potential").otherwise("none").alias("verdict"), F.when(danger, "High").when(doubt, "Moderate").otherwise("Low").alias("rating"), "n_pass", "n_concern", "n_threat", "n_unavailable")
