"""What became of a capture: the error ladder, bundles and script candidates worth fetching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import urls
from pagelens.functions.channels import container_ids, every
from pagelens.operators.catalogue import ERRORS
from pagelens.operators.matching import MAX_CONTAINER, MAX_CONTAINERS
from pagelens.operators.safety import is_challenge

#: Limits of a capture, in hops, pieces and bytes.
MAX_HOPS, MAX_BUNDLES, MAX_CANDIDATES = 5, 5, 20
MAX_HTML, MAX_BUNDLE = 500_000, 250_000
#: Hops and bytes of HTML of a page in the scan of a site.
SCAN_HOPS, SCAN_HTML = 3, 100_000
SCRIPT_SRC = r"""(?i)<script[^>]+src=["']([^"']+)["']"""
LINK = r"(?i)<link\s+[^>]*>"
MODULE = r"""(?i)rel=["'](?:[^"']*\s+)?modulepreload(?:\s+[^"']*)?["']"""
PRELOAD = r"""(?i)rel=["'](?:[^"']*\s+)?preload(?:\s+[^"']*)?["']"""
AS_SCRIPT = r"""(?i)as=["']script["']"""
HREF = r"""(?i)href=["']([^"']+)["']"""
BASE = r"""(?i)<base\s+[^>]*href=["']([^"']+)["']"""
NOT_FETCHED = r"^(data|blob|javascript):"
#: From this CPU time on a scan is noted as costly.
HIGH_CPU_MS = 8.0


def is_html(content_type: Column, html: Column) -> Column:
    """By content type; whatever else it says, by how the text begins."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    head = F.lower(F.substring(html, 1, 1024))
    return kind.contains("text/html") | kind.contains("application/xhtml") | head.contains("<!doctype html") | head.contains("<html")


def fetch_error(error: Column) -> Column:
    """A struct (code, message) of what a fetch was stopped by, told from its text."""
    named = lambda code, message: F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))
    return F.when(error.contains("abort"), named("TIMEOUT", "The request timed out.")).when(error.rlike("DNS|ENOTFOUND|EAI_AGAIN"), named("DNS_FAILED", "Could not resolve domain name.")).when(error.rlike("certificate|SSL|TLS"), named("TLS_ERROR", "TLS certificate verification failed.")).otherwise(named("HTTP_ERROR", "Network connection failed."))


def outcome(captures: DataFrame, *keep: str) -> DataFrame:
    """(page_id, ok, scan, error_code, http_status, retryable, truncated): the first reason of the ladder.

    `redirect_chain` may start with the page's own address, as a scanner notes it, or with the first hop.  A hop that
    validation refuses is BLOCKED_TARGET; a loop, more than `MAX_HOPS` hops, no answer and 5xx are HTTP_ERROR.  `error`, where
    captures have it, is what a fetch was stopped by.  A capture that was cut is partial.
    """
    error = F.col("error") if "error" in captures.columns else F.lit(None).cast("string")
    first = urls.whole(F.col("url"))
    # Each hop is meant from where the last one led; an empty one leads nowhere.
    step = lambda done, u: F.concat(done, F.array(F.when(F.trim(u) == "", F.lit("")).otherwise(urls.whole(urls.resolved(F.trim(u), F.element_at(done, -1))))))
    chain = F.coalesce("redirect_chain", F.array().cast("array<string>"))
    hops = F.when(urls.whole(F.get(chain, 0)) == first, F.slice(chain, 2, 1000)).otherwise(chain)
    cut = (F.octet_length("html") > MAX_HTML) | F.exists("bundles", lambda b: F.octet_length(b) > MAX_BUNDLE) | F.exists("containers", lambda c: F.octet_length(c["js"]) > MAX_CONTAINER)
    page = captures.select("page_id", *keep, "status", "content_type", "html", error.alias("error"), urls.validation(F.col("url"))["code"].alias("check"), F.aggregate(hops, F.array(first), step).alias("reached"), F.coalesce(cut, F.lit(False)).alias("truncated"))
    refused = F.exists(F.slice("reached", 2, 1000), lambda u: urls.validation(u)["code"] != "ok")
    loop = (F.size(F.array_distinct("reached")) < F.size("reached")) | (F.size("reached") > MAX_HOPS + 1)
    html, status = F.coalesce("html", F.lit("")), F.col("status")
    code = (
        F.when(F.col("check") != "ok", F.col("check")).when(F.col("error").isNotNull(), fetch_error(F.col("error"))["code"]).when(refused, "BLOCKED_TARGET").when(loop | status.isNull() | (status >= 500), "HTTP_ERROR")
        .when(is_challenge(status, F.lit("")), "TARGET_BLOCKED").when(~is_html(F.col("content_type"), html), "NOT_HTML").when(is_challenge(status, html), "TARGET_BLOCKED")
    )
    told = page.select("page_id", *keep, "status", "error", "truncated", code.alias("error_code"))
    of = lambda at: F.element_at(F.create_map(*(F.lit(x) for e in ERRORS for x in (e[0], e[at]))), F.col("error_code"))
    http = F.when((F.col("error_code") == "HTTP_ERROR") & F.col("error").isNull() & (status >= 500), status).otherwise(of(1))
    failed = F.col("error_code").isNotNull()
    return told.select("page_id", *keep, (~failed).alias("ok"), F.when(failed, "failed").when(F.col("truncated"), "partial").otherwise("complete").alias("scan"), "error_code", http.cast("int").alias("http_status"), F.coalesce(of(2), F.lit(False)).alias("retryable"), "truncated")


def folded_attempts(attempts: DataFrame) -> DataFrame:
    """The outcome of each page from a log of attempts (captures with `attempt` and `error`): (page_id, attempts, retried, ...).

    A second attempt counts only if the first ended in HTTP_ERROR, which a status of 500 or more is too; later ones never do.
    """
    rows = outcome(attempts.where("attempt in (1, 2)"), "attempt")
    fields = ["ok", "scan", "error_code", "http_status", "retryable", "truncated"]
    pick = lambda n: F.max_by(F.struct(*fields), F.when(F.col("attempt") == n, 1)).alias(f"a{n}")
    both = rows.withColumn("again", F.coalesce((F.col("attempt") == 1) & (F.col("error_code") == "HTTP_ERROR"), F.lit(False))).groupBy("page_id").agg(F.count("*").alias("attempts"), F.max("again").alias("again"), pick(1), pick(2))
    retried = F.col("again") & F.col("a2").isNotNull()
    return both.select("page_id", "attempts", retried.alias("retried"), F.when(retried, F.col("a2")).otherwise(F.col("a1")).alias("o")).where("o is not null").select("page_id", "attempts", "retried", "o.*")


def script_candidates(html: Column, url: Column) -> Column:
    """Scripts of the base's own origin, each once: script sources, then preloaded modules and scripts as they stand."""
    base = F.coalesce(F.nullif(F.regexp_extract(html, BASE, 1), F.lit("")), url)
    base = urls.resolved(base, url)
    tags = F.filter(every(html, LINK, 0), lambda t: t.rlike(MODULE) | (t.rlike(PRELOAD) & t.rlike(AS_SCRIPT)))
    given = F.concat(every(html, SCRIPT_SRC), F.transform(tags, lambda t: F.regexp_extract(t, HREF, 1)))
    all_ = F.transform(F.filter(given, lambda x: (x != "") & ~x.rlike(NOT_FETCHED)), lambda x: urls.resolved(x, base))
    origin = lambda u: F.concat(urls.scheme_of(u), F.lit("://"), urls.host_of(u), F.lit(":"), urls.port_of(u))
    own = F.filter(F.array_distinct(all_), lambda u: (origin(u) == origin(base)) & (urls.validation(u)["code"] == "ok"))
    return F.slice(own, 1, MAX_CANDIDATES)


def scan_log(scans: DataFrame) -> DataFrame:
    """What happened, by host and outcome; scans has url, outcome, duration_ms, cpu_ms, subrequests and truncated."""
    flag = lambda c: F.sum(c.cast("int")).alias
    return scans.groupBy(urls.host_of(F.col("url")).alias("host"), "outcome").agg(F.count("*").alias("scans"), F.sum("duration_ms").alias("duration_ms"), F.sum("subrequests").alias("subrequests"), flag(F.col("truncated"))("truncated"), flag(F.col("cpu_ms") >= HIGH_CPU_MS)("high_cpu"))


def missing_containers(captures: DataFrame) -> DataFrame:
    """(page_id, ord, id, fetched): the first `MAX_CONTAINERS` container ids of a page and whether their script is there."""
    ids = F.slice(container_ids(F.array_join(F.concat(F.array(F.coalesce("html", F.lit(""))), "bundles"), "\n")), 1, MAX_CONTAINERS)
    return captures.select("page_id", "containers", F.posexplode(ids).alias("ord", "id")).select("page_id", "ord", "id", F.exists("containers", lambda c: c["id"] == F.col("id")).alias("fetched"))


def scan_pages(captures: DataFrame) -> DataFrame:
    """Captures as the scan of a site sees them, with `scan_error`.

    HTML counts only with an HTML type or none and a status under 400, up to `SCAN_HTML` bytes; a page behind a challenge
    keeps its headers and cookies, but no HTML.  A bad address, a hop that validation refuses and more than `SCAN_HOPS`
    hops leave nothing.
    """
    kind = F.lower(F.coalesce(F.col("content_type"), F.lit("")))
    readable = (kind.contains("text/html") | kind.contains("application/xhtml") | (kind == "")) & (F.col("status") < 400)
    html = F.when(readable, F.coalesce("html", F.lit(""))).otherwise("")
    cut = F.rtrim(F.make_valid_utf8(F.substring(F.encode("seen", "UTF-8"), 1, SCAN_HTML).cast("string")), F.lit("\ufffd"))
    chain = F.coalesce("redirect_chain", F.array().cast("array<string>"))
    hops = F.when(urls.whole(F.get(chain, 0)) == urls.whole(F.col("url")), F.slice(chain, 2, 1000)).otherwise(chain)
    own = urls.validation(F.col("url"))["code"]
    page = captures.withColumns({"seen": html, "hops_": hops, "own_": own})
    page = page.withColumns({"seen": F.when(F.octet_length("seen") > SCAN_HTML, cut).otherwise(F.col("seen")), "refused_": F.get(F.filter(F.transform("hops_", lambda u: urls.validation(u)["code"]), lambda c: c != "ok"), 0)})
    challenged = is_challenge(F.col("status"), F.col("seen"))
    error = (
        F.when(F.col("own_") != "ok", F.concat(F.lit("Rejected: "), "own_")).when(F.col("refused_").isNotNull(), F.concat(F.lit("Redirect rejected: "), "refused_")).when(F.size("hops_") > SCAN_HOPS, "Too many redirects")
        .when(F.col("status").isNull(), "Fetch failed").when(challenged, "Blocked: bot-protection challenge — headers and cookies only")
    )
    page = page.withColumn("scan_error", error)
    lost = F.col("scan_error").isNotNull() & ~F.col("scan_error").startswith("Blocked")
    page = page.withColumns({"html": F.when(F.col("scan_error").isNull(), F.col("seen")).otherwise(""), "headers": F.when(lost, F.from_json(F.lit("{}"), "map<string,string>")).otherwise(F.col("headers")), "cookies": F.when(lost, F.array().cast("array<string>")).otherwise(F.col("cookies"))})
    return page.drop("seen", "hops_", "own_", "refused_")


def chosen_bundles(asked: DataFrame, most: int = MAX_BUNDLES) -> DataFrame:
    """(page_id, place, script, body, truncated) of the scripts of a page (page_id, ord, script, size, status, content_type, body) that are read.

    The `most` largest by the size that was announced are asked for, the first of equals; one that is no script is asked for in
    vain.
    """
    order = Window.partitionBy("page_id").orderBy(F.coalesce("size", F.lit(0)).desc(), "ord")
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    good = F.col("status").between(200, 299) & (kind.contains("javascript") | kind.contains("ecmascript") | (kind == "") | kind.contains("text/plain"))
    rows = asked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).where(good)
    return rows.select("page_id", "place", "script", F.substring("body", 1, MAX_BUNDLE).alias("body"), (F.length("body") > MAX_BUNDLE).alias("truncated"))


def largest_bundles(bundles: Column, most: int = MAX_BUNDLES) -> Column:
    """Of an array of (url, size, body) the largest, each cut at 250,000 characters."""
    order = F.array_sort(bundles, lambda a, b: F.when(a["size"] > b["size"], -1).when(a["size"] < b["size"], 1).otherwise(0))
    return F.transform(F.slice(order, 1, most), lambda b: F.substring(b["body"], 1, 250_000))
