"""The detection queries over whole tables.  Pages are read with the synthetic overlay of `sources.captures`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import channels as ch
from pagelens.functions import urls
from pagelens.operators import catalogue, matching, outcomes, safety, scoring, sites
from pagelens.sources.captures import capped_html as capped
from pagelens.sources.captures import overlay

Query = Callable[[SparkSession, str], DataFrame]


#: Rules that look into containers, by type.
GROWTH_CONTAINERS = ("script-host", "sdk-init")
SECURITY_CONTAINERS = ("script-host", "sdk-init", "network-host", "iframe", "runtime-global")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of fewer files than cores is spread over them; a larger one is read as it lies."""
    table, cores = pages(spark, sf_dir), spark.sparkContext.defaultParallelism
    return overlay(table.repartition(cores) if len(table.inputFiles()) < cores else table)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.core_evidence(captures(spark, sf_dir), catalogue.core(spark))


def growth_hits(spark: SparkSession, page: DataFrame) -> DataFrame:
    """With containers on the page, tag management is deployed even if nothing else matches."""
    return matching.with_default(matching.type_hits(page, catalogue.growth(spark), matching.GROWTH_LOOK, GROWTH_CONTAINERS), page, _tag(), 0.9)


def _tag() -> tuple:
    return next(r for r in catalogue.growth_rows()[0] if r[1] == "google-tag-manager")[:4]


def growth_of(spark: SparkSession, page: DataFrame, hits: DataFrame) -> DataFrame:
    return scoring.growth_scores(hits, sites.extracted_ids(page, catalogue.growth_ids(spark)))


def growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = captures(spark, sf_dir)
    return growth_of(spark, page, growth_hits(spark, page))


def security(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = captures(spark, sf_dir)
    hits = security_hits(spark, page)
    demo = page.where(F.exists(ch.every(F.col("html"), ch.SITEKEYS), lambda k: (F.length(k) < 30) & k.rlike(scoring.PLACEHOLDER))).select("page_id")
    return scoring.security_scores(hits, demo)


def url_anatomy(spark, sf_dir):
    return captures(spark, sf_dir).select("page_id", *(v.alias(k) for k, v in urls.anatomy(F.col("final_url")).items()))


#: URL spellings that exercise the validation, beside the pages' own.
SPELLINGS = ["", "   ", "http://127.0.0.1/", "http://0x7f.1.2.3/", "http://2130706433/", "http://user:pw@a.com/", "ftp://a.com/", "https://a.com:8443/", "a.com", "http://localhost/x", "https://x.internal", "http://a.com/a b", "https://metadata.goog/", "HTTP://A.Com:80/", "https://a.test./", "http://[::1]/", "http://0x7f000001/", "http://017700000001/", "http://127.1/", "http://0x7f.1/", "http://%31%32%37.0.0.1/", "http://256.1.1.1/", "http://4294967296/", "http://1.2.3.4.5/", "http://a%2Ecom/", "http://a%40b.com/", "http://a%zz.com/", "http://0x/", "http://a.0x7f/", "http://08.1/", "http://1.2.65536/", "http://a.com:99999/"]


def url_validate(spark, sf_dir):
    spellings = spark.createDataFrame([(-1 - i, s) for i, s in enumerate(SPELLINGS)], "page_id long, url string")
    rows = pages(spark, sf_dir).select("page_id", "url").union(spellings)
    return rows.select("page_id", "url", urls.validation(F.col("url")).alias("v")).select("page_id", "url", "v.code", "v.message")


def page_profile(spark, sf_dir):
    html = F.col("html")
    return captures(spark, sf_dir).select("page_id", F.octet_length(html).alias("bytes"), ch.text_length(html).alias("text_length"), ch.is_shell(html).alias("shell"), F.size(ch.every(html, ch.COMMENT)).alias("comments"), F.size(ch.inline_scripts(html)).alias("inline_scripts"), ch.meta_refresh(html).alias("refresh"))


def internal_links(spark, sf_dir):
    return captures(spark, sf_dir).select("page_id", F.posexplode(sites.internal_links(F.col("html"), F.col("url"))).alias("ord", "link"))


def diverse_sample(spark, sf_dir):
    links = pages(spark, sf_dir).select(urls.host_of(F.col("url")).alias("site"), F.col("page_id").alias("ord"), "url")
    return sites.diverse_sample(links, 10)


def sample_plan(spark, sf_dir):
    rows = pages(spark, sf_dir).select(urls.host_of(F.col("url")).alias("site"), F.col("page_id").alias("ord"), "url", "html")
    home = rows.groupBy("site").agg(F.lit(0), F.concat(F.lit("https://"), "site", F.lit("/")).alias("url")).select("site", "url")
    first = rows.groupBy("site").agg(F.min_by(F.struct("url", "html"), "ord").alias("p")).select("site", F.posexplode(sites.internal_links(F.col("p.html"), F.col("p.url"))).alias("ord", "url"))
    return sites.sample_plan(home, rows.select("site", "ord", "url"), first, home.select("site", F.lit(0).alias("ord"), F.concat("url", F.lit("extra/")).alias("url")))


def resource_refs(spark, sf_dir):
    return captures(spark, sf_dir).select("page_id", F.posexplode(ch.resource_refs(F.col("html"))).alias("ord", "r")).select("page_id", "ord", "r.tag", "r.attr", "r.src")


def security_channels(spark, sf_dir):
    html = F.col("html")
    join = lambda x: F.array_join(x, "\n")
    return captures(spark, sf_dir).select("page_id", join(ch.resource_urls(html)).alias("resources"), join(ch.iframe_srcs(html)).alias("iframes"), join(ch.inline_scripts(html)).alias("scripts"), join(F.transform(ch.meta_pairs(html), lambda x: F.concat(x["name"], F.lit("="), x["content"]))).alias("metas"), F.array_join(ch.ids_and_classes(html), " ").alias("dom"), join(ch.every(html, ch.SITEKEYS)).alias("sitekeys"), join(ch.every(html, ch.COMMENT)).alias("comments"), F.coalesce(ch.lowered_headers(F.col("headers"))["content-security-policy"], F.lit("")).alias("csp"))


def attribute_hooks(spark, sf_dir):
    return captures(spark, sf_dir).select("page_id", F.posexplode(ch.attribute_hooks(F.col("html"))).alias("ord", "hook"))


def core_evidence(spark, sf_dir):
    return evidence(spark, sf_dir).select("page_id", "tech_id", "sig_ord", "type", "name", "value", "artifact", "version", "weight", "strength", "family", "specificity", "description")


def core_confidence(spark, sf_dir):
    return scoring.detections(evidence(spark, sf_dir)).drop("tech_ord")


def core_score(spark, sf_dir):
    return scoring.scores(evidence(spark, sf_dir)).drop("tech_ord").withColumn("label", scoring.label5(F.col("score")))


def core_detect(spark, sf_dir):
    return scoring.detect(evidence(spark, sf_dir)).drop("tech_ord")


def explain_detections(spark, sf_dir):
    return scoring.explained(evidence(spark, sf_dir)).select("page_id", "tech_id", "sig_ord", "key", "adjusted", "stands", "wins")


def growth_detect(spark, sf_dir):
    return scoring.with_details(growth(spark, sf_dir), catalogue.details(spark)).drop("tech_ord")


def growth_evidence(spark, sf_dir):
    # The same hits on both sides, so Spark finds them once.
    page = captures(spark, sf_dir)
    hits = growth_hits(spark, page)
    return scoring.shown_evidence(hits, growth_of(spark, page, hits))


def growth_by_category(spark, sf_dir):
    return scoring.by_category(pages(spark, sf_dir), growth(spark, sf_dir), catalogue.GROWTH_CATEGORIES)


def growth_ids(spark, sf_dir):
    return sites.extracted_ids(captures(spark, sf_dir), catalogue.growth_ids(spark))


def growth_via_container(spark, sf_dir):
    return growth_hits(spark, captures(spark, sf_dir)).where("type = 'via-gtm'").select("page_id", "tech_id", "container", "weight")


def server_side_warning(spark, sf_dir):
    return captures(spark, sf_dir).select("page_id", ch.server_side(F.col("html"), F.col("bundles")).alias("warning"))


def security_detect(spark, sf_dir):
    return security(spark, sf_dir).drop("tech_ord")


def security_by_category(spark, sf_dir):
    return scoring.by_category(pages(spark, sf_dir), security(spark, sf_dir), catalogue.SECURITY_CATEGORIES)


def bot_challenge(spark, sf_dir):
    return captures(spark, sf_dir).select("page_id", "status", safety.is_challenge(F.col("status"), F.col("html")).alias("challenge"))


def bot_provider(spark, sf_dir):
    return sites.protection(captures(spark, sf_dir), catalogue.protection(spark))


def relevant_headers(spark, sf_dir):
    return captures(spark, sf_dir).select("page_id", F.explode(safety.relevant_headers(F.col("headers"))).alias("header", "value"))


def header_audit(spark, sf_dir):
    return captures(spark, sf_dir).select("page_id", *(v.alias(k) for k, v in safety.header_audit(F.col("headers")).items()))


def mixed_content(spark, sf_dir):
    return captures(spark, sf_dir).select("page_id", F.posexplode(safety.mixed_content(F.col("html"), F.col("url"))).alias("ord", "resource"))


def redirect_audit(spark, sf_dir):
    return captures(spark, sf_dir).select("page_id", *(v.alias(k) for k, v in safety.redirect_audit(F.col("url"), F.col("final_url"), F.col("redirect_chain")).items()))


def safety_findings(spark, sf_dir):
    return safety.findings(captures(spark, sf_dir)).drop("at")


def safety_score(spark, sf_dir):
    return safety.verdicts(safety.findings(captures(spark, sf_dir)))


def wp_plugins(spark, sf_dir):
    return captures(spark, sf_dir).select("page_id", F.posexplode(sites.plugins(F.col("html"))).alias("ord", "plugin"))


def wp_theme(spark, sf_dir):
    return captures(spark, sf_dir).select("page_id", sites.wp_theme(F.col("html"), F.col("style_css")).alias("t")).where("t is not null").select("page_id", "t.*")


def shop_theme(spark, sf_dir):
    return captures(spark, sf_dir).select("page_id", sites.shop_theme(F.col("html")).alias("t")).where("t is not null").select("page_id", "t.*")


def cname_hint(spark, sf_dir):
    return sites.cname_hints(captures(spark, sf_dir), scoring.detections(evidence(spark, sf_dir)))


def container_ids(spark, sf_dir):
    return captures(spark, sf_dir).select("page_id", F.posexplode(ch.container_ids(F.array_join(F.concat(F.array("html"), "bundles"), "\n"))).alias("ord", "id"))


def loader_ids(spark, sf_dir):
    ids = ch.loader_ids(F.array_join(F.concat(F.array("html"), "bundles"), "\n"))
    kind = F.when(F.col("id").startswith("G-"), "ga4").when(F.col("id").startswith("AW-"), "ads").when(F.col("id").startswith("GT-"), "generic").otherwise("legacy")
    return captures(spark, sf_dir).select("page_id", F.posexplode(ids).alias("ord", "id")).select("page_id", kind.alias("kind"), "ord", "id")


def container_sanitize(spark, sf_dir):
    return captures(spark, sf_dir).select("page_id", F.explode("containers").alias("c")).select("page_id", "c.id", ch.sanitised(F.col("c.js")).alias("js"))


def cookie_names(spark, sf_dir):
    return captures(spark, sf_dir).where("set_cookie is not null").select("page_id", F.posexplode(ch.cookie_names(F.col("set_cookie"))).alias("ord", "cookie"))


def framework_data(spark, sf_dir):
    return captures(spark, sf_dir).select("page_id", F.explode(ch.framework_data(F.col("html"))).alias("framework", "data"))


def robots_filter(spark, sf_dir):
    return sites.robots_allowed(captures(spark, sf_dir))


def scan_view(spark, sf_dir):
    return outcomes.scan_pages(captures(spark, sf_dir))


def evidence_of(spark, view):
    """Evidence of pages as the scan of a site sees them, without analytics."""
    return matching.core_evidence(view, catalogue.core(spark)).where("category <> 'analytics'")


def scan_pages(spark, sf_dir):
    return scan_view(spark, sf_dir).select("page_id", "scan_error", F.octet_length("html").alias("bytes"), F.size("headers").alias("headers"))


def _site_pages(page):
    """(page_id, site, ok, cross_domain); pages that robots rules skip are no scanned pages."""
    hops = safety.redirect_audit(F.col("url"), F.col("final_url"), F.col("redirect_chain"))
    good = F.col("scan_error").isNull() & sites.is_allowed(F.col("url"), F.col("robots"))
    return page.select("page_id", urls.host_of(F.col("url")).alias("site"), good.alias("ok"), hops["cross_domain"].alias("cross_domain"))


def site_tech_rollup(spark, sf_dir):
    view = scan_view(spark, sf_dir)
    return sites.site_rollup(evidence_of(spark, view), _site_pages(view))


def site_tech_evidence(spark, sf_dir):
    view = scan_view(spark, sf_dir)
    return sites.site_evidence(evidence_of(spark, view), _site_pages(view))


def site_tech_kinds(spark, sf_dir):
    view = scan_view(spark, sf_dir)
    return sites.tech_kinds(scoring.detections(evidence_of(spark, view)), _site_pages(view))


def chosen_bundles(spark, sf_dir):
    """The scripts of pages that are read, with sizes and answers made from their addresses (synthetic)."""
    asked = script_candidates(spark, sf_dir).withColumn("n", F.length("script"))
    made = asked.select("page_id", "ord", "script", (F.col("n") * 37 % 11).alias("size"), F.when(F.col("n") % 5 == 0, 404).otherwise(200).alias("status"), F.when(F.col("n") % 3 == 0, "text/html").when(F.col("n") % 3 == 1, "").otherwise("text/javascript").alias("content_type"), F.concat(F.lit("// "), "script").alias("body"))
    return outcomes.chosen_bundles(made, 2)


def site_consistency(spark, sf_dir):
    view = scan_view(spark, sf_dir)
    return sites.consistency(sites.page_platforms(scoring.detections(evidence_of(spark, view)), _site_pages(view)))


def coverage_penalty(spark, sf_dir):
    site = pages(spark, sf_dir).select("page_id", urls.host_of(F.col("url")).alias("site"))
    found = scoring.scores(evidence(spark, sf_dir)).join(site, "page_id")
    checked = site.groupBy("site").agg(F.count("*").alias("checked"))
    rows = found.groupBy("site", "tech_id").agg(F.max("score").alias("score"), F.count_distinct("page_id").alias("detected_on")).join(checked, "site")
    return rows.withColumn("adjusted", scoring.for_coverage(F.col("score"), F.col("detected_on"), F.col("checked")))


def rate_limit(spark, sf_dir):
    hits = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("key"), F.col("ts").alias("at"))
    return sites.rate_limited(hits, 2, 3600).select("event_id", "key", "recent", "limited")


def security_hits(spark, page):
    return matching.type_hits(page, catalogue.security(spark), matching.SECURITY_LOOK, SECURITY_CONTAINERS)


def catalogue_stats(spark, sf_dir):
    """Technologies and rules of each catalogue and category, how many of them the pages show and on how many pages."""
    page = captures(spark, sf_dir)
    rules = {"core": catalogue.core(spark), "growth": catalogue.growth(spark), "security": catalogue.security(spark)}
    found = matching.catalogue_hits(page, {"growth": (rules["growth"], matching.GROWTH_LOOK, GROWTH_CONTAINERS), "security": (rules["security"], matching.SECURITY_LOOK, SECURITY_CONTAINERS)})
    return catalogue.stats(rules, {"core": evidence(spark, sf_dir), "others": matching.with_default(found, page, _tag(), 0.9, catalogue="growth")})


def family_floor(spark, sf_dir):
    """The evidence that is left if every technology has to show two families of signals."""
    rules = catalogue.core(spark).withColumn("min_families", F.lit(2))
    return matching.core_evidence(captures(spark, sf_dir), rules).select("page_id", "tech_id", "sig_ord", "family")


def scan_results(spark, sf_dir):
    """What a scan shows of each page."""
    return sites.page_results(scoring.detections(evidence_of(spark, scan_view(spark, sf_dir)), artifacts=2))


def error_codes(spark, sf_dir):
    codes = spark.createDataFrame(catalogue.ERRORS, "code string, http_status int, retryable boolean")
    rows = url_validate(spark, sf_dir).where("code <> 'ok'").groupBy("code").agg(F.count("*").alias("n"))
    return codes.join(rows, "code", "left").select("code", "http_status", "retryable", F.coalesce("n", F.lit(0)).alias("n"))


def cache_keys(spark, sf_dir):
    """One page for each cache key: the first."""
    key = urls.cache_key(F.col("final_url"), with_query=False)
    return captures(spark, sf_dir).groupBy(key.alias("cache_key")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


def cache_keys_with_query(spark, sf_dir):
    """The same for analyses that look at the query too; only complete captures are kept."""
    page = captures(spark, sf_dir)
    good = page.join(outcomes.outcome(page).where("ok and not truncated").select("page_id"), "page_id", "left_semi")
    return good.groupBy(urls.cache_key(F.col("final_url"), with_query=True).alias("cache_key")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


def capture_outcome(spark, sf_dir):
    return outcomes.outcome(captures(spark, sf_dir))


def script_candidates(spark, sf_dir):
    page = captures(spark, sf_dir)
    return page.select("page_id", F.posexplode(outcomes.script_candidates(F.col("html"), F.col("url"))).alias("ord", "script"))


def missing_containers(spark, sf_dir):
    return outcomes.missing_containers(captures(spark, sf_dir))


def capped_html(spark, sf_dir):
    """A byte cap small enough to cut some of the pages."""
    return capped(captures(spark, sf_dir), 4000).select("page_id", "truncated", F.octet_length("html").alias("bytes"), F.md5("html").alias("digest"))


def scan_log(spark, sf_dir):
    """The log of a scan that took page_id % 200 milliseconds (synthetic)."""
    page = captures(spark, sf_dir)
    took = (F.col("page_id") % 200).cast("double")
    scans = page.join(outcomes.outcome(page), "page_id").select("url", F.coalesce("error_code", F.lit("ok")).alias("outcome"), took.alias("duration_ms"), (took * 0.08).alias("cpu_ms"), (F.size("redirect_chain") + 1).alias("subrequests"), "truncated")
    return outcomes.scan_log(scans)


def sitemap_locs(spark, sf_dir):
    """The locations of a sitemap made of each page's address (synthetic)."""
    xml = F.concat(F.lit("<urlset><url><loc> "), "url", F.lit(" </loc></url><loc>https://a.example.com/Sitemap-2.xml</loc><LOC>"), "url", F.lit("?p=2</LOC></urlset>"))
    return pages(spark, sf_dir).select("page_id", F.posexplode(sites.sitemap_locs(xml)).alias("ord", "loc"))


def domains(spark, sf_dir):
    """The domain of each address, and of spellings that people type."""
    typed = spark.createDataFrame([(-1 - i, s) for i, s in enumerate(TYPED)], "page_id long, url string")
    return pages(spark, sf_dir).select("page_id", "url").union(typed).select("page_id", urls.domain_of(F.col("url")).alias("domain"))


#: Domains as people type them.
TYPED = ["WWW.Example.com/path?x", "https://sub.a-b.co.uk:8080", "..dots.org..", "no domain", "localhost", "http://-bad.com", "ftp://files.example.net/#top", "a.b"]


def all_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        url_anatomy, url_validate, page_profile, internal_links, diverse_sample, sample_plan, resource_refs, security_channels, attribute_hooks, core_evidence, core_confidence, core_score, core_detect, explain_detections, growth_detect, growth_evidence, growth_by_category, growth_ids, growth_via_container,
        server_side_warning, security_detect, security_by_category, bot_challenge, bot_provider, relevant_headers, header_audit, mixed_content, redirect_audit, safety_findings, safety_score, wp_plugins, wp_theme, shop_theme, cname_hint, container_ids, loader_ids, container_sanitize, cookie_names,
        framework_data, robots_filter, scan_pages, site_tech_rollup, site_tech_evidence, site_tech_kinds, scan_results, family_floor, chosen_bundles, site_consistency, coverage_penalty, rate_limit, catalogue_stats, error_codes, cache_keys, cache_keys_with_query, capture_outcome, script_candidates, missing_containers, capped_html, scan_log, sitemap_locs, domains,
    )}
