"""How much of the pages detection looks at, and that what it leaves out could not have matched."""

import pytest
from pyspark.sql import functions as F

from pagelens.functions import channels as ch
from pagelens.operators import catalogue, matching, safety, sites
from pagelens.plans import queries
from tests.test_detection import capture

ODD = [
    {"html": 'İİ <p class="a">x</p><i class="fa-solid fa-user"></i> Shopify.theme'},
    {"html": "😀 é " * 50 + "<script>fbq('init', '123456789')</script>/wp-content/"},
    {"html": '<p class="b">no icon</p><div data-sitekey="test" class="g-recaptcha"></div>', "headers": {"Server": "cloudflare", "CF-Ray": "1"}, "cookies": ["__cf_bm"]},
    {"html": "shopify /wp-includes/ SHOPIFY.THEME <pre>cdn.shopify.com</pre>```x```", "probes": {"/wp-json/": '{"namespaces":[]}'}},
]


@pytest.mark.parametrize("query", ["scan_results", "site_tech_rollup"])
def test_a_scan_detects_once(spark, query):
    frame = queries.all_queries()[query](spark, "/root/testdata/sf0.001")
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_rules_meet_texts_that_hold_all_they_need(spark):
    rules = catalogue.core(spark).where("tech_id in ('font-awesome', 'shopify') and channel = 'usage'")
    text = spark.createDataFrame([(0, "usage", '<p class="a">'), (1, "usage", '<p class="fa-solid">'), (2, "usage", "ab Shopify.theme cdn.shopify.com"), (3, "usage", "İ Shopify.theme")], "page_id int, channel string, value string")
    met = matching.rules_for(text, rules, "value").select("page_id", "r.tech_id", "rest").distinct().collect()
    assert {(r.page_id, r.tech_id, r.rest) for r in met} == {(1, "font-awesome", 'class="fa-solid">'), (2, "shopify", "Shopify.theme cdn.shopify.com"), (3, "shopify", "İ Shopify.theme")}


def test_what_is_left_out_could_not_match(spark, monkeypatch):
    page, rules = capture(spark, *ODD), catalogue.core(spark)
    columns = ["page_id", "tech_id", "sig_ord", "name", "artifact", "version", "strength"]
    quick = sorted(map(tuple, matching.core_evidence(page, rules).select(*columns).collect()), key=str)
    monkeypatch.setattr(matching, "MAX_RULES", 0)
    assert quick == sorted(map(tuple, matching.core_evidence(page, rules).select(*columns).collect()), key=str) and len(quick) > 5


def test_requirements_of_patterns():
    assert catalogue.requirements(r"class=[^>]*fa-x|data\.b") == [("class=", frozenset({"class=", "fa-x"}), "class="), ("data.b", frozenset({"data.b"}), "data.b")]
    assert catalogue.requirements(r"(www\.)?abc/def") == [("abc/def", frozenset({"abc/def"}), "")] and catalogue.requirements(r"(?<=x)abcd") == [("abcd", frozenset({"abcd"}), "")]
    # Characters by number are no fixed text, and a bracket that is escaped or in a class ends no group.
    assert catalogue.needles(r"\x41bcdef") == [] and catalogue.requirements(r"(x|a\)bcd)efg") == [("efg", frozenset({"efg"}), "")] and catalogue.needles("([)]|abc)def") == ["def"]


def test_texts_are_cleared_only_of_whole_boxes(spark):
    rows = ["a<PRE>x</pre>b", "a```x```b```c", '<script type="application/<pre>x</pre>ld+json">x</script>y', '<div class="x prettyprint">x</div>z', "plain", None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, html string").orderBy("i").select(ch.usage_html(F.col("html"))).collect()]
    assert got == ["ab", "ab```c", "y", "z", "plain", None]


def test_a_roll_up_looks_at_its_pages_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = queries.site_tech_rollup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("ReusedExchange") == 1


def test_pages_without_an_id_count_for_their_site(spark):
    rows = [(1, "a", True), (1, "a", True), (None, "a", True), (None, "a", False), (2, "b", False), (None, None, True), (3, None, True), (4, "c", True)]
    pages = spark.createDataFrame(rows, "page_id long, site string, ok boolean")
    kinds = "page_id long, tech_id string, tech_name string, category string, type string, name string, strength string, family string"
    found = spark.createDataFrame([(i, "t", "T", "cms", "header", "x", "strong", "NETWORK") for i in (1, 2, 3, None)], kinds)
    got = sites.site_rollup(found, pages).select("site", "detected_on", "checked").collect()
    assert [tuple(r) for r in got] == [("a", 1, 3)]


def test_challenge_words_are_found_as_by_their_alternatives(spark):
    words = [w.replace("\\", "") for w in safety.CHALLENGE.removeprefix("(?i)").split("|")]
    texts = [*words, *(f"caé {w.title()}s" for w in words), *(w[:-1] for w in words), *(w[1:] for w in words), "", "ca cap secs DDoS", "cHaLLenge", "a\ncaptcha", "shapexsh", "\u212aasada", None]
    frame = spark.createDataFrame([(200, t) for t in texts], "status int, html string")
    both = frame.select(safety.is_challenge(F.col("status"), F.col("html")).alias("a"), (F.col("html").rlike(safety.CHALLENGE) | (F.col("status") == 403)).alias("b")).collect()
    assert all(r.a == r.b for r in both) and sum(bool(r.a) for r in both) == 2 * len(words) + 2
    assert safety.CHALLENGE_WORDS != safety.CHALLENGE


def test_statistics_look_at_pages_once_for_core_and_once_for_the_others(spark):
    frame = queries.catalogue_stats(spark, "/root/testdata/sf0.001")
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2


def test_catalogues_together_hit_what_each_hits(spark):
    page = capture(spark, *ODD, {"html": '<script src="https://www.googletagmanager.com/gtm.js?id=GTM-A1"></script>', "containers": [("GTM-A1", 'fbq("init","1"); js.stripe.com/v3/ Sentry.init(')]}, {"html": "x", "containers": [("GTM-B2", "klaviyo")]})
    given = {"growth": (catalogue.growth(spark), matching.GROWTH_LOOK, queries.GROWTH_CONTAINERS), "security": (catalogue.security(spark), matching.SECURITY_LOOK, queries.SECURITY_CONTAINERS)}
    both = matching.with_default(matching.catalogue_hits(page, given), page, queries._tag(), 0.9, catalogue="growth")
    apart = {"growth": queries.growth_hits(spark, page), "security": queries.security_hits(spark, page)}
    for name, hits in apart.items():
        expected = sorted(map(tuple, hits.collect()), key=str)
        assert expected == sorted(map(tuple, both.where(f"catalogue = '{name}'").select(*hits.columns).collect()), key=str) and len(expected) >= 3
    pages = catalogue.stats({n: g[0] for n, g in given.items()}, {"both": both})
    assert sorted(pages.collect()) == sorted(catalogue.stats({n: g[0] for n, g in given.items()}, apart).collect())
