import base64
import gzip
import json

import pytest
from pyspark.sql import functions as F

from pagelens.operators import catalogue, matching, outcomes, scoring, sites
from pagelens.sources import archives
from tests.test_detection import capture, detected


def har(tmp_path, name, entries, **more):
    def entry(url, status=200, mime="text/html", text=None, headers=(), cookies=(), encoding=None):
        return {"startedDateTime": "2026-03-01T00:00:00Z", "request": {"method": "GET", "url": url}, "response": {"status": status, "headers": [{"name": k, "value": v} for k, v in headers], "cookies": [{"name": c, "value": "x"} for c in cookies], "redirectURL": "", "content": {"mimeType": mime, "text": text, "encoding": encoding}}}

    (tmp_path / name).write_text(json.dumps({"log": {"version": "1.2", "entries": [entry(**e) for e in entries], **more}}, indent=1))


def test_har_captures_and_a_rule_on_a_network_request(spark, tmp_path):
    har(
        tmp_path, "a.har",
        [
            {"url": "http://a.com/", "status": 301}, {"url": "https://a.com/", "headers": [("Server", "cloudflare"), ("CF-Ray", "x"), ("server", "second")], "cookies": ["_ga"], "encoding": "base64", "text": base64.b64encode(b"<html>h\xc3\xa9</html>").decode()},
            {"url": "https://a.com/app.js", "mime": "application/javascript", "text": "Sentry.init({})"}, {"url": "https://cdn.b.com/x.js", "mime": "text/javascript", "text": "other"}, {"url": "https://www.googletagmanager.com/gtm.js?id=GTM-AB12", "mime": "text/javascript", "text": "fbq('init')"}, {"url": "https://collect.vendor.net/v1/beacon?k=1", "mime": "image/gif", "status": 204},
        ],
        _globals=["dataLayer"], _storage=["vendor_id"],
    )
    har(tmp_path, "b.har", [{"url": "https://b.com/", "text": "<p>https://collect.vendor.net/v1/beacon</p>"}])
    har(tmp_path, "empty.har", [])
    page = archives.read_har(spark, f"{tmp_path}/*.har")
    got = {r.final_url: r for r in page.collect()}
    a = got["https://a.com/"]
    assert set(got) == {"https://a.com/", "https://b.com/"}
    assert (a.url, a.status, a.html, a.headers["server"], a.cookies, a.redirect_chain) == ("http://a.com/", 200, "<html>hé</html>", "cloudflare", ["_ga"], ["http://a.com/", "https://a.com/"])
    assert a.bundles == ["Sentry.init({})"] and [tuple(c) for c in a.containers] == [("GTM-AB12", "fbq('init')")] and len(a.requests) == 4 and a.globals == ["dataLayer"] and a.storage_keys == ["vendor_id"]
    # A catalogue brings a type of its own and says where it looks.
    rules = spark.createDataFrame([(0, "vendor", "Vendor", "other", 0, "network-request", 0.9, "", r"collect\.vendor\.net/v\d+/beacon", "beacon", False), (1, "keeper", "Keeper", "other", 0, "storage-key", 0.8, "", "^vendor_id$", "key", False), (2, "lang", "Lang", "other", 0, "language", 0.8, "", "^https://a", "address", False)], catalogue.RULE_SCHEMA)
    hits = matching.type_hits(page, rules, {"network-request": ["network"], "storage-key": ["storage"], "language": ["address"]}, (), {"address": F.col("final_url")})
    assert {(r.page_id, r.tech_id, r.value) for r in hits.collect()} == {(a.page_id, "vendor", "collect.vendor.net/v1/beacon"), (a.page_id, "keeper", "vendor_id"), (a.page_id, "lang", "https://a")}


def test_rendered_channels_count_with_the_page(spark):
    page = capture(spark, {"requests": ["https://widget.intercom.io/widget/abc1"]}, {"globals": ["Sentry.init("]}, {"storage_keys": ["_hjSessionUser_1"]}, {})
    growth = {(r.page_id, r.tech_id) for r in matching.type_hits(page, catalogue.growth(spark), matching.GROWTH_LOOK, ()).collect()}
    assert growth == {(0, "intercom"), (2, "hotjar")}
    assert (1, "sentry") in {(r.page_id, r.tech_id) for r in matching.type_hits(page, catalogue.security(spark), matching.SECURITY_LOOK, ()).collect()}
    assert {(r.page_id, r.value) for r in sites.extracted_ids(page, catalogue.growth_ids(spark)).collect()} == {(0, "abc1")}


def warc(*records):
    out = b""
    for kind, uri, block in records:
        out += f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{uri}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2026-03-01T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return out


@pytest.mark.parametrize("name", ["a.warc", "a.warc.gz"])
def test_warc_captures(spark, tmp_path, name):
    http = lambda head, body: f"HTTP/1.1 {head}\r\n\r\n".encode() + body
    html = '<meta name="generator" content="WordPress 6.4">\r\n\r\n<p>é</p>'.encode()
    data = warc(
        ("warcinfo", "info", b"software: x"), ("request", "https://a.com/", b"GET / HTTP/1.1\r\n\r\n"), ("response", "https://a.com/", http("200 OK\r\nContent-Type: text/html\r\nSet-Cookie: one=1; Path=/\r\nset-cookie: two=2\r\nX-A: b: c", html)),
        ("response", "https://b.com/", http("404 Not Found\r\nServer: nginx", b"")), ("response", "dns:c.com", b"20260301 c.com. 1.2.3.4"), ("response", "https://d.com/", http("200 OK\r\nContent-Type: image/png", b"\x89PNG\xff\xfe")),
    )
    (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    page = archives.read_warc(spark, str(tmp_path / name))
    got = {r.url: r for r in page.collect()}
    assert set(got) == {"https://a.com/", "https://b.com/", "https://d.com/"} and len({r.page_id for r in got.values()}) == 3
    a, b = got["https://a.com/"], got["https://b.com/"]
    assert (a.status, a.content_type, a.html.encode(), a.cookies, a.headers["x-a"], a.set_cookie) == (200, "text/html", html, ["one", "two"], "b: c", "one=1; Path=/, two=2")
    assert (b.status, b.html, b.headers["server"]) == (404, "", "nginx") and got["https://d.com/"].status == 200
    found = scoring.detect(matching.core_evidence(page, catalogue.core(spark))).where("tech_id = 'wordpress'").collect()
    assert [(r.page_id, r.version) for r in found] == [(a.page_id, "6.4")]


def test_theme_objects(spark):
    cases = {
        'Shopify.theme = {"name":" Dawn ","id":12,"theme_store_id":887,"role":"main","style":{"name":"Other"}};': ("Dawn", "12", 887, "main"),
        'Shopify.theme = {"settings":{"name":"Inner","id":5},"name":"Outer","id":"abc","theme_store_id":"887"};': ("Outer", "abc", None, None),
        'Shopify.theme = {"name":{"en":"x"},"id":null};BOOMR.themeName="Sense"; BOOMR.themeId = 44': ("Sense", "44", None, None),
        "Shopify.theme = {'Name':' Sense ','id':99,'THEME_STORE_ID':1356,};": ("Sense", "99", 1356, None),
        'Shopify.theme = {"name":"Broken", id: 7, "role":"main"};': ("Broken", None, None, "main"),
        'Shopify.theme = {"name":5};': None, 'Shopify.theme.name = "Direct";': ("Direct", None, None, None),
    }
    got = spark.createDataFrame([(h,) for h in cases], "h string").select("h", sites.shop_theme(F.col("h")).alias("t")).collect()
    assert {r.h: r.t and (r.t.theme, r.t.id, r.t.store_id, r.t.role) for r in got} == cases


def test_names_in_reading_order(spark):
    names = ["Zoo", "Élan", "elan", "Elan", "eland", "zoo", "Ábc", "abd"]
    rows = [(1, i, f"t{i}", n, "cms", 5) for i, n in enumerate(names)]
    table = spark.createDataFrame(rows, "page_id long, tech_ord int, tech_id string, tech_name string, category string, score int")
    placed = [r.tech_name for r in table.withColumn("place", scoring.by_score()).orderBy("place").collect()]
    assert placed == ["Ábc", "abd", "elan", "Elan", "Élan", "eland", "zoo", "Zoo"]


def test_growth_details(spark):
    rows = {r.tech_id: r for r in catalogue.details(spark).collect()}
    assert len(rows) == 38 and all(r.website.startswith("https://") for r in rows.values())
    assert rows["paypal"].variant_note == "A plain paypal.me link is IGNORED (links are never scanned)." and sum(r.variant_note is not None for r in rows.values()) == 7 and rows["drift"].variant_note is None
    scored = spark.createDataFrame([(1, "stripe", 90), (1, "unknown", 1)], "page_id long, tech_id string, score int")
    assert {r.tech_id: r.website for r in scoring.with_details(scored, catalogue.details(spark)).collect()} == {"stripe": "https://stripe.com", "unknown": None}


def test_only_the_first_containers_count(spark):
    page = capture(spark, {"containers": [("GTM-A", "x"), ("GTM-B", "x"), ("GTM-C", "y" * 400_000 + 'fbq("init","123456")'), ("GTM-D", 'fbq("init","123456")')]}, {"containers": [("GTM-A", 'fbq("init","123456")')]})
    hits = matching.type_hits(page, catalogue.growth(spark), matching.GROWTH_LOOK, ("script-host", "sdk-init")).where("tech_id = 'meta-pixel'")
    assert [r.page_id for r in hits.collect()] == [1]


def test_pages_as_a_scan_sees_them(spark):
    wp = '<meta name="generator" content="WordPress 6">'
    rows = [
        {"html": wp}, {"html": wp, "content_type": "application/json"}, {"html": wp, "content_type": ""}, {"html": wp, "status": 404}, {"html": wp + "Just a moment", "headers": {"cf-ray": "1"}}, {"html": wp, "status": 503, "headers": {"cf-ray": "1"}}, {"html": wp, "redirect_chain": ["https://a.com/"] + [f"https://b.com/{i}" for i in range(3)]},
        {"html": wp, "redirect_chain": [f"https://b.com/{i}" for i in range(4)], "headers": {"cf-ray": "1"}}, {"html": wp, "redirect_chain": ["http://10.0.0.1/"]}, {"url": "ftp://x.com/", "html": wp}, {"html": "é" * 60_000 + wp}, {"html": None},
    ]
    page = outcomes.scan_pages(capture(spark, *rows))
    got = page.orderBy("page_id").collect()
    blocked = "Blocked: bot-protection challenge — headers and cookies only"
    assert [r.scan_error for r in got] == [None, None, None, None, blocked, blocked, None, "Too many redirects", "Redirect rejected: BLOCKED_TARGET", "Rejected: INVALID_URL", None, None]
    assert [r.page_id for r in got if r.html.startswith("<meta")] == [0, 2, 6] and len(got[10].html.encode()) == 100_000 and got[4].headers == {"cf-ray": "1"} and got[7].headers == {}
    found = {(r.page_id, r.tech_id) for r in matching.core_evidence(page, catalogue.core(spark)).collect()}
    assert {p for p, t in found if t == "wordpress"} == {0, 2, 6} and {p for p, t in found if t == "cloudflare"} == {4, 5}


def test_bundles_by_announced_size(spark):
    rows = [(1, i, f"s{i}", size, status, kind, body) for i, (size, status, kind, body) in enumerate([(5, 200, "text/javascript", "a"), (9, 200, "text/html", "b"), (None, 200, "", "c"), (7, 404, "", "d"), (6, 206, "TEXT/PLAIN; x", "e" * 250_001), (5, 200, "", "f"), (1, 200, "", "g")])]
    asked = spark.createDataFrame(rows, "page_id long, ord int, script string, size int, status int, content_type string, body string")
    got = [(r.place, r.script, len(r.body), r.truncated) for r in outcomes.chosen_bundles(asked).orderBy("place").collect()]
    assert got == [(3, "s4", 250_000, True), (4, "s0", 1, False), (5, "s5", 1, False)]


def test_evidence_and_kinds_of_a_site(spark):
    schema = "page_id long, tech_ord int, tech_id string, tech_name string, category string, sig_ord int, type string, name string, value string, artifact string, strength string, family string"
    rows = [(2, 0, "wp", "WP", "cms", 0, "html-path", "p", "two", "", "strong", "ASSET"), (1, 0, "wp", "WP", "cms", 0, "html-path", "p", "one", "", "strong", "ASSET"), (3, 0, "wp", "WP", "cms", 1, "html-path", "p", "best", "", "definitive", "ASSET"), (1, 0, "wp", "WP", "cms", 2, "header", "", "", "art", "strong", "NETWORK"), (1, 0, "wp", "WP", "cms", 3, "cookie-name", "c", "c", "", "weak", "COOKIE"), (9, 0, "wp", "WP", "cms", 0, "html-path", "p", "lost", "", "definitive", "ASSET")]
    pages = spark.createDataFrame([(1, "h", True, False), (2, "h", True, False), (3, "h", True, False), (9, "h", False, False)], "page_id long, site string, ok boolean, cross_domain boolean")
    got = [tuple(r)[2:] for r in sites.site_evidence(spark.createDataFrame(rows, schema), pages).orderBy("place").collect()]
    assert got == [(1, "html-path", "p", "best", 3, "definitive"), (2, "header", "header", "art", 1, "strong"), (3, "cookie-name", "c", "c", 1, "weak")]
    found = spark.createDataFrame([(1, 0, "wp", "WP", "cms", 90), (1, 1, "shop", "Shop", "ecommerce", 80), (2, 1, "shop", "Shop", "ecommerce", 99), (1, 2, "cf", "CF", "hosting", 70), (2, 3, "vc", "VC", "hosting", 60), (2, 2, "cf", "CF", "hosting", 50), (9, 4, "x", "X", "cms", 99)], "page_id long, tech_ord int, tech_id string, tech_name string, category string, confidence int")
    assert {r.tech_id: r.kind for r in sites.tech_kinds(found, pages).collect()} == {"wp": "framework", "shop": "other", "cf": "hosting", "vc": "hosting"}


def test_automaton_finds_what_the_join_finds(spark, monkeypatch):
    rows = [{"html": '<script src="https://js.stripe.com/v3/"></script>/wp-content/'}, {"headers": {"CF-Ray": "x"}, "cookies": ["OptanonConsent"]}, {"html": '<i class="fa-solid fa-user"></i><a href="https://www.YOUTUBE.com/embed/abcdef">'}]
    fast = detected(spark, *rows)
    monkeypatch.setattr(matching, "MAX_RULES", 3)
    assert detected(spark, *rows) == fast and {t for _, t in fast} >= {"stripe", "wordpress", "cloudflare", "onetrust", "font-awesome"}


def test_what_lies_behind_a_cap_is_not_seen(spark):
    wp, key = '<meta name="generator" content="WordPress 6">', "fbq('init','123456')"
    rows = [{"html": "é" * 249_900 + wp}, {"html": "é" * 250_000 + wp}, {"html": "é" * 250_000 + f"<script>{key}</script>"}, {"html": "/wp-content/", "probes": {"/wp-json/": "x" * 50_000 + '"namespaces"'}}, {"html": "/wp-content/", "probes": {"/wp-json/": "x" * 49_000 + '"namespaces"'}}]
    page = capture(spark, *rows)
    found = {(r.page_id, r.type) for r in matching.core_evidence(page, catalogue.core(spark)).where("tech_id = 'wordpress'").collect()}
    assert found == {(0, "meta-generator"), (3, "html-path"), (4, "html-path"), (4, "probe")}
    assert matching.type_hits(page, catalogue.growth(spark), matching.GROWTH_LOOK, ()).where("tech_id = 'meta-pixel'").count() == 0


def test_page_results_in_words(spark):
    rules = catalogue.core(spark)
    page = capture(
        spark,
        {"html": '<meta name="generator" content="WordPress 6"><a href="/wp-content/x">', "headers": {"CF-Ray": "1"}},
        {"headers": {"Server": "cloudflare"}}, {"html": "/wp-content/"}, {"html": "nothing"}, {"html": '<script src="https://js.stripe.com/v3/"></script>'},
    )
    evidence = matching.core_evidence(page, rules)
    got = {r.page_id: r for r in sites.page_results(scoring.detections(evidence), evidence).collect()}
    assert (got[0].framework, got[0].provider_id, got[0].confidence) == ("WordPress", "cloudflare", "High") and got[0].evidence.count(" | ") == 2 and got[0].evidence.startswith("meta[generator]")
    assert (got[1].framework, got[1].framework_id, got[1].provider) == ("Unknown", None, "Cloudflare") and (got[2].confidence, got[2].provider) == ("Medium", "Unknown") and 3 not in got
    assert (got[4].framework, got[4].confidence, got[4].evidence) == ("Unknown", "Low", "No distinctive fingerprint matched")


def test_catalogue_statistics_over_pages(spark):
    page = capture(spark, {"html": '<script src="https://js.stripe.com/v3/"></script>'}, {"html": '<script src="https://js.stripe.com/v3/"></script><script src="https://www.paypal.com/sdk/js?client-id=x"></script>'})
    growth = catalogue.growth(spark)
    rows = {(r.catalogue, r.category): (r.technologies, r.seen, r.pages) for r in catalogue.stats({"growth": growth, "core": catalogue.core(spark)}, {"growth": matching.type_hits(page, growth, matching.GROWTH_LOOK, ()), "core": matching.core_evidence(page.limit(0), catalogue.core(spark))}).collect()}
    assert rows["growth", "payments"] == (7, 2, 2) and rows["growth", "chat"][1:] == (0, 0) and sum(n for (c, _), (n, _, _) in rows.items() if c == "core") == 107
