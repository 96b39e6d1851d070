import json
import re
from importlib import resources

import pytest
from pyspark.sql import functions as F

from pagelens.functions import channels as ch
from pagelens.functions import urls
from pagelens.operators import catalogue, matching, outcomes, safety, scoring, sites
from pagelens.sources import captures as source


def capture(spark, *rows):
    """Captures from dicts."""
    names = list(source.COLUMNS)
    base = {"url": "https://a.com/", "final_url": "https://a.com/", "status": 200, "content_type": "text/html", "html": "", "headers": {}, "cookies": [], "redirect_chain": [], "containers": [], "bundles": [], "probes": {}}
    schema = ", ".join(f"{n} {k}" for n, k in source.COLUMNS.items())
    return spark.createDataFrame([tuple(({"page_id": i} | base | r).get(n) for n in names) for i, r in enumerate(rows)], schema)


def growth(spark, page):
    hits = matching.with_default(matching.type_hits(page, catalogue.growth(spark), matching.GROWTH_LOOK, ("script-host", "sdk-init")), page, (1, "google-tag-manager", "Google Tag Manager", "analytics"), 0.9)
    return scoring.growth_scores(hits, sites.extracted_ids(page, catalogue.growth_ids(spark)))


def detected(spark, *rows, rules=None):
    return {(r.page_id, r.tech_id): r for r in scoring.detect(matching.core_evidence(capture(spark, *rows), rules or catalogue.core(spark))).collect()}


def test_positive_negative_and_near_miss(spark):
    got = detected(
        spark,
        {"html": '<meta name="generator" content="WordPress 6.4"><script src="/wp-content/a.js"></script>'},
        {"html": "<p>WordPress and cdn.shopify are mentioned</p><pre>/wp-content/ Shopify.theme</pre>```\n/_astro/\n```"},
        {"html": "", "headers": {"CF-Ray": "abc", "X-Vercel-Id": " "}},
    )
    assert set(got) == {(0, "wordpress"), (2, "cloudflare")}
    assert (got[0, "wordpress"].version, got[0, "wordpress"].score, got[0, "wordpress"].confidence) == ("6.4", 100, 99)
    assert got[2, "cloudflare"].score == 95


def test_repeated_evidence_does_not_raise_a_score(spark):
    one = '<script src="https://js.stripe.com/v3/"></script>'
    got = detected(spark, {"html": one}, {"html": one * 20})
    assert got[0, "stripe"].score == got[1, "stripe"].score and got[0, "stripe"].confidence == got[1, "stripe"].confidence


def test_probe_counts_only_with_other_evidence_and_veto_removes(spark):
    key = '<script src="https://www.google.com/recaptcha/api.js"></script><div data-sitekey="{}"></div>'
    got = detected(spark, {"probes": {"/wp-json/": '"namespaces"'}}, {"html": "/wp-content/", "probes": {"/wp-json/": '"namespaces"'}}, {"html": key.format("YOUR_SITE_KEY")}, {"html": key.format("6Lc" + "a" * 37)})
    assert set(got) == {(1, "wordpress"), (3, "recaptcha")} and got[1, "wordpress"].families == 2


def test_contest_and_exclusion(spark):
    html = '<meta name="generator" content="Drupal 10"><script>var a = Shopify.theme</script>'
    got = detected(spark, {"html": html})
    assert got[0, "shopify"].lost_to == "drupal" and got[0, "shopify"].score == 60 - 29 and got[0, "drupal"].lost_to is None
    rules = catalogue.core(spark).withColumn("excludes", F.when(F.col("tech_id") == "drupal", "shopify").otherwise(F.col("excludes")))
    assert set(detected(spark, {"html": html}, rules=rules)) == {(0, "drupal")}


def test_score_model(spark):
    rows = [(0, "a", "x", "header", 95, "definitive", "NETWORK", 1.0), (1, "b", "y", "cookie-name", 70, "weak", "COOKIE", 0.3), (2, "b", "y", "html-regex", 30, "weak", "HTML", 0.3)]
    evidence = spark.createDataFrame([(1, t, n, n, "cms", "", o, k, f"n{o}", f"v{o}", "", None, w, s, f, sp, "") for o, n, t, k, w, s, f, sp in [(o, n, ord(n), k, w, s, f, sp) for o, n, _, k, w, s, f, sp in rows]], "page_id long, tech_ord int, tech_id string, tech_name string, category string, excludes string, sig_ord int, type string, name string, value string, artifact string, version string, weight int, strength string, family string, specificity double, description string")
    got = {r.tech_id: (r.score, r.families) for r in scoring.scores(evidence).collect()}
    combined = 1 - (1 - 0.21) * (1 - 0.09)
    assert got == {"a": (95, 1), "b": (int(combined * 100 + 4 + 0.5), 2)}


@pytest.mark.parametrize(("score", "on", "checked", "want"), [(80, 3, 3, 80), (80, 1, 3, 39), (80, 2, 3, 69), (30, 1, 4, 30), (80, 0, 0, 80)])
def test_coverage(spark, score, on, checked, want):
    assert spark.range(1).select(scoring.for_coverage(F.lit(score), F.lit(on), F.lit(checked)).alias("x")).first().x == want


def test_growth_caps_and_half_points(spark):
    page = capture(
        spark,
        {"html": "<script src='https://www.googletagmanager.com/gtag/js?id=G-ABCDE1'></script><script>gtag('config', 'G-ABCDE1')</script>"},
        {"html": "<script src='https://js.stripe.com/v3/'></script>", "cookies": ["__stripe_mid"]},
        {"html": "<!-- widget.intercom.io/widget/abc -->"},
        {"containers": [("GTM-AB12", 'fbq("init","123456789")'), ("GTM-CD34", 'fbq("init","1")')]},
    )
    scored = {(r.page_id, r.tech_id): r for r in growth(spark, page).collect()}
    assert scored[0, "google-analytics"].score == 99 and scored[1, "stripe"].score == 96  # 98.5 and 95.5 round up
    assert scored[2, "intercom"].score == 59 and scored[3, "meta-pixel"].score == 70
    ids = {(r.page_id, r.kind, r.value) for r in sites.extracted_ids(page, catalogue.growth_ids(spark)).collect()}
    assert (0, "GA4 measurement ID", "G-ABCDE1") in ids and (3, "GTM container ID", "GTM-AB12") in ids


def test_growth_notes_launch_cap_and_order(spark):
    page = capture(
        spark,
        {"html": "<script src='https://assets.adobedtm.com/x/launch.min.js'></script><script>_satellite.track('x')</script>"},
        {"html": "<script src='https://pi.pardot.com/pd.js'></script><script src='https://cdn.evgnet.com/beacon.js'></script>"},
        {"html": "<script>ga('create', 'UA-12345-6')</script><script src='https://js.stripe.com/v3/'></script>", "cookies": ["__stripe_mid"]},
        {"containers": [("GTM-AB12", "x"), ("GTM-CD34", "y")]},
    )
    got = {(r.page_id, r.tech_id): r for r in growth(spark, page).collect()}
    assert (got[0, "adobe-analytics"].score, got[0, "adobe-analytics"].band) == (59, "low")  # a tag manager alone
    note = got[1, "salesforce"].note
    assert note.startswith("Matched products: ") and note.endswith(".") and "," in note
    assert got[2, "google-analytics"].note == "Universal Analytics (legacy) UA-12345-6; GA4 (G-…) not seen."
    assert [got[2, t].place for t in ("stripe", "google-analytics")] == [1, 2] and got[2, "stripe"].note is None
    assert got[3, "google-tag-manager"].score == 90
    hits = matching.with_default(matching.type_hits(page, catalogue.growth(spark), matching.GROWTH_LOOK, ("script-host", "sdk-init")), page, (1, "google-tag-manager", "Google Tag Manager", "analytics"), 0.9)
    shown = {(r.page_id, r.tech_id, r.place): r for r in scoring.shown_evidence(hits, growth(spark, page)).collect()}
    tag = shown[3, "google-tag-manager", 1]
    assert (tag.detail, tag.value, tag.family) == ("Google Tag Manager container (GTM-AB12, GTM-CD34) deployed", "GTM-AB12", "SCRIPT")
    assert shown[2, "google-analytics", 1].value == "ga('create'" and shown[2, "google-analytics", 1].detail == "Google Analytics init call with tracking ID"


def test_containers_stay_visible_beside_the_winner(spark):
    page = capture(spark, {"containers": [("GTM-AB12", 'fbq("init","123456789")'), ("GTM-CD34", 'fbq("init","1")')]})
    hits = matching.type_hits(page, catalogue.growth(spark), matching.GROWTH_LOOK, ("script-host", "sdk-init"))
    rows = scoring.shown_evidence(hits, growth(spark, page)).where("tech_id = 'meta-pixel'").orderBy("place").collect()
    assert [(r.type, r.detail, r.value) for r in rows] == [("via-gtm", f"Found in GTM container {c}: Meta Pixel init (fbq('init', …))", 'fbq("init"') for c in ("GTM-AB12", "GTM-CD34")]


def test_themes(spark):
    css = "/*\nTheme Name: My Theme\nAuthor: Me\nAuthor URI: https://me.com/x\nTheme URI: https://t.com\nVersion: 2.1\nTemplate: divi\n*/"
    rows = [("/wp-content/themes/kadence-child/a.css", None), ("/wp-content/themes/my_own-look/a.css", "x" * 15_000 + "\nVersion: 9"), ("/wp-content/themes/divi/a /wp-content/themes/mine-child/b", css)]
    got = [r.t for r in spark.createDataFrame(rows, "h string, c string").select(sites.wp_theme(F.col("h"), F.col("c")).alias("t")).collect()]
    assert (got[0].theme, got[0].author, got[0].theme_uri, got[0].known, got[0].child) == ("Kadence Child", "Kadence WP", "https://wordpress.org/themes/kadence/", True, True)
    assert (got[1].theme, got[1].version, got[1].known) == ("My Own Look", None, False)
    assert (got[2].theme, got[2].author, got[2].author_uri, got[2].theme_uri, got[2].version, got[2].parent, got[2].slug) == ("My Theme", "Me", "https://me.com/x", "https://t.com", "2.1", "Divi", "mine-child")
    rows = [('Shopify.theme = {"name":"Dawn 12.0","id":1,"theme_store_id":887,"role":"main"};',), ('Shopify.theme = {"theme_store_id":849};',), ('BOOMR.themeName = "Prestige (v7)"; BOOMR.themeVersion = "7.1";',), ('Shopify.theme = {"name":"Homemade"};',), ("none",)]
    got = [r.t for r in spark.createDataFrame(rows, "h string").select(sites.shop_theme(F.col("h")).alias("t")).collect()]
    assert (got[0].theme, got[0].store_name, got[0].store_url, got[0].known, got[0].role) == ("Dawn 12.0", "Dawn", "https://themes.shopify.com/themes/dawn", True, "main")
    assert (got[1].theme, got[1].known) == ("Prestige", True) and (got[2].version, got[3].known, got[3].store_url) == ("7.1", False, None) and got[4] is None


def test_server_side_marks(spark):
    rows = [{"html": "a /CDN-CGI/zaraz/s.js"}, {"bundles": ["x", "zaraz.track('y')"]}, {"html": "https://sgtm.example.com"}, {"bundles": ["fetch('/g/collect?v=2')"]}, {"html": "x" * 200_000 + "sgtm."}, {"html": "server-side tagging, transport_url"}, {}]
    got = capture(spark, *rows).select("page_id", ch.server_side(F.col("html"), F.col("bundles")).alias("w")).orderBy("page_id").collect()
    assert [r.w for r in got] == [True, True, True, True, False, False, False]


@pytest.mark.parametrize("kind", ["growth", "security"])
def test_every_technology_has_a_positive_and_a_near_miss(spark, kind):
    """A page that holds one rule's own text in its channel is detected; the same text as prose is not."""
    rules = catalogue.growth_rows()[0] if kind == "growth" else catalogue.security_rows()
    look, table = (matching.GROWTH_LOOK, catalogue.growth(spark)) if kind == "growth" else (matching.SECURITY_LOOK, catalogue.security(spark))
    wrap = {"script-host": "<script src='https://{}'></script>", "network-host": "<img src='https://{}'>", "iframe": "<iframe src='https://{}'></iframe>", "sdk-init": "<script>{}</script>", "runtime-global": "<script>{}</script>", "dom": '<div id="{}"></div>'}
    pages, names = [], []
    for tech in sorted({r[1] for r in rules}):
        own = [r for r in rules if r[1] == tech and r[5] in wrap and r[6] >= 0.6]
        text = next((x for r in own for x in [sample_of(r[8])] if x and not ("'" in x and r[5] in ("script-host", "iframe", "network-host")) and not ('"' in x and r[5] == "dom") for r in [r]), None)
        rule = next(r for r in own if sample_of(r[8]) == text)
        pages += [{"html": wrap[rule[5]].format(text)}, {"html": f"<p>We write about {text} here.</p>"}]
        names.append(tech)
    hits = matching.type_hits(capture(spark, *pages), table, look, ()).select("page_id", "tech_id").distinct().collect()
    found = {(r.page_id, r.tech_id) for r in hits}
    assert [n for i, n in enumerate(names) if (2 * i, n) not in found] == []
    assert [n for i, n in enumerate(names) if (2 * i + 1, n) in found] == []


def test_every_core_technology_has_a_positive_and_a_near_miss(spark):
    wrap = {"meta-generator": '<meta name="generator" content="{}">', "html-path": "<a href='{}'>x</a>", "html-regex": "<b {}>x</b>", "script-host": "<script src='https://{}'></script>"}
    pages, names = [], []
    for tech in sorted({r[1] for r in catalogue.core_rows()}):
        own = [r for r in catalogue.core_rows() if r[1] == tech and r[7] != "probe"]
        for r in own:
            text = sample_of(r[12])
            if r[7] == "header":
                page, miss = {"headers": {r[8].title(): text or "x"}}, {"headers": {"X-Other": text or "x"}}
            elif r[7] == "cookie-name":
                page, miss = {"cookies": [text]}, {"html": f"<p>{text}</p>"}
            elif r[7] in wrap:
                page, miss = {"html": wrap[r[7]].format(text)}, {"html": f"<pre>{wrap[r[7]].format(text)}</pre>" if r[7].startswith("html") else f"<p>{text}</p>"}
            else:
                continue
            if text or r[7] == "header":
                pages += [page, miss]
                names.append((tech, r[6]))
    rows = matching.core_evidence(capture(spark, *pages), catalogue.core(spark)).select("page_id", "tech_id", "sig_ord").collect()
    found = {tuple(r) for r in rows}
    missed = [n for i, n in enumerate(names) if (2 * i, *n) not in found]
    assert missed == [] and len({t for t, _ in names}) == 107
    assert [n for i, n in enumerate(names) if (2 * i + 1, *n) in found] == []


def sample_of(pattern):
    """A text that a pattern matches, or None: its first alternatives, fewest repetitions."""
    parse = re._parser.parse
    try:
        tree = parse(pattern)
    except re.error:
        return None

    def text(items):
        out = ""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "NOT_LITERAL" or name == "ANY":
                out += "x"
            elif name == "IN":
                kind, value = next(x for x in arg if str(x[0]) != "NEGATE") if str(arg[0][0]) != "NEGATE" else ("LITERAL", ord("x"))
                out += chr(value) if str(kind) == "LITERAL" else chr(value[0]) if str(kind) == "RANGE" else {"CATEGORY_DIGIT": "1", "CATEGORY_WORD": "a", "CATEGORY_SPACE": " "}.get(str(value), "a")
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                out += text(arg[2]) * arg[0]
            elif name == "SUBPATTERN":
                out += text(arg[3])
            elif name == "BRANCH":
                out += text(arg[1][0])
        return out

    sample = text(tree)
    return sample if re.search(pattern, sample, re.I) else None


def test_outcomes_by_host(spark):
    rows = [("https://A.com/x?y", "ok", 10.0, 7.9, 3, False), ("https://a.com/z", "ok", 5.0, 8.0, 1, True), ("https://b.com/", "TIMEOUT", 1.0, 0.0, 1, False)]
    got = outcomes.scan_log(spark.createDataFrame(rows, "url string, outcome string, duration_ms double, cpu_ms double, subrequests long, truncated boolean")).orderBy("host").collect()
    assert [tuple(r) for r in got] == [("a.com", "ok", 2, 15.0, 4, 1, 1), ("b.com", "TIMEOUT", 1, 1.0, 1, 0, 0)]
    page = capture(spark, {"html": "GTM-AAA1 GTM-BBB2", "bundles": ["GTM-CCC3 GTM-DDD4"], "containers": [("GTM-BBB2", "x")]})
    assert [(r.id, r.fetched) for r in outcomes.missing_containers(page).orderBy("ord").collect()] == [("GTM-AAA1", False), ("GTM-BBB2", True), ("GTM-CCC3", False)]


def test_security_prefers_real_iframes_over_links(spark):
    page = capture(spark, {"html": '<iframe src="https://www.youtube.com/embed/abcdef"></iframe>'}, {"html": '<a href="https://www.youtube.com/embed/abcdef">x</a>'}, {"headers": {"content-security-policy": "x cdn.cookielaw.org"}})
    hits = matching.type_hits(page, catalogue.security(spark), matching.SECURITY_LOOK, ())
    got = {(r.page_id, r.tech_id): (r.score, r.label) for r in scoring.security_scores(hits, page.select("page_id").limit(0)).collect()}
    assert got == {(0, "youtube"): (0.9, "high"), (2, "onetrust"): (0.59, "low")}


def test_catalogue_lint_json_and_needles(spark, tmp_path):
    assert catalogue.lint(catalogue.core(spark)).count() == 0
    one = [{"id": "t", "name": "T", "category": "cms", "signals": [{"type": "html-regex", "pattern": "tee-[0-9]+", "weight": 80, "strength": "strong"}, {"type": "header", "name": "X-T", "pattern": ".*", "weight": 120}], "probes": [{"path": "/p", "successSignal": "ok", "weight": 90}], "excludes": ["u", "v"]}]
    (tmp_path / "a.json").write_text(json.dumps(one))
    rules = catalogue.read_catalogue(spark, str(tmp_path / "a.json"))
    got = rules.orderBy("sig_ord").collect()
    assert [(r.type, r.header, r.strength, r.excludes, r.family) for r in got] == [("html-regex", "", "strong", "u,v", "HTML"), ("header", "x-t", "weak", "u,v", "NETWORK"), ("probe", "/p", "strong", "u,v", "PLATFORM_IDENTIFIER")]
    assert [r.problem for r in catalogue.lint(rules).collect()] == ["weight outside 1 to 100"]
    assert set(detected(spark, {"html": "tee-5"}, rules=rules)) == {(0, "t")}
    assert [catalogue.needles(p) for p in (r"a\.b/c", "x|y", "ab?c", "(a|b)long", r"\d+pxy", "a{2}bcd", "one|two[|]x|(a|b)three", "[|]four|\\|five")] == [["a.b/c"], [], [], ["long"], ["pxy"], ["bcd"], ["one", "three", "two"], ["four", "|five"]]
    families = [{"id": "m", "name": "M", "category": "cms", "minFamilies": 2, "signals": [{"type": "html-regex", "pattern": "mmm-one", "weight": 80, "strength": "strong"}, {"type": "inline-script", "pattern": "mmm-two", "weight": 80, "strength": "strong"}, {"type": "cookie-name", "pattern": "^mmm$", "weight": 80, "strength": "strong"}]}]
    (tmp_path / "b.json").write_text(json.dumps({"technologies": families}))
    rules = catalogue.read_catalogue(spark, str(tmp_path / "b.json"))
    assert set(detected(spark, {"html": "mmm-one mmm-two"}, {"html": "mmm-one", "cookies": ["mmm"]}, rules=rules)) == {(1, "m")}


def test_readers_give_what_the_package_brings(spark):
    folder = resources.files("pagelens.catalogues")
    rows = lambda table: sorted(map(str, table.collect()))
    assert rows(catalogue.read_rules(spark, str(folder / "growth.json"))) == rows(catalogue.growth(spark))
    assert rows(catalogue.read_ids(spark, str(folder / "growth.json"))) == rows(catalogue.growth_ids(spark))
    assert rows(catalogue.read_details(spark, str(folder / "growth.json"))) == rows(catalogue.details(spark))
    assert rows(catalogue.read_rules(spark, str(folder / "security.json"))) == rows(catalogue.security(spark))
    assert rows(catalogue.read_protection(spark, str(folder / "protection.json"))) == rows(catalogue.protection(spark))
    same = [c for c in catalogue.core(spark).columns if c not in ("specificity", "needles")]
    assert rows(catalogue.read_catalogue(spark, str(folder / "core.json")).select(*same)) == rows(catalogue.core(spark).select(*same))
    assert len({r[1] for r in catalogue.growth_rows()[0]}) == 38 and len({r[1] for r in catalogue.security_rows()}) == 26 and len({r[1] for r in catalogue.protection_rows()}) == 10


def test_url_validation_and_anatomy(spark):
    cases = {"a.com": "ok", "": "INVALID_URL", "http://0x7f.1/": "BLOCKED_TARGET", "http://127.1/": "BLOCKED_TARGET", "http://127.0.1/": "BLOCKED_TARGET", "http://%31%32%37.0.0.1/": "BLOCKED_TARGET", "http://a%2ecom/": "ok", "http://a%40b.com/": "INVALID_URL", "http://a%zz.com/": "INVALID_URL", "http://0177.0.0.1/": "BLOCKED_TARGET", "http://256.0.0.1/": "INVALID_URL", "http://1.2.3.4.5/": "INVALID_URL", "http://4294967296/": "INVALID_URL", "http://loc%61lhost/": "BLOCKED_TARGET", "http://[::1]/": "BLOCKED_TARGET", "http://1.a.com/": "ok", "http://4294967295/": "BLOCKED_TARGET", "http://a.com:81/": "INVALID_URL", "https://a.com:443/": "ok", "https://x.local": "BLOCKED_TARGET", "https://mylocal": "ok", "https://u@a.com": "INVALID_URL"}
    got = spark.createDataFrame([(u,) for u in cases], "url string").select("url", urls.validation(F.col("url"))["code"].alias("c")).collect()
    assert {r.url: r.c for r in got} == cases
    look = spark.createDataFrame([("http://XN--a.b.Example.com:8080/Login-Update",)], "u string").select(*(v.alias(k) for k, v in urls.anatomy(F.col("u")).items())).first()
    assert (look.hostname, look.is_punycode, look.subdomains, look.risk_words, look.unusual_port) == ("xn--a.b.example.com", True, 2, "login-update", True)


def test_channels(spark):
    row = spark.createDataFrame([('"name": "a\\"b" x /* c */ y // z\nhttp://k', "a=1, b=2,c=3; x=1", "x" * 300_000)], "js string, c string, t string").select(ch.sanitised(F.col("js")).alias("js"), ch.cookie_names(F.col("c")).alias("c"), ch.sanitised(F.concat(F.lit('"name":"'), "t", F.lit('"'))).alias("t")).first()
    assert row.js == '"name":"" x   y  \nhttp://k' and row.c == ["a", "c"] and row.t == '"name":""'
    text = "é" * 300_000
    cut = source.capped_html(capture(spark, {"html": text}, {"html": "short"})).orderBy("page_id").collect()
    assert [(r.truncated, len(r.html)) for r in cut] == [(True, 250_000), (False, 5)]


def test_outcome_ladder(spark):
    rows = [{"html": "<html>"}, {"url": "http://x.local/"}, {"status": 503}, {"status": 403}, {"content_type": "image/png"}, {"content_type": "", "html": "<!DOCTYPE html>"}, {"html": "Just a moment"}, {"redirect_chain": ["https://a.com/", "https://a.com/"]}, {"redirect_chain": ["http://10.0.0.1/"]}]
    got = [r.error_code for r in outcomes.outcome(capture(spark, *rows)).orderBy("page_id").collect()]
    assert got == [None, "BLOCKED_TARGET", "HTTP_ERROR", "TARGET_BLOCKED", "NOT_HTML", None, "TARGET_BLOCKED", "HTTP_ERROR", "BLOCKED_TARGET"]
    html = '<base href="/x/"><script src="a.js"></script><script src="https://other.com/b.js"></script><link rel="modulepreload" href="/m.js"><script src="a.js"></script>'
    assert spark.range(1).select(outcomes.script_candidates(F.lit(html), F.lit("https://a.com/p/q")).alias("s")).first().s == ["https://a.com/x/a.js", "https://a.com/m.js"]
    html = '<link as="script" href="/p.js" rel="preload"><link href="/n.js" rel="x modulepreload"><link rel="preload" as="style" href="/s.css"><script src="data:x"></script><script src="https://a.com:8080/q.js"></script>'
    assert spark.range(1).select(outcomes.script_candidates(F.lit(html), F.lit("https://a.com/")).alias("s")).first().s == ["https://a.com/p.js", "https://a.com/n.js"]
    bundles = spark.createDataFrame([([("a", 1, "one"), ("b", 3, "three"), ("c", 2, "two")],)], "b array<struct<url:string,size:int,body:string>>")
    assert bundles.select(outcomes.largest_bundles(F.col("b"), 2).alias("x")).first().x == ["three", "two"]


def test_safety_findings_with_feeds(spark):
    page = capture(spark, {"headers": {"content-security-policy": "default-src 'self'"}}, {"final_url": "http://a.com/"})
    feeds = F.when(F.col("page_id") == 0, F.array(F.struct(F.lit("Feed A").alias("source"), F.lit(True).alias("checked"), F.lit(True).alias("listed")))).cast("array<struct<source:string,checked:boolean,listed:boolean>>")
    found = safety.findings(page.withColumn("threats", feeds).withColumn("http_redirects", F.col("page_id") == 0).withColumn("resolves", F.lit(True)))
    kinds = {(r.page_id, r.finding) for r in found.collect()}
    assert {(0, "threat-feed-a"), (0, "conn-http-redirect"), (1, "conn-http-no-redirect"), (1, "conn-https-missing"), (0, "dns-resolves")} <= kinds
    got = {r.page_id: r for r in safety.verdicts(found).collect()}
    assert (got[0].verdict, got[0].score) == ("known_threat", 100 - 50 - 8 - 4 - 8 - 4) and got[1].rating == "High"


def test_rate_limit_and_robots(spark):
    hits = spark.createDataFrame([("a", i) for i in (0, 10, 59, 60, 61, 200)] + [("b", 5)], "key string, s int").select("key", F.timestamp_seconds("s").alias("at"))
    got = {(r.key, r.at.second + 60 * r.at.minute): (r.recent, r.limited) for r in sites.rate_limited(hits, 3, 60).collect()}
    assert got["a", 59] == (3, False) and got["a", 60] == (3, False) and got["a", 61] == (4, True) and got["a", 200] == (1, False) and got["b", 5] == (1, False)
    robots = "User-agent: x\nDisallow: /\nUser-agent: *\nDisallow: /a # note\nUser-agent: y\nDisallow: /b"
    late = "Disallow: /a\nUSER-AGENT : * # all\n disallow : /c  # x\nDisallow:\nAllow: /d"
    page = capture(spark, {"url": "https://h.com/a/1", "robots": robots}, {"url": "https://h.com/b", "robots": robots}, {"url": "https://h.com/a"}, {"url": "https://h.com/c?x", "robots": late}, {"url": "https://h.com/a", "robots": late}, {"url": "https://h.com/", "robots": ""})
    assert [r.allowed for r in sites.robots_allowed(page).orderBy("page_id").collect()] == [False, True, True, False, True, True]


def test_rate_limit_of_a_busy_key_is_spread(spark):
    times = [7 * i % 1000 for i in range(600)]
    hits = spark.createDataFrame([("a", t) for t in times], "key string, s int").select("key", F.timestamp_seconds("s").alias("at"))
    got = sorted((int(r.at.timestamp()) % 1000, r.recent) for r in sites.rate_limited(hits, 3, 60).collect())
    base = min(t for t, _ in got)
    assert [n for _, n in got] == [sum(t - 60 < u <= t for u in times) for t in sorted(times)] and base == 0
    plan = sites.rate_limited(hits, 3, 60)._jdf.queryExecution().executedPlan().toString()
    assert "_stretch" in plan


def test_sample_plan_and_consistency(spark):
    site = lambda rows, names: spark.createDataFrame(rows, names)
    home = site([("h", "https://h.com")], "site string, url string")
    sitemap = site([("h", i, f"https://h.com/{'ab'[i % 2]}/{i}") for i in range(40)], "site string, ord int, url string")
    links = site([("h", 0, "https://h.com/a/0"), ("h", 1, "https://h.com/link/")], "site string, ord int, url string")
    extras = site([("h", 0, "https://h.com/extra")], "site string, ord int, url string")
    got = sites.sample_plan(home, sitemap, links, extras, limit=4, preview=3).orderBy("place").collect()
    assert [r.url.removeprefix("https://h.com") for r in got] == ["/", "/a/0", "/b/1", "/a/2", "/b/3", "/a/4", "/b/5"]
    assert [r.scanned for r in got] == [True] * 4 + [False] * 3 and {r.found for r in got} == {40}
    rows = [("h", 1, True, False, "A", "P"), ("h", 2, True, False, "B", "P"), ("h", 3, False, False, "B", "P"), ("h", 4, False, False, "B", "Q"), ("k", 5, True, False, "A", "P"), ("k", 6, True, False, "A", "P"), ("z", 7, False, True, "A", "P")]
    pages = site(rows, "site string, page_id long, ok boolean, cross_domain boolean, framework string, provider string")
    got = {r.site: r for r in sites.consistency(pages).collect()}
    assert (got["h"].verdict, got["h"].framework, got["h"].provider, got["h"].verdict_line) == ("mixed", "A", "P", "2 of 4 pages scanned (2 unscanned or failed, 1 differ)")
    assert (got["k"].verdict, got["k"].verdict_line, got["k"].front_door) == ("consistent", "2/2 pages run A + P", True)
    assert (got["z"].framework, got["z"].verdict_line) == ("Unknown", "0 of 1 pages could be scanned")


def test_detection_is_deterministic_and_silent_on_prose(spark):
    rules = catalogue.core(spark)
    page = source.overlay(spark.range(48).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h.example.com/"), "id").alias("url"), F.lit("<html><body>x</body></html>").alias("html")))
    runs = [sorted(map(tuple, scoring.detect(matching.core_evidence(page.repartition(n), rules)).collect()), key=str) for n in (1, 5)]
    assert runs[0] == runs[1] and runs[0]
    assert not detected(spark, {"html": "the of and that with this from were have which"})
