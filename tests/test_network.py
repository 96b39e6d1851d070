from pyspark.sql import functions as F

from pagelens.functions import urls
from pagelens.operators import catalogue, network, outcomes, safety
from pagelens.sources import lookups
from tests.test_detection import capture


def answers(spark, *rows):
    """Answers from (question, type, status, AD, record type, data), in order; resolver `plain` but where a seventh says another."""
    full = [(r[0], r[6] if len(r) > 6 else "plain", r[1], r[2], r[3], i, r[0], r[4], r[5]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, lookups.ANSWERS)


def test_dns_report(spark):
    rows = answers(
        spark,
        ("a.com", "A", 0, True, 1, "192.0.2.1"), ("a.com", "A", 0, True, 46, "sig"), ("a.com", "A", 0, True, 1, "192.0.2.2"), ("a.com", "CAA", 0, False, 257, '0 issue "x"'), ("a.com", "CAA", 0, False, 5, "alias."),
        ("b.com", "A", 3, True, None, None), ("c.com", "A", 0, False, 5, "d.com."), ("c.com", "CAA", 2, False, 257, "lost"), ("1.2.3.4", "A", 0, True, 1, "1.2.3.4"), ("e.com", "A", 0, True, 1, "0.0.0.0", "filter"),
    )
    hosts = spark.createDataFrame([(h,) for h in ("a.com", "b.com", "c.com", "1.2.3.4", "nobody.com", "e.com", "a.com")], "host string")
    got = {r.host: tuple(r)[1:] for r in network.dns_reports(hosts, rows).collect()}
    none = (False, [], False, False, False, [])
    assert got == {"a.com": (True, ["192.0.2.1", "192.0.2.2"], True, True, True, ['0 issue "x"']), "b.com": none, "c.com": (True, [], False, False, False, []), "1.2.3.4": none, "nobody.com": none, "e.com": none}


def test_cname_chains(spark):
    point = lambda a, b: (a, "CNAME", 0, False, 5, b)
    rows = answers(spark, point("A.com", "b.net."), point("b.net", "X1.CloudFront.NET."), point("l.com", "m.com"), point("m.com", "l.com"), *(point(f"n{i}.com", f"n{i + 1}.com") for i in range(20)), point("w.com", "x.wpengine.com"), point("x.wpengine.com", "y.kinsta.com"))
    hosts = spark.createDataFrame([("a.com",), ("l.com",), ("n0.com",), ("w.com",), ("none.com",)], "host string")
    got = {r.host: r for r in network.cname_chains(hosts, rows).collect()}
    assert (got["a.com"].chain, got["a.com"].tech_id, got["a.com"].cname, got["a.com"].loops) == (["b.net", "x1.cloudfront.net"], "aws-cloudfront", "x1.cloudfront.net", False)
    assert (got["l.com"].chain, got["l.com"].loops, got["l.com"].tech_id) == (["m.com"], True, None)
    assert got["n0.com"].chain == [f"n{i}.com" for i in range(1, 9)]
    assert got["w.com"].tech_id == "wp-engine" and "none.com" not in got


def test_feed_expressions(spark):
    cases = {
        "http://a.b.c/1/2.html?param=1": {f"{h}{p}" for h in ("a.b.c", "b.c") for p in ("/1/2.html?param=1", "/1/2.html", "/", "/1/")},
        "http://a.b.c.d.e.f.g/1.html": {f"{h}{p}" for h in ("a.b.c.d.e.f.g", "c.d.e.f.g", "d.e.f.g", "e.f.g", "f.g") for p in ("/1.html", "/")},
        "http://1.2.3.4/1/": {"1.2.3.4/1/", "1.2.3.4/"},
        "http://x.com/a/b/c/d/e/f": {f"x.com{p}" for p in ("/a/b/c/d/e/f", "/", "/a/", "/a/b/", "/a/b/c/")},
        "no-host": {"no-host/"}, "": set(),
    }
    got = spark.createDataFrame([(u,) for u in cases], "url string").select("url", network.expressions(F.col("url")).alias("e")).collect()
    for r in got:
        assert len(r.e) == len(set(r.e)) and set(r.e) == cases[r.url], r.url


def test_threat_feeds(spark):
    pages = spark.createDataFrame([(0, "https://evil.shop.com/login/now?x=1"), (1, "https://good.com/"), (2, "https://sink.com/"), (3, "https://gone.com/"), (4, "https://listed.net/a"), (5, "https://unasked.com/")], "page_id long, url string")
    hash_ = lambda x: spark.range(1).select(F.sha2(F.lit(x), 256)).first()[0]
    near = hash_("good.com/")[:8] + "0" * 56  # the prefix of a clean page with another whole hash
    entries = spark.createDataFrame([("safe-browsing", "url", hash_("shop.com/login/"), "MALWARE"), ("safe-browsing", "url", near, "MALWARE"), ("urlhaus", "host", hash_("listed.net"), "malware_download"), ("safe-browsing", "host", hash_("good.com"), "wrong kind")], lookups.ENTRIES)
    asked = answers(spark, ("evil.shop.com", "A", 0, False, 1, "1.1.1.1", "filter"), ("good.com", "A", 0, False, 1, "1.1.1.2", "filter"), ("sink.com", "A", 0, False, 1, "0.0.0.0", "filter"), ("gone.com", "A", 3, False, None, None, "filter"), ("listed.net", "A", 2, False, None, None, "filter"))
    feeds = spark.createDataFrame([("safe-browsing", True), ("urlhaus", True)], "feed string, available boolean")
    got = {(r.page_id, r.place): (r.checked, r.listed, r.threat) for r in network.threat_reports(pages, asked, entries, feeds).collect()}
    assert [got[i, 0] for i in range(6)] == [(True, False, None), (True, False, None), (True, True, network.SINKHOLE[0]), (True, True, network.BLOCKED[0]), (True, False, None), (False, False, None)]
    assert [got[i, 1][1] for i in range(6)] == [True, False, False, False, False, False] and got[0, 1] == (True, True, "MALWARE")
    assert [got[i, 2][1] for i in range(6)] == [False, False, False, False, True, False]
    off = network.threat_reports(pages, asked, entries, spark.createDataFrame([], "feed string, available boolean")).where("place > 0").select("checked", "said").distinct().collect()
    assert [tuple(r) for r in off] == [(False, "Provider lookup timed out or unavailable")]
    page = capture(spark, *({"url": r.url, "final_url": r.url} for r in pages.orderBy("page_id").collect()))
    found = safety.findings(network.with_network(page, asked, entries, feeds))
    assert {r.finding for r in found.where("page_id = 0 and area = 'threat_intel'").collect()} == {"clean-cloudflare-security-threat-intelligence-(1.1.1.2)", "threat-google-safe-browsing-v4", "clean-urlhaus-malware-intelligence-(abuse.ch)"}
    assert {r.page_id for r in safety.verdicts(found).where("verdict = 'known_threat'").collect()} == {0, 2, 3, 4}


def test_plain_http(spark):
    rows = [("http://a.com/", 301, " HTTPS://a.com/", None), ("http://b.com/", 200, None, None), ("http://c.com/", 308, "http://c.com/x", None), ("http://d.com/", 404, None, None), ("http://e.com/", None, None, "refused"), ("http://f.com/", 302, None, None), ("http://1.2.3.4/", 200, None, None)]
    hosts = spark.createDataFrame([(f"{h}.com",) for h in "abcdefg"] + [("1.2.3.4",), ("a.com",)], "host string")
    got = {r.host: r.http_redirects for r in network.http_redirects(hosts, spark.createDataFrame(rows, lookups.RESPONSES)).collect()}
    assert got == {"a.com": True, "b.com": False, "c.com": False, "d.com": None, "e.com": None, "f.com": False, "g.com": None, "1.2.3.4": None}


def followed(spark, rows, starts, **options):
    table = spark.createDataFrame([(u, s, l, e) for u, s, l, e in rows], lookups.RESPONSES)
    return {r.url: r for r in network.follow(spark.createDataFrame([(u,) for u in starts], "url string"), table, **options).collect()}


def test_redirects_hop_by_hop(spark):
    rows = [
        ("https://a.com/", 301, "/b", None), ("https://a.com/b", 302, "//c.com/x", None), ("https://c.com/x", 404, None, None), ("https://l.com/", 301, "https://m.com", None), ("https://m.com/", 301, "HTTPS://L.com:443/", None),
        ("https://f.com/", 301, "ftp://b.com/", None), ("https://i.com/", 301, "http://10.0.0.1/", None), ("https://n.com/", 301, None, None), ("https://e.com/", 301, " ", None), ("https://s.com/", 503, None, None), ("https://d.com/", None, None, "getaddrinfo ENOTFOUND d.com"),
        ("https://t.com/", None, None, "unable to verify the first certificate"), ("https://o.com/", None, None, "The operation was aborted"), ("https://r.com/", None, None, "socket hang up"), *((f"https://h.com/{i}", 307, f"{i + 1}", None) for i in range(6)), ("https://h.com/6", 200, None, None), ("https://c4.com/", 300, "/never", None),
    ]
    starts = ["a.com", "https://l.com/", "https://f.com/", "https://i.com/", "https://n.com/", "https://e.com/", "https://s.com/", "https://d.com/", "https://t.com/", "https://o.com/", "https://r.com/", "https://h.com/0", "https://h.com/1", "https://unknown.com/", "http://localhost/", "", "https://c4.com/"]
    got = followed(spark, rows, starts)
    assert (got["a.com"].ok, got["a.com"].final_url, got["a.com"].chain, got["a.com"].hops) == (True, "https://c.com/x", ["https://a.com/", "https://a.com/b", "https://c.com/x"], 2)
    told = {u: (r.error_code, r.message, r.http_status) for u, r in got.items() if not r.ok}
    assert told == {
        "https://l.com/": ("HTTP_ERROR", "Redirect loop detected.", 301), "https://f.com/": ("BLOCKED_TARGET", "Unsupported scheme: ftp:", 301), "https://i.com/": ("BLOCKED_TARGET", "Direct IP access is not allowed", 301),
        "https://n.com/": ("HTTP_ERROR", "Redirect response missing Location header.", 301), "https://e.com/": ("BLOCKED_TARGET", "Empty redirect location", 301), "https://s.com/": ("HTTP_ERROR", "Server returned HTTP status 503.", 503),
        "https://d.com/": ("DNS_FAILED", "Could not resolve domain name.", None), "https://t.com/": ("TLS_ERROR", "TLS certificate verification failed.", None), "https://o.com/": ("TIMEOUT", "The request timed out.", None), "https://r.com/": ("HTTP_ERROR", "Network connection failed.", None),
        "https://h.com/0": ("HTTP_ERROR", "Exceeded maximum redirect limit (5).", None), "https://unknown.com/": ("HTTP_ERROR", "Network connection failed.", None), "http://localhost/": ("BLOCKED_TARGET", "Private or reserved hostname", 403), "": ("INVALID_URL", "Empty URL", 400),
    }
    assert got["https://h.com/1"].hops == 5 and got["https://h.com/1"].ok and got["https://c4.com/"].ok
    pinned = followed(spark, rows, ["https://a.com/", "https://h.com/3"], pin_host="a.com")
    assert (pinned["https://a.com/"].error_code, pinned["https://a.com/"].message) == ("BLOCKED_TARGET", "Container fetch must not follow redirects off a.com.") and pinned["https://h.com/3"].error_code == "BLOCKED_TARGET"


def test_whole_address(spark):
    cases = {"HTTP://A.com:80": "http://a.com/", "a.com/x?y#z": "https://a.com/x?y#z", "https://u@B.com:8443/p": "https://b.com:8443/p"}
    got = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.whole(F.col("u")).alias("w")).collect()
    assert {r.u: r.w for r in got} == cases


def test_ladder_and_codes(spark):
    rows = [
        {"html": "<html>"}, {"content_type": "text/plain", "html": "x <!DOCTYPE html>"}, {"content_type": "application/xhtml+xml"}, {"content_type": "application/vnd.html-like", "html": "x"}, {"content_type": "", "html": "y" * 1024 + "<html"}, {"status": None}, {"status": 502}, {"status": 503},
        {"redirect_chain": ["https://b.com/", "https://a.com/"]}, {"redirect_chain": ["https://a.com/", "https://b.com/", "https://b.com/"]}, {"redirect_chain": ["https://a.com/"] + [f"https://b.com/{i}" for i in range(5)]}, {"redirect_chain": [f"https://b.com/{i}" for i in range(6)]}, {"redirect_chain": ["ftp://b.com/"]}, {"redirect_chain": [""]},
        {"html": "<html>" + "x" * 500_000}, {"bundles": ["y" * 250_001]}, {"containers": [("GTM-A", "z" * 400_001)]},
    ]
    got = outcomes.outcome(capture(spark, *rows)).orderBy("page_id").collect()
    assert [r.error_code for r in got] == [None, None, None, "NOT_HTML", "NOT_HTML", "HTTP_ERROR", "HTTP_ERROR", "HTTP_ERROR", "HTTP_ERROR", "HTTP_ERROR", None, "HTTP_ERROR", "BLOCKED_TARGET", "BLOCKED_TARGET", None, None, None]
    assert [(r.http_status, r.retryable) for r in got[3:8]] == [(422, False), (422, False), (502, True), (502, True), (503, True)] and [r.scan for r in got[-3:]] == ["partial"] * 3 and got[0].scan == "complete" and got[3].scan == "failed"
    codes = {c: (s, r) for c, s, r in catalogue.ERRORS}
    assert len(codes) == 12 and {c for c, (_, r) in codes.items() if r} == {"TIMEOUT", "HTTP_ERROR", "RATE_LIMITED", "DNS_FAILED"}
    assert {s: sorted(c for c in codes if codes[c][0] == s) for s in (413, 422, 429, 500)} == {413: ["TOO_LARGE"], 422: ["NOT_HTML"], 429: ["BUDGET_EXCEEDED", "RATE_LIMITED"], 500: ["INTERNAL"]}


def test_attempts_fold_into_one_outcome(spark):
    tries = {  # page: (status, error) of each attempt -> (attempts, retried, code)
        0: ([(200, None)], (1, False, None)), 1: ([(503, None), (200, None)], (2, True, None)), 2: ([(None, "socket hang up"), (500, None)], (2, True, "HTTP_ERROR")), 3: ([(404, None), (200, None)], (2, False, None)),
        4: ([(None, "aborted"), (200, None)], (2, False, "TIMEOUT")), 5: ([(403, None), (200, None)], (2, False, "TARGET_BLOCKED")), 6: ([(503, None)], (1, False, "HTTP_ERROR")), 7: ([(503, None), (None, "EAI_AGAIN"), (200, None)], (2, True, "DNS_FAILED")),
    }
    flat = [(page, n, s, e) for page, (attempts, _) in tries.items() for n, (s, e) in enumerate(attempts, 1)]
    rows = capture(spark, *({"page_id": page, "status": s, "html": "<html>"} for page, _, s, _ in flat))
    extra = spark.createDataFrame([(p, n, e) for p, n, _, e in flat], "p long, attempt int, error string")
    log = extra.join(rows.dropDuplicates(["page_id"]).drop("status"), extra.p == rows.page_id).drop("p").join(spark.createDataFrame([(p, n, s) for p, n, s, _ in flat], "page_id long, attempt int, status int"), ["page_id", "attempt"])
    got = {r.page_id: (r.attempts, r.retried, r.error_code) for r in outcomes.folded_attempts(log).collect()}
    assert got == {p: want for p, (_, want) in tries.items()}
