"""Captured pages: the schema that the detectors read, and a synthetic overlay that gives plain pages something to detect.

A capture is one fetched page.  Real captures are read with `read_captures`; the columns that a table lacks are filled
with empty values.  `overlay` turns a table (page_id, url, html) into captures as a pure function of page_id % 12; it is
test data, stated once here and rendered both as Spark columns and as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a capture and their types.
COLUMNS = {
    "page_id": "bigint", "url": "string", "final_url": "string", "status": "int", "content_type": "string", "html": "string", "headers": "map<string,string>", "cookies": "array<string>",
    "redirect_chain": "array<string>", "containers": "array<struct<id:string,js:string>>", "bundles": "array<string>", "probes": "map<string,string>", "style_css": "string", "robots": "string", "set_cookie": "string", "cname": "string",
    # What a rendered pass adds: names of globals, addresses that were asked for, keys of local storage.
    "globals": "array<string>", "requests": "array<string>", "storage_keys": "array<string>",
}
#: Bytes of HTML that are looked at.
MAX_HTML_BYTES = 500_000

#: Synthetic fixture, by page_id % 12.  html is appended to the page.
VARIANTS: list[dict] = [
    {},
    {
        "html": '<meta name="generator" content="WordPress 6.4.2"><link rel="stylesheet" href="/wp-content/themes/astra-child/style.css"><link rel="stylesheet" href="/wp-content/themes/astra/style.css"><script src="/wp-content/plugins/woocommerce/assets/js/woocommerce.min.js"></script><script src="/wp-content/plugins/Contact-Form-7/a.js"></script>',
        "headers": {"server": "cloudflare", "cf-ray": "8a1b-FRA", "link": '<https://a.example/wp-json/>; rel="https://api.w.org/"'}, "cookies": ["wordpress_test_cookie", "__cf_bm"],
        "style_css": "/*\nTheme Name: Astra Child\nAuthor: Brainstorm\nAuthor URI: https://a.example.com/me\nVersion: 1.2.3\nTemplate: astra\n*/", "probes": {"/wp-json/": '{"namespaces":["wp/v2"]}'}, "set_cookie": "a=1; Path=/,b=2; Expires=Wed, 09 Jun 2027 10:18:14 GMT, c=3", "cname": "proxy.cdn.cloudflare.net.",
    },
    {
        "html": '<script src="https://cdn.shopify.com/s/files/1/theme.js?v=2"></script><script>Shopify.theme = {"name":"Dawn 12.0","id":123456,"theme_store_id":887,"role":"main"};</script>',
        "headers": {"x-shopify-stage": "production", "x-powered-by": "PHP/8.2"}, "cookies": ["_shopify_y", "cart"], "cname": "shops.myshopify.com", "globals": ["dataLayer", "Sentry.init("], "storage_keys": ["_hjSessionUser_12345"],
    },
    {
        "html": '<script id="__NEXT_DATA__" type="application/json">{"page":"/"}</script><script src="/_next/static/chunks/main.js"></script>',
        "headers": {"x-powered-by": "Next.js", "x-vercel-id": "fra1::abc", "server": "Vercel"}, "cname": "cname.vercel-dns.com",
        "bundles": ['fetch("https://sgtm.shop.example.com/collect"); load("GTM-BUNDLE9")', 'load("https://www.googletagmanager.com/gtag/js?id=UA-12345-6")'],
    },
    {
        "html": '<astro-island></astro-island><link rel="preload" href="/_astro/a.css"><script src="https://www.googletagmanager.com/gtm.js?id=GTM-ABC123"></script><script>(function(){dataLayer.push({"gtm.start":1})})()</script>',
        "containers": [("GTM-ABC123", '{"name":"Meta Pixel tag"} /* klaviyo comment */ fbq("init","123456789"); // intercom\nload("https://connect.facebook.net/en_US/fbevents.js")'), ("GTM-ZZZ999", "var a=1;")],
    },
    {
        "html": "<script src='https://www.googletagmanager.com/gtag/js?id=G-ABCDE12345'></script><script>gtag('config', 'G-ABCDE12345'); gtag('config', 'AW-123456789'); fbq('init', '1234567890');</script><ins class=\"adsbygoogle\" data-ad-client=\"ca-pub-123456\"></ins>",
        "cookies": ["_ga", "_gid", "_fbp", "intercom-id-x"],
    },
    {
        "html": '<script src="https://cdn.cookielaw.org/scripttemplates/otSDKStub.js" data-domain-script="x"></script><script src="https://www.google.com/recaptcha/api.js"></script><div class="g-recaptcha" data-sitekey="YOUR_SITE_KEY"></div><script>Shopify.theme = {"name":{"en":"Nested"},"id":"55","theme_store_id":"887","settings":{"a":1},"role":"unpublished"}; BOOMR.themeName = "Prestige 4";</script>',
        "cookies": ["OptanonConsent"], "requests": ["https://widget.intercom.io/widget/abc1", "https://www.clarity.ms/tag/xyz"],
    },
    {
        "html": '<script>Sentry.init({dsn: "https://abc@o1.ingest.sentry.io/1"}); stripe = new Stripe(1);</script><iframe src="https://www.youtube.com/embed/dQw4w9WgXcQ"></iframe><iframe src="https://www.google.com/maps/embed?pb=1"></iframe><i class="fa-solid fa-user"></i><img srcset="https://a.example/1.png 1x, https://b.example/2.png 2x"><script>Shopify.theme = {\'name\': \' Sense \',\'id\':99,\'theme_store_id\':1356,};</script>',
        "headers": {"Content-Security-Policy": "script-src 'self' js.stripe.com/v3 cdn.cookielaw.org/consent/; frame-ancestors 'none'"},
    },
    {
        "html": '<p>We compare WordPress, Shopify and Stripe.</p><pre>/wp-content/ cdn.shopify.com</pre><code>__NEXT_DATA__</code><script type="application/ld+json">{"a":"/_astro/"}</script>```\nfbq("init")\n```<a href="https://js.stripe.com/v3/">x</a><!-- widget.intercom.io/widget/abc -->',
        "cname": "ghs.example.net",
    },
    {
        "html": "<title>Just a moment...</title><script src=\"https://challenges.cloudflare.com/turnstile/v0/api.js\"></script>",
        "status": 403, "headers": {"Server": "cloudflare", "CF-Ray": "7f", "cf-mitigated": "challenge"}, "cookies": ["__cf_bm", "cf_clearance"],
    },
    {
        "html": '<img src="http://img.example.com/a.png"><script src="http://js.example.com/a.js"></script><img src="http://img.example.com/a.png"><script src="/cdn-cgi/zaraz/i.js"></script><script src="https://assets.adobedtm.com/x/launch.min.js"></script><script src="https://pi.pardot.com/pd.js"></script><script src="https://cdn.evgnet.com/beacon.js"></script><meta http-equiv="refresh" content="5; url=https://next.example.com/"><div id="root"></div>',
        "headers": {"Content-Security-Policy": "default-src 'self' 'unsafe-inline'", "Strict-Transport-Security": "max-age=31536000; includeSubDomains; preload", "X-Content-Type-Options": " nosniff ", "X-Frame-Options": "sameorigin", "Referrer-Policy": "strict-origin", "Permissions-Policy": "camera=()", "Server": "nginx/1.25.3"},
        "robots": "User-agent: *\nDisallow: /en/\nDisallow:\nUser-agent: bot\nDisallow: /",
    },
    {
        "html": '<meta name="generator" content="Drupal 10"><script src="/core/assets/vendor/a.js"></script><script>var x = Shopify.theme;</script>',
        "headers": {"x-generator": "Drupal 10", "x-drupal-cache": "HIT", "strict-transport-security": "max-age=86400"}, "final_url": "http://xn--bcher-kva.shop.example.com:8080/account-verify/login-update?x=1",
        "redirect_chain": ["https://a.example.com/", "http://b.example.com/", "https://c.example.com/x", "https://d.example.com/"], "robots": "user-agent: * # all\ndisallow: /",
    },
]
_DEFAULT = {"status": 200, "headers": {}, "cookies": [], "redirect_chain": [], "containers": [], "bundles": [], "probes": {}, "content_type": "text/html", "globals": [], "requests": [], "storage_keys": []}


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _spark(value: object, kind: str) -> Column:
    if kind.startswith("array<struct"):
        return F.array(*(F.struct(F.lit(i).alias("id"), F.lit(js).alias("js")) for i, js in value)).cast(kind)
    if kind.startswith("array"):
        return F.array(*map(F.lit, value)).cast(kind)
    if kind.startswith("map"):
        return F.create_map(*(F.lit(x) for kv in value.items() for x in kv)).cast(kind) if value else F.from_json(F.lit("{}"), kind)
    return F.lit(value).cast(kind)


def _sql(value: object, kind: str) -> str:
    if kind.startswith("array<struct"):
        return "[" + ", ".join(f"{{'id': {quoted(i)}, 'js': {quoted(js)}}}" for i, js in value) + "]::struct(id varchar, js varchar)[]"
    if kind.startswith("array"):
        return f"[{', '.join(map(quoted, value))}]::varchar[]"
    if kind.startswith("map"):
        return f"map([{', '.join(map(quoted, value))}]::varchar[], [{', '.join(map(quoted, value.values()))}]::varchar[])"
    return str(value) if isinstance(value, int) else f"{quoted(value)}::varchar"


def _cases(column: str) -> list[tuple[int, object]]:
    return [(i, v[column]) for i, v in enumerate(VARIANTS) if column in v]


def overlay(pages: DataFrame) -> DataFrame:
    """Synthetic captures from plain pages (page_id, url, html)."""
    variant = F.col("page_id") % len(VARIANTS)

    def column(name: str, kind: str) -> Column:
        rest = F.col("url") if name == "final_url" else _spark(_DEFAULT.get(name), kind)
        if name == "html":
            rest = F.lit("")
        for i, value in _cases(name):
            rest = F.when(variant == i, _spark(value, kind)).otherwise(rest)
        return F.concat(F.coalesce("html", F.lit("")), rest) if name == "html" else rest

    return pages.select(*((F.col(n).cast(k) if n in ("page_id", "url") else column(n, k)).alias(n) for n, k in COLUMNS.items()))


def overlay_sql() -> str:
    """The same captures as a SELECT over the table `pages`."""
    out = ["page_id", "url"]
    for name, kind in COLUMNS.items():
        if name not in ("page_id", "url"):
            rest = {"final_url": "url", "html": "''"}.get(name) or _sql(_DEFAULT.get(name), kind)
            cases = "".join(f" when {i} then {_sql(v, kind)}" for i, v in _cases(name))
            value = f"case page_id % {len(VARIANTS)}{cases} else {rest} end" if cases else rest
            out.append(f"{"coalesce(html, '') || " if name == 'html' else ''}{value} as {name}")
    return f"select {', '.join(out)} from pages"


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captures from Parquet; missing columns are empty, header names lower-cased later, HTML kept whole."""
    table = spark.read.parquet(path)
    return table.select(*((F.col(n).cast(k) if n in table.columns else _spark(_DEFAULT.get(n), k)).alias(n) for n, k in COLUMNS.items()))


def seen_html(limit: int = MAX_HTML_BYTES) -> Column:
    """`html` as far as it is looked at: cut at a number of bytes, of which a cut character is lost."""
    cut = F.rtrim(F.make_valid_utf8(F.substring(F.encode("html", "UTF-8"), 1, limit).cast("string")), F.lit("\ufffd"))
    return F.when(F.octet_length("html") > limit, cut).otherwise(F.col("html"))


def capped_html(captures: DataFrame, limit: int = MAX_HTML_BYTES) -> DataFrame:
    """`html` cut at a number of bytes and the flag `truncated`."""
    return captures.withColumn("truncated", F.octet_length("html") > limit).withColumn("html", seen_html(limit))
