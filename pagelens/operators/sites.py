"""Sites: links and samples of pages, robots rules, roll-ups of technologies, consistency, hints, themes and limits."""

from __future__ import annotations

import json
from importlib import resources

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import urls
from pagelens.functions.channels import ANCHOR, every, inline_scripts, lowered_headers, resource_urls
from pagelens.operators import scoring
from pagelens.operators.matching import small

#: Fixed values.
PLUGIN = r"(?i)/wp-content/plugins/([^/\"'\s?#]+)"
THEME = r"(?i)/wp-content/themes/([^/\"'\s?#]+)/"
NOT_PLUGINS = ["cache", "uploads", "upgrade", "languages", "dist", "build", "assets", "vendor", "node_modules", "tmp", "temp"]
CNAMES = [(".cloudfront.net", "aws-cloudfront", "AWS CloudFront"), (".fastly.net", "fastly", "Fastly"), (".fastlylb.net", "fastly", "Fastly"), (".vercel-dns.com", "vercel", "Vercel"), (".vercel.app", "vercel", "Vercel"), (".netlify.app", "netlify", "Netlify"), (".netlify.com", "netlify", "Netlify"), (".wpengine.com", "wp-engine", "WP Engine"), (".wpenginepowered.com", "wp-engine", "WP Engine"), (".kinsta.cloud", "kinsta", "Kinsta"), (".kinsta.com", "kinsta", "Kinsta"), (".github.io", "github-pages", "GitHub Pages"), (".wixdns.net", "wix", "Wix"), (".squarespace.com", "squarespace", "Squarespace"), (".shopify.com", "shopify", "Shopify"), (".myshopify.com", "shopify", "Shopify"), (".hubspot.net", "hubspot-cms", "HubSpot CMS")]
_THEME_FILE = json.loads(resources.files("pagelens.catalogues").joinpath("themes.json").read_text("utf-8"))
BLOG_THEMES: dict[str, dict[str, str]] = _THEME_FILE["blog"]
STORE_THEMES = {int(k): v for k, v in _THEME_FILE["store"].items()}
SHOP_THEMES: list[str] = _THEME_FILE["known"]
#: Characters of a style sheet that are looked at.
MAX_STYLE = 15_000
#: How sure a detection is, in the words of a scan.
SURE = {"confirmed": "High", "likely": "Medium", "possible": "Low"}
GROUP_RANK = {"header": 0, "cookie-name": 0, "html-regex": 1, "meta-generator": 1, "html-path": 2, "script-host": 2, "probe": 3}
FRAMEWORKS = ["cms", "builder", "ecommerce", "framework"]


def internal_links(html: Column, base: Column) -> Column:
    """Normalised links of a page to other pages of its host, each once, in order."""
    raw = F.filter(F.transform(every(F.coalesce(html, F.lit("")), ANCHOR), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^(mailto|tel|javascript):"))
    full = F.filter(F.transform(raw, lambda x: urls.resolved(x, base)), lambda u: u.rlike("^(?i:https?)://") & (urls.host_of(u) == urls.host_of(base)) & ~F.get(F.split(u, r"\?"), 0).rlike(urls.ASSET))
    return F.slice(F.array_distinct(F.transform(full, urls.normal_url)), 1, 100)


def diverse_sample(links: DataFrame, limit: int = 15) -> DataFrame:
    """Links (site, ord, url) taken by turns from the groups of their first path segment, in order of appearance.

    Of each group, and then of each site, only the first `limit` are kept, which Spark cuts before the shuffle.
    """
    links = links.withColumn("prefix", urls.first_segment(F.col("url")))
    group = Window.partitionBy("site", "prefix").orderBy("ord")
    links = links.withColumn("round", F.row_number().over(group)).withColumn("group_ord", F.first("ord").over(group)).where(F.col("round") <= limit)
    order = Window.partitionBy("site").orderBy("round", "group_ord")
    return links.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("site", "place", "url", "prefix")


def sample_plan(homepages: DataFrame, sitemap: DataFrame, links: DataFrame, extras: DataFrame, limit: int = 15, preview: int = 15) -> DataFrame:
    """The pages of a site to scan: homepage, a diverse sample of the sitemap, links, extras; each once.

    homepages has site and url, the others site, ord and url.  Behind them stand up to `preview` pages of sitemap and
    links that are not scanned; `found` is about how many pages the site has.
    """
    of = lambda rows, source, ord_: rows.select("site", F.lit(source).alias("source"), ord_.alias("ord"), urls.normal_url(F.col("url")).alias("url"))
    once = lambda rows: rows.groupBy("site", "url").agg(F.min(F.struct("source", "ord")).alias("k"))
    order = Window.partitionBy("site").orderBy("k")
    known = of(sitemap, 1, F.col("ord")).unionByName(of(links, 2, F.col("ord")))
    rows = of(homepages, 0, F.lit(0)).unionByName(of(diverse_sample(sitemap, limit), 1, F.col("place"))).unionByName(of(links, 2, F.col("ord"))).unionByName(of(extras.where("ord < 5"), 3, F.col("ord")))
    sample = once(rows).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    rest = once(known).join(sample.select("site", "url"), ["site", "url"], "left_anti").withColumn("place", F.row_number().over(order) + limit).where(F.col("place") <= limit + preview)
    n = known.groupBy("site").agg(F.sum((F.col("source") == 1).cast("int")).alias("a"), F.sum((F.col("source") == 2).cast("int")).alias("b"))
    found = sample.groupBy("site").agg(F.count("*").alias("c")).join(n, "site", "left").select("site", F.greatest("a", "b", "c").alias("found"))
    both = sample.withColumn("scanned", F.lit(True)).unionByName(rest.withColumn("scanned", F.lit(False)))
    return both.join(found, "site").select("site", "place", "url", F.col("k.source").alias("source"), "scanned", "found")


def sitemap_locs(xml: Column, cap: int = 500) -> Column:
    return F.slice(F.filter(every(xml, r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), lambda x: ~x.rlike(r"(?i)sitemap.*\.xml$")), 1, cap)


def disallowed(robots: Column) -> Column:
    """The path starts that `User-agent: *` groups of a robots file forbid; every user-agent line opens a new group."""
    lines = F.transform(F.split(robots, "\n"), lambda x: F.trim(F.get(F.split(F.trim(x), "#"), 0)))
    opens = lambda x: x.rlike(r"(?i)^user-agent\s*:")
    rule = lambda x: F.trim(F.regexp_replace(x, r"^[^:]*:", ""))
    step = lambda state, x: F.struct(
        F.when(opens(x), x.rlike(r"(?i)^user-agent\s*:\s*\*\s*$")).otherwise(state["wild"]).alias("wild"),
        F.when(state["wild"] & x.rlike(r"(?i)^disallow\s*:") & (rule(x) != ""), F.concat(state["rules"], F.array(rule(x)))).otherwise(state["rules"]).alias("rules"),
    )
    return F.aggregate(lines, F.struct(F.lit(False).alias("wild"), F.array().cast("array<string>").alias("rules")), step, lambda state: state["rules"])


def is_allowed(url: Column, robots: Column) -> Column:
    """Whether robots rules leave an address; without a file they do."""
    path = urls.path_of(url)
    return F.coalesce(~F.exists(disallowed(robots), lambda r: (r == "/") | path.startswith(r)), F.lit(True))


def robots_allowed(captures: DataFrame) -> DataFrame:
    """(page_id, path, allowed)."""
    return captures.select("page_id", urls.path_of(F.col("url")).alias("path"), is_allowed(F.col("url"), F.col("robots")).alias("allowed"))


def site_rollup(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """Technologies of each site: pages, signals, confidence level and the score as the model gives it (bonus only).

    `pages` has page_id, site and ok; pages that failed count for nothing.
    """
    # Dealt by page as the evidence is, and once for both uses: what the joins ask of a page is asked here, so Spark finds the
    # same step twice.  Pages without an id count for their site, too; Parquet tells without a look at them that there are none.
    ok = pages.where("ok and site is not null").select("page_id", "site")
    good = ok.where("page_id is not null").repartition("page_id")
    nameless = ok.where("page_id is null").groupBy("site").agg(F.count("*").alias("n"))
    checked = good.groupBy("site").agg(F.count("page_id").alias("n")).unionAll(nameless).groupBy("site").agg(F.sum("n").alias("checked"))
    rank = F.when(F.col("strength") == "definitive", 0).when(F.col("strength") == "strong", 1).otherwise(2)
    rows = evidence.join(good, "page_id").withColumn("rank", rank)
    # Signals and, in rows of their own, technologies, in one pass over the evidence.
    keys = [F.col(c) for c in ("site", "tech_id", "tech_name", "category", "type", "name")]
    both = rows.groupingSets([keys, keys[:2]], *keys).agg(F.min("rank").alias("rank"), F.count_distinct("page_id").alias("pages"), F.min("family").alias("family"), (F.grouping_id() > 0).alias("whole"))
    on = F.max(F.when(F.col("whole"), F.col("pages"))).over(Window.partitionBy("site", "tech_id"))
    signal = both.withColumn("detected_on", on).where(~F.col("whole"))
    n = lambda r: F.sum((F.col("rank") == r).cast("int"))
    group = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in GROUP_RANK.items() for x in kv)), F.col("type")), F.lit(4))
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", group.alias("g"), (-F.col("pages")).alias("p"), "name"))), lambda x: x["name"])
    tech = signal.groupBy("site", "tech_id", "tech_name", "category").agg(F.max("detected_on").alias("detected_on"), n(0).alias("definitive"), n(1).alias("strong"), n(2).alias("weak"), F.count_distinct("family").alias("families"), F.array_join(names, " | ").alias("signals"))
    tech = tech.join(checked, "site")
    cover = F.col("detected_on") / F.col("checked")
    high, medium = (F.col("definitive") >= 1) | (F.col("strong") >= 2), (F.col("strong") == 1) | (F.col("weak") >= 2)
    level = F.when(cover < 0.5, "Low").when(high & (cover < 1), "Medium").when(high, "High").when(medium, "Medium").otherwise("Low")
    bonus = F.element_at(F.array(*map(F.lit, scoring.BONUS)), F.least(F.col("families"), F.lit(4)).cast("int") + 1)
    score = scoring.for_coverage(bonus, F.col("detected_on"), F.col("checked"))
    return tech.select("site", "tech_id", "tech_name", "category", "detected_on", "checked", level.alias("confidence"), score.alias("score"), scoring.label5(score).alias("score_label"), "signals")


def site_evidence(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, tech_id, place, type, name, sample, pages, strength): each signal of a technology once, the strongest first.

    The sample is the value on the first page where the signal is as strong as anywhere on the site.
    """
    good = pages.where("ok").select("page_id", "site")
    rank = F.when(F.col("strength") == "definitive", 0).when(F.col("strength") == "strong", 1).otherwise(2)
    rows = evidence.join(good, "page_id").withColumn("rank", rank).withColumn("line", F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("type")))
    shown = F.coalesce(F.nullif(F.col("value"), F.lit("")), F.col("artifact"))
    signal = rows.groupBy("site", "tech_id", "type", F.col("line").alias("name")).agg(F.min_by(F.struct("strength", shown.alias("sample")), F.struct("rank", "page_id", "sig_ord")).alias("s"), F.min("rank").alias("rank"), F.count_distinct("page_id").alias("pages"))
    group = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in GROUP_RANK.items() for x in kv)), F.col("type")), F.lit(4))
    place = F.row_number().over(Window.partitionBy("site", "tech_id").orderBy("rank", group, F.desc("pages"), "name", "type"))
    return signal.select("site", "tech_id", place.alias("place"), "type", "name", "s.sample", "pages", "s.strength")


def tech_kinds(found: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, tech_id, kind): whether a technology is the framework or the host of the first good page that has it, or other."""
    good = page_platforms(found, pages.where("ok")).select("page_id", "site", "framework", "provider")
    rows = found.join(good, "page_id").groupBy("site", "tech_id").agg(F.min_by(F.struct("tech_name", "category", "framework", "provider"), "page_id").alias("f"))
    framework = (F.col("f.tech_name") == F.col("f.framework")) & F.col("f.category").isin(*FRAMEWORKS)
    return rows.select("site", "tech_id", F.when(framework, "framework").when((F.col("f.tech_name") == F.col("f.provider")) & (F.col("f.category") == "hosting"), "hosting").otherwise("other").alias("kind"))


def page_results(found: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """What a scan shows of each page that has any: framework, host, how sure it is in words, and the first artifacts of both.

    Detections that have their `artifacts` need no second look at the evidence.
    """
    if evidence is not None:
        found = found.join(evidence.groupBy("page_id", "tech_id").agg(F.slice(scoring.in_order("artifact", "sig_ord"), 1, 2).alias("artifacts")), ["page_id", "tech_id"])
    first = lambda cond, name: F.min_by(F.when(cond, F.struct("tech_id", "tech_name", "label", "artifacts")), F.when(cond, F.struct(-F.col("confidence"), F.col("tech_ord")))).alias(name)
    page = found.groupBy("page_id").agg(first(F.col("category").isin(*FRAMEWORKS), "f"), first(F.col("category") == "hosting", "p"))
    texts = F.when(F.col("f").isNotNull() | F.col("p").isNotNull(), F.array_join(F.flatten(F.array_compact(F.array("f.artifacts", "p.artifacts"))), " | "))
    word = _lookup(SURE, F.coalesce("f.label", "p.label", F.lit("possible")))
    return page.select("page_id", F.coalesce("f.tech_name", F.lit("Unknown")).alias("framework"), F.col("f.tech_id").alias("framework_id"), F.coalesce("p.tech_name", F.lit("Unknown")).alias("provider"), F.col("p.tech_id").alias("provider_id"), word.alias("confidence"), F.coalesce(texts, F.lit("No distinctive fingerprint matched")).alias("evidence"))


def page_platforms(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Each page with the best framework and hosting provider of its detections."""
    best = lambda cond, name: F.min_by(F.when(cond, F.col("tech_name")), F.when(cond, F.struct(-F.col("confidence"), F.col("tech_ord")))).alias(name)
    rows = found.groupBy("page_id").agg(best(F.col("category").isin(*FRAMEWORKS), "framework"), best(F.col("category") == "hosting", "provider"))
    return pages.join(rows, "page_id", "left").select(*pages.columns, F.coalesce("framework", F.lit("Unknown")).alias("framework"), F.coalesce("provider", F.lit("Unknown")).alias("provider"))


def consistency(pages: DataFrame) -> DataFrame:
    """Verdict of each site over its pages (site, page_id, ok, cross_domain, framework, provider).

    Pages are counted by what they run first; a site's modes are then found among those few rows.
    """
    good = F.col("ok")
    rows = pages.groupBy("site", "framework", "provider", "ok", "cross_domain").agg(F.count("*").alias("pages"), F.min("page_id").alias("at"))
    for column in ("framework", "provider"):
        same = Window.partitionBy("site", column)
        rows = rows.withColumn("_n", F.sum(F.when(good, F.col("pages"))).over(same)).withColumn("_at", F.min(F.when(good, F.col("at"))).over(same))
        best = Window.partitionBy("site").orderBy(F.col("_n").desc_nulls_last(), "_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn(f"base_{column}", F.first(F.when(F.col("_n").isNotNull(), F.col(column))).over(best)).drop("_n", "_at")
    odd = good & ((F.col("framework") != F.col("base_framework")) | (F.col("provider") != F.col("base_provider")) | F.col("cross_domain"))
    named = good & ~F.col("provider").isin("Unknown", "Unscanned")
    of = lambda cond: F.sum(F.when(cond, F.col("pages")).otherwise(0))
    site = rows.groupBy("site").agg(F.sum("pages").alias("n"), of(good).alias("good"), of(odd).alias("odd"), of(named).alias("named"), F.count_distinct(F.when(named, F.col("provider"))).alias("providers"), F.first("base_framework").alias("framework"), F.first("base_provider").alias("provider"))
    site = site.withColumn("framework", F.coalesce("framework", F.lit("Unknown"))).withColumn("provider", F.coalesce("provider", F.lit("Unknown"))).withColumn("missing", F.col("n") - F.col("good"))
    same = (F.col("good") > 0) & (F.col("missing") == 0) & (F.col("odd") == 0)
    s = lambda c: F.col(c).cast("string")
    line = (
        F.when(same, F.concat(s("good"), F.lit("/"), s("n"), F.lit(" pages run "), "framework", F.lit(" + "), "provider"))
        .when(F.col("good") == 0, F.concat(F.lit("0 of "), s("n"), F.lit(" pages could be scanned")))
        .when(F.col("missing") > 0, F.concat(s("good"), F.lit(" of "), s("n"), F.lit(" pages scanned ("), s("missing"), F.lit(" unscanned or failed"), F.when(F.col("odd") > 0, F.concat(F.lit(", "), s("odd"), F.lit(" differ"))).otherwise(""), F.lit(")")))
        .otherwise(F.concat(s("odd"), F.lit(" of "), s("n"), F.lit(" path"), F.when(F.col("n") == 1, "").otherwise("s"), F.lit(" differ")))
    )
    return site.select("site", F.when(same, "consistent").otherwise("mixed").alias("verdict"), "framework", "provider", line.alias("verdict_line"), ((F.col("named") > 0) & (F.col("named") == F.col("good")) & (F.col("providers") == 1)).alias("front_door"))


def plugins(html: Column, limit: int = 8) -> Column:
    slugs = F.transform(every(html, PLUGIN), lambda x: F.lower(x))
    return F.slice(F.array_distinct(F.filter(slugs, lambda x: x.rlike("^[a-z0-9][a-z0-9_-]{1,60}$") & ~x.isin(*NOT_PLUGINS))), 1, limit)


def title_case(slug: Column) -> Column:
    return F.array_join(F.transform(F.split(slug, "[-_]+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), " ")


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def _of_theme(what: str, slug: Column) -> Column:
    return _lookup({k: v[what] for k, v in BLOG_THEMES.items()}, F.regexp_replace(F.lower(slug), "-child$", ""))


def wp_theme(html: Column, css: Column) -> Column:
    """A struct of what is known of a blog theme; null without a theme path.

    What the style sheet says counts first; a known theme gives name, and then author and address, where it has no name.
    """
    slugs = F.array_distinct(every(html, THEME))
    slug = F.coalesce(F.get(F.filter(slugs, lambda s: F.lower(s).endswith("-child")), 0), F.get(slugs, 0))
    other = F.get(F.filter(slugs, lambda s: s != slug), 0)
    style = F.substring(F.coalesce(css, F.lit("")), 1, MAX_STYLE)
    header = lambda name, value=r".+": F.nullif(F.trim(F.regexp_extract(style, rf"(?im)^{name}:[ \t]*({value})$", 1)), F.lit(""))
    template, given = header("Template"), header("Theme Name")
    child = template.isNotNull() | F.lower(slug).endswith("-child")
    name = F.coalesce(given, F.concat(_of_theme("name", slug), F.when(child, " Child").otherwise("")), title_case(slug))
    own = F.when(given.isNull(), F.lit(True))
    parent = F.coalesce(template, F.when(child, other))
    fields = {
        "theme": name, "author": F.coalesce(header("Author"), F.when(own, _of_theme("author", slug))), "author_uri": header("Author UR[Ii]", r"https?://\S+"), "theme_uri": F.coalesce(header("Theme UR[Ii]", r"https?://\S+"), F.when(own, _of_theme("url", slug))),
        "version": header("Version"), "parent": F.coalesce(_of_theme("name", parent), parent), "slug": slug, "child": child, "known": _of_theme("name", slug).isNotNull(),
    }
    return F.when(F.size(slugs) > 0, F.struct(*(v.alias(k) for k, v in fields.items())))


def shop_theme(html: Column) -> Column:
    """A struct of what is known of a shop theme; null without a name or an id.

    The theme object is read as JSON, where only texts are names and roles and only numbers ids in the store; patterns read
    what is no JSON.
    """
    object_ = F.regexp_extract(html, r"(?i)Shopify\.theme\s*=\s*(\{[^;]+?\});", 1)
    given = F.struct(object_.alias("text"), F.try_parse_json(object_).alias("json"), html.alias("html"))
    return urls.bound(urls.bound(given, _theme_parts), _theme_known)


def _theme_parts(x: Column) -> Column:
    """Name, id, number in the store, version and role of a theme, from its object and what stands beside it."""
    json_, html = x["json"], x["html"]
    kind = lambda path: F.schema_of_variant(F.try_variant_get(json_, path, "variant"))
    at = lambda path, only=None: F.try_variant_get(json_, path, "string") if only is None else F.when(kind(path) == only, F.try_variant_get(json_, path, "string"))
    of = lambda value, pattern: F.nullif(F.when(json_.isNotNull(), value).otherwise(F.trim(F.regexp_extract(x["text"], pattern, 1))), F.lit(""))
    field = lambda pattern: F.nullif(F.trim(F.regexp_extract(html, pattern, 1)), F.lit(""))
    parts = {
        "name": F.coalesce(of(F.trim(at("$.name", "STRING")), r"""(?i)["']name["']\s*:\s*["']([^"']+)["']"""), field(r"""(?i)Shopify\.theme\.name\s*=\s*["']([^"']+)["']"""), field(r"""(?i)BOOMR\.themeName\s*=\s*["']([^"']+)["']""")),
        "id": F.coalesce(of(at("$.id"), r"""(?i)["']id["']\s*:\s*(\d+)"""), field(r"(?i)BOOMR\.themeId\s*=\s*(\d+)"), field(r"""(?i)["']theme_id["']\s*:\s*(\d+)"""), field(r"""(?i)data-theme-id=["'](\d+)["']""")),
        "store": of(at("$.theme_store_id", "BIGINT"), r"""(?i)["']theme_store_id["']\s*:\s*(\d+)""").try_cast("int"),
        "role": of(at("$.role", "STRING"), r"""(?i)["']role["']\s*:\s*["']([^"']+)["']"""),
        "version": field(r"""(?i)BOOMR\.themeVersion\s*=\s*["']([^"']+)["']"""),
    }
    return F.struct(*(v.alias(k) for k, v in parts.items()))


def _theme_known(x: Column) -> Column:
    """What the store and the list of known themes say of a theme's parts."""
    store_name = _lookup(STORE_THEMES, x["store"])
    theme = F.coalesce(x["name"], store_name)
    listed = F.array(*map(F.lit, SHOP_THEMES))
    low = F.lower(F.trim(theme))
    # A number behind a name is a version of the theme.
    known = F.coalesce(F.array_contains(listed, low) | F.array_contains(listed, F.trim(F.regexp_replace(low, r"[\s\-_v]*\d+(\.\d+)*\s*$", ""))), F.lit(False)) | store_name.isNotNull()
    part = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(store_name, theme))), "[^a-z0-9]+", "-"), "^-|-$", ""), r"-\d+.*$", "")
    address = F.when(F.array_contains(listed, part), F.concat(F.lit("https://themes.shopify.com/themes/"), part))
    fields = {"theme": theme, "id": x["id"], "store_id": x["store"], "store_name": store_name, "store_url": address, "version": x["version"], "role": x["role"], "known": known}
    return F.when(F.coalesce(x["name"], x["id"], store_name).isNotNull(), F.struct(*(v.alias(k) for k, v in fields.items())))


def cname_hints(captures: DataFrame, found: DataFrame) -> DataFrame:
    """Hosting by the first provider suffix that a page's CNAME ends with, for pages without a hosting detection."""
    suffixes = F.broadcast(captures.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(CNAMES)], "ord int, suffix string, tech_id string, tech_name string"))
    target = captures.where("cname is not null").select("page_id", F.lower(F.regexp_replace("cname", r"\.$", "")).alias("cname"))
    # A suffix has two labels, so the last two of the name are its key.
    key = F.concat(F.lit("."), F.regexp_extract("cname", r"([^.]+\.[^.]+)$", 1))
    hits = target.withColumn("suffix", key).where(F.length("cname") >= F.length("suffix")).join(suffixes, "suffix").where(F.endswith(F.col("cname"), F.col("suffix"))).groupBy("page_id", "cname").agg(F.min(F.struct("ord", "tech_id", "tech_name")).alias("h"))
    return hits.join(found.where("category = 'hosting'").select("page_id").distinct(), "page_id", "left_anti").select("page_id", "cname", F.col("h.tech_id").alias("tech_id"), F.col("h.tech_name").alias("tech_name"))


def protection(captures: DataFrame, rules: DataFrame, threshold: int = 40) -> DataFrame:
    """The bot-protection provider of each page with enough evidence, of which one piece must be strong.

    Pages are exploded into channels and meet the rules of the same channel; a rule `header:x+body:n` looks at the body
    of pages with the header.
    """
    headers, cookies = F.map_entries(lowered_headers(F.col("headers"))), F.coalesce("cookies", F.array().cast("array<string>"))
    channel = lambda name, value: F.struct(name.alias("channel"), value.alias("value"))
    head = F.substring(F.coalesce("html", F.lit("")), 1, 20_000)
    rows = captures.select("page_id", head.alias("body"), F.concat(F.transform(headers, lambda h: channel(F.concat(F.lit("header:"), h["key"]), F.coalesce(h["value"], F.lit("")))), F.transform(cookies, lambda c: channel(F.lit("cookie"), c)), F.array(channel(F.lit("body"), head))).alias("c"))
    both = F.col("r.channel").contains("+")
    keyed = small(rules.withColumn("key", F.regexp_replace(F.regexp_replace("channel", r"\+.*", ""), r"^body:.*", "body"))).alias("r")
    rows = rows.select("page_id", F.substring("body", 1, 8000).alias("body"), F.explode("c").alias("c"))
    hit = F.when(both, (F.col("c.value") != "") & F.rlike("body", F.col("r.pattern"))).otherwise(F.rlike("c.value", F.col("r.pattern")))
    hits = rows.join(keyed, (F.col("c.channel") == F.col("r.key")) & hit).select("page_id", "provider_ord", "provider", "rule_ord", "strength", "label").distinct()
    hits = hits.withColumn("points", F.when(F.col("strength") == "strong", 55).otherwise(25))
    rows = hits.groupBy("page_id", "provider_ord", "provider").agg(scoring.saturating(scoring.in_order("points", "rule_ord")).alias("score"), F.max((F.col("strength") == "strong").cast("int")).alias("strong"), F.array_join(scoring.in_order("label", "rule_ord"), " | ").alias("evidence"))
    best = rows.where((F.col("score") >= threshold) & (F.col("strong") == 1)).groupBy("page_id").agg(F.min(F.struct(-F.col("score"), "provider_ord", "provider", "score", "evidence")).alias("b"))
    return best.select("page_id", F.col("b.provider").alias("provider"), (F.least(F.lit(98), F.col("b.score")) / 100).alias("confidence"), F.col("b.evidence").alias("evidence"))


def extracted_ids(captures: DataFrame, rules: DataFrame, limit: int = 10) -> DataFrame:
    """Identifiers of a page's tools in resources and code, each once, at most ten a technology."""
    html = F.coalesce("html", F.lit(""))
    code = F.concat(inline_scripts(html), "bundles")
    asked = F.coalesce("requests", F.array().cast("array<string>")) if "requests" in captures.columns else F.array().cast("array<string>")
    text = captures.select("page_id", F.lit("text").alias("channel"), F.array_join(F.concat(resource_urls(html), asked, code), "\n").alias("text")).where("text <> ''")
    found = text.join(small(rules.withColumn("channel", F.lit("text"))), "channel").select("page_id", "tech_id", "rule_ord", "kind", F.posexplode(F.regexp_extract_all("text", F.col("pattern"), F.lit(1))).alias("at", "value"))
    given = captures.select("page_id", F.posexplode("containers.id").alias("at", "value")).select("page_id", F.lit("google-tag-manager").alias("tech_id"), F.lit(-1).alias("rule_ord"), F.lit("GTM container ID").alias("kind"), "at", "value")
    rows = given.unionByName(found).withColumn("value", F.trim("value")).where((F.col("value") != "") & (F.length("value") <= 128))
    rows = rows.where(~((F.col("kind") == "GTM container ID") & (~F.col("value").rlike("^GTM-[A-Z0-9]{4,15}$"))) & ~((F.col("kind") == "GA4 measurement ID") & ~F.col("value").rlike("^G-[A-Z0-9]{4,15}$")))
    first = rows.groupBy("page_id", "tech_id", "kind", "value").agg(F.min(F.struct("rule_ord", "at")).alias("k"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("page_id", "tech_id").orderBy("k"))).where(F.col("place") <= limit).select("page_id", "tech_id", "place", "kind", "value")


def rate_limited(hits: DataFrame, most: int = 30, seconds: int = 60) -> DataFrame:
    """Each hit (key, at) with the number of its key's hits in the last `seconds` and whether it exceeds `most`.

    A key's time is cut into stretches of `seconds`; a hit also stands in the next stretch, where it is only counted, so
    a busy key is spread over its stretches.
    """
    span = seconds * 1_000_000
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    columns = hits.columns
    rows = hits.withColumn("_at", micros).withColumn("_of", F.floor(F.col("_at") / span))
    rows = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_more")).withColumn("_stretch", F.col("_of") + F.col("_more"))
    window = Window.partitionBy("key", "_stretch").orderBy("_at").rangeBetween(-span + 1, 0)
    rows = rows.withColumn("recent", F.count("*").over(window)).where("_more = 0")
    return rows.select(*columns, "recent").withColumn("limited", F.col("recent") > most)
