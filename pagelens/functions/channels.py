"""What detection rules look at: the channels of a page, as column expressions over its HTML and headers.

Extraction is by regular expressions, without a document tree; all are case-insensitive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.urls import bound

#: The patterns of the channels.
RESOURCE = r"""(?i)<(script|iframe|img|source|video|audio|embed|track|link|form)[^>]+?(?:src|href|action|data-src)=["']([^"']+)["']"""
LOADED = r"""(?i)<(script|iframe|img|source|video|audio|embed|track|link|form)[^>]*?(?:src|href|action|data-src|data-href)\s*=\s*["']([^"']+)["']"""
SRCSET = r"""(?i)<(?:img|source|video)[^>]*?srcset=["']([^"']+)["']"""
GENERATOR = r"""(?i)<meta[^>]+name=["']generator["'][^>]+content=["']([^"']+)["']"""
META = r"""(?i)<meta[^>]+(?:name|property|itemprop)=["']([^"']+)["'][^>]+content=["']([^"']+)["']"""
REL_HREF = r"""(?i)<link[^>]+rel=["']([^"']+)["'][^>]*href=["']([^"']+)["']"""
HREF_REL = r"""(?i)<link[^>]+href=["']([^"']+)["'][^>]*rel=["']([^"']+)["']"""
HREF = r"""(?i)<link[^>]+href=["']([^"']+)["']"""
ANCHOR = r"""(?i)<a[^>]+href=["']([^"'#]+)["']"""
SCRIPT = r"(?is)<script(?![^>]*\bsrc\s*=)[^>]*>(.*?)</script\s*>"
IDS, CLASSES, SITEKEYS = (rf"""(?i)\b{name}\s*=\s*["']([^"']+)["']""" for name in ("id", "class", "data-sitekey"))
COMMENT = r"(?s)<!--(.*?)-->"
STYLE, FENCE, JSON_LD = r"(?is)<style[^>]*>(.*?)</style\s*>", r"(?s)```.*?```", r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>.*?</script\s*>"""
SAMPLES = "(?is)<(style|pre|code)[\\s>].*?</\\1\\s*>"
SAMPLE_BOX = r"""(?is)<(div|figure)[^>]*class=["'][^"']*(code-wrapper|codeblock|code-sample|gatsby-highlight|prettyprint|codehilite|highlighter-|(?<=["'\s])highlight(?=["'\s]))[^"']*["'][^>]*>.*?</\1\s*>"""
#: What is no part of a page's use, and texts of which every match of the pattern holds one.
BOXES = {SAMPLES: ("<style", "<pre", "<code"), FENCE: ("```",), JSON_LD: ("application/ld+json",), SAMPLE_BOX: ("code-wrapper", "codeblock", "code-sample", "prettyprint", "codehilite", "highlight")}
DATA_ATTRIBUTE, CUSTOM_ELEMENT = r"""(?i)\bdata-[a-z-]+\s*=\s*["'][^"']*["']""", r"(?i)<([a-z]+-[a-z0-9-]+)(?=[\s/>])"
NOT_LOADED = ("data:", "blob:", "javascript:")
NONE = "array<string>"


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def pairs(text: Column, pattern: str, first: str, second: str) -> Column:
    """Groups 1 and 2 of each match, as structs; the text is searched once, and the groups are found in its short matches.

    So a pattern must not look behind or ahead of its match.
    """
    return F.transform(every(text, pattern, 0), lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias(first), F.regexp_extract(x, pattern, 2).alias(second)))


def without(text: Column, *patterns: str) -> Column:
    """A text without what some of `BOXES` match, one after the other; only where it has what every match holds is it searched."""
    both = lambda t: F.struct(t.alias("text"), F.lower(t).alias("low"))

    def step(pattern: str):
        held = lambda low: reduce(lambda a, b: a | b, (low.contains(m) for m in BOXES[pattern]))
        return lambda x: F.when(held(x["low"]), bound(F.regexp_replace(x["text"], pattern, ""), both)).otherwise(x)

    return reduce(lambda state, pattern: bound(state, step(pattern)), patterns, both(text))["text"]


def lowered_headers(headers: Column) -> Column:
    """Names in lower case; of several that then agree the first in alphabetical order stays."""
    sorted_ = F.array_sort(F.map_entries(F.coalesce(headers, F.from_json(F.lit("{}"), "map<string,string>"))))
    names = F.array_distinct(F.transform(sorted_, lambda e: F.lower(e["key"])))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.get(F.filter(sorted_, lambda e: F.lower(e["key"]) == n), 0)["value"])))


def _kept(url: Column) -> Column:
    out = url != ""
    for prefix in NOT_LOADED:
        out = out & ~url.startswith(prefix)
    return out


def resource_refs(html: Column) -> Column:
    """Array of (tag, attr, src)."""
    refs = F.filter(pairs(html, RESOURCE, "tag", "src"), lambda x: _kept(x["src"]))
    return F.transform(refs, lambda x: F.struct(F.lower(x["tag"]).alias("tag"), F.when(F.lower(x["tag"]) == "link", "href").when(F.lower(x["tag"]) == "form", "action").otherwise("src").alias("attr"), x["src"].alias("src")))


def usage_html(html: Column) -> Column:
    """HTML without styles, code samples, fences and JSON-LD."""
    return without(html, *BOXES)


def loaded_refs(html: Column) -> Column:
    return F.filter(pairs(html, LOADED, "tag", "src"), lambda x: _kept(x["src"]))


def resource_urls(html: Column, loaded: Column | None = None) -> Column:
    """Addresses that a page loads; `loaded` are its `loaded_refs`, where they are known."""
    sets = F.flatten(F.transform(every(html, SRCSET), lambda s: F.transform(F.split(s, ","), lambda p: F.get(F.split(F.trim(p), r"\s+"), 0))))
    return F.concat(F.transform(loaded_refs(html) if loaded is None else loaded, lambda x: x["src"]), F.filter(sets, lambda u: (u != "") & ~u.startswith("data:")))


def iframe_srcs(html: Column, loaded: Column | None = None) -> Column:
    return F.transform(F.filter(loaded_refs(html) if loaded is None else loaded, lambda x: F.lower(x["tag"]) == "iframe"), lambda x: x["src"])


def inline_scripts(html: Column) -> Column:
    return F.filter(every(without(html, SAMPLES, FENCE, JSON_LD), SCRIPT), lambda s: F.regexp_replace(s, r"\s+", "") != "")


def meta_pairs(html: Column) -> Column:
    return pairs(html, META, "name", "content")


def link_pairs(html: Column) -> Column:
    """(rel, href) of links with rel first, then of those with href first."""
    return F.concat(pairs(html, REL_HREF, "rel", "href"), F.transform(pairs(html, HREF_REL, "href", "rel"), lambda x: F.struct(x["rel"].alias("rel"), x["href"].alias("href"))))


def ids_and_classes(html: Column) -> Column:
    return F.concat(every(html, IDS), every(html, CLASSES))


def attribute_hooks(html: Column) -> Column:
    return F.concat(every(html, DATA_ATTRIBUTE, 0), every(html, CUSTOM_ELEMENT), F.transform(every(html, STYLE), lambda s: F.substring(s, 1, 20_000)))


def cookie_names(set_cookie: Column) -> Column:
    """Names from a joined Set-Cookie header; a comma parts cookies only where a name and = follow at once."""
    parts = F.split(set_cookie, r",(?=[^;,=\s]+\s*=)")
    return F.filter(F.transform(parts, lambda x: F.trim(F.get(F.split(F.get(F.split(x, ";"), 0), "="), 0))), lambda x: x != "")


def framework_data(html: Column) -> Column:
    """Map of the embedded state of three frameworks, each cut at 10,000 characters."""
    found = {
        "__NEXT_DATA__": F.regexp_extract(html, r"""(?is)<script\s+[^>]*id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>""", 1),
        "__NUXT__": F.regexp_extract(html, r"(?is)window\.__NUXT__\s*=\s*(\{.*?\});", 1),
        "__remixContext": F.regexp_extract(html, r"(?is)window\.__remixContext\s*=\s*(\{.*?\});", 1),
    }
    entries = F.array(*(F.struct(F.lit(k).alias("key"), F.substring(v, 1, 10_000).alias("value")) for k, v in found.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] != ""))


def meta_refresh(html: Column) -> Column:
    target = F.trim(F.regexp_extract(html, r"""(?i)<meta\s+[^>]*http-equiv=["']refresh["'][^>]*content=["'][0-9]+;\s*url=([^"']+)["']""", 1))
    return F.when(target != "", target)


def text_length(html: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", ""), r"<[^>]+>", "")
    return F.length(F.regexp_replace(text, r"^\s+|\s+$", ""))


def is_shell(html: Column) -> Column:
    """Whether scripts must still build the page."""
    return (text_length(html) < 200) | html.rlike(r"""(?i)<div[^>]+id=["'](?:root|app)["']>\s*</div>""") | html.rlike(r"(?i)<body>\s*</body>")


def container_ids(text: Column) -> Column:
    return F.array_distinct(every(text, "GTM-[A-Z0-9]+", 0))


def loader_ids(text: Column) -> Column:
    """Ids of tag loaders: (G-…), (AW-…), (GT-…) or (UA-…), in order of appearance."""
    return F.array_distinct(every(text, r"(?i)googletagmanager\.com/gtag/js\?id=(G-[A-Z0-9]+|AW-[A-Z0-9/_-]+|GT-[A-Z0-9]+|UA-[0-9]+-[0-9]+)"))


#: What a page or script shows of tools that load on a server.
SERVER_SIDE = ["/cdn-cgi/zaraz/", "zaraz.track", "sgtm.", "/g/collect?"]


def server_side(html: Column, bundles: Column) -> Column:
    """Whether tools may load on a server, by the first 200,000 characters of the page and of its bundles."""
    text = F.lower(F.concat(F.substring(F.coalesce(html, F.lit("")), 1, 200_000), F.lit("\n"), F.substring(F.coalesce(F.array_join(bundles, "\n"), F.lit("")), 1, 200_000)))
    found = F.lit(False)
    for mark in SERVER_SIDE:
        found = found | text.contains(mark)
    return found


def sanitised(js: Column) -> Column:
    """A container without tag names and comments (possessive, so long strings need no deep stack)."""
    js = F.regexp_replace(js, r'"name"\s*:\s*"(?:[^"\\]++|\\.)*+"', '"name":""')
    js = F.regexp_replace(js, r"(?s)/\*.*?\*/", " ")
    return F.regexp_replace(js, r"(^|[^:/])//[^\n]*", "$1 ")
