"""Pages meet rules: long channels joined with a broadcast rule table.

One automaton for each channel holds the fixed texts of all its rules.  It runs over a text once and names the rules of
which some alternative has all its fixed texts there, so the work does not grow with the number of rules; only these rules'
regular expressions are tried.  Rules without a fixed text are always tried, those of a header or probe on their own only.  Rule tables are broadcast because their size is checked
(`MAX_RULES`); a larger one is joined by channel as Spark sees fit.  Of several values of a channel that match, the first
one counts.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import channels as ch
from pagelens.operators.catalogue import needles, requirements
from pagelens.sources.captures import seen_html

MAX_RULES = 20_000
#: Fixed texts of a channel that are looked for one by one.
FEW = 4
#: Containers of a page, and characters of one, that are looked at.
MAX_CONTAINERS, MAX_CONTAINER = 3, 400_000
#: Fixed value: characters of a probe's answer that are looked at.
MAX_PROBE = 50_000
#: What a hit keeps of its rule.
RULE = ["tech_ord", "tech_id", "tech_name", "category", "excludes", "min_families", "sig_ord", "type", "weight", "strength", "family", "specificity", "description"]
NO_STRUCTS = "array<struct<channel:string,name:string,ord:int,value:string,alt:string>>"


def small(rules: DataFrame) -> DataFrame:
    return F.broadcast(rules) if rules.limit(MAX_RULES + 1).count() <= MAX_RULES else rules


#: A place, and of an alternative of a rule there its key text, all texts that it needs, the one that it begins with, and the rule's number.
Fixed = tuple[str, str, frozenset[str], str, int]


@functools.lru_cache(maxsize=8)
def automata(fixed: tuple[Fixed, ...]) -> dict[str, tuple[ahocorasick.Automaton, dict[str, list[tuple]]]]:
    """By place the automaton of its fixed texts, and by key text what the alternatives of rules need."""
    by: dict[str, dict[str, list]] = defaultdict(lambda: defaultdict(list))
    for place, key, *rest in fixed:
        by[place][key].append(rest)
    made = {}
    for place, keys in by.items():
        automaton = ahocorasick.Automaton()
        for text in {t for rules in keys.values() for needed, _, _ in rules for t in needed}:
            automaton.add_word(text, text)
        automaton.make_automaton()
        made[place] = automaton, dict(keys)
    return made


def matches_from(keys: dict[str, list[tuple]], first: dict[str, int]) -> dict[int, int]:
    """The rules that may match a text, each with the number of characters before which no match begins; `first` says where the fixed texts stand."""
    found = {}
    for key in first:
        for needed, begins, number in keys.get(key, ()):
            if needed <= first.keys():
                start = first[begins] if begins else 0
                found[number] = min(start, found.get(number, start))
    return found


def rules_for(texts: DataFrame, rules: DataFrame, text: str, named: tuple[str, ...] = ()) -> DataFrame:
    """`texts` (alias c, with `channel`) with the rules (alias r) of their channel whose fixed texts the column `text` may hold.

    Of the text, `rest` is what lies behind the first `skipped` characters, in which no match of the rule begins.  Rules have
    `channel`, `pattern` and, where they were worked out before, `needles`.  In channels that are `named`, a rule's `header` must
    be a text's `name`.
    """
    lower = F.lower(text)
    place_of = lambda channel, name: f"{channel} {name}" if channel in named else channel
    rows = rules.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        return texts.withColumns({"skipped": F.lit(0), "rest": F.col(text)}).alias("c").join(rules.alias("r"), F.col("c.channel") == F.col("r.channel"))
    fixed, always = [], defaultdict(list)
    for number, rule in enumerate(rows):
        own, place = needles(rule["pattern"]), place_of(rule["channel"], rule["header"] if named else "")
        known = (rule["needles"] if "needles" in rules.columns else None) or own
        # Texts that a caller gave count by themselves; of the pattern's own, a match needs all of an alternative.
        fixed += [(place, *wanted, number) for wanted in (requirements(rule["pattern"]) if sorted(known) == own else [(t, frozenset([t]), "") for t in known])]
        if not known:
            always[place].append(number)
    fixed, always = tuple(fixed), dict(always)

    @F.arrow_udf("map<int,int>")
    def candidates(place: pa.Array, low: pa.Array) -> pa.Array:
        made, out = automata(fixed), []
        for name, value in zip(place.to_pylist(), low, strict=True):
            found = {}
            if name in made:
                (automaton, keys), value, first = made[name], value.as_py() or "", {}
                for end, t in automaton.iter(value):
                    if t not in first:
                        first[t] = end + 1 - len(t)
                found = matches_from(keys, first) if first else {}
                # The only letter that lower case makes longer; places are not those of the text then.
                if found and "\u0307" in value:
                    found = dict.fromkeys(found, 0)
            out.append(sorted((found | dict.fromkeys(always.get(name, ()), 0)).items()))
        return pa.array(out, pa.map_(pa.int32(), pa.int32()))

    table = rules.sparkSession.createDataFrame([(n, *r) for n, r in enumerate(rows)], f"rule_number int, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rules.schema)}")
    channel = F.col("channel")
    place = F.when(channel.isin(*named), F.concat(channel, F.lit(" "), "name")).otherwise(channel) if named else channel
    asked = texts.withColumn("_place", place).where(F.col("_place").isin(*{place_of(r["channel"], r["header"] if named else "") for r in rows}))
    # Where a channel's rules need one of a few texts, most values end here and never leave the JVM.
    for name in {f[0] for f in fixed} - set(always):
        few = sorted({key for p, key, *_ in fixed if p == name})
        if len(few) <= FEW:
            asked = asked.where((F.col("_place") != name) | reduce(lambda a, b: a | b, (lower.contains(text) for text in few)))
    met = asked.select(*texts.columns, F.explode(candidates("_place", lower)).alias("rule_number", "skipped"))
    met = met.withColumn("rest", F.when(F.col("skipped") > 0, F.substr(text, F.col("skipped") + 1)).otherwise(F.col(text)))
    return met.alias("c").join(F.broadcast(table).alias("r"), F.col("c.rule_number") == F.col("r.rule_number"))


def icase(pattern: Column) -> Column:
    return F.concat(F.lit("(?i)"), pattern)


def _rows(channel: str, values: Column, name=None, value=None, alt=None) -> Column:
    """Channel rows from an array; `name`, `value` and `alt` pick from its elements."""
    none = F.lit(None).cast("string")
    return F.transform(F.coalesce(values, F.array()), lambda x, i: F.struct(F.lit(channel).alias("channel"), (name(x) if name else F.lit("")).alias("name"), i.alias("ord"), (value(x) if value else x).alias("value"), (alt(x) if alt else none).alias("alt"))).cast(NO_STRUCTS)


def core_channels(captures: DataFrame, asked: set[str] | None = None) -> DataFrame:
    """(page_id, channel, name, ord, value, alt): what core rules look at, or only the channels that are `asked`."""
    captures = captures.withColumn("html", F.coalesce(seen_html(), F.lit("")))
    html = F.col("html")
    channels = {
        "generator": lambda x: _rows(x, F.when(F.lower(html).contains("generator"), ch.every(html, ch.GENERATOR))),
        "usage": lambda x: _rows(x, F.array(ch.usage_html(html))),
        "raw": lambda x: _rows(x, F.array(html)),
        "resource": lambda x: _rows(x, ch.resource_refs(html), name=lambda x: F.concat(x["tag"], F.lit("["), x["attr"], F.lit("]")), value=lambda x: x["src"]),
        "href": lambda x: _rows(x, ch.every(html, ch.HREF)),
        "link": lambda x: _rows(x, ch.link_pairs(html), name=lambda x: x["rel"], value=lambda x: x["href"]),
        "meta": lambda x: _rows(x, ch.meta_pairs(html), name=lambda x: x["name"], value=lambda x: x["content"], alt=lambda x: F.concat(x["name"], F.lit("="), x["content"])),
        "header": lambda x: _rows(x, F.map_entries(ch.lowered_headers(F.col("headers"))), name=lambda x: x["key"], value=lambda x: x["value"]),
        "cookie": lambda x: _rows(x, F.col("cookies")),
        "probe": lambda x: _rows(x, F.map_entries("probes"), name=lambda x: x["key"], value=lambda x: F.substring(x["value"], 1, MAX_PROBE)),
    }
    every = F.concat(*(make(name) for name, make in channels.items() if asked is None or name in asked), F.array().cast(NO_STRUCTS))
    return captures.select("page_id", F.explode(every).alias("c")).select("page_id", "c.*").where(F.rlike("value", F.lit(r"\S")))


def with_vetoes(rules: DataFrame) -> DataFrame:
    """The rules and, for each technology with a veto, one more that looks for it in the raw HTML."""
    veto = rules.where("veto <> ''").dropDuplicates(["tech_id"]).withColumns({"type": F.lit("veto"), "channel": F.lit("raw"), "pattern": F.col("veto"), "sig_ord": F.lit(-1), "needles": F.array().cast("array<string>")})
    return rules.unionByName(veto)


def core_evidence(captures: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each page, technology and signal that matches, in one pass over the pages.

    A probe's success text counts only where another signal of the technology matches; a veto on the raw HTML removes
    the technology.  Patterns that need a fixed text are tried only on values that contain it.
    """
    rules = with_vetoes(rules)
    some = rules.select("channel").limit(MAX_RULES + 1).collect()
    met = rules_for(core_channels(captures, {r["channel"] for r in some} if len(some) <= MAX_RULES else None), rules, "value", ("header", "probe"))
    named = ~F.col("r.channel").isin("header", "probe") | (F.col("r.header") == F.col("c.name"))
    plain = F.col("r.channel") == "probe"
    pattern = icase(F.col("r.pattern"))
    hit = F.when(plain, F.col("c.value").contains(F.col("r.pattern"))).otherwise(F.rlike("c.rest", pattern) | F.coalesce(F.rlike("c.alt", pattern), F.lit(False)))
    rows = met.where(named & hit)
    # A long text is searched once more for the place and the words of its hit, however often these are shown.
    usage = F.col("r.type").isin(*USAGE)
    rows = rows.withColumns({"at": F.when(usage, F.col("c.skipped") + F.regexp_instr("c.rest", pattern)), "marker": F.when(usage, F.substring(F.regexp_substr("c.rest", pattern), 1, 80))})
    # What is kept of a hit is a few short texts; the page's own text ends here and meets no shuffle.
    short = rows.select("page_id", *(f"r.{x}" for x in RULE), "c.ord", *_texts())
    # Dealt by page once, for all that follows by page and technology.
    first = short.repartition("page_id").groupBy("page_id", *RULE).agg(F.min(F.struct("ord", "name", "value", "artifact", "version")).alias("hit"))
    tech = Window.partitionBy("page_id", "tech_id")
    # Correlated hits of one family are not enough where a technology asks for several.
    of = {"vetoed": F.max((F.col("type") == "veto").cast("int")).over(tech), "seen": F.max((~F.col("type").isin("probe", "veto")).cast("int")).over(tech), "families": F.size(F.collect_set("family").over(tech))}
    first = first.withColumns(of).where("vetoed = 0 and seen = 1 and families >= min_families")
    return first.select("page_id", "tech_ord", "tech_id", "tech_name", "category", "excludes", "sig_ord", "type", "hit.name", "hit.value", "hit.artifact", "hit.version", "weight", "strength", "family", "specificity", "description")


#: Types of rules that look into the whole text of a page.
USAGE = ("html-path", "html-regex", "js-global", "inline-script")


def _texts() -> list[Column]:
    """Name, value, artifact and version of a hit of rule r on value c, with its place `at` and `marker` in a long text."""
    value, kind, name, marker = F.col("c.value"), F.col("r.type"), F.col("c.name"), F.col("marker")
    pattern = icase(F.col("r.pattern"))
    usage = kind.isin(*USAGE)
    start = F.greatest(F.lit(0), F.col("at") - 1 - 24)
    length = F.col("at") - 1 + 56 - start
    context = F.substring(F.trim(F.regexp_replace(F.substring(value, start + 1, length), r"\s+", " ")), 1, 80)
    cut = F.substring(value, 1, 120)
    host = F.lower(F.regexp_extract(value, r"^(?i:https?:)?//([^/?#:]+)", 1))
    quote = lambda label, x: F.concat(label, F.lit(': "'), x, F.lit('"'))
    shown_name = F.when(usage, marker).when(kind == "script-host", F.when(host != "", host).otherwise(F.col("r.pattern"))).when(kind == "meta-generator", "generator").when(kind.isin("stylesheet-url", "link-relation"), F.substring(value, 1, 80)).when(kind == "meta-tag", name).when(kind == "cookie-name", value).otherwise(F.col("r.header"))
    shown = F.when(usage, F.when(context == "", marker).otherwise(context)).when(kind == "probe", F.concat(F.lit("success signal "), F.col("r.pattern"))).when(kind == "cookie-name", value).otherwise(cut)
    artifact = (
        F.when(usage, quote(F.lit("html"), marker)).when(kind == "script-host", quote(name, cut)).when(kind == "meta-generator", quote(F.lit("meta[generator]"), value)).when(kind == "stylesheet-url", quote(F.lit("stylesheet"), cut))
        .when(kind == "link-relation", quote(F.concat(F.lit("link["), name, F.lit("]")), cut)).when(kind == "meta-tag", quote(F.concat(F.lit("meta["), name, F.lit("]")), cut)).when(kind == "header", quote(F.concat(F.lit("header["), F.col("r.header"), F.lit("]")), cut))
        .when(kind == "cookie-name", quote(F.lit("cookie"), value)).otherwise(F.concat(F.lit("probe["), F.col("r.header"), F.lit("]")))
    )
    version = F.when(F.col("r.version_group").isNotNull() & kind.isin("meta-generator", "header"), F.call_function("regexp_extract", value, pattern, F.coalesce("r.version_group", F.lit(0))))
    given = kind != "veto"
    return [F.when(given, shown_name).alias("name"), F.when(given, shown).alias("value"), F.when(given, artifact).alias("artifact"), F.when(given & (version != ""), version).alias("version")]


#: Where rules of the growth and security tables look, in order; from `weak` channels a hit is header-only.
GROWTH_LOOK = {"script-host": ["resource", "code", "weak"], "sdk-init": ["global"], "dom": ["dom", "attr", "code"], "cookie-storage": ["cookie"]}
SECURITY_LOOK = {"script-host": ["resource", "weak"], "network-host": ["resource", "weak"], "iframe": ["iframe", "comments"], "sdk-init": ["global"], "runtime-global": ["global"], "dom": ["dom", "code"], "cookie-storage": ["cookie"]}
WEAK = ("weak", "comments")


#: What a rendered pass adds to pages, each as a channel of its own; a catalogue names them in its rules' places.
RENDERED = {"globals": "globals", "network": "requests", "storage": "storage_keys"}


def limited(containers: Column) -> Column:
    """The first containers of a page, each cut."""
    return F.transform(F.slice(containers, 1, MAX_CONTAINERS), lambda c: F.struct(c["id"].alias("id"), F.substring(c["js"], 1, MAX_CONTAINER).alias("js")))


def haystacks(captures: DataFrame, channels: dict[str, Column] | None = None, asked: set[str] | None = None) -> DataFrame:
    """One text for each page and channel; container scripts, sanitised, as channel `container` with their id.

    Addresses that a rendered page asked for count among its resources, its globals among its code, its storage keys among
    its cookies.  `channels` adds texts of other columns under names that a catalogue's rules may look at.
    With `asked`, other channels than these and the containers are left out.
    """
    html, none = F.coalesce(seen_html(), F.lit("")), F.array().cast("array<string>")
    given = {c: F.coalesce(F.col(c), none) if c in captures.columns else none for c in RENDERED.values()}
    more = {name: F.array_join(given[c], "\n") for name, c in RENDERED.items()} | (channels or {})
    page = captures.select("page_id", html.alias("html"), ch.lowered_headers(F.col("headers")).alias("headers"), "cookies", "bundles", limited(F.col("containers")).alias("containers"), *(v.alias(c) for c, v in given.items()), *(v.alias(f"_{name}") for name, v in more.items()))
    page = page.select("*", F.array_join(F.concat(ch.inline_scripts(F.col("html")), "bundles"), "\n").alias("code"), F.array_join(ch.ids_and_classes(F.col("html")), " ").alias("dom"), F.array_join(ch.every(F.col("html"), ch.COMMENT), "\n").alias("comments"), ch.loaded_refs(F.col("html")).alias("loaded"))
    html = F.col("html")
    loaded = F.col("loaded")
    texts = {
        "resource": F.array_join(F.concat(ch.resource_urls(html, loaded), "requests"), "\n"), "code": F.col("code"), "global": F.array_join(F.concat("globals", F.array("code")), "\n"), "dom": F.col("dom"), "attr": F.array_join(F.concat(ch.attribute_hooks(html), F.array("dom")), "\n"), "cookie": F.array_join(F.concat("cookies", "storage_keys"), " "),
        "comments": F.col("comments"), "weak": F.concat(F.coalesce(F.col("headers")["content-security-policy"], F.lit("")), F.lit("\n"), "comments"), "iframe": F.array_join(ch.iframe_srcs(html, loaded), "\n"),
    }
    all_ = [*texts.items(), *((name, F.coalesce(F.col(f"_{name}"), F.lit(""))) for name in more)]
    texts = F.array(*(F.struct(F.lit(name).alias("channel"), F.lit("").alias("name"), text.alias("text")) for name, text in all_ if asked is None or name in asked)).cast("array<struct<channel:string,name:string,text:string>>")
    inside = F.transform("containers", lambda c, i: F.struct(F.lit("container").alias("channel"), F.concat(F.lpad(i.cast("string"), 4, "0"), F.lit(" "), c["id"]).alias("name"), ch.sanitised(c["js"]).alias("text")))
    return page.select("page_id", F.explode(F.concat(texts, inside)).alias("c")).select("page_id", "c.*").where("text <> ''")


def type_hits(captures: DataFrame, rules: DataFrame, look: dict[str, list[str]], in_containers: tuple[str, ...], channels: dict[str, Column] | None = None) -> DataFrame:
    """One row for each page, technology and rule that matches: type, weight, header_only, container.

    `look` says where rules of a type look, in order; with a type of its own there, and `channels` for what no page has yet, a
    catalogue looks at anything that captures hold.
    """
    return _hits(captures, _placed(rules, look, in_containers), {c for cs in look.values() for c in cs}, channels)


def catalogue_hits(captures: DataFrame, catalogues: dict[str, tuple[DataFrame, dict[str, list[str]], tuple[str, ...]]]) -> DataFrame:
    """The `type_hits` of several catalogues (rules, look, in_containers), which the column `catalogue` names; the pages are looked at once for all."""
    placed = reduce(DataFrame.unionByName, [_placed(*given).withColumn("catalogue", F.lit(name)) for name, given in catalogues.items()])
    return _hits(captures, placed, {c for _, look, _ in catalogues.values() for cs in look.values() for c in cs})


def _placed(rules: DataFrame, look: dict[str, list[str]], in_containers: tuple[str, ...]) -> DataFrame:
    """The rules, each with the channels in which it looks and their places in that order."""
    places = [(t, c, i) for t, cs in look.items() for i, c in enumerate(cs)] + [(t, "container", 90) for t in in_containers]
    where = rules.sparkSession.createDataFrame(places, "type string, channel string, place int")
    return rules.join(F.broadcast(where), "type").where("channel <> 'container' or weight >= 0.35")


def _hits(captures: DataFrame, placed: DataFrame, asked: set[str], channels: dict[str, Column] | None = None) -> DataFrame:
    """The hits of rules that know their channels, of which `asked` are those of pages."""
    own = [c for c in ("catalogue",) if c in placed.columns]
    hits = rules_for(haystacks(captures, channels, asked), placed, "text").where(F.rlike("c.rest", icase(F.col("r.pattern"))))
    detail = F.when(F.col("c.channel") == "container", F.concat(F.lit("Found in GTM container "), F.substring("c.name", 6, 200), F.lit(": "), "description")).otherwise(F.col("description"))
    hits = hits.withColumn("matched", F.regexp_substr("c.rest", icase(F.col("r.pattern"))))
    found = snippet(F.col("matched"))
    hits = hits.select("page_id", *own, "tech_ord", "tech_id", "tech_name", "category", "rule_ord", "type", "weight", "product", "launch_only", detail.alias("detail"), found.alias("value"), "place", F.col("c.channel").alias("channel"), F.col("c.name").alias("container"))
    # A rule counts once, where it is found first; a container once for each technology, by its first rule.
    inside = F.col("channel") == "container"
    order = F.when(inside, F.col("rule_ord")).otherwise(F.col("place"))
    unit = F.when(inside, F.col("container")).otherwise(F.col("rule_ord").cast("string"))
    first = hits.groupBy("page_id", *own, "tech_ord", "tech_id", "tech_name", "category", unit.alias("unit")).agg(F.min(F.struct(order.alias("order"), "rule_ord", "type", "weight", "product", "launch_only", "detail", "value", "channel", "container")).alias("f"))
    inside = F.col("f.channel") == "container"
    return first.select(
        "page_id", *own, "tech_ord", "tech_id", "tech_name", "category", F.when(inside, F.lit(1000) + F.substring("f.container", 1, 4).cast("int")).otherwise(F.col("f.rule_ord")).alias("rule_ord"), F.when(inside, "via-gtm").otherwise(F.col("f.type")).alias("type"), F.when(inside, 0.7).otherwise(F.col("f.weight")).alias("weight"), "f.product",
        F.col("f.channel").isin(*WEAK).alias("header_only"), "f.launch_only", "f.detail", "f.value", F.when(inside, F.substring("f.container", 6, 200)).alias("container"),
    )


def snippet(found: Column) -> Column:
    """What a pattern matched, on one line and cut at 140 characters."""
    flat = F.trim(F.regexp_replace(found, r"\s+", " "))
    return F.when(F.length(flat) > 140, F.concat(F.substring(flat, 1, 137), F.lit("…"))).otherwise(flat)


def with_default(hits: DataFrame, pages: DataFrame, tech: tuple, weight: float, **of: str) -> DataFrame:
    """A script-host hit of a technology (tech_ord, tech_id, tech_name, category) for pages with containers and no direct one; `of` is the catalogue, where hits name it."""
    ids = F.array_join(F.transform("containers", lambda c: c["id"]), ", ")
    more = [F.lit(500).alias("rule_ord"), F.lit("script-host").alias("type"), F.lit(weight).alias("weight"), F.lit("").alias("product"), F.lit(False).alias("header_only"), F.lit(False).alias("launch_only"), F.concat(F.lit(tech[2] + " container ("), ids, F.lit(") deployed")).alias("detail"), F.get("containers", 0)["id"].alias("value"), F.lit(None).cast("string").alias("container")]
    given = pages.where(F.size("containers") > 0).select("page_id", *(F.lit(v).alias(n) for n, v in zip(("tech_ord", "tech_id", "tech_name", "category"), tech, strict=True)), *(F.lit(v).alias(n) for n, v in of.items()), *more)
    both = hits.withColumn("default", F.lit(0)).unionByName(given.withColumn("default", F.lit(1)))
    direct = F.max(((F.col("default") == 0) & (F.col("type") != "via-gtm")).cast("int")).over(Window.partitionBy("page_id", "tech_id", *of))
    return both.withColumn("direct", direct).where("default = 0 or direct = 0").drop("default", "direct")
