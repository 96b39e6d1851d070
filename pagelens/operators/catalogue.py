r"""Rule tables.  A catalogue is data: pass your own as a DataFrame of the same columns, or read one from JSON.

`read_catalogue` takes core catalogues of any size (an array of technologies with `id`, `name`, `category`, `signals`, and
optional `probes`, `excludes`, `negative`, `minFamilies`); `read_rules` and `read_ids` growth and security catalogues,
`read_protection` providers.  The package brings its own as JSON: the growth and the security catalogue, the providers, and
a starter set of core technologies.
"""

from __future__ import annotations

import functools
import json
import re
from functools import reduce
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROWTH_CATEGORIES = ["analytics", "advertising", "marketing", "payments", "chat"]
SECURITY_CATEGORIES = ["privacy", "security", "other"]

FAMILY = {"header": "NETWORK", "cookie-name": "COOKIE", "meta-generator": "META", "meta-tag": "META", "script-host": "SCRIPT", "js-global": "SCRIPT", "stylesheet-url": "ASSET", "html-path": "ASSET", "inline-script": "HTML", "html-regex": "HTML", "link-relation": "HTML", "probe": "PLATFORM_IDENTIFIER"}
SPECIFICITY = {"definitive": 1.0, "strong": 0.7, "weak": 0.3}
CHANNEL = {"meta-generator": "generator", "html-path": "usage", "html-regex": "usage", "js-global": "usage", "inline-script": "usage", "script-host": "resource", "stylesheet-url": "href", "link-relation": "link", "meta-tag": "meta", "header": "header", "cookie-name": "cookie", "probe": "probe"}
DESCRIPTION = {"script-host": "resource URL detected", "stylesheet-url": "stylesheet detected", "link-relation": "linked resource detected", "header": "HTTP header detected", "cookie-name": "cookie detected", "meta-generator": "generator tag detected", "meta-tag": "meta tag detected", "js-global": "JavaScript global detected", "inline-script": "initialization code detected", "html-path": "asset path detected", "html-regex": "code signature detected", "probe": "endpoint responded"}
#: Error codes of a capture, their HTTP status and whether a retry may help.
ERRORS = [("INVALID_URL", 400, False), ("BLOCKED_TARGET", 403, False), ("TARGET_BLOCKED", 403, False), ("NOT_HTML", 422, False), ("RATE_LIMITED", 429, True), ("TIMEOUT", 504, True), ("DNS_FAILED", 502, True), ("TLS_ERROR", 502, False), ("HTTP_ERROR", 502, True), ("TOO_LARGE", 413, False), ("BUDGET_EXCEEDED", 429, False), ("INTERNAL", 500, False)]

CORE_SCHEMA = "tech_ord int, tech_id string, tech_name string, category string, excludes string, veto string, sig_ord int, type string, header string, weight int, strength string, version_group int, pattern string, channel string, family string, specificity double, description string, needles array<string>, min_families int"


def alternatives(pattern: str) -> list[str]:
    """The pattern cut at its top-level alternatives."""
    parts, start, depth, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = pattern.index("]", i + 2)
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def runs_of(pattern: str) -> list[str]:
    """Lower-case texts that every match of a pattern without top-level alternatives contains."""
    runs, run, i, depth = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            if pattern[i + 1] in "xu0ckNQ":
                raise ValueError("characters by number or name")
            literal, step = ("" if pattern[i + 1].isalnum() else pattern[i + 1]), 2
        elif c in "([{":
            close = {"(": ")", "[": "]", "{": "}"}[c]
            depth, end = 1, i + 1
            while end < len(pattern) and depth:
                if pattern[end] == "\\":
                    end += 2
                elif c == "(" and pattern[end] == "[":
                    end = pattern.index("]", end + 2) + 1
                else:
                    depth += (pattern[end] == c and c == "(") - (pattern[end] == close)
                    end += 1
            literal, step = "", end - i
        else:
            literal, step = ("" if c in "^$.*+?|)" else c), 1
        after = pattern[i + step : i + step + 1]
        if not literal or after in ("?", "*", "{"):
            runs.append(run)
            run = ""
        else:
            run += literal
        i += step
    return [r.lower() for r in (*runs, run)]


def needle(pattern: str) -> str:
    """The longest of these texts, or ''."""
    return max(runs_of(pattern), key=len)


def needles(pattern: str) -> list[str]:
    """Lower-case texts of which every match contains one; none if some alternative needs no fixed text."""
    try:
        found = [needle(p) for p in alternatives(pattern)]
    except (IndexError, ValueError):  # not a pattern
        return []
    return sorted(set(found)) if all(len(n) > 2 for n in found) else []


def requirements(pattern: str) -> list[tuple[str, frozenset[str], str]]:
    """For each alternative of a pattern with needles its needle, all lower-case texts that a match of it contains, and the one of them that it begins with, or ''."""
    if not needles(pattern):
        return []
    found = []
    for part in alternatives(pattern):
        runs = runs_of(part)
        # A pattern that looks behind may look at what stands before its match.
        begins = part[:1] not in ("(", "[") and runs[0] and "(?<" not in pattern and "\\G" not in pattern
        found.append((needle(part), frozenset(r for r in runs if len(r) > 2), runs[0] if begins and len(runs[0]) > 2 else ""))
    return found


@functools.lru_cache
def _technologies(name: str) -> list[dict]:
    """The technologies of a catalogue file that comes with the package."""
    return json.loads(resources.files("pagelens.catalogues").joinpath(f"{name}.json").read_text("utf-8"))["technologies"]


def core_rows() -> list[tuple]:
    """The core catalogue as rows of CORE_SCHEMA; a technology's probes stand where they come in the file's order."""
    rows = []
    for t, tech in enumerate(_technologies("core")):
        probes = [{"type": "probe", "name": p["path"], "pattern": p["successSignal"], "weight": p["weight"], "strength": "strong"} for p in tech.get("probes") or []]
        for k, s in enumerate([*tech["signals"], *probes]):
            kind, header, strength, pattern = s["type"], s.get("name") or "", s.get("strength") or "weak", s["pattern"]
            text = s.get("description") or f"{tech['name']} {DESCRIPTION[kind]}" + (f" ({header})" if kind == "header" and header else "")
            specificity = s.get("specificity", SPECIFICITY[strength])
            known = [pattern.lower()] if kind == "probe" else needles(pattern)
            rows.append((t, tech["id"], tech["name"], tech["category"], ",".join(tech.get("excludes") or []), "|".join(tech.get("negative") or []), k, kind, header.lower() if kind == "header" else header, s["weight"], strength, s.get("versionGroup"), pattern, CHANNEL[kind], s.get("family") or FAMILY[kind], specificity, text, known, tech.get("minFamilies") or 1))
    return rows


def typed_rows(technologies: list[dict]) -> tuple[list[tuple], list[tuple]]:
    """(rules, identifier rules) of a growth or security catalogue, as rows of RULE_SCHEMA and ID_SCHEMA."""
    rules, ids = [], []
    for t, tech in enumerate(technologies):
        for k, r in enumerate(tech["evidence"]):
            rules.append((t, tech["id"], tech["name"], tech["category"], k, r["type"], float(r["weight"]), r.get("product") or "", r["pattern"], r["description"], bool(r.get("launchOnly"))))
        for k, r in enumerate(tech.get("ids") or []):
            # A pattern that spells an upper-case prefix looks at case.
            exact = re.search(r"\[A-Z\]|GTM-|AW-|GA4", r["pattern"])
            ids.append((t, tech["id"], k, r["kind"], ("" if exact else "(?i)") + r["pattern"]))
    return rules, ids


def growth_rows() -> tuple[list[tuple], list[tuple]]:
    return typed_rows(_technologies("growth"))


def growth_details() -> list[tuple]:
    """(tech_id, website, variant_note) of the growth catalogue."""
    return [(t["id"], t.get("website"), t.get("variantNote")) for t in _technologies("growth")]


def security_rows() -> list[tuple]:
    return typed_rows(_technologies("security"))[0]


def protection_rows() -> list[tuple]:
    return [(t, p["id"], p["name"], k, r["strength"], r["channel"], r["label"], r["pattern"]) for t, p in enumerate(_technologies("protection")) for k, r in enumerate(p["rules"])]


RULE_SCHEMA = "tech_ord int, tech_id string, tech_name string, category string, rule_ord int, type string, weight double, product string, pattern string, description string, launch_only boolean"
ID_SCHEMA = "tech_ord int, tech_id string, rule_ord int, kind string, pattern string"
DETAIL_SCHEMA = "tech_id string, website string, variant_note string"
PROTECTION_SCHEMA = "provider_ord int, provider_id string, provider string, rule_ord int, strength string, channel string, label string, pattern string"


def core(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(core_rows(), CORE_SCHEMA)


def growth(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(growth_rows()[0], RULE_SCHEMA)


def growth_ids(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(growth_rows()[1], ID_SCHEMA)


def details(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(growth_details(), DETAIL_SCHEMA)


def security(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(security_rows(), RULE_SCHEMA)


def protection(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(protection_rows(), PROTECTION_SCHEMA)


def read_catalogue(spark: SparkSession, *paths: str) -> DataFrame:
    """A core catalogue from JSON files, in file order; the columns of CORE_SCHEMA."""
    kind = "array<struct<id:string,name:string,category:string,signals:array<struct<type:string,name:string,pattern:string,weight:int,strength:string,versionGroup:int,family:string,specificity:double,description:string>>,probes:array<struct<path:string,successSignal:string,weight:int>>,excludes:array<string>,negative:array<string>,minFamilies:int>>"
    files = None
    for i, path in enumerate(paths):
        listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", kind)).otherwise(F.from_json("value", f"struct<technologies:{kind}>")["technologies"])
        one = spark.read.text(path, wholetext=True).select(F.lit(i).alias("file"), listed.alias("all"))
        files = one if files is None else files.unionAll(one)
    tech = files.select("file", F.posexplode("all").alias("at", "t"))
    probes = F.transform(F.coalesce("t.probes", F.array().cast("array<struct<path:string,successSignal:string,weight:int>>")), lambda p: F.struct(F.lit("probe").alias("type"), p["path"].alias("name"), p["successSignal"].alias("pattern"), p["weight"].alias("weight"), F.lit("strong").alias("strength"), F.lit(None).cast("int").alias("versionGroup"), F.lit(None).cast("string").alias("family"), F.lit(None).cast("double").alias("specificity"), F.lit(None).cast("string").alias("description")))
    rules = tech.select((F.col("file") * 100_000 + F.col("at")).alias("tech_ord"), "t", F.posexplode(F.concat("t.signals", probes)).alias("sig_ord", "s"))
    look = lambda table, key: F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)
    strength = F.coalesce("s.strength", F.lit("weak"))
    text = F.coalesce("s.description", F.concat(F.col("t.name"), F.lit(" "), look(DESCRIPTION, F.col("s.type")), F.when((F.col("s.type") == "header") & F.col("s.name").isNotNull(), F.concat(F.lit(" ("), "s.name", F.lit(")"))).otherwise("")))
    empty = F.lit("")
    return rules.select(
        "tech_ord", F.col("t.id").alias("tech_id"), F.col("t.name").alias("tech_name"), F.col("t.category").alias("category"), F.array_join(F.coalesce("t.excludes", F.array().cast("array<string>")), ",").alias("excludes"), F.array_join(F.coalesce("t.negative", F.array().cast("array<string>")), "|").alias("veto"), "sig_ord", F.col("s.type").alias("type"),
        F.when(F.col("s.type") == "header", F.lower("s.name")).otherwise(F.coalesce("s.name", empty)).alias("header"), F.col("s.weight").alias("weight"), strength.alias("strength"), F.col("s.versionGroup").alias("version_group"), F.col("s.pattern").alias("pattern"), look(CHANNEL, F.col("s.type")).alias("channel"), F.coalesce("s.family", look(FAMILY, F.col("s.type"))).alias("family"), F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "s.specificity")), look(SPECIFICITY, strength)).alias("specificity"), text.alias("description"),
        # The rules are a small table; this looks at their patterns, never at pages.
        F.when(F.col("s.type") == "probe", F.array(F.lower("s.pattern"))).otherwise(F.udf(needles, "array<string>")("s.pattern")).alias("needles"), F.coalesce("t.minFamilies", F.lit(1)).alias("min_families"),
    )


def _read_technologies(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame:
    """(tech_ord, t): the technologies of JSON files (an array, or an object with `technologies`), in file order."""
    kind = "array<struct<id:string,name:string,category:string,website:string,variantNote:string,evidence:array<struct<type:string,pattern:string,weight:double,description:string,product:string,launchOnly:boolean>>,ids:array<struct<kind:string,pattern:string>>,rules:array<struct<strength:string,channel:string,label:string,pattern:string>>>>"
    files = None
    for i, path in enumerate(paths):
        listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", kind)).otherwise(F.from_json("value", f"struct<technologies:{kind}>")["technologies"])
        one = spark.read.text(path, wholetext=True).select(F.lit(i).alias("file"), F.posexplode(listed).alias("at", "t"))
        files = one if files is None else files.unionAll(one)
    return files.select((F.col("file") * 100_000 + F.col("at")).alias("tech_ord"), "t")


def read_rules(spark: SparkSession, *paths: str) -> DataFrame:
    """A growth or security catalogue from JSON files; the columns of RULE_SCHEMA."""
    rows = _read_technologies(spark, paths).select("tech_ord", "t", F.posexplode("t.evidence").alias("rule_ord", "r"))
    return rows.select("tech_ord", F.col("t.id").alias("tech_id"), F.col("t.name").alias("tech_name"), F.col("t.category").alias("category"), "rule_ord", "r.type", "r.weight", F.coalesce("r.product", F.lit("")).alias("product"), "r.pattern", "r.description", F.coalesce("r.launchOnly", F.lit(False)).alias("launch_only"))


def read_ids(spark: SparkSession, *paths: str) -> DataFrame:
    """The identifier rules of growth catalogues; the columns of ID_SCHEMA."""
    rows = _read_technologies(spark, paths).select("tech_ord", "t", F.posexplode("t.ids").alias("rule_ord", "r"))
    exact = F.col("r.pattern").rlike(r"\[A-Z\]|GTM-|AW-|GA4")
    return rows.select("tech_ord", F.col("t.id").alias("tech_id"), "rule_ord", "r.kind", F.concat(F.when(exact, "").otherwise("(?i)"), "r.pattern").alias("pattern"))


def read_details(spark: SparkSession, *paths: str) -> DataFrame:
    """Websites and notes on variants of growth catalogues; the columns of DETAIL_SCHEMA."""
    return _read_technologies(spark, paths).select(F.col("t.id").alias("tech_id"), F.col("t.website").alias("website"), F.col("t.variantNote").alias("variant_note"))


def read_protection(spark: SparkSession, *paths: str) -> DataFrame:
    """Bot-protection providers (id, name, rules of strength, channel, label, pattern); the columns of PROTECTION_SCHEMA."""
    rows = _read_technologies(spark, paths).select("tech_ord", "t", F.posexplode("t.rules").alias("rule_ord", "r"))
    return rows.select(F.col("tech_ord").alias("provider_ord"), F.col("t.id").alias("provider_id"), F.col("t.name").alias("provider"), "rule_ord", "r.strength", "r.channel", "r.label", "r.pattern")


def lint(rules: DataFrame) -> DataFrame:
    """Rows that break a catalogue's rules: (tech_id, sig_ord, problem)."""
    problems = F.array_compact(F.array(
        F.when(~F.col("type").isin(*CHANNEL), "unknown type"), F.when(~F.col("strength").isin(*SPECIFICITY), "unknown strength"), F.when(~F.col("weight").between(1, 100), "weight outside 1 to 100"), F.when(F.coalesce("pattern", F.lit("")) == "", "no pattern"),
    ))
    rows = rules.select("tech_id", "sig_ord", F.explode(problems).alias("problem"))
    twice = rules.groupBy("tech_id").agg(F.count_distinct("tech_ord").alias("n")).where("n > 1").select("tech_id", F.lit(None).cast("int").alias("sig_ord"), F.lit("id used twice").alias("problem"))
    return rows.unionByName(twice)


def stats(rules: dict[str, DataFrame], hits: dict[str, DataFrame]) -> DataFrame:
    """Technologies and rules of each catalogue and category, and what they come to on pages: by catalogue its rules and its hits (page_id, category, tech_id).

    Hits that have a column `catalogue` say themselves of which they are.
    """
    of = lambda tables, *names: reduce(DataFrame.unionAll, [t.select((F.col("catalogue") if "catalogue" in t.columns else F.lit(n)).alias("catalogue"), *names) for n, t in tables.items()])
    known = of(rules, "category", "tech_id").groupBy("catalogue", "category").agg(F.count_distinct("tech_id").alias("technologies"), F.count("*").alias("rules"))
    # Spark deals distinct values by the values themselves, so no key gathers all pages, and reads the hits once for both.
    shown = of(hits, "category", "tech_id", "page_id").groupBy("catalogue", "category").agg(F.count_distinct("tech_id").alias("seen"), F.count_distinct("page_id").alias("pages"))
    none = F.lit(0).cast("long")
    return known.join(shown, ["catalogue", "category"], "left").select("catalogue", "category", "technologies", "rules", F.coalesce("seen", none).alias("seen"), F.coalesce("pages", none).alias("pages"))
