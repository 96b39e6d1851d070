"""Scores over matched evidence: saturating sums, family-grouped noisy-OR, platform contest, type-grouped noisy-OR.

Half points are rounded up, sums and products run in the order in which the evidence was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.urls import bound

#: Fixed values of the models.
BONUS = [0, 0, 4, 8, 12]
WEAK_CEILING, NO_DEFINITIVE_CEILING, CONTEST_MIN, CONTEST_PENALTY, DISPLAY_MIN = 59, 89, 60, 30, 40
PLATFORMS = ["cms", "builder", "ecommerce"]
NO_STRONG, HEADER_ONLY, LAUNCH_ONLY, CONTAINER_ONLY, GROWTH_MIN = 0.74, 0.59, 0.59, 0.74, 40
SECURITY_NO_STRONG, SECURITY_HEADER_ONLY, SECURITY_MIN = 0.84, 0.59, 0.35
GROWTH_STRONG = ["script-host", "sdk-init"]
SECURITY_STRONG = ["script-host", "network-host", "iframe", "sdk-init", "runtime-global"]
PLACEHOLDER = r"(?i)(YOUR_SITE_KEY|YOUR_API_KEY|placeholder|example|test|x{3,}|12345|10000000-ffff-ffff-ffff-000000000001)"
GA4, UA = "GA4 measurement ID", "UA property (legacy)"
#: The family of each type of evidence.
FAMILIES = {"script-host": "SCRIPT", "sdk-init": "SCRIPT", "dom": "HTML", "cookie-storage": "COOKIE", "via-gtm": "VIA_GTM"}
WIDGETS = ["recaptcha", "hcaptcha", "cloudflare-turnstile"]
TECH = ["page_id", "tech_ord", "tech_id", "tech_name", "category"]

#: Names are ordered as readers expect: accents and case count only between names that are otherwise equal.
ORDER = "UNICODE"


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def saturating(ordered_weights: Column) -> Column:
    """Each weight fills its share of what is left to 100, in order."""
    return F.aggregate(ordered_weights, F.lit(0.0), lambda t, w: F.least(F.lit(100.0), t + half_up(w * (1 - t / 100)))).cast("int")


def noisy_or(ordered: Column) -> Column:
    return F.aggregate(ordered, F.lit(0.0), lambda c, v: 1 - (1 - c) * (1 - v))


def in_order(value: str, *keys: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, F.col(value).alias("_v")))), lambda x: x["_v"])


def label3(score: Column) -> Column:
    return F.when(score >= 90, "confirmed").when(score >= 70, "likely").otherwise("possible")


def label5(score: Column) -> Column:
    return F.when(score >= 90, "VERY HIGH").when(score >= 75, "HIGH").when(score >= 60, "MEDIUM").when(score >= 40, "LOW").otherwise("INSUFFICIENT")


def band(score: Column) -> Column:
    return F.when(score >= 90, "very-high").when(score >= 75, "high").when(score >= 60, "medium").otherwise("low")


def for_coverage(score: Column, on: Column, checked: Column) -> Column:
    """A score under partial page coverage."""
    share = on / checked
    return F.when((checked <= 0) | (share >= 1), score).when(share < 0.5, F.least(score, F.lit(39))).otherwise(half_up(score * (0.6 + 0.4 * share))).cast("int")


def _summed(evidence: DataFrame, *more: Column) -> DataFrame:
    """One row for each page and technology: confidence, version and number of signals, and what it excludes."""
    version = F.get(F.transform(F.array_sort(F.collect_list(F.when(F.col("version").isNotNull(), F.struct("sig_ord", "version")))), lambda x: x["version"]), 0)
    return evidence.groupBy(*TECH).agg(saturating(in_order("weight", "sig_ord")).alias("confidence"), version.alias("version"), F.count("*").cast("int").alias("signals"), F.max("excludes").alias("excludes"), *more)


def without_excluded(found: DataFrame) -> DataFrame:
    """A technology that another one on the page excludes is dropped; all exclusions look at the full set."""
    gone = F.flatten(F.collect_set(F.split("excludes", ",")).over(Window.partitionBy("page_id")))
    return found.withColumn("_gone", gone).where(~F.array_contains("_gone", F.col("tech_id"))).drop("_gone", "excludes")


def detections(evidence: DataFrame, artifacts: int = 0) -> DataFrame:
    """One row for each page and technology: confidence by the saturating sum, label, version and number of signals; on demand the first `artifacts` of its evidence."""
    shown = [F.slice(in_order("artifact", "sig_ord"), 1, artifacts).alias("artifacts")] if artifacts else []
    return without_excluded(_summed(evidence, *shown)).select(*TECH, "confidence", label3(F.col("confidence")).alias("label"), "version", "signals", *(["artifacts"] if artifacts else []))


def evidence_key(family: Column, value: Column, name: Column) -> Column:
    """What makes two signals one: a host with its first path segment, else family and text."""
    raw = F.lower(F.trim(value))
    url = r"((?:[a-z0-9-]+\.)+[a-z]{2,})(:\d+)?(/[a-z0-9_~.-]*)?"
    # The text is searched once, and only if it has a dot; the parts are found in the short match.
    return bound(F.struct(raw.alias("raw"), F.when(raw.contains("."), F.regexp_extract(raw, url, 0)).otherwise(F.substring(raw, 1, 0)).alias("url")), lambda x: _key_of(x["raw"], x["url"], url, family, name))


def _key_of(raw: Column, found: Column, url: str, family: Column, name: Column) -> Column:
    host, segment = F.regexp_replace(F.regexp_extract(found, url, 1), r"^www\.", ""), F.regexp_replace(F.regexp_extract(found, url, 3), "/+$", "")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "^https?://", ""), "^//", ""), "[/?#\\s\"'<>.,;:]+$", "")
    return F.when(raw == "", F.concat(F.lit("t::"), family, F.lit("::"), name)).when(found != "", F.concat(F.lit("u::"), host, segment)).otherwise(F.concat(F.lit("t::"), family, F.lit("::"), text))


def explained(evidence: DataFrame) -> DataFrame:
    """Every signal with its adjusted weight, its key, whether it stands for its key and wins its family."""
    adjusted = F.greatest(F.lit(0), F.least(F.lit(100), "weight")) / 100.0 * F.col("specificity")
    rows = evidence.withColumn("adjusted", adjusted).withColumn("key", evidence_key(F.col("family"), F.col("value"), F.col("name")))
    same = Window.partitionBy("page_id", "tech_id", "key")
    rows = rows.withColumn("first_ord", F.min("sig_ord").over(same)).withColumn("stands", F.row_number().over(same.orderBy(F.desc("adjusted"), "sig_ord")) == 1)
    family = Window.partitionBy("page_id", "tech_id", "family", "stands").orderBy(F.desc("adjusted"), "first_ord")
    family_ord = F.min("first_ord").over(Window.partitionBy("page_id", "tech_id", "family", "stands"))
    return rows.withColumn("wins", F.col("stands") & (F.row_number().over(family) == 1)).withColumn("family_ord", family_ord)


def _score_parts() -> list[Column]:
    """Aggregates over explained evidence: the winners of the families in order, and the ceilings that apply."""
    winners = F.transform(F.array_sort(F.collect_list(F.when(F.col("wins"), F.struct("family_ord", "family", "adjusted")))), lambda x: x["adjusted"])
    of_stands = lambda cond, name: F.max((F.col("stands") & cond).cast("int")).alias(name)
    return [noisy_or(winners).alias("combined"), F.sum(F.col("wins").cast("int")).cast("int").alias("families"), of_stands(F.col("strength") == "definitive", "definitive"), of_stands(F.col("strength") != "weak", "strong")]


def _score() -> Column:
    bonus = F.element_at(F.array(*map(F.lit, BONUS)), F.least(F.col("families"), F.lit(4)) + 1)
    score = half_up(F.col("combined") * 100 + bonus)
    score = F.least(score, F.when(F.col("strong") == 0, WEAK_CEILING).otherwise(100), F.when(F.col("definitive") == 0, NO_DEFINITIVE_CEILING).otherwise(100))
    return F.greatest(F.lit(0), score).cast("int")


def scores(evidence: DataFrame) -> DataFrame:
    """Score 0 to 100 and number of families for each page and technology."""
    return explained(evidence).groupBy(*TECH).agg(*_score_parts()).select(*TECH, _score().alias("score"), "families")


def contest(scored: DataFrame) -> DataFrame:
    """Platforms of a page compete: a winner of 60 or more takes a share of its score from each other."""
    rows = scored.withColumn("_platform", F.col("category").isin(*PLATFORMS))
    rank = Window.partitionBy("page_id", "_platform").orderBy(F.desc("score"), "tech_ord")
    rows = rows.select("*", F.row_number().over(rank).alias("_place"), F.first("tech_id").over(rank).alias("_winner"), F.first("score").over(rank).alias("_top"))
    lost = F.col("_platform") & (F.col("_place") > 1) & (F.col("_top") >= CONTEST_MIN)
    score = F.when(lost, F.greatest(F.lit(0), F.col("score") - half_up(CONTEST_PENALTY * F.col("_top") / 100))).otherwise(F.col("score")).cast("int")
    return rows.withColumn("score", score).withColumn("lost_to", F.when(lost, F.col("_winner"))).drop("_platform", "_place", "_winner", "_top")


def detect(evidence: DataFrame) -> DataFrame:
    """The final list of a page: contested scores, labels and versions, analytics left out; one pass over the evidence."""
    found = without_excluded(_summed(explained(evidence), *_score_parts()).withColumn("score", _score()))
    rows = contest(found).where("category <> 'analytics'")
    # The order of the list; a score under the floor is kept, but not shown.
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("confidence"), "tech_ord"))
    return rows.select(*TECH, "confidence", label3(F.col("confidence")).alias("label"), "version", "score", label5(F.col("score")).alias("score_label"), "families", "lost_to", rank.alias("rank"), (F.col("score") >= DISPLAY_MIN).alias("shown"))


def best_by_type(hits: DataFrame) -> DataFrame:
    """Of each page, technology and type the hit of largest weight, the first of several, in order of first hits."""
    same = Window.partitionBy("page_id", "tech_id", "type")
    rows = hits.withColumn("at", F.min("rule_ord").over(same)).withColumn("n", F.row_number().over(same.orderBy(F.desc("weight"), "rule_ord")))
    return rows.where("n = 1")


def _combined(best: DataFrame) -> DataFrame:
    product = F.aggregate(in_order("weight", "at"), F.lit(1.0), lambda p, w: p * (1 - w))
    return best.groupBy(*TECH).agg((1 - product).alias("p"), F.concat_ws(",", in_order("type", "at")).alias("types"), F.collect_set("type").alias("kinds"), F.min("header_only").alias("header_only"), F.min("launch_only").alias("launch_only"), F.max((F.col("type") != "via-gtm").cast("int")).alias("direct"))


def capped(p: Column, cond: Column, cap: float) -> Column:
    return F.when(cond, F.least(p, F.lit(cap))).otherwise(p)


def by_score() -> Column:
    """The place in a page's list: best score first, then by name."""
    return F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), F.collate(F.col("tech_name"), ORDER), "tech_ord"))


def growth_scores(hits: DataFrame, ids: DataFrame) -> DataFrame:
    """Scored technologies of each page; ids are the page's identifiers (page_id, tech_id, place, kind, value)."""
    rows = _combined(best_by_type(hits))
    p = capped(F.col("p"), ~F.arrays_overlap("kinds", F.array(*map(F.lit, GROWTH_STRONG))), NO_STRONG)
    p = capped(capped(capped(p, F.col("header_only"), HEADER_ONLY), F.col("launch_only"), LAUNCH_ONLY), F.col("direct") == 0, CONTAINER_ONLY)
    rows = rows.withColumn("score", half_up(p * 100).cast("int")).where(F.col("score") >= GROWTH_MIN)
    listed = F.array_distinct(in_order("product", "rule_ord"))
    products = hits.where((F.col("tech_id") == "salesforce") & (F.col("product") != "")).groupBy("page_id", "tech_id").agg(F.concat(F.when(F.size(listed) == 1, "Matched product: ").otherwise("Matched products: "), F.array_join(listed, ", "), F.lit(".")).alias("products"))
    legacy = F.concat(F.lit("Universal Analytics (legacy) "), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == UA, F.struct("place", "value")))), lambda x: x["value"]), ", "), F.lit("; GA4 (G-…) not seen."))
    only = ids.where(F.col("tech_id") == "google-analytics").groupBy("page_id", "tech_id").agg(F.max((F.col("kind") == GA4).cast("int")).alias("ga4"), F.max((F.col("kind") == UA).cast("int")).alias("ua"), legacy.alias("legacy")).where("ga4 = 0 and ua = 1")
    rows = rows.join(products, ["page_id", "tech_id"], "left").join(only.select("page_id", "tech_id", "legacy"), ["page_id", "tech_id"], "left")
    return rows.select(*TECH, "score", band(F.col("score")).alias("band"), "types", F.coalesce("products", "legacy").alias("note"), by_score().alias("place"))


def with_details(scored: DataFrame, details: DataFrame) -> DataFrame:
    """Scored technologies with their website and the note that a catalogue has on their variants."""
    return scored.join(F.broadcast(details), "tech_id", "left").select(*scored.columns, "website", "variant_note")


def shown_evidence(hits: DataFrame, scored: DataFrame) -> DataFrame:
    """The evidence of scored technologies in order: the best hit of each type, then what further containers hold."""
    best = best_by_type(hits).withColumn("extra", F.lit(0))
    winner = best.where("type = 'via-gtm'").select("page_id", "tech_id", F.col("detail").alias("won"))
    more = hits.where("type = 'via-gtm'").join(winner, ["page_id", "tech_id"]).where("detail <> won").select(*(c for c in hits.columns), F.col("rule_ord").alias("at"), F.lit(1).alias("extra"))
    rows = best.select(*more.columns).unionByName(more).join(scored.select("page_id", "tech_id"), ["page_id", "tech_id"], "left_semi")
    place = F.row_number().over(Window.partitionBy("page_id", "tech_id").orderBy("extra", "at", "rule_ord"))
    family = F.element_at(F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv)), F.col("type"))
    return rows.select("page_id", "tech_id", place.alias("place"), "type", "detail", F.nullif("value", F.lit("")).alias("value"), family.alias("family"))


def security_scores(hits: DataFrame, placeholder_pages: DataFrame) -> DataFrame:
    rows = _combined(best_by_type(hits))
    p = capped(F.col("p"), ~F.arrays_overlap("kinds", F.array(*map(F.lit, SECURITY_STRONG))), SECURITY_NO_STRONG)
    rows = rows.withColumn("p", capped(p, F.col("header_only"), SECURITY_HEADER_ONLY)).where(F.col("p") >= SECURITY_MIN)
    demo = placeholder_pages.select("page_id", F.explode(F.array(*map(F.lit, WIDGETS))).alias("tech_id"))
    score = half_up(F.col("p") * 100) / 100
    label = F.when(score >= 0.85, "high").when(score >= 0.6, "medium").otherwise("low")
    return rows.join(demo, ["page_id", "tech_id"], "left_anti").select(*TECH, score.alias("score"), half_up(score * 100).cast("int").alias("score100"), label.alias("label"), "types").withColumn("place", by_score())


def by_category(pages: DataFrame, scored: DataFrame, categories: list[str]) -> DataFrame:
    """Technologies of each page and category, best first; categories without any are kept."""
    grid = pages.select("page_id", F.posexplode(F.array(*map(F.lit, categories))).alias("category_ord", "category"))
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("tech_name").isNotNull(), F.struct((-F.col("score")).alias("s"), "tech_name")))), lambda x: x["tech_name"])
    return grid.join(scored.select("page_id", "category", "tech_name", "score"), ["page_id", "category"], "left").groupBy("page_id", "category_ord", "category").agg(F.array_join(names, ", ").alias("technologies"), F.count("tech_name").alias("n"))
