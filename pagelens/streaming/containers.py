"""Tag containers of captured pages, from a log of container fetches: the same join for tables and for streams.

A fetched container serves every page for `VALID` after it was fetched.  A page asks for the first `MAX_CONTAINERS` ids in its
HTML and bundles; of the fetches that are valid when it was captured the latest counts.  An id without one, or with a response that
is no script, gives a warning and the page keeps its other results.

Time is cut into stretches of `VALID`: a fetch stands in its own and in the next, and the join is equal on id and stretch, so an
id that most pages share is spread over time.  On streams both sides carry watermarks; a page whose fetch never comes is
given out, with its warning, once the watermark has passed it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.channels import container_ids
from pagelens.operators.outcomes import MAX_CONTAINER, MAX_CONTAINERS

#: Fixed value: seconds that a fetched container is kept.
VALID = 300
#: Columns of a fetch; `error` holds what went wrong instead of a response.
FETCHES = "id string, fetched_at timestamp, status int, content_type string, js string, error string"


def asked_ids(html: Column, bundles: Column) -> Column:
    """The first container ids of a page, each once."""
    none = F.array().cast("array<string>")
    return F.slice(container_ids(F.array_join(F.concat(F.array(F.coalesce(html, F.lit(""))), F.coalesce(bundles, none)), "\n")), 1, MAX_CONTAINERS)


def is_script(fetch: Column) -> Column:
    kind = F.lower(F.coalesce(fetch["content_type"], F.lit("")))
    return fetch["status"].between(200, 299) & ((kind == "") | kind.rlike("javascript|ecmascript|text"))


def expanded(captures: DataFrame, fetches: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(page_id, at, containers, warnings) for pages (page_id, at, html, bundles) with at least one container id."""
    pages = captures.select("page_id", "at", asked_ids(F.col("html"), F.col("bundles")).alias("ids")).where(F.size("ids") > 0).withWatermark("at", late)
    stretch = lambda c: F.floor(F.unix_seconds(c) / VALID)
    asked = pages.select("page_id", "at", F.posexplode("ids").alias("ord", "id")).withColumn("stretch", stretch(F.col("at"))).alias("p")
    response = F.struct("fetched_at", "status", "content_type", F.substring("js", 1, MAX_CONTAINER).alias("js"), (F.length("js") > MAX_CONTAINER).alias("truncated"), "error")
    kept = fetches.withWatermark("fetched_at", late).select("id", "fetched_at", response.alias("fetch"), F.explode(F.array(stretch(F.col("fetched_at")), stretch(F.col("fetched_at")) + 1)).alias("stretch")).alias("f")
    valid = (F.col("p.id") == F.col("f.id")) & (F.col("p.stretch") == F.col("f.stretch")) & (F.col("f.fetched_at") <= F.col("p.at")) & (F.col("p.at") < F.col("f.fetched_at") + F.expr(f"interval {VALID} seconds"))
    met = asked.join(kept, valid, "left").select("page_id", "at", "ord", "p.id", "fetch")
    # A page has few ids, and an id few fetches that are valid at one time.
    listed = met.groupBy("page_id", "at").agg(F.array_sort(F.collect_list(F.struct("ord", "id", F.col("fetch.fetched_at").alias("fetched_at"), "fetch"))).alias("all"))
    last = F.filter("all", lambda x, i: F.coalesce(F.get("all", i + 1)["ord"] != x["ord"], F.lit(True)))
    good = lambda x: F.coalesce(x["fetch"]["error"].isNull() & is_script(x["fetch"]), F.lit(False))
    warning = lambda x: (
        F.when(x["fetch"].isNull(), F.concat(F.lit("GTM container "), x["id"], F.lit(" fetch failed; kept normal results.")))
        .when(x["fetch"]["error"].isNotNull(), F.concat(F.lit("GTM container "), x["id"], F.lit(" unavailable ("), x["fetch"]["error"], F.lit(")")))
        .otherwise(F.concat(F.lit("GTM container "), x["id"], F.lit(" returned an unexpected response.")))
    )
    of = listed.select("page_id", "at", last.alias("last"))
    containers = F.transform(F.filter("last", good), lambda x: F.struct(x["id"].alias("id"), x["fetch"]["js"].alias("js"), x["fetch"]["truncated"].alias("truncated")))
    return of.select("page_id", "at", containers.alias("containers"), F.transform(F.filter("last", lambda x: ~good(x)), warning).alias("warnings"))
