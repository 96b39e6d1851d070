"""Captures from archives: HAR files of rendered pages, and WARC files of crawls.

Both are read by Spark's own readers from any store it knows.  A HAR file is one JSON document, read whole by one task.  A WARC file
is cut at its record headers, so a large plain one is read by many tasks; one that is compressed as a whole by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import urls
from pagelens.functions.channels import container_ids
from pagelens.operators.matching import MAX_CONTAINER
from pagelens.operators.outcomes import MAX_BUNDLE, MAX_BUNDLES
from pagelens.sources.captures import COLUMNS

_PAIRS = "array<struct<name:string,value:string>>"
HAR = f"log struct<entries:array<struct<startedDateTime:string,request:struct<method:string,url:string>,response:struct<status:int,headers:{_PAIRS},cookies:{_PAIRS},redirectURL:string,content:struct<mimeType:string,text:string,encoding:string>>>>,_globals:array<string>,_storage:array<string>>"
#: What a record starts with.
RECORD = "WARC/1.0\r\n"


def completed(rows: DataFrame) -> DataFrame:
    """Rows with all columns of a capture, in order; what is missing is empty."""
    def column(name: str, kind: str) -> Column:
        if name in rows.columns:
            return F.col(name).cast(kind).alias(name)
        empty = F.from_json(F.lit("{}"), kind) if kind.startswith("map") else F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)
        return empty.alias(name)

    return rows.select(*(column(n, k) for n, k in COLUMNS.items()))


def _by_name(pairs: Column) -> Column:
    """Pairs as a map of lower-cased names; of equals the first."""
    names = F.transform(F.coalesce(pairs, F.array().cast(_PAIRS)), lambda p: F.lower(p["name"]))
    first = F.filter(F.coalesce(pairs, F.array().cast(_PAIRS)), lambda p, i: F.array_position(names, F.lower(p["name"])) == i + 1)
    return F.map_from_entries(F.transform(first, lambda p: F.struct(F.lower(p["name"]).alias("key"), p["value"].alias("value"))))


def _text(content: Column) -> Column:
    decoded = F.make_valid_utf8(F.try_to_binary(content["text"], F.lit("base64")).cast("string"))
    return F.when(content["encoding"] == "base64", decoded).otherwise(content["text"])


def read_har(spark: SparkSession, path: str) -> DataFrame:
    """One capture for each HAR file: the first document that is no redirect, and what the page asked for after it.

    Redirects before the document are its chain; scripts of its own host are bundles, tag containers containers; all
    addresses are `requests`, and what a recorder notes as `_globals` and `_storage` of the log the other rendered channels.
    """
    entry = F.col("log.entries")
    files = spark.read.schema(HAR).json(path, multiLine=True).withColumn("file", F.input_file_name()).where(F.size(entry) > 0)
    moved = lambda e: e["response"]["status"].between(301, 308)
    at = F.array_position(F.transform(entry, lambda e: ~moved(e)), F.lit(True))
    page = files.withColumn("at", F.when(at > 0, at).otherwise(1)).select("*", F.get(entry, (F.col("at") - 1).cast("int")).alias("e"), F.slice(entry, F.col("at").cast("int") + 1, F.size(entry)).alias("rest"))
    page = page.withColumns({"final_url": F.col("e.request.url"), "html": _text(F.col("e.response.content"))})
    kind = lambda e: F.lower(F.coalesce(e["response"]["content"]["mimeType"], F.lit("")))
    own = lambda e: (urls.host_of(e["request"]["url"]) == urls.host_of(F.col("final_url"))) & kind(e).rlike("javascript|ecmascript")
    tags = F.filter("rest", lambda e: e["request"]["url"].rlike(r"(?i)googletagmanager\.com/gtm\.js") & _text(e["response"]["content"]).isNotNull())
    rows = page.select(
        F.xxhash64("file").alias("page_id"), F.get(entry, 0)["request"]["url"].alias("url"), "final_url", F.col("e.response.status").alias("status"), F.col("e.response.content.mimeType").alias("content_type"), "html", _by_name(F.col("e.response.headers")).alias("headers"),
        F.transform(F.coalesce("e.response.cookies", F.array().cast(_PAIRS)), lambda c: c["name"]).alias("cookies"), F.transform(F.slice(entry, 1, F.col("at").cast("int")), lambda e: e["request"]["url"]).alias("redirect_chain"),
        F.transform(tags, lambda e: F.struct(F.get(container_ids(e["request"]["url"]), 0).alias("id"), F.substring(_text(e["response"]["content"]), 1, MAX_CONTAINER).alias("js"))).alias("containers"),
        F.slice(F.transform(F.filter("rest", own), lambda e: F.substring(F.coalesce(_text(e["response"]["content"]), F.lit("")), 1, MAX_BUNDLE)), 1, MAX_BUNDLES).alias("bundles"), F.transform("rest", lambda e: e["request"]["url"]).alias("requests"),
        F.coalesce("log._globals", F.array().cast("array<string>")).alias("globals"), F.coalesce("log._storage", F.array().cast("array<string>")).alias("storage_keys"),
    )
    return completed(rows)


def _fields(text: Column) -> Column:
    """Header lines `name: value` as pairs."""
    lines = F.filter(F.split(text, "\r\n"), lambda x: x.contains(":"))
    return F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]*):", 1)).alias("name"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value")))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One capture for each response record of HTTP; other records and pieces without a header are left out.

    page_id is a hash of the record's id, or of its address and date.
    """
    # Options in Spark's reader are the same for plain and compressed files.
    pieces = spark.read.option("lineSep", RECORD).text(path).where("value <> ''")
    split = lambda c: (F.substring_index(c, "\r\n\r\n", 1), F.substring(c, F.length(F.substring_index(c, "\r\n\r\n", 1)) + 5, F.length(c)))
    head, block = split(F.col("value"))
    records = pieces.select(_by_name(_fields(head)).alias("warc"), block.alias("block")).where("lower(warc['warc-type']) = 'response' and block like 'HTTP/%'")
    # What the length says belongs to the record; behind it stand two line ends.
    sized = records.select("warc", F.make_valid_utf8(F.substring(F.encode("block", "UTF-8"), 1, F.coalesce(F.col("warc")["content-length"].try_cast("int"), F.octet_length("block"))).cast("string")).alias("block"))
    head, body = split(F.col("block"))
    pairs = _fields(F.regexp_replace(head, r"^[^\r\n]*\r\n", ""))
    rows = sized.select("warc", head.alias("head"), body.alias("html"), pairs.alias("pairs")).withColumn("headers", _by_name(F.col("pairs")))
    address = F.regexp_replace(F.col("warc")["warc-target-uri"], "^<|>$", "")
    given = F.filter("pairs", lambda p: F.lower(p["name"]) == "set-cookie")
    names = F.transform(given, lambda p: F.trim(F.substring_index(p["value"], "=", 1)))
    return completed(rows.select(F.xxhash64(F.coalesce(F.col("warc")["warc-record-id"], F.concat(address, F.col("warc")["warc-date"]))).alias("page_id"), address.alias("url"), address.alias("final_url"), F.regexp_extract("head", r"^HTTP/\S+ (\d{3})", 1).try_cast("int").alias("status"), F.col("headers")["content-type"].alias("content_type"), "html", "headers", names.alias("cookies"), F.array_join(F.transform(given, lambda p: p["value"]), ", ").alias("set_cookie")))
