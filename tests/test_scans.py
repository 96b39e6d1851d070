import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagelens.operators import sites
from pagelens.streaming import containers, scans

START = datetime(2026, 3, 1, 12, 0, 0)


def at(seconds):
    return START + timedelta(seconds=seconds)


def append(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


PAGES = "page_id long, at timestamp, html string, bundles array<string>"


def container_cases():
    """(pages, fetches): fresh, expired, at the edges, missing, refreshed, failed and unexpected ones."""
    rng = random.Random(6)
    pages = [(i, at(60 * i), f"x GTM-A{i % 4} y", ["GTM-B1 GTM-C1 GTM-D1"]) for i in range(40)] + [(100, at(0), "none", [])]
    pages += [(200, at(299), "GTM-EDGE", None), (201, at(300), "GTM-EDGE", None), (202, at(0), "GTM-EDGE", None)]
    fetches = [("GTM-EDGE", at(0), 200, "text/javascript", "edge", None), ("GTM-B1", at(10), 200, "", "b" * 400_001, None), ("GTM-B1", at(200), 200, "application/javascript", "newer", None)]
    fetches += [(f"GTM-A{k}", at(rng.randrange(2400)), 200, "text/javascript", f"a{k}.{n}", None) for k in range(3) for n in range(6)]
    fetches += [("GTM-C1", at(0), 404, "text/html", "no", None), ("GTM-C1", at(600), 200, "image/png", "no", None), ("GTM-C1", at(1200), None, None, None, "Request timed out")]
    return pages, fetches


def plain_containers(pages, fetches):
    out = {}
    for page_id, when, html, bundles in pages:
        ids = list(dict.fromkeys(w for t in [html, *(bundles or [])] for w in t.split() if w.startswith("GTM-")))[:3]
        got, warnings = [], []
        for i in ids:
            valid = [f for f in fetches if f[0] == i and f[1] <= when < f[1] + timedelta(seconds=300)]
            f = max(valid, key=lambda f: f[1], default=None)
            if f is None:
                warnings.append(f"GTM container {i} fetch failed; kept normal results.")
            elif f[5]:
                warnings.append(f"GTM container {i} unavailable ({f[5]})")
            elif f[2] != 200 or not any(w in f[3] for w in ("javascript", "text")) and f[3]:
                warnings.append(f"GTM container {i} returned an unexpected response.")
            else:
                got.append((i, f[4][:400_000], len(f[4]) > 400_000))
        if ids:
            out[page_id] = (got, warnings)
    return out


def collected(rows):
    return {r.page_id: ([tuple(c) for c in r.containers], r.warnings) for r in rows}


def test_containers_in_a_table(spark):
    pages, fetches = container_cases()
    want = plain_containers(pages, fetches)
    assert {len(w) for _, w in want.values()} == {0, 1, 2, 3}
    got = containers.expanded(spark.createDataFrame(pages, PAGES), spark.createDataFrame(fetches, containers.FETCHES))
    assert collected(got.collect()) == want


def test_containers_in_streams_with_late_and_missing_ones(spark, tmp_path):
    pages, fetches = container_cases()
    want = plain_containers(pages, fetches)
    # A fetch that is written after the pages it serves, and one behind the watermark, which is lost.
    late, rest = fetches[:1], fetches[1:]
    append(spark, pages, PAGES, tmp_path, "pages/1")
    append(spark, rest, containers.FETCHES, tmp_path, "fetches/1")
    page, fetch = (spark.readStream.schema(s).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{n}") for s, n in ((PAGES, "pages"), (containers.FETCHES, "fetches")))

    def run():
        query = containers.expanded(page, fetch, late="60 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    append(spark, late, containers.FETCHES, tmp_path, "fetches/2")
    run()
    # Two hours on, the watermark passes everything; the last fetch comes too late to be counted.
    append(spark, [(900, at(20_000), "GTM-LAST", [])], PAGES, tmp_path, "pages/3")
    append(spark, [("GTM-LAST", at(20_000), 200, "", "x", None)], containers.FETCHES, tmp_path, "fetches/3")
    run()
    append(spark, [("GTM-A3", at(180), 200, "", "too late", None)], containers.FETCHES, tmp_path, "fetches/4")
    append(spark, [(901, at(40_000), "GTM-LAST", [])], PAGES, tmp_path, "pages/4")
    append(spark, [("GTM-X", at(40_000), 200, "", "x", None)], containers.FETCHES, tmp_path, "fetches/5")
    run()
    run()
    got = collected(spark.read.parquet(f"{tmp_path}/out").collect())
    assert {k: v for k, v in got.items() if k < 900} == want


def test_scan_log_by_minute(spark, tmp_path):
    schema = "at timestamp, url string, outcome string, duration_ms double, cpu_ms double, truncated boolean"
    rows = [(at(s), f"https://{h}/x", o, 10.0, c, False) for s, h, o, c in [(0, "a", "ok", 1.0), (59, "A", "ok", 8.0), (30, "a", "TIMEOUT", 9.0), (60, "a", "ok", 0.0), (5, "b", "ok", 2.0)]]
    want = {(at(0), "a"): (3, 1, 2, 2 / 3), (at(60), "a"): (1, 0, 0, 0.0), (at(0), "b"): (1, 0, 0, 0.0)}
    table = scans.scan_minutes(spark.createDataFrame(rows, schema))
    assert {(r.minute, r.host): (r.scans, r.failed, r.high_cpu, r.high_cpu_share) for r in table.collect()} == want
    append(spark, rows, schema, tmp_path, "in/1")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")

    def run():
        scans.scan_minutes(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination()

    run()
    append(spark, [(at(100), "https://a/", "ok", 1.0, 0.0, False), (at(20), "https://b/", "ok", 1.0, 9.0, True)], schema, tmp_path, "in/2")  # late, but within the watermark
    run()
    append(spark, [(at(1000), "https://z/", "ok", 1.0, 0.0, False)], schema, tmp_path, "in/3")
    run()
    append(spark, [(at(10), "https://b/", "ok", 1.0, 9.0, False)], schema, tmp_path, "in/4")  # behind the watermark
    run()
    got = {(r.minute, r.host): (r.scans, r.failed, r.high_cpu) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(at(0), "a"): (3, 1, 2), (at(60), "a"): (2, 0, 0), (at(0), "b"): (2, 0, 1)}


def scan_events():
    plan = lambda site, s, *urls: (site, at(s), "plan", list(urls), None, None, None, None, None, None)
    step = lambda site, s, url, ok=True, framework="A", provider="P", cross=False, n=2: (site, at(s), "step", None, url, ok, framework, provider, cross, n)
    first = [plan("x", 0, "/1", "/2", "/3"), step("x", 1, "/1"), plan("y", 0, "/a", "/b", "/a"), step("y", 2, "/b", framework="B"), step("z", 1, "/early", provider=None)]
    second = [step("x", 5, "/2", ok=False), step("x", 6, "/3", n=7), step("y", 7, "/a"), plan("z", 8, "/early"), plan("w", 8, "/1", "/2"), step("w", 9, "/1")]
    third = [step("x", 12, "/2"), step("x", 13, "/3", n=9), step("x", 14, "/unknown")]
    return first, second, third


@pytest.mark.parametrize("restarts", [False, True])
def test_scan_goes_on_after_a_restart(spark, tmp_path, restarts):
    """Every micro-batch in a run of its own gives the same pages and verdicts as one run."""
    events = scan_events()
    (tmp_path / "in").mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", scans.STORE)
    try:
        stream = spark.readStream.schema(scans.EVENTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        run = lambda: scans.resumable_scans(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        for n, rows in enumerate([*events, [("clock", at(500), "tick", None, None, None, None, None, None, None)], [("clock", at(1000), "tick", None, None, None, None, None, None, None)]]):
            append(spark, rows, scans.EVENTS, tmp_path, f"in/{n}")
            if restarts:
                run()
        run()
        run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = spark.read.parquet(f"{tmp_path}/out")
    pages = {(r.site, r.place): (r.url, r.ok, r.tries, r.framework, r.provider, r.error) for r in out.where("kind = 'page'").collect()}
    assert pages == {
        ("x", 0): ("/1", True, 1, "A", "P", None), ("x", 1): ("/2", True, 2, "A", "P", None), ("x", 2): ("/3", False, 2, "Unscanned", "Unscanned", "BUDGET_EXCEEDED"), ("y", 0): ("/a", True, 1, "A", "P", None), ("y", 1): ("/b", True, 1, "B", "P", None),
        ("z", 0): ("/early", True, 1, "A", "Unknown", None), ("w", 0): ("/1", True, 1, "A", "P", None), ("w", 1): ("/2", False, 1, "Unscanned", "Unscanned", "TIMEOUT"),
    }
    asked = sorted((r.site, r.url, r.tries) for r in out.where("kind = 'request'").collect())
    assert asked == [("w", "/1", 1), ("w", "/2", 1), ("x", "/1", 1), ("x", "/2", 1), ("x", "/2", 2), ("x", "/3", 1), ("x", "/3", 2), ("y", "/a", 1), ("y", "/b", 1), ("z", "/early", 1)]
    verdicts = {r.site: (r.verdict, r.verdict_line) for r in sites.consistency(out.where("kind = 'page'").select("site", F.col("place").alias("page_id"), "ok", "cross_domain", "framework", "provider")).collect()}
    assert verdicts == {"x": ("mixed", "2 of 3 pages scanned (1 unscanned or failed)"), "y": ("mixed", "1 of 2 paths differ"), "z": ("consistent", "1/1 pages run A + Unknown"), "w": ("mixed", "1 of 2 pages scanned (1 unscanned or failed)")}
