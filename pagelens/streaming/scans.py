"""Scans of sites as streams: the log by minute, and a scan that can be stopped and taken up again.

`scan_minutes` folds a log of scans over windows of event time, for tables and streams alike.  `resumable_scans` keeps the state
of each site's scan: what its plan still asks for, what each step found and how often it was tried.  A step that fails is
asked for once more; one that never answers is unscanned once the time limit has passed, and never counts as consistent.
When the last step is in, the pages are given out in the order of the plan, as `operators.sites.consistency` reads them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from pagelens.functions import urls
from pagelens.operators.outcomes import HIGH_CPU_MS

#: Responses that one step may take, and tries of a step.
STEP_BUDGET, TRIES = 6, 2
#: What state stores on disk hold; a session needs it for `resumable_scans`.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a scan: a plan (`urls` in order), or what a step found.
EVENTS = "site string, at timestamp, kind string, urls array<string>, url string, ok boolean, framework string, provider string, cross_domain boolean, subrequests int"
#: Rows given out: steps to take (`request`), then the pages of a finished scan (`page`).
GIVEN = "site string, kind string, place int, url string, tries int, ok boolean, framework string, provider string, cross_domain boolean, error string"


def scan_minutes(scans: DataFrame, late: str = "2 minutes", minutes: int = 1) -> DataFrame:
    """(minute, host, scans, failed, truncated, high_cpu, high_cpu_share, duration_ms) of scans (at, url, outcome, duration_ms, cpu_ms, truncated)."""
    costly = (F.col("cpu_ms") >= HIGH_CPU_MS).cast("long")
    rows = scans.withWatermark("at", late).groupBy(F.window("at", f"{minutes} minutes").alias("w"), urls.host_of(F.col("url")).alias("host"))
    found = rows.agg(F.count("*").alias("scans"), F.sum((F.col("outcome") != "ok").cast("long")).alias("failed"), F.sum(F.col("truncated").cast("long")).alias("truncated"), F.sum(costly).alias("high_cpu"), F.sum("duration_ms").alias("duration_ms"))
    return found.select(F.col("w.start").alias("minute"), "host", "scans", "failed", "truncated", "high_cpu", (F.col("high_cpu") / F.col("scans")).alias("high_cpu_share"), "duration_ms")


class SiteScan(StatefulProcessor):
    """One site's scan: steps of the plan by place, with what they found."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", "place int", "url string, tries int, done boolean, ok boolean, framework string, provider string, cross_domain boolean, error string")
        self.early = handle.getMapState("early", "url string", "ok boolean, framework string, provider string, cross_domain boolean, subrequests int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        site, given, planned = key[0], [], None
        # Plans first: of rows that come together the order is not known.
        for row in sorted(rows, key=lambda r: (r.kind != "plan", r.ms, r.url or "")):
            if row.kind == "plan" and not self.steps.exists():
                for place, url in enumerate(dict.fromkeys(row.urls or [])):
                    self.steps.updateValue((place,), (url, 1, False, False, None, None, False, None))
                    given.append(self.request(site, place, url, 1))
                    planned = row.ms
                for url, found in [(k[0], v) for k, v in self.early.iterator()]:
                    given += self.answer(site, url, *found)
                self.early.clear()
            elif row.kind == "step":
                found = (bool(row.ok), row.framework, row.provider, bool(row.cross_domain), row.subrequests or 0)
                if self.steps.exists():
                    given += self.answer(site, row.url, *found)
                else:  # ahead of its plan
                    self.early.updateValue((row.url,), found)
        if planned is not None:
            self.handle.registerTimer(max(planned, timerValues.getCurrentWatermarkInMs()) + 1000 * self.seconds)
        yield from given
        yield from self.finished(site)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[Row]:
        """What has not answered by now is unscanned."""
        for place, step in list(self.steps.iterator()):
            if not step[2]:
                self.steps.updateValue(place, (step[0], step[1], True, False, "Unscanned", "Unscanned", False, "TIMEOUT"))
        yield from self.finished(key[0])

    def request(self, site: str, place: int, url: str, tries: int) -> Row:
        return Row(site=site, kind="request", place=place, url=url, tries=tries, ok=None, framework=None, provider=None, cross_domain=None, error=None)

    def answer(self, site: str, url: str, ok: bool, framework: str | None, provider: str | None, cross_domain: bool, subrequests: int) -> list[Row]:
        """Take what a step found; one that failed or went over its budget is asked for again, once."""
        for place, step in list(self.steps.iterator()):
            if step[0] == url and not step[2]:
                good = ok and subrequests <= STEP_BUDGET
                if not good and step[1] < TRIES:
                    self.steps.updateValue(place, (url, step[1] + 1, False, False, None, None, False, None))
                    return [self.request(site, place[0], url, step[1] + 1)]
                error = None if good else "BUDGET_EXCEEDED" if ok else "TIMEOUT"
                self.steps.updateValue(place, (url, step[1], True, good, framework or "Unknown" if good else "Unscanned", provider or "Unknown" if good else "Unscanned", cross_domain and good, error))
        return []

    def finished(self, site: str) -> Iterator[Row]:
        steps = sorted(((k[0], v) for k, v in self.steps.iterator()), key=lambda x: x[0])
        if steps and all(v[2] for _, v in steps):
            for place, (url, tries, _, ok, framework, provider, cross_domain, error) in steps:
                yield Row(site=site, kind="page", place=place, url=url, tries=tries, ok=ok, framework=framework, provider=provider, cross_domain=cross_domain, error=error)
            self.steps.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)

    def close(self) -> None:
        pass


def resumable_scans(events: DataFrame, seconds: int = 120, late: str = "10 seconds") -> DataFrame:
    """Steps to take and the pages of finished scans (GIVEN), from plans and steps (EVENTS); `seconds` is the limit of a scan."""
    return events.withWatermark("at", late).withColumn("ms", F.unix_millis("at")).groupBy("site").transformWithState(SiteScan(seconds), GIVEN, "append", "EventTime")
