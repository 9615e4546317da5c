"""Log events of request handlers: validation, filters, the stored form, alerts, and figures of metrics."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

EVENT = (
    "scriptName string, outcome string, eventTimestamp long, "
    "event struct<request struct<url string, method string, cf struct<colo string, country string>>>, "
    "logs array<struct<timestamp long, level string, message string>>, exceptions array<struct<name string, message string, timestamp long>>, "
    "diagnosticsChannelEvents array<struct<cpuTime double>>"
)

# Sections of an article that have an address of their own.
SECTIONS = ("summary", "infobox", "links", "categories", "text")


def parsed_events(raw: Column) -> Column:
    """The struct of a JSON line; null where it is no event (no outcome, or logs or exceptions that are no arrays)."""
    e = F.from_json(raw, EVENT)
    return F.when(e["outcome"].isNotNull() & e["logs"].isNotNull() & e["exceptions"].isNotNull(), e)


def glob_regex(pattern: str) -> str:
    """An anchored regular expression: ``*`` any run, ``?`` one character."""
    return r"^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + r"\z"


def event_filter(script_names: Sequence[str] = (), outcomes: Sequence[str] = (), exceptions_only: bool = False, min_logs: int | None = None, log_levels: Sequence[str] = (), url_patterns: Sequence[str] = ()) -> Column:
    """All of the given conditions. Events without logs pass the levels, events without an address the patterns."""
    tests = [F.lit(True)]
    if script_names:
        tests.append(F.col("scriptName").isin(*script_names))
    if outcomes:
        tests.append(F.col("outcome").isin(*outcomes))
    if exceptions_only:
        tests.append(F.size("exceptions") > 0)
    if min_logs is not None:
        tests.append(F.size("logs") >= min_logs)
    if log_levels:
        tests.append((F.size("logs") == 0) | F.exists("logs", lambda x: F.coalesce(x["level"].isin(*log_levels), F.lit(False))))
    if url_patterns:
        url = F.col("event.request.url")
        tests.append((F.coalesce(url, F.lit("")) == "") | reduce(or_, [url.rlike(glob_regex(p)) for p in url_patterns]))
    return reduce(lambda a, b: a & b, [F.coalesce(x, F.lit(False)) for x in tests])


def processed(df: DataFrame) -> DataFrame:
    """The stored form of events: counts, request, errors as text, and only logs that warn or tell of errors."""
    kept = F.filter("logs", lambda x: x["level"].isin("warn", "error"))
    request = F.col("event.request")
    cpu = F.filter(F.transform("diagnosticsChannelEvents", lambda x: x["cpuTime"]), lambda x: x.isNotNull())
    return df.select(
        F.timestamp_millis("eventTimestamp").alias("timestamp"), F.coalesce("scriptName", F.lit("unknown")).alias("scriptName"), "outcome",
        F.size("logs").alias("logCount"), F.size("exceptions").alias("exceptionCount"),
        request["method"].alias("method"), request["url"].alias("url"), request["cf"]["colo"].alias("colo"), request["cf"]["country"].alias("country"),
        F.when(F.size("exceptions") > 0, F.transform("exceptions", lambda e: F.concat(F.coalesce(e["name"], F.lit("")), F.lit(": "), F.coalesce(e["message"], F.lit(""))))).alias("errors"),
        F.when(F.size(kept) > 0, kept).alias("logs"), F.get(cpu, 0).alias("cpuTimeMs"),
    )


def critical() -> Column:
    return F.col("outcome").isin("exceededCpu", "exceededMemory") | (F.col("exceptionCount") > 0)


def alert_summary(df: DataFrame) -> DataFrame:
    of = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return df.where(critical()).agg(F.count("*").alias("events"), of("exceededCpu"), of("exceededMemory"), F.count_if(F.col("exceptionCount") > 0).alias("exceptions"))


def data_points(df: DataFrame) -> DataFrame:
    """``blobs, doubles, indexes`` for an analytics store."""
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return df.select(F.array("scriptName", "outcome", known("method"), known("country")).alias("blobs"), F.array(F.lit(1.0), number("logCount"), number("exceptionCount"), number("cpuTimeMs")).alias("doubles"), F.array(known("colo")).alias("indexes"))


def endpoint(path: Column) -> Column:
    """The route that a path takes: ``/fr/Paris/links`` is ``/:lang/:title/:section``."""
    p = F.filter(F.split(path, "/"), lambda x: x != "")
    first, n = F.get(p, 0), F.size(p)
    section = lambda i: F.coalesce(F.get(p, i).isin(*SECTIONS), F.lit(False))
    lang = F.when(n == 2, "/:lang/:title").when((n == 3) & section(2), "/:lang/:title/:section").otherwise("/:lang/:title/*")
    plain = F.when((n == 1) & F.endswith(first, F.lit(".json")), "/:title.json").when(n == 1, "/:title").when((n == 2) & section(1), "/:title/:section").otherwise("/:title/*")
    return F.when(n == 0, "/").when(F.startswith(first, F.lit("_")), F.concat(F.lit("/"), first)).when(first.rlike(r"^[a-z]{2}\z"), lang).otherwise(plain)


def bucket_percentile(buckets: Column, total: Column, q: float) -> Column:
    """A percentile from ``array<struct<le double, count long>>`` of cumulative counts, linear inside a bucket.

    Above the last bound it is that bound; without buckets 0.
    """
    target = total * F.lit(q)
    start = F.struct(F.lit(0.0).alias("le"), F.lit(0.0).alias("n"), F.lit(None).cast("double").alias("found"))

    def step(s: Column, b: Column) -> Column:
        le, n = b["le"].cast("double"), b["count"].cast("double")
        inside = s["le"] + (target - s["n"]) / F.when(n == s["n"], 1.0).otherwise(n - s["n"]) * (le - s["le"])
        return F.struct(le.alias("le"), n.alias("n"), F.coalesce(s["found"], F.when(n >= target, inside)).alias("found"))

    return F.aggregate(buckets, start, step, lambda s: F.coalesce(s["found"], s["le"]))


def health(state: Column, requests: Column, errors: Column) -> Column:
    rate = F.coalesce(F.try_divide(errors, requests), F.lit(0.0))
    return F.when(state == "open", "unhealthy").when((state == "half-open") | (rate > 0.1), "degraded").otherwise("healthy")
