"""Operators with state per key: batch folds in Arrow groups and their streaming twins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a time without zone, rounded down. The session's zone has no part in it: hours that a zone
    skips or repeats stay apart."""
    since = ts.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), since)
    return (part("DAY").cast("long") * 86_400_000 + part("HOUR") * 3_600_000 + part("MINUTE") * 60_000 + F.floor(part("SECOND") * 1000)).cast("long")


def admit_sliding(times: list[int], kept: list[int], limit: int, window: int) -> list[bool]:
    """Which requests pass; refused ones are not recorded. ``kept`` is updated in place."""
    out = []
    for t in times:
        while kept and kept[0] <= t - window:
            kept.pop(0)
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


def folded(df: DataFrame, key: str, by: list[str], fresh: Callable[[], list], step: Callable[[list, pd.DataFrame], list], name: str, kind: str) -> DataFrame:
    """Adds a column by a fold over each key's rows in order.

    Rows are dealt by key and sorted by Spark, which spills; they then pass a batch at a time, and only one key's state
    goes from batch to batch. So a key of any length takes no more memory than a batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = (), fresh()
        for g in batches:
            keys = [None if pd.isna(k) else k for k in g[key].tolist()]
            made, begin = [], 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[begin]:
                    if last != (keys[begin],):
                        last, state = (keys[begin],), fresh()
                    made += step(state, g.iloc[begin:i])
                    begin = i
            yield g.assign(**{name: made})

    return df.repartition(key).sortWithinPartitions(key, *by).mapInPandas(run, StructType([*df.schema.fields]).add(name, kind))


def rate_limited(df: DataFrame, key: str, time_ms: str, order: str, limit: int = 100, window_ms: int = 60_000) -> DataFrame:
    """Adds ``allowed``. A key is one stream of requests, which has to be read in order."""
    step = lambda kept, g: admit_sliding(g[time_ms].tolist(), kept, limit, window_ms)
    return folded(df.select(key, time_ms, order), key, [time_ms, order], list, step, "allowed", "boolean")


def rate_limited_stream(df: DataFrame, key: str, time_ms: str, limit: int = 100, window_ms: int = 60_000) -> DataFrame:
    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        g = pd.concat(batches).sort_values(time_ms)
        allowed = admit_sliding(g[time_ms].tolist(), kept, limit, window_ms)
        state.update((kept,))
        yield pd.DataFrame({key: k[0], "time_ms": g[time_ms].to_numpy(), "allowed": allowed})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, time_ms long, allowed boolean", "kept array<long>", "append", GroupStateTimeout.NoTimeout)


def breaker(events: list[tuple[int, bool]], failures: int = 5, rest_ms: int = 30_000, successes: int = 3, kept: list | None = None) -> list[str]:
    """The circuit breaker's state after each (time, ok). ``kept`` goes on from batch to batch."""
    state, bad, good, opened = kept or ("closed", 0, 0, 0)
    out = []
    for t, ok in events:
        if state == "open" and t - opened >= rest_ms:
            state, good = "half-open", 0
        if state == "closed":
            bad = 0 if ok else bad + 1
            if bad >= failures:
                state, opened = "open", t
        elif state == "half-open":
            good = good + 1 if ok else 0
            if not ok:
                state, opened = "open", t
            elif good >= successes:
                state, bad = "closed", 0
        out.append(state)
    if kept is not None:
        kept[:] = state, bad, good, opened
    return out


def breaker_states(df: DataFrame, key: str, time_ms: str, ok: str, order: str) -> DataFrame:
    step = lambda kept, g: breaker(list(zip(g[time_ms].tolist(), g[ok].tolist(), strict=True)), kept=kept)
    return folded(df.select(key, order, time_ms, ok), key, [time_ms, order], list, step, "state", "string").select(key, order, "state")


def event_windows(df: DataFrame, time: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per event-time window with a watermark, for streams and tables alike."""
    ts = F.col(time).cast("timestamp")
    return df.withColumn("ts_", ts).withWatermark("ts_", late).groupBy(F.window("ts_", width, slide) if slide else F.window("ts_", width)).agg(F.count("*").alias("n"))


def admit_fixed(times: list[int], start: int | None, count: int, limit: int, window: int) -> tuple[list[bool], int | None, int]:
    """Windows begin with the first request after the last one ended; refused requests count too."""
    out = []
    for t in times:
        if start is None or t - start >= window:
            start, count = t, 0
        count += 1
        out.append(count <= limit)
    return out, start, count


def rate_limited_fixed(df: DataFrame, key: str, time_ms: str, order: str, limit: int = 100, window_ms: int = 60_000) -> DataFrame:
    """As ``rate_limited``, by fixed windows."""

    def step(kept: list, g: pd.DataFrame) -> list[bool]:
        start, count = kept or (None, 0)
        out, *kept[:] = admit_fixed(g[time_ms].tolist(), start, count, limit, window_ms)
        return out

    return folded(df.select(key, time_ms, order), key, [time_ms, order], list, step, "allowed", "boolean")


def write_batches(df: DataFrame, path: str, checkpoint: str, seconds: int = 10):  # noqa: ANN201
    """Starts a stream that writes JSON files of its new rows every so many seconds; batches without rows write nothing."""

    def flush(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").json(f"{path}/batch={number}")  # a repeated batch replaces itself

    return df.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
