"""Detection over a stream: keyed state instead of windows, with the same arithmetic as the batch operators.

Within a micro-batch an account's events are taken in the order (ms, event_id); between micro-batches in order of arrival.
State lives in the state store (RocksDB on a cluster) with a time-to-live in processing time.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigil.model import Thresholds

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State is kept at least so long on the clock of the machine, which may run behind or ahead of the events' own.
LEAST_TTL_MS = 120_000
JUDGED = "event_id string, account_id string, amount double, lat double, lon double, ms bigint, produced_us bigint, velocity_prior bigint, n bigint, mean double, m2 double, prev_lat double, prev_lon double, prev_ms bigint"


class AccountState(StatefulProcessor):
    """Per account: the recent events' times and ids, (n, mean, m2, last time) and the last place.

    Each state is read and written once per micro-batch. Times are kept in order, so that counting those within the window is a
    binary search; an id that comes again moves its time instead of counting twice. Statistics restart in event time after a
    pause longer than stats_ttl_ms, as in the batch form; the store's own time-to-live only clears what nobody asks for.
    """

    def __init__(self, thresholds: Thresholds):
        self.t = thresholds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "ms bigint, event_id string", ttlDurationMs=max(LEAST_TTL_MS, 2 * self.t.velocity_window_ms))
        self.stats = handle.getValueState("stats", "n bigint, mean double, m2 double, ms bigint", ttlDurationMs=max(LEAST_TTL_MS, 2 * self.t.stats_ttl_ms))
        self.place = handle.getValueState("place", "lat double, lon double, ms bigint", ttlDurationMs=max(LEAST_TTL_MS, 2 * self.t.geo_ttl_ms))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ms", "event_id"])
        recent = sorted((ms, ident) for ms, ident in self.recent.get())
        time_of = {ident: ms for ms, ident in recent}
        n, mean, m2, last = self.stats.get() if self.stats.exists() else (0, 0.0, 0.0, None)
        place = self.place.get() if self.place.exists() else None
        cap, start, priors, states, befores = self.t.zscore_cap, 0, [], [], []
        columns = [events[c].tolist() for c in ("event_id", "amount", "lat", "lon", "ms")]
        for ident, amount, lat, lon, ms in zip(*columns):
            oldest = ms - self.t.velocity_window_ms
            while start < len(recent) and recent[start][0] <= oldest:
                gone = recent[start]
                if time_of.get(gone[1]) == gone[0]:
                    del time_of[gone[1]]
                start += 1
            if ident in time_of:
                recent.pop(bisect_left(recent, (time_of[ident], ident), start))
            priors.append(len(recent) - start)
            insort(recent, (ms, ident), start)
            time_of[ident] = ms
            if last is not None and ms - last > self.t.stats_ttl_ms:
                n, mean, m2 = 0, 0.0, 0.0
            n, last = n + 1, ms
            d = amount - mean
            mean += d / min(n, cap)
            m2 = (m2 - m2 / cap if n > cap else m2) + d * (amount - mean)
            states.append((n, mean, m2))
            befores.append(place if place is not None and ms - place[2] <= self.t.geo_ttl_ms else (None, None, None))
            place = (lat, lon, ms)
        self.recent.put(recent[start:])
        self.stats.update((n, mean, m2, last))
        self.place.update(place)
        out = events[["event_id", "account_id", "amount", "lat", "lon", "ms", "produced_us"]].copy()
        out["velocity_prior"] = priors
        out["n"], out["mean"], out["m2"] = zip(*states)
        for i, name in enumerate(("prev_lat", "prev_lon")):
            out[name] = pd.array([b[i] for b in befores], "Float64").to_numpy(float, na_value=float("nan"))
        out["prev_lat"], out["prev_lon"] = out["prev_lat"].astype("Float64"), out["prev_lon"].astype("Float64")
        out["prev_ms"] = pd.array([b[2] for b in befores], "Int64")
        yield out

    def close(self) -> None:
        pass


def judge_stream(events: DataFrame, t: Thresholds) -> DataFrame:
    """The stream with all that the rules look at, ready for detect.alerts()."""
    from vigil.functions.geo import haversine_km, speed_kmh

    keyed = events.select("event_id", "account_id", "amount", "lat", "lon", "ms", "produced_us").groupBy("account_id")
    judged = keyed.transformWithStateInPandas(AccountState(t), JUDGED, "Append", "ProcessingTime")
    prev = F.when(F.col("prev_ms").isNotNull(), F.struct(F.col("prev_lat").alias("lat"), F.col("prev_lon").alias("lon"), F.col("prev_ms").alias("ms")))
    placed = judged.withColumn("prev", prev).withColumn("dist_km", haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon")))
    return placed.withColumn("speed_kmh", speed_kmh(F.col("dist_km"), F.col("ms") - F.col("prev_ms"))).drop("prev_lat", "prev_lon", "prev_ms")


class SeenOnce(StatefulProcessor):
    """Per event id: the time of the accepted copy. Copies within the time-to-live of it are marked as not accepted."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ms bigint", ttlDurationMs=max(LEAST_TTL_MS, 2 * self.ttl_ms))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        copies = pd.concat(list(rows))
        copies = copies.sort_values(["ms", "arrival"] if "arrival" in copies.columns else ["ms"], kind="stable")
        accepted = []
        for ms in copies["ms"]:
            accepted.append(last is None or ms - last >= self.ttl_ms)
            last = ms if accepted[-1] else last
        self.last.update((int(last),))
        yield copies.assign(accepted=accepted)

    def close(self) -> None:
        pass


def dedup_stream(events: DataFrame, ttl_ms: int) -> DataFrame:
    """The stream with `accepted`, as folds.dedup_ttl; events has event_id and ms, and arrival if ties are to go by it."""
    fields = ", ".join(f"{name} {kind}" for name, kind in events.dtypes)
    return events.groupBy("event_id").transformWithStateInPandas(SeenOnce(ttl_ms), f"{fields}, accepted boolean", "Append", "ProcessingTime")


class TokenBucket(StatefulProcessor):
    """Per account: tokens and time of the last decision, as folds.token_bucket."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "tokens double, ms bigint", ttlDurationMs=max(LEAST_TTL_MS, self.ttl_ms))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import math

        tokens, at = self.bucket.get() if self.bucket.exists() else (None, None)
        events = pd.concat(list(rows)).sort_values(["ms", "arrival"])
        allowed, waits = [], []
        for ms, rate in zip(events["ms"], events["rate"]):
            full = tokens is None or ms - at > self.ttl_ms
            tokens = float(rate) if full else min(float(rate), tokens + max(0, ms - at) / 1000.0 * rate)
            allowed.append(tokens >= 1)
            waits.append(0 if tokens >= 1 else (math.ceil((1 - tokens) / rate * 1000) if rate > 0 else -1))
            tokens, at = (tokens - 1 if tokens >= 1 else tokens), int(ms)
        self.bucket.update((float(tokens), int(at)))
        yield events.assign(allowed=allowed, wait_ms=waits)

    def close(self) -> None:
        pass


def token_stream(events: DataFrame, ttl_ms: int) -> DataFrame:
    """The stream with allowed and wait_ms; events has account_id, ms, arrival and rate."""
    fields = ", ".join(f"{name} {kind}" for name, kind in events.dtypes)
    return events.groupBy("account_id").transformWithStateInPandas(TokenBucket(ttl_ms), f"{fields}, allowed boolean, wait_ms bigint", "Append", "ProcessingTime")


def counts_stream(events: DataFrame, at: str, width: str, keys: list[str], delay: str) -> DataFrame:
    """(keys, window_us, n): counts per tumbling window of event time. A window comes out once the watermark, `delay` behind the
    latest event time seen, has passed its end; later events are dropped and its state is cleared, so that state stays bounded."""
    marked = events.withWatermark(at, delay)
    counted = marked.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, F.unix_micros("w.start").alias("window_us"), "n")
