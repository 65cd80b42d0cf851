"""Counts per period of event time under late and out-of-order arrival: lambda views.

The clock of a row is the greatest event time among rows that arrived strictly earlier. A period is closed for the row when
the clock has reached the period's end, frozen when it has reached the end plus the cut-off. As ends are multiples of the
period, both are facts about arrival time alone: the clock of a row has reached a moment E exactly when the first arrival
among all rows with event time >= E lies strictly before the row's own. So the clock is kept as one compact table, a row per
period with its first arrival, and no row has to be put in global order.

Layers: the fast layer adds up rows as they arrive while their period is provisional; the batch layer recomputes the open
periods from the full log, replaces the provisional figures, and leaves frozen periods alone.
All times are bigint microseconds since the epoch.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.session import small_side, written

HOUR_US = 3_600_000_000
#: Lists of served figures, in the order of the columns.
FIGURES = ("provisional", "n", "corrections", "refused")
_STEP = re.compile(r"^(log|served)-(\d+)(?:-(\d+))?$")


def period_of(at_us: Column, period_us: int = HOUR_US) -> Column:
    """First moment of the period that holds the time; a full period's moment belongs to the period it begins."""
    return at_us - F.pmod(at_us, F.lit(period_us))


def event_log(df: DataFrame, stream: str, event_time: str, arrival: str, *keep: str, period_us: int = HOUR_US) -> DataFrame:
    """(stream, keep..., period_us, arrival_us) of the rows that have both times; the others count for nothing."""
    timed = df.filter(F.col(event_time).isNotNull() & F.col(arrival).isNotNull())
    return timed.select(
        F.lit(stream).alias("stream"),
        *keep,
        period_of(F.unix_micros(F.col(event_time).cast("timestamp")), period_us).alias("period_us"),
        F.unix_micros(F.col(arrival).cast("timestamp")).alias("arrival_us"),
    )


def first_arrivals(log: DataFrame) -> DataFrame:
    """(stream, period_us, first_arrival): the rows are combined to one per period before anything is shuffled."""
    return log.groupBy("stream", "period_us").agg(F.min("arrival_us").alias("first_arrival"))


def period_bounds(firsts: DataFrame, period_us: int = HOUR_US, cutoff_us: int = 6 * HOUR_US) -> DataFrame:
    """(stream, period_us, first_arrival, closes_at, freezes_at), one row per period of first_arrivals(); null while not yet so.

    The running minimum goes over occupied periods, at most one per hour of history, never over rows.
    """
    if cutoff_us % period_us:
        raise ValueError("the cut-off must be a multiple of the period")
    later = Window.partitionBy("stream").orderBy(F.col("period_us").desc())
    reached = lambda after: F.min("first_arrival").over(later.rangeBetween(Window.unboundedPreceding, -after))
    return firsts.select("stream", "period_us", "first_arrival", reached(period_us).alias("closes_at"), reached(period_us + cutoff_us).alias("freezes_at"))


def classify(log: DataFrame, bounds: DataFrame) -> DataFrame:
    """log with `lateness`: on_time, corrects (its period was closed) or too_late (its period was frozen)."""
    late = F.when(F.col("arrival_us") > F.col("freezes_at"), "too_late").when(F.col("arrival_us") > F.col("closes_at"), "corrects")
    return log.join(bounds, ["stream", "period_us"]).withColumn("lateness", F.coalesce(late, F.lit("on_time")))


def with_lateness(log: DataFrame, period_us: int = HOUR_US, cutoff_us: int = 6 * HOUR_US) -> DataFrame:
    """classify() of a whole log at once; the bounds are broadcast only if they are few enough."""
    return classify(log, small_side(period_bounds(first_arrivals(log), period_us, cutoff_us).drop("first_arrival"), "period-bounds"))


def _figures(classified: DataFrame) -> DataFrame:
    """(stream, period_us, provisional, n, corrections, refused) of rows with lateness."""
    count = lambda *kinds: F.count(F.when(F.col("lateness").isin(*kinds), 1))
    counted = [count("on_time"), count("on_time", "corrects"), count("corrects"), count("too_late")]
    return classified.groupBy("stream", "period_us").agg(*[c.alias(name) for c, name in zip(counted, FIGURES)])


def _state(closes: str = "closes_at", freezes: str = "freezes_at") -> Column:
    return F.when(F.col(freezes).isNotNull(), "frozen").when(F.col(closes).isNotNull(), "closed").otherwise("open")


def lambda_view(log: DataFrame, period_us: int = HOUR_US, cutoff_us: int = 6 * HOUR_US) -> DataFrame:
    """(stream, period_us, provisional, n, corrections, refused, state): what LambdaViews serves in the end, for a log that is
    there as a whole. state is open, closed (corrections still possible) or frozen."""
    classified = with_lateness(log, period_us, cutoff_us)
    ends = classified.groupBy("stream", "period_us").agg(F.max("closes_at").alias("closes_at"), F.max("freezes_at").alias("freezes_at"))
    return _figures(classified).join(ends, ["stream", "period_us"]).withColumn("state", _state()).drop("closes_at", "freezes_at")


class LambdaViews:
    """The layers kept as tables below a shared path, for batches that come in order of arrival; a row that comes in a later
    batch although it arrived earlier is judged by its arrival, but refused if its period was frozen by then.

    add() is the fast layer: it moves the clock on, appends the batch with each row's lateness to the log, and adds up the
    rows that are on time. recompute() is the scheduled batch: it counts the periods that are not frozen anew from the log,
    corrections included, replaces them, and freezes the periods past the cut-off. view() serves frozen and recomputed
    periods plus the later increments of the fast layer; a frozen period's n never changes again, and what arrives for it is
    counted as refused.

    The log keeps every row. A recompute also leaves the rows of the periods still open in a table of their own, so that the
    next one reads these and the batches since, and not history again.

    A batch has a number and is logged under it once: adding a number that is complete does nothing, and one that broke off is
    written anew. Every recompute is a new generation. Opening a path finds what is complete there and goes on from it.
    """

    def __init__(self, spark: SparkSession, path: str, period_us: int = HOUR_US, cutoff_us: int = 6 * HOUR_US):
        if cutoff_us % period_us:
            raise ValueError("the cut-off must be a multiple of the period")
        self.spark, self.path, self.period_us, self.cutoff_us = spark, path, period_us, cutoff_us
        found = self._complete()
        self.numbers = sorted(int(a) for kind, a, _ in found if kind == "log")
        #: (generation, number of batches it contains) of the last complete recompute.
        self.generation, self.folded = max(((int(a), int(b)) for kind, a, b in found if kind == "served"), default=(0, 0))

    def _complete(self) -> list[tuple[str, str, str | None]]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        root = hadoop(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return [m.groups() for name in names if (m := _STEP.match(name)) and fs.exists(hadoop(f"{self.path}/{name}/_SUCCESS"))]

    def _read(self, *names: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{name}" for name in names])

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def _since(self) -> list[int]:
        """Batches that no recompute contains."""
        return self.numbers[self.folded :]

    def add(self, log: DataFrame, number: int | None = None) -> None:
        """Fast layer for a batch (stream, period_us, arrival_us, ...), every batch with the same columns."""
        number = (self.numbers[-1] + 1 if self.numbers else 0) if number is None else number
        if number in self.numbers:
            return
        if self.numbers and number < self.numbers[-1]:
            raise ValueError(f"batch {number} comes after batch {self.numbers[-1]}")
        firsts = first_arrivals(log)
        if self.numbers:
            both = firsts.unionByName(self._read(f"clock-{self.numbers[-1]}").select(*firsts.columns))
            firsts = both.groupBy("stream", "period_us").agg(F.min("first_arrival").alias("first_arrival"))
        bounds = period_bounds(firsts, self.period_us, self.cutoff_us)
        self._write(bounds, f"clock-{number}")
        classified = classify(log, self._bounds(number)).drop("closes_at", "freezes_at")
        self._write(classified, f"rows-{number}")
        on_time = self._read(f"rows-{number}").filter("lateness = 'on_time'").groupBy("stream", "period_us")
        self._write(on_time.agg(F.count(F.lit(1)).alias("provisional")), f"log-{number}")  # the batch's last step
        self.numbers.append(number)

    def _bounds(self, number: int) -> DataFrame:
        """The bounds as of a batch: a table of one row per period, which joins may broadcast as far as its size allows."""
        return self._read(f"clock-{number}").select("stream", "period_us", "closes_at", "freezes_at")

    def log(self) -> DataFrame:
        """Every row added, with its lateness."""
        return self._read(*[f"rows-{i}" for i in self.numbers])

    def recompute(self) -> None:
        """Batch layer: the periods that were not frozen before, from all their rows; frozen ones keep their n."""
        since = self._since()
        if not since:
            return
        bounds, now = self._bounds(self.numbers[-1]), self.generation + 1
        columns = ["stream", "period_us", "lateness"]
        fresh = rows = self._read(*[f"rows-{i}" for i in since]).select(*columns)
        if self.generation:
            rows = rows.unionByName(self._read(f"open-{self.generation}"))
            frozen = self._read(f"served-{self.generation}-{self.folded}").filter("state = 'frozen'")
            kept = frozen.select("stream", "period_us")
            rows, refused = rows.join(kept, ["stream", "period_us"], "left_anti"), fresh.join(kept, ["stream", "period_us"], "left_semi")
            more = refused.groupBy("stream", "period_us").agg(F.count(F.lit(1)).alias("more"))
            carried = frozen.join(more, ["stream", "period_us"], "left").withColumn("refused", F.col("refused") + F.coalesce("more", F.lit(0))).drop("more")
        still = bounds.filter(F.col("freezes_at").isNull()).select("stream", "period_us")
        self._write(rows.join(still, ["stream", "period_us"], "left_semi"), f"open-{now}")
        served = _figures(rows).join(bounds, ["stream", "period_us"]).withColumn("state", _state()).drop("closes_at", "freezes_at")
        served = served.unionByName(carried) if self.generation else served
        self._write(served, f"served-{now}-{len(self.numbers)}")  # the generation's last step
        self.generation, self.folded = now, len(self.numbers)

    def view(self) -> DataFrame:
        """(stream, period_us, provisional, n, corrections, refused, state) as of now, one row per period."""
        if not self.numbers:
            return self.spark.createDataFrame([], "stream string, period_us bigint, provisional bigint, n bigint, corrections bigint, refused bigint, state string")
        zero = F.lit(0).cast("bigint")
        parts = [self._read(f"served-{self.generation}-{self.folded}").drop("state")] if self.generation else []
        if since := self._since():
            fast = self._read(*[f"log-{i}" for i in since])
            parts.append(fast.select("stream", "period_us", "provisional", F.col("provisional").alias("n"), zero.alias("corrections"), zero.alias("refused")))
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        summed = rows.groupBy("stream", "period_us").agg(*[F.sum(name).alias(name) for name in FIGURES])
        placed = summed.join(self._bounds(self.numbers[-1]), ["stream", "period_us"], "right")
        return placed.select("stream", "period_us", *[F.coalesce(name, zero).alias(name) for name in FIGURES], _state().alias("state"))


def add_in_waves(views: LambdaViews, log: DataFrame, waves: int = 3, every: int = 2) -> LambdaViews:
    """A whole log through the layers: cut by time of arrival into `waves` batches per stream, a recompute after every
    `every`-th and after the last. The log is read once, to be put down by wave; rows that arrived at one time stay together."""
    ends = {r["stream"]: (r["lo"], r["hi"]) for r in log.groupBy("stream").agg(F.min("arrival_us").alias("lo"), F.max("arrival_us").alias("hi")).collect()}
    wave = F.lit(0)
    for stream, (lo, hi) in ends.items():
        wave = F.when(F.col("stream") == stream, F.floor((F.col("arrival_us") - lo) / F.lit((hi - lo + 1) / waves)).cast("int")).otherwise(wave)
    landed = written(log.withColumn("__wave", F.least(wave, F.lit(waves - 1))), "landed", by="__wave")
    for i in range(waves):
        views.add(landed.filter(F.col("__wave") == i).drop("__wave"))
        if (i + 1) % every == 0 or i + 1 == waves:
            views.recompute()
    return views
