"""Aggregates over topics, partitions and tags; all algebraic, so combined map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.running import running


def depth(offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys the sum over partitions of latest less earliest offset; offsets has partition_no and offset_no."""
    spans = offsets.groupBy(*keys, "partition_no").agg((F.max("offset_no") - F.min("offset_no") + 1).alias("n"))
    return spans.groupBy(*keys).agg(F.sum("n").alias("depth"))


def lag(ends: DataFrame, committed: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys the sum over partitions of end less committed offset, never below 0; nothing committed counts as 0 committed."""
    joined = ends.join(committed, [*keys, "partition_no"], "left")
    behind = F.greatest(F.lit(0), F.col("end_offset") - F.coalesce("committed_offset", F.lit(0)))
    return joined.groupBy(*keys).agg(F.sum(behind).alias("lag"))


def tagged_counts(df: DataFrame, tags: list[str]) -> DataFrame:
    """A counter per combination of tags."""
    return df.groupBy(*tags).agg(F.count(F.lit(1)).alias("n"))


def outcome_counts(df: DataFrame, key: str, tag: str, order: str) -> DataFrame:
    """(tag, outcome, n): rows per tag that are their key's first by order, which must be unique (actioned), and all others
    (duplicate). Rows with a null key are left out.

    Rows are combined per key and tag, these per key; nothing is joined back to the rows.
    """
    parts = df.filter(F.col(key).isNotNull()).groupBy(key, tag).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    each = parts.groupBy(key).agg(F.min(F.struct("first", tag)).alias("least"), F.collect_list(F.struct(tag, "n")).alias("tags"))
    one = lambda outcome, n: F.struct(F.col(f"least.{tag}").alias(tag), F.lit(outcome).alias("outcome"), F.lit(n).cast("bigint").alias("n"))
    all_of = F.transform("tags", lambda t: F.struct(t[tag].alias(tag), F.lit("duplicate").alias("outcome"), t["n"].alias("n")))
    rows = each.select(F.inline(F.concat(F.array(one("actioned", 1), one("duplicate", -1)), all_of)))
    return rows.groupBy(tag, "outcome").agg(F.sum("n").alias("n")).filter("n > 0")


def percentiles(df: DataFrame, keys: list[str], value: Column, points: tuple[float, ...] = (0.5, 0.95, 0.99), accuracy: int = 10_000) -> DataFrame:
    """Approximate percentiles per keys, by mergeable sketches of bounded size (error at most 1/accuracy of the ranks)."""
    found = df.groupBy(*keys).agg(F.percentile_approx(value, list(points), accuracy).alias("p"), F.count(value).alias("n"))
    return found.select(*keys, "n", *[F.col("p")[i].alias(f"p{str(p)[2:]}") for i, p in enumerate(points)])


def exact_percentiles(df: DataFrame, keys: list[str], value: Column, width: float, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(keys, n, p5, ...): the least value up to which there are at least n times the point values; null without values.

    Equal values are combined first; their counts are added up along the values in blocks of `width`, so that neither a value
    nor a key that holds most rows is one task.
    """
    whole = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("__key")  # never null, so that it can be joined
    counts = df.groupBy(*keys, value.alias("__v")).agg(F.count(F.lit(1)).alias("__n")).select("*", whole)
    totals = counts.groupBy(*keys, "__key").agg(F.coalesce(F.sum(F.when(F.col("__v").isNotNull(), F.col("__n"))), F.lit(0)).alias("n"))
    present = counts.filter(F.col("__v").isNotNull()).select("__key", "__v", "__n", F.floor(F.col("__v") / width).alias("__block"))
    joined = totals.join(running(present, ["__key"], "__block", ["__v"], {"__upto": "__n"}), "__key", "left")
    found = [F.min(F.when(F.col("__upto") >= F.ceil(F.col("n") * F.lit(p)), F.col("__v"))).alias(f"p{str(p)[2:]}") for p in points]
    return joined.groupBy(*keys, "n").agg(*found)


def change_per_window(df: DataFrame, at: str, value: str, keys: list[str], width: str) -> DataFrame:
    """Per keys and tumbling window the greatest value and last less first value, by time."""
    windowed = df.groupBy(*keys, F.window(at, width).alias("w"))
    order = F.struct(F.col(at), F.col(value))
    out = windowed.agg(F.max(value).alias("highest"), (F.max_by(value, order) - F.min_by(value, order)).alias("change"))
    return out.select(*keys, F.unix_micros("w.start").alias("window_us"), "highest", "change")


def histogram(df: DataFrame, keys: list[str], value: Column, bounds: list[float]) -> DataFrame:
    """(keys, le, n): per keys the number of values up to each bound and, as infinity, of all; nulls are not counted.

    A key is one row of counters until its buckets are spread, so only these are shuffled.
    """
    ends = [*sorted(bounds), float("inf")]
    counts = [F.count(F.when(value <= F.lit(b), 1)).alias(f"__b{i}") for i, b in enumerate(ends)]
    row = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"__b{i}").alias("n")) for i, b in enumerate(ends)])
    return df.groupBy(*keys).agg(*counts).select(*keys, F.inline(row))


def histogram_quantiles(buckets: DataFrame, keys: list[str], points: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """(keys, p95, ...): quantiles from cumulative buckets (keys, le, n), linear within a bucket, the first of which begins at
    0. A quantile beyond the last finite bound is that bound; without values it is null. Buckets of several histograms are added."""
    summed = buckets.groupBy(*keys, "le").agg(F.sum("n").alias("n"))
    rows = summed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("le", "n"))).alias("b"))
    last = F.element_at("b", -1)["n"]

    def quantile(p: float) -> Column:
        rank = F.lit(p) * last
        place = F.size(F.filter("b", lambda x: x["n"] < rank))
        here, before = F.col("b")[place], F.when(place > 0, F.col("b")[place - 1])
        low, below = F.coalesce(before["le"], F.lit(0.0)), F.coalesce(before["n"], F.lit(0))
        return F.when(last > 0, F.when(here["le"] == float("inf"), low).otherwise(low + (here["le"] - low) * (rank - below) / (here["n"] - below)))

    return rows.select(*keys, *[quantile(p).alias(f"p{str(p)[2:]}") for p in points])


def counter_increase(df: DataFrame, at: str, order: list[str], value: str, keys: list[str], width: str) -> DataFrame:
    """(keys, window_us, increase, per_second): how much a counter that may start anew grew per keys and tumbling window.

    A sample below the one before it began at 0 again and counts whole. The step from one window's last sample to the next
    one's first belongs to the later window; a key's first sample adds nothing. Nothing is extrapolated. Windows are the
    blocks, so that a key with many samples is not one task. Rows with a null key, time or value are left out.
    """
    placed = df.dropna(subset=[*keys, at, value]).withColumn("__window", F.window(at, width))
    placed = placed.withColumn("__from", F.unix_micros("__window.start")).withColumn("__width", (F.unix_micros("__window.end") - F.col("__from")) / 1e6)
    stepped = running(placed.drop("__window"), keys, "__from", order, previous={"__prev": [value]})
    now, prev = F.col(value), F.col(f"__prev.{value}")
    step = F.when(prev.isNull(), 0).when(now >= prev, now - prev).otherwise(now)
    out = stepped.groupBy(*keys, F.col("__from").alias("window_us")).agg(F.sum(step).alias("increase"), F.max("__width").alias("__width"))
    return out.select(*keys, "window_us", "increase", (F.col("increase") / F.col("__width")).alias("per_second"))


def percent_of(df: DataFrame, keys: list[str], part: Column, whole: Column) -> DataFrame:
    """(keys, percent): 100 times part over whole, both aggregates; null where the whole is 0."""
    out = df.groupBy(*keys).agg(part.alias("__part"), whole.alias("__whole"))
    return out.select(*keys, (F.col("__part") * 100.0 / F.when(F.col("__whole") != 0, F.col("__whole"))).alias("percent"))
