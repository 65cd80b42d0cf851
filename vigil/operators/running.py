"""Running aggregates per key that do not put a key into one task.

A key's rows are cut into blocks of time. Blocks are combined map-side, their prefixes are taken over blocks (one row per key
and block), and each block then continues from its prefix on its own. A hot key is thus as parallel as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Length of the blocks into which a key's events are cut.
BLOCK_MS = 86_400_000


def running(df: DataFrame, keys: list[str], block: str, order: list[str], sums: dict[str, str] | None = None, mins: dict[str, str] | None = None, maxs: dict[str, str] | None = None, previous: dict[str, list[str]] | None = None) -> DataFrame:
    """df with running sums, minima and maxima (name -> column, current row included) and previous rows (name -> columns).

    Rows of a key are in the order of `order`, which must not contradict `block`. keys, block and order must not be null.
    Null values are passed over by the aggregates; the previous row is null at a key's first row. A new column takes the place
    of one of the same name.
    """
    kinds = [(F.sum, sums or {}), (F.min, mins or {}), (F.max, maxs or {})]
    place = F.struct(*order)
    states = [of(c).alias(f"__{n}") for of, each in kinds for n, c in each.items()]
    states += [F.max_by(F.struct(*cols), place).alias(f"__{n}") for n, cols in (previous or {}).items()]
    blocks = df.groupBy(*keys, block).agg(*(states or [F.count(F.lit(1)).alias("__n")]))
    earlier = Window.partitionBy(*keys).orderBy(block)
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    prefixes = [of(f"__{n}").over(before).alias(f"__{n}") for of, each in kinds for n in each]
    prefixes += [F.lag(f"__{n}").over(earlier).alias(f"__{n}") for n in (previous or {})]
    out = df.join(blocks.select(*keys, block, *prefixes), [*keys, block])
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    columns = [F.coalesce(F.sum(c).over(upto) + F.col(f"__{n}"), F.sum(c).over(upto), f"__{n}").alias(n) for n, c in (sums or {}).items()]
    columns += [F.least(F.min(c).over(upto), f"__{n}").alias(n) for n, c in (mins or {}).items()]
    columns += [F.greatest(F.max(c).over(upto), f"__{n}").alias(n) for n, c in (maxs or {}).items()]
    columns += [F.coalesce(F.lag(F.struct(*cols)).over(inside), f"__{n}").alias(n) for n, cols in (previous or {}).items()]
    made = {n.lower() for each in (sums, mins, maxs, previous) for n in (each or {})}
    return out.select(*[c for c in df.columns if c.lower() not in made], *columns)


def statistics(events: DataFrame, ttl_ms: int | None = None, block_ms: int = BLOCK_MS, previous: dict[str, list[str]] | None = None, inner: bool = False) -> DataFrame:
    """events (account_id, event_id, ms, amount) with n, mean and m2 (sum of squared deviations) up to and with each event,
    in the order (ms, event_id); with ttl_ms also epoch, how often the account had been idle for longer, as statistics restart
    then. `previous` (name -> columns) adds the account's event before, restart or not; null at its first.

    A block is cut into segments where a pause lies within it. Segments are combined map-side to count, mean and deviation,
    which are merged over an account's segments, one row each, as deviations from the epoch's first mean, so that large
    amounts that differ little lose nothing. Each segment then goes on from its prefix. Equal amounts have no deviation.
    `inner` adds the columns __block, __segment, __epoch, __before (n before the segment) and __total (n of the epoch).
    """
    made = {"n", "mean", "m2", *(["epoch"] if ttl_ms is not None else []), *map(str.lower, previous or {})}
    rows = events.drop(*[c for c in events.columns if c.lower() in made]).withColumn("__block", F.floor(F.col("ms") / block_ms).cast("bigint"))
    names, upto = rows.columns[:-1], lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    place = Window.partitionBy("account_id", "__block").orderBy("ms", "event_id")
    rows = rows.withColumns({f"__{n}": F.lag(F.struct(*cols)).over(place) for n, cols in (previous or {}).items()})
    if ttl_ms is None:
        rows = rows.withColumn("__segment", F.lit(0).cast("bigint"))
    else:
        rows = rows.withColumn("__idle", F.when(F.col("ms") - F.lag("ms").over(place) > ttl_ms, 1).otherwise(0).cast("bigint"))
        rows = rows.withColumn("__segment", F.sum("__idle").over(upto(place)))
    at, x = ["account_id", "__block", "__segment"], F.col("amount")
    sums = [F.count(F.lit(1)).alias("__c"), F.avg(x).alias("__avg"), (F.var_pop(x) * F.count(F.lit(1))).alias("__ss"), F.min(x).alias("__lo"), F.max(x).alias("__hi"), F.min("ms").alias("__from"), F.max("ms").alias("__to")]
    lasts = [F.max_by(F.struct(*cols), F.struct("ms", "event_id")).alias(f"__last_{n}") for n, cols in (previous or {}).items()]
    parts = rows.groupBy(*at).agg(*sums, *lasts)
    line = Window.partitionBy("account_id").orderBy("__block", "__segment")
    again = F.when((F.col("__segment") > 0) | (F.col("__from") - F.lag("__to").over(line) > (ttl_ms or 0)), 1).otherwise(0)
    parts = parts.withColumn("__again", again.cast("bigint") if ttl_ms is not None else F.lit(0).cast("bigint"))
    parts = parts.withColumns({f"__last_{n}": F.lag(f"__last_{n}").over(line) for n in (previous or {})})
    parts = parts.withColumn("__epoch", F.sum("__again").over(upto(line)))
    own = Window.partitionBy("account_id", "__epoch")
    inside = own.orderBy("__block", "__segment")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__origin", F.first("__avg").over(upto(inside))).withColumn("__d", F.col("__avg") - F.col("__origin"))
    s1, s2 = F.sum(F.col("__c") * F.col("__d")).over(before), F.sum(F.col("__ss") + F.col("__c") * F.col("__d") * F.col("__d")).over(before)
    prefix = parts.select(
        *at, "__epoch", "__avg", *[f"__last_{n}" for n in (previous or {})],
        F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"), F.sum("__c").over(own).alias("__total"),
        (F.col("__origin") + s1 / F.sum("__c").over(before)).alias("__mean0"), (s2 - s1 * s1 / F.sum("__c").over(before)).alias("__ss0"),
        F.min("__lo").over(before).alias("__lo0"), F.max("__hi").over(before).alias("__hi0"),
    )
    within = upto(Window.partitionBy(*at).orderBy("ms", "event_id"))
    out = rows.join(prefix, at).withColumns({
        "__n": F.count(F.lit(1)).over(within), "__m": F.col("__avg") + F.avg(x - F.col("__avg")).over(within), "__v": F.var_pop(x).over(within),
        "__lo": F.least(F.min(x).over(within), "__lo0"), "__hi": F.greatest(F.max(x).over(within), "__hi0"),
    })
    n, apart = F.col("__before") + F.col("__n"), F.col("__m") - F.col("__mean0")
    mean = F.when(F.col("__before") == 0, F.col("__m")).otherwise(F.col("__mean0") + apart * F.col("__n") / n)
    merged = F.col("__v") * F.col("__n") + F.when(F.col("__before") > 0, F.col("__ss0") + apart * apart * F.col("__before") * F.col("__n") / n).otherwise(0.0)
    m2 = F.when(F.col("__lo") == F.col("__hi"), 0.0).otherwise(F.greatest(F.lit(0.0), merged))
    columns = [F.coalesce(f"__{c}", f"__last_{c}").alias(c) for c in (previous or {})] + [n.alias("n"), mean.alias("mean"), m2.alias("m2")]
    columns += [F.col("__epoch").alias("epoch")] if ttl_ms is not None else []
    return out.select(*names, *columns, *(["__block", "__segment", "__epoch", "__before", "__total"] if inner else []))


def prior_in_window(df: DataFrame, key: str, at: str, tie: str, width: int, name: str = "prior") -> DataFrame:
    """df with the number of the key's rows before each row and less than `width` before it in `at` (bigint).

    A row exactly `width` earlier does not count; rows at the same time count if their `tie` is lower. Each row is counted
    within its own stretch of `width` and handed to the next one as context, so a task never needs more of a key than two
    stretches. key and at must not be null.
    """
    stretch = F.floor(F.col(at) / width)
    copies = df.withColumn("__own", F.explode(F.array(F.lit(True), F.lit(False))))
    copies = copies.withColumn("__stretch", stretch + F.when(F.col("__own"), 0).otherwise(1))
    group = Window.partitionBy(key, "__stretch")
    earlier = F.count(F.lit(1)).over(group.orderBy(at).rangeBetween(-(width - 1), -1))
    same = F.row_number().over(Window.partitionBy(key, "__stretch", "__own", at).orderBy(tie)) - 1
    return copies.withColumn(name, (earlier + same).cast("bigint")).filter("__own").drop("__own", "__stretch")
