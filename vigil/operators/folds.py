"""Sequential operators: deduplication with a time-to-live, token bucket, capped online variance.

Each is cut where its state is known without the past, so that a hot key is not one task: the first two where a gap resets
the state, the third into blocks that are folded to a map first and entered with their true state afterwards. Only keys with
more than HOT_ROWS rows are cut; they are found by a combined count. Folds stream over sorted partitions in Arrow batches,
work on arrays, and hold one key's state, never a key's rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vigil.operators.running import BLOCK_MS, running, statistics
from vigil.session import small_side, written

#: A key with more rows is cut into parts that are worked on side by side.
HOT_ROWS = 200_000
#: Groups of fewer rows are folded row by row, as setting up arrays would take longer.
FEW = 24


def _changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a key begins in a sorted batch, with 0 and the end."""
    turn = np.zeros(batch.num_rows - 1, bool)
    for key in keys:
        column = batch.column(key)
        values = column.to_numpy(zero_copy_only=False)
        turn |= values[1:] != values[:-1]
        if column.null_count:  # a null is a key like any other
            empty = column.is_null().to_numpy(zero_copy_only=False)
            turn = turn & ~(empty[1:] & empty[:-1]) | (empty[1:] != empty[:-1])
    return np.concatenate([[0], np.flatnonzero(turn) + 1, [batch.num_rows]])


def grouped_fold(df: DataFrame, keys: list[str], order: list[str], run: Callable, inputs: list[str], outputs: str, alone: Callable | None = None) -> DataFrame:
    """df with the columns `outputs`, made in the order of `order` within a key.

    run(state, inputs as arrays) gives the next state and the outputs of some consecutive rows of a key; the state is None at
    its first row. alone(inputs), if given, makes the outputs of rows that are their key's only one, for a batch at once.
    Rows are partitioned and sorted by Spark, which spills. The columns of df go through as they are.
    """
    made = StructType.fromDDL(outputs)
    schema, added = StructType([*df.schema.fields, *made.fields]), to_arrow_schema(made)
    kinds = [f.type.to_pandas_dtype() for f in added]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in inputs]
            cuts = _changes(batch, keys)
            heads = cuts[:-1]
            if alone:
                out = [np.asarray(x, kind).copy() for x, kind in zip(alone(columns), kinds)]
            else:
                out = [np.empty(batch.num_rows, kind) for kind in kinds]
            first = tuple(batch.column(c)[0].as_py() for c in keys)
            joined = key is not None and first == key
            for i, (a, b) in enumerate(zip(heads.tolist(), cuts[1:].tolist())):
                if alone and b - a == 1 and b < batch.num_rows and not (i == 0 and joined):
                    continue
                state, some = run(state if i == 0 and joined else None, [c[a:b] for c in columns])
                for place, values in zip(out, some):
                    place[a:b] = values
            key = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in keys)
            arrays = [pa.array(values, f.type) for values, f in zip(out, added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *added.names])

    # By a hash of the keys: a repartition by columns that a join has just placed is left out by Spark, and when the join then
    # becomes a broadcast while it runs, a key's rows are in several partitions.
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(fold, schema)


def _with_cuts(df: DataFrame, key: str, gap_ms: int, hot_rows: int) -> DataFrame:
    """df with __session, 0 but for rows of hot keys, where it rises if the key's previous row is at least gap_ms earlier."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__rows"))
    hot = small_side(counts.filter(F.col("__rows") > hot_rows).select(key), "hot-keys")
    if hot.isEmpty():
        return df.withColumn("__session", F.lit(0).cast("bigint"))
    some = df.join(hot, key, "left_semi").withColumn("__block", F.floor(F.col("ms") / BLOCK_MS))
    placed = written(running(some, [key], "__block", ["ms", "arrival"], previous={"__prev": ["ms"]}), "hot-rows")
    cut = placed.withColumn("__cut", F.when(F.col("ms") - F.col("__prev.ms") >= gap_ms, 1).otherwise(0).cast("bigint"))
    cut = running(cut, [key], "__block", ["ms", "arrival"], {"__session": "__cut"}).drop("__prev", "__cut", "__block")
    both = df.join(hot, key, "left_anti").withColumn("__session", F.lit(0).cast("bigint")).unionByName(cut)
    return both.select(*df.columns, "__session")  # a join moves its keys to the front


def dedup_ttl(events: DataFrame, ttl_ms: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """events (event_id, ms, arrival, ...) with `accepted`: false where an accepted copy is less than the ttl old.

    A blocked copy does not prolong the time. A copy at least the ttl after the copy before it is accepted whatever came
    earlier, which is where a hot id's rows are cut. A null id is an id like any other; ms must not be null.
    """

    def run(last: int | None, columns: list) -> tuple:
        accepted = []
        for ms in columns[0].tolist():
            accepted.append(last is None or ms - last >= ttl_ms)
            last = ms if accepted[-1] else last
        return last, [accepted]

    alone = lambda columns: [np.ones(len(columns[0]), bool)]
    cut = _with_cuts(events, "event_id", ttl_ms, hot_rows)
    return grouped_fold(cut, ["event_id", "__session"], ["ms", "arrival"], run, ["ms"], "accepted boolean", alone).drop("__session")


def token_bucket(events: DataFrame, ttl_ms: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """events (account_id, ms, arrival, rate, ...) with `allowed`, and wait_ms for the next token where not.

    Capacity equals the rate; an unseen or expired bucket is full; a second's pause fills any bucket, which is where a hot
    account's rows are cut. A rate below 1 can never hold a token: nothing is allowed.
    """

    def run(state: tuple | None, columns: list) -> tuple:
        times, rates = columns
        if len(times) >= FEW and rates.min() == rates.max() >= 1:
            # Without a refusal the tokens before each take are the rate plus S less the running maximum of S, the running sum of
            # refills less takes; where that stays above 1 nobody is refused and the last value is all there is to know.
            rate, tokens, at = float(rates[0]), *(state or (float(rates[0]), None))
            steps = np.diff(times, prepend=times[0] if at is None else at)
            if steps.min() >= 0 and steps.max() <= ttl_ms:
                refills = steps / 1000.0 * rate
                refills[0] = 0.0 if at is None else min(refills[0], rate - tokens)
                total = np.cumsum(refills - 1) + 1
                level = np.minimum(tokens + total, rate + total - np.maximum.accumulate(total))
                if level.min() > 1 + 1e-6:
                    return (float(level[-1]) - 1, int(times[-1])), [np.ones(len(times), bool), np.zeros(len(times), np.int64)]
        allowed, waits = [], []
        tokens, at = state or (None, None)
        for ms, rate in zip(times.tolist(), rates.tolist()):
            full = at is None or ms - at > ttl_ms
            tokens = float(rate) if full else min(float(rate), tokens + max(0, ms - at) / 1000.0 * rate)
            allowed.append(tokens >= 1)
            waits.append(0 if tokens >= 1 else math.ceil((1 - tokens) / rate * 1000) if rate > 0 else -1)
            tokens, at = tokens - 1 if tokens >= 1 else tokens, ms
        return (tokens, at), [allowed, waits]

    def alone(columns: list) -> list:
        rates = columns[1].astype(float)
        waits = np.ceil((1 - rates) / np.where(rates > 0, rates, 1) * 1000)
        return [rates >= 1, np.where(rates >= 1, 0, np.where(rates > 0, waits, -1)).astype(np.int64)]

    cut = _with_cuts(events, "account_id", 1000, hot_rows)
    return grouped_fold(cut, ["account_id", "__session"], ["ms", "arrival"], run, ["ms", "rate"], "allowed boolean, wait_ms bigint", alone).drop("__session")


def advance(xs: np.ndarray, n: int, mean: float, m2: float, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, mean and m2 after each of the amounts, online up to `cap` events and decaying beyond, from a given state."""
    if len(xs) < FEW or cap < 2:
        rows = []
        for x in xs.tolist():
            n += 1
            d = x - mean
            mean = mean + d / min(n, cap)
            m2 = (m2 - m2 / cap if n > cap else m2) + d * (x - mean)
            rows.append((n, mean, m2))
        ns, means, m2s = zip(*rows)
        return np.array(ns), np.array(means), np.array(m2s)
    count, at, means, m2s = n + np.arange(1, len(xs) + 1), 0, np.empty(len(xs)), np.empty(len(xs))
    keep = 1 - 1 / cap
    while at < len(xs):
        online = n + at < cap
        end = min(len(xs), at + (cap - n - at if online else 4 * cap))
        origin = float(xs[at]) if n + at == 0 else mean
        y = xs[at:end] - origin
        # Both recurrences are v' = keep v + input; online, the mean is a running sum by the count and m2 keeps everything.
        power = keep ** np.arange(1, end - at + 1)
        path = np.cumsum(y) / count[at:end] if online else power * np.cumsum(y / cap / power)
        apart = y - np.concatenate([[0.0], path[:-1]])
        grown = apart * (y - path)
        m2s[at:end] = m2 + np.cumsum(grown) if online else power * (m2 + np.cumsum(grown / power))
        means[at:end] = origin + path
        mean, m2, at = float(means[end - 1]), float(m2s[end - 1]), end
    return count, means, m2s


def block_map(xs: np.ndarray, n: int, cap: int) -> list[float]:
    """What a block does to the state it is entered with: [first, shift, keep, q0, q1, q2, keep2].

    With u = mean - first on entering, mean becomes first + shift + keep u, and m2 becomes keep2 m2 + q0 + q1 u + q2 u^2.
    Amounts count from the block's first one, so that a large mean does not swallow a small deviation.
    """
    first = float(xs[0])
    counts, means, m2s = advance(xs, n, first, 0.0, cap)
    y, path = xs - first, means - first
    apart = y - np.concatenate([[0.0], path[:-1]])
    before = counts - 1  # events before each one
    decays = np.maximum(counts - max(cap, n), 0)  # steps of decay up to and with each one
    b = 1 - 1 / np.minimum(counts, cap)
    # How much of u is left before each event: n/(n+1) and so on up to the cap, then a constant factor.
    factor = (1 - 1 / cap) if cap > 1 else 0.0
    left = (n / np.minimum(np.maximum(before, 1), max(cap, n)) if n else np.where(before == 0, 1.0, 0.0)) * factor ** np.maximum(before - max(cap, n), 0)
    weight = factor ** (decays[-1] - decays).astype(float)
    q1, q2 = float(np.sum(-2 * weight * b * apart * left)), float(np.sum(weight * b * left * left))
    return [first, float(path[-1]), float(left[-1] * b[-1]), float(m2s[-1]), q1, q2, float(factor ** float(decays[-1]))]


def throttle(events: DataFrame, ttl_ms: int, budget_ms: int = 5000) -> DataFrame:
    """events (account_id, ms, arrival, rate, ...) with `admitted`, and delay_ms from an event's time to its admission or refusal.

    An account's events go one after the other: each waits for the one before it, then for a token, and is refused when it has
    waited for budget_ms. Buckets are as in token_bucket(). As waiting piles up, an account is one task here, which streams.
    """

    def run(state: tuple | None, columns: list) -> tuple:
        admitted, delays = [], []
        tokens, at = state or (None, None)
        for ms, rate in zip(columns[0].tolist(), columns[1].tolist()):
            now = ms if at is None else max(ms, at)
            full = at is None or now - at > ttl_ms
            tokens = float(rate) if full else min(float(rate), tokens + (now - at) / 1000.0 * rate)
            if tokens < 1:
                wait = math.ceil((1 - tokens) / rate * 1000) if rate >= 1 else budget_ms
                wait = min(wait, budget_ms)
                now, tokens = now + wait, min(float(rate), tokens + wait / 1000.0 * rate)
            admitted.append(tokens >= 1)
            delays.append(now - ms)
            tokens, at = tokens - 1 if tokens >= 1 else tokens, now
        return (tokens, at), [admitted, delays]

    def alone(columns: list) -> list:
        free = columns[1].astype(float) >= 1
        return [free, np.where(free, 0, budget_ms)]

    return grouped_fold(events, ["account_id"], ["ms", "arrival"], run, ["ms", "rate"], "admitted boolean, delay_ms bigint", alone)


def then(one: list[float], two: list[float]) -> list[float]:
    """The map of two consecutive parts of a block, as block_map."""
    f1, s1, k1, a0, a1, a2, m1 = one
    f2, s2, k2, b0, b1, b2, m2 = two
    d = f1 + s1 - f2
    return [f1, f2 + s2 + k2 * d - f1, k1 * k2, m2 * a0 + b0 + b1 * d + b2 * d * d, m2 * a1 + (b1 + 2 * b2 * d) * k1, m2 * a2 + b2 * k1 * k1, m1 * m2]


def capped_welford(events: DataFrame, cap: int, block_ms: int = BLOCK_MS, ttl_ms: int | None = None, previous: dict[str, list[str]] | None = None) -> DataFrame:
    """events (account_id, event_id, ms, amount) with n, mean and m2 after each: online up to `cap` events, then decaying.

    Beyond the cap the mean moves by 1/cap and m2 first loses 1/cap of itself; n goes on counting. With ttl_ms, statistics
    restart after a longer pause. `previous` as in statistics(). Where an account has at most `cap` events between restarts,
    that is plain running statistics. The others are cut into blocks that are folded side by side: (mean, m2) changes with
    each amount by a map that is linear in m2 and quadratic in the mean, so a block is one such map. The maps are applied in
    order, a row per block, and give each block the state with which it starts; equal amounts have no deviation.
    """
    plain = written(statistics(events, ttl_ms, block_ms, previous, inner=True), "running-statistics")
    inner = ["__block", "__segment", "__epoch", "__before", "__total"]
    few, many = plain.filter(F.col("__total") <= cap).drop(*inner), plain.filter(F.col("__total") > cap).drop("n", "mean", "m2")
    at, out = ["account_id", "__block", "__segment"], ["account_id", "__epoch", "__block", "__segment"]
    kinds = dict(many.dtypes)
    made_of = StructType.fromDDL(", ".join([*[f"`{c}` {kinds[c]}" for c in out], "__map array<double>"]))
    arrow = to_arrow_schema(made_of)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], arrow.names)

    def to_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, key, seen, whole = [], None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = _changes(batch, at).tolist()
            heads = list(zip(*[batch.column(c).take(pa.array(cuts[:-1])).to_pylist() for c in out]))
            xs, before = batch.column("amount").to_numpy(zero_copy_only=False), batch.column("__before").to_numpy(zero_copy_only=False)
            for here, a, b in zip(heads, cuts[:-1], cuts[1:]):
                if here != key:
                    if key is not None:
                        made.append((*key, whole))
                    key, seen, whole = here, 0, None
                part = block_map(xs[a:b], int(before[a]) + seen, cap)
                whole, seen = part if whole is None else then(whole, part), seen + b - a
            yield as_batch(made)
            made = []
        if key is not None:
            yield as_batch([(*key, whole)])

    narrow = many.select(*out, "ms", "event_id", "amount", "__before")
    ordered = narrow.repartition(F.xxhash64(*at)).sortWithinPartitions(*at, "ms", "event_id")
    maps = ordered.mapInArrow(to_maps, made_of)

    def enter(state: tuple | None, columns: list) -> tuple:
        means, m2s = [], []
        for first, shift, keep, q0, q1, q2, keep2 in columns[0]:
            mean, m2 = state or (first, 0.0)
            means.append(mean)
            m2s.append(m2)
            u = mean - first
            state = first + shift + keep * u, max(0.0, keep2 * m2 + q0 + q1 * u + q2 * u * u)
        return state, [means, m2s]

    entries = grouped_fold(maps, ["account_id", "__epoch"], ["__block", "__segment"], enter, ["__map"], "__mean double, __m2 double").drop("__map", "__epoch")

    def finish(state: tuple | None, columns: list) -> tuple:
        xs, before, mean, m2 = columns
        ns, means, m2s = advance(xs, *(state or (int(before[0]), float(mean[0]), float(m2[0]))), cap)
        return (int(ns[-1]), float(means[-1]), float(m2s[-1])), [ns, means, m2s]

    joined = many.join(entries, at)
    done = grouped_fold(joined, at, ["ms", "event_id"], finish, ["amount", "__before", "__mean", "__m2"], "n bigint, mean double, m2 double")
    return few.unionByName(done.drop("__mean", "__m2", *inner))
