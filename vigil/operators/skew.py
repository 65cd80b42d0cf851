"""Results per key while a few keys hold most of the rows.

Every task combines its own rows into one mergeable state per key in a bounded hash table (which Spark turns into sorted
runs on disk when it fills), and only those states are shuffled. A key thus costs a reducer at most one row per map task,
however many rows it has. Counts, sums and extremes are algebraic and need nothing else. Distinct counts are not: they
are made algebraic by combining per (key, value) first, which spreads a hot key's values over all reducers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.session import written


def combine_by_key(df: DataFrame, keys: list[str], states: list[Column], distinct: dict[str, str] | None = None) -> DataFrame:
    """One row per key with the given algebraic aggregates and, for each entry of `distinct`, a distinct count.

    `distinct` maps an output name to a column of df; null values are not counted. A null key is a key of its own.
    An empty df gives no rows. Other columns of df, whatever their names, are not touched.
    """
    out = df.groupBy(*keys).agg(*states)
    for name, column in (distinct or {}).items():
        values = df.select(*keys, F.col(column).alias("__value")).groupBy(*keys, "__value").agg(F.lit(1).alias("__one"))
        counts = values.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count("__value").alias(name))
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        condition = same[0]
        for one in same[1:]:
            condition = condition & one
        out = out.join(counts, condition).drop(*[f"__{k}" for k in keys])
    return out


def combine_with_distinct(df: DataFrame, keys: list[str], value: str, name: str, rows: str, mins: dict[str, Column], maxs: dict[str, Column]) -> DataFrame:
    """One row per key with the number of rows, minima, maxima and the number of distinct values of a column, in one pass.

    Rows are combined per (key, value) first, the value being 128 bits of hash instead of its text, which spreads a hot key over
    all reducers; these states are then combined per key. Null values are not counted as values; a null key is a key of its own.
    """
    column = F.col(value)
    marks = [F.when(column.isNotNull(), F.xxhash64(column)).alias("__h1"), F.when(column.isNotNull(), F.xxhash64(F.lit(1), column)).alias("__h2")]
    bare = df.select(*keys, *marks, *[c.alias(n) for n, c in {**mins, **maxs}.items()])
    inner = [F.count(F.lit(1)).alias("__n"), *[F.min(n).alias(n) for n in mins], *[F.max(n).alias(n) for n in maxs]]
    parts = bare.groupBy(*keys, "__h1", "__h2").agg(*inner)
    outer = [F.sum("__n").alias(rows), F.count("__h1").alias(name), *[F.min(n).alias(n) for n in mins], *[F.max(n).alias(n) for n in maxs]]
    return parts.groupBy(*keys).agg(*outer)


def heavy_keys(df: DataFrame, group: str, key: str, share: tuple[int, int] = (1, 100)) -> DataFrame:
    """(group, key) pairs that hold at least share[0]/share[1] of the rows of their group.

    Every row counts, also rows with a null key, but a null key is never a result. The rows are read once: the combined
    counts, a row per key, are kept in the shared folder, and the totals are one row per group of these.
    """
    counts = written(combine_by_key(df, [group, key], [F.count(F.lit(1)).alias("__n")]), "key-counts")
    totals = counts.groupBy(F.col(group).alias("__group")).agg(F.sum("__n").alias("__total"))
    at_least = F.col("__n") * share[1] >= F.col("__total") * share[0]
    return counts.join(totals, F.col(group) == F.col("__group")).filter(at_least & F.col(key).isNotNull()).select(group, key)
