"""One row per entity with a count and a latest time for each of hundreds of event types, kept up by signed deltas.

An event has an identifier; a later delivery of it replaces the earlier one. A new event is an insert (+1), a replacement
that changes entity, type or time is a retraction (-1) of the old version and an insert of the new one, and an identical
delivery is nothing at all. Deltas are combined per (entity, type) before they meet the state. Counts just add up. The
latest time takes the greater of both sides, except where a retraction reaches the latest event: only those (entity, type)
pairs are recomputed from the surviving versions.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import written

#: Types beyond this number are refused, as each becomes two columns. Lists of types are the only thing the driver reads.
MAX_TYPES = 5_000
_TOTAL = "\x00total"


def versions(events: DataFrame, is_new: Column) -> DataFrame:
    """(before, now) per event: its version without and with the rows for which is_new holds.

    events has id, seq (bigint; the highest is the valid version), entity, type, at_us. A null id is an error of the caller:
    events without an identifier need one of their own. Copies of one event are combined before the shuffle.
    """
    version = F.struct("entity", "type", "at_us")
    before = F.max_by(version, F.when(~is_new, F.col("seq")))
    return events.groupBy("id").agg(before.alias("before"), F.max_by(version, "seq").alias("now"))


def state_of(version: str, of: DataFrame) -> DataFrame:
    """(entity, type, n, latest_us) of one side of versions()."""
    rows = of.filter(F.col(version).isNotNull()).select(f"{version}.*")
    return rows.groupBy("entity", "type").agg(F.count(F.lit(1)).alias("n"), F.max("at_us").alias("latest_us"))


def signed_deltas(of: DataFrame) -> DataFrame:
    """(entity, type, dn, inserted_us, retracted_us): the deltas of versions(), combined."""
    changed = of.filter(~F.col("before").eqNullSafe(F.col("now")))
    signed = F.array(F.struct(F.lit(1).alias("sign"), F.col("now").alias("v")), F.struct(F.lit(-1).alias("sign"), F.col("before").alias("v")))
    rows = changed.select(F.explode(signed).alias("d")).select("d.sign", "d.v").filter(F.col("v").isNotNull()).select("sign", "v.*")
    latest = lambda sign: F.max(F.when(F.col("sign") == sign, F.col("at_us")))
    return rows.groupBy("entity", "type").agg(F.sum("sign").alias("dn"), latest(1).alias("inserted_us"), latest(-1).alias("retracted_us"))


def _on(left: str, right: str) -> Column:
    return F.col(f"{left}.entity").eqNullSafe(F.col(f"{right}.entity")) & F.col(f"{left}.type").eqNullSafe(F.col(f"{right}.type"))


def _merged(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """(entity, type, n, latest_us, hit): the state after the deltas, hit being true where latest_us must be looked up anew."""
    joined = state.alias("s").join(deltas.alias("d"), _on("s", "d"), "full")
    reached = (F.col("d.retracted_us") >= F.col("s.latest_us")) & ~F.coalesce(F.col("d.inserted_us") >= F.col("s.latest_us"), F.lit(False))
    return joined.select(
        F.coalesce("s.entity", "d.entity").alias("entity"),
        F.coalesce("s.type", "d.type").alias("type"),
        (F.coalesce("s.n", F.lit(0)) + F.coalesce("d.dn", F.lit(0))).alias("n"),
        F.greatest("s.latest_us", "d.inserted_us").alias("latest_us"),
        F.coalesce(reached, F.lit(False)).alias("hit"),
    ).filter(F.col("n") > 0)


def _looked_up(hit: DataFrame, surviving: DataFrame) -> DataFrame:
    """The hit pairs with their latest time among the surviving versions."""
    pairs = hit.select("entity", "type")
    again = surviving.alias("e").join(pairs.alias("h"), _on("e", "h"), "left_semi").groupBy("entity", "type").agg(F.max("at_us").alias("again_us"))
    return hit.alias("m").join(again.alias("a"), _on("m", "a"), "left").select("m.entity", "m.type", "m.n", F.col("a.again_us").alias("latest_us"))


def apply_deltas(state: DataFrame, deltas: DataFrame, surviving: DataFrame) -> DataFrame:
    """The state after the deltas. surviving (entity, type, at_us) holds the valid versions; only pairs whose latest event
    was retracted are looked up there. Pairs left without events are dropped."""
    merged = _merged(state, deltas)
    return merged.filter(~F.col("hit")).drop("hit").unionByName(_looked_up(merged.filter("hit"), surviving))


class FeatureStore:
    """Features kept below a shared path: the state, and the valid version of every event in runs by batch.

    add() reads the new batch alone, beside the store's own tables: it looks the batch's identifiers up in the runs, turns what
    they were and are into signed deltas, combines these per (entity, type), and adds them to the state. Only where a retraction
    reached the latest event, the time is looked up in the surviving versions. More than max_runs runs are merged to one.

    Batches have numbers; one that is complete is not added again, one that broke off is written anew. Within and between
    batches the version with the highest seq is valid.
    """

    VERSION = ("entity", "type", "at_us")

    def __init__(self, spark: SparkSession, path: str, max_runs: int = 4):
        self.spark, self.path, self.max_runs = spark, path, max_runs

    def _complete(self, kind: str) -> list[tuple[int, int]]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        root = hadoop(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        found = [m for name in names if (m := re.fullmatch(rf"{kind}-(\d+)-(\d+)", name)) and fs.exists(hadoop(f"{self.path}/{name}/_SUCCESS"))]
        return sorted((int(m[1]), int(m[2])) for m in found)

    def _runs(self) -> list[tuple[int, int]]:
        """The runs of versions of complete batches that no wider run covers."""
        last = self.last()
        runs = [r for r in self._complete("versions") if last is not None and r[1] <= last]
        return [r for r in runs if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in runs)]

    def last(self) -> int | None:
        """The number of the last complete batch."""
        return max((b for _, b in self._complete("fixes")), default=None)

    def _versions(self) -> list[DataFrame]:
        return [self.spark.read.parquet(f"{self.path}/versions-{a}-{b}").withColumn("run", F.lit(b)) for a, b in self._runs()]

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def state(self) -> DataFrame:
        """(entity, type, n, latest_us) as of the last complete batch."""
        last = self.last()
        if last is None:
            return self.spark.createDataFrame([], "entity string, type string, n bigint, latest_us bigint")
        merged = self.spark.read.parquet(f"{self.path}/state-{last}-{last}").filter(~F.col("hit")).drop("hit")
        return merged.unionByName(self.spark.read.parquet(f"{self.path}/fixes-{last}-{last}"))

    def add(self, events: DataFrame, number: int) -> None:
        """Add a batch (id, seq, entity, type, at_us). ids must not be null; copies of one event are combined before the shuffle."""
        last = self.last()
        if last is not None and number <= last:
            return
        version = F.struct(*self.VERSION)
        new = events.groupBy("id").agg(F.max_by(version, "seq").alias("now"), F.max("seq").alias("seq"))
        if runs := self._versions():
            old = runs[0]
            for run in runs[1:]:
                old = old.unionByName(run)
            if len(runs) > 1:
                old = old.join(new.select("id"), "id", "left_semi").groupBy("id").agg(F.max_by("now", "run").alias("now"), F.max_by("seq", "run").alias("seq"))
            of = new.join(old.select("id", F.col("now").alias("before"), F.col("seq").alias("before_seq")), "id", "left")
            stale = F.coalesce(F.col("before_seq") > F.col("seq"), F.lit(False))
            of = of.select("id", "before", F.when(stale, F.col("before")).otherwise(F.col("now")).alias("now"), F.greatest("before_seq", "seq").alias("seq"))
        else:
            of = new.select("id", F.lit(None).cast(new.schema["now"].dataType).alias("before"), "now", "seq")
        self._write(of, f"versions-{number}-{number}")
        of = self.spark.read.parquet(f"{self.path}/versions-{number}-{number}")
        self._write(_merged(self.state(), signed_deltas(of)), f"state-{number}-{number}")
        hit = self.spark.read.parquet(f"{self.path}/state-{number}-{number}").filter("hit").drop("hit")
        fixes = hit.select("entity", "type", "n", "latest_us") if hit.isEmpty() else _looked_up(hit, self._surviving(hit, of))
        self._write(fixes, f"fixes-{number}-{number}")  # the batch's last step
        if len(self._runs()) > self.max_runs:
            self.merge()

    def _surviving(self, hit: DataFrame, newest: DataFrame) -> DataFrame:
        """Valid versions of the hit pairs: of all runs the versions of these pairs that no later run replaced."""
        parts, later = [newest.select("now.*")], newest.select("id")
        pairs = written(hit.select("entity", "type"), "hit-pairs")
        for run in reversed(self._versions()):
            own = run.select("id", "now.*")
            same = F.col("e.entity").eqNullSafe(F.col("h.entity")) & F.col("e.type").eqNullSafe(F.col("h.type"))
            parts.append(own.alias("e").join(pairs.alias("h"), same, "left_semi").join(later, "id", "left_anti").drop("id"))
            later = later.unionByName(run.select("id"))
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def merge(self) -> None:
        """Merge the runs of versions into one that has every event's valid version."""
        runs, ends = self._versions(), self._runs()
        every = runs[0]
        for run in runs[1:]:
            every = every.unionByName(run)
        latest = every.groupBy("id").agg(F.max_by("before", "run").alias("before"), F.max_by("now", "run").alias("now"), F.max_by("seq", "run").alias("seq"))
        self._write(latest, f"versions-{ends[0][0]}-{ends[-1][1]}")


def feature_column(kind: str, name: str) -> str:
    """The column of a type: a readable part and a hash, as names may differ only in signs or case."""
    slug = re.sub("[^a-z0-9]+", "_", name.lower()).strip("_")[:40]
    return f"{kind}_{slug}_{hashlib.sha1(name.encode()).hexdigest()[:8]}"


def type_names(state: DataFrame, listed: DataFrame | None = None) -> list[str]:
    """The types that occur and those listed, in order; more than MAX_TYPES raise an error."""
    names = state.select("type")
    if listed is not None:
        names = names.unionByName(listed.select(F.col(listed.columns[0]).alias("type")))
    found = sorted(r[0] for r in names.filter(F.col("type").isNotNull()).distinct().limit(MAX_TYPES + 1).collect())
    if len(found) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} types")
    return found


def feature_table(state: DataFrame, names: list[str]) -> DataFrame:
    """One row per entity: n_total, latest_total_us, then n_ and latest_ columns of each name (0 and null without events).

    Events with a null type count in the totals only. A null entity is an entity of its own.
    The state is partitioned by entity first, so that wide rows are built where they stay and are never shuffled.
    """
    totals = state.groupBy("entity").agg(F.sum("n").alias("n"), F.max("latest_us").alias("latest_us")).withColumn("type", F.lit(_TOTAL))
    long = state.filter(F.col("type").isNotNull()).unionByName(totals).repartition("entity")
    wide = long.groupBy("entity").pivot("type", [_TOTAL, *names]).agg(F.first("n").alias("n"), F.first("latest_us").alias("latest"))
    columns = ["entity", "n_total", "latest_total_us"]
    for name in names:
        columns += [feature_column("n", name), feature_column("latest_us", name)]
    wide = wide.toDF(*columns)
    return wide.select("entity", *[F.coalesce(c, F.lit(0)).alias(c) if c.startswith("n_") else F.col(c) for c in columns[1:]])
