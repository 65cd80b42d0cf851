"""Exactly one copy of each message: a persisted index of identifiers seen before.

Identifiers are 16 bytes; an array is stored as one binary value, the sorted identifiers one after the other. A batch is first combined to one row per identifier, map-side, so that copies of one message,
however many, are not shuffled. The distinct identifiers then meet the index by hash prefix: for each prefix the index holds
one sorted array per run, and a binary search of the batch's identifiers in these arrays tells the novel ones. Those become
a new immutable run. Runs are merged when there are more than `max_runs`; a merged run covers the batches in its name, and
the runs it covers are no longer read.

The number of prefixes is chosen so that an array stays near IDS_PER_PREFIX identifiers (16 bytes each), whatever the size.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import written

IDS_PER_PREFIX = 20_000
ADMITTED = "ns string, prefix int, ids binary, rows array<bigint>, repeated array<binary>"
WIDTH = 16
_RUN = re.compile(r"^(batch|merged)-(\d+)-(\d+)-b(\d+)$")


def prefix_bits_for(rows: int, ids_per_prefix: int = IDS_PER_PREFIX) -> int:
    """Bits of hash prefix with which `rows` distinct identifiers give arrays of about ids_per_prefix."""
    return min(30, max(4, math.ceil(math.log2(max(1, rows / ids_per_prefix)))))


def hash_prefix(ident: Column, bits: int) -> Column:
    """The first `bits` bits of the identifier's hash."""
    return F.shiftrightunsigned(F.xxhash64(ident), 64 - bits).cast("int")


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    """A column of 16-byte identifiers as a numpy array on the same memory; as all have one length, its order is that of
    their bytes."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):  # of no chunks
        return np.empty(0, f"S{WIDTH}")
    if len(array) == 0:
        return np.empty(0, f"S{WIDTH}")
    offsets = np.frombuffer(array.buffers()[1], np.int64 if pa.types.is_large_binary(array.type) else np.int32)
    return np.frombuffer(array.buffers()[2], f"S{WIDTH}", len(array), int(offsets[array.offset]))


def _stored(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The sorted arrays of an index column."""
    return [np.frombuffer(x.as_buffer(), f"S{WIDTH}") for x in column if x.is_valid and len(x.as_buffer())]


def _known(ids: np.ndarray, runs: list[np.ndarray]) -> np.ndarray:
    """Which ids are in any of the sorted arrays, by binary search."""
    found = np.zeros(len(ids), bool)
    for run in runs:
        if len(run):
            at = np.minimum(np.searchsorted(run, ids), len(run) - 1)
            found |= run[at] == ids
    return found


def _row(key: tuple, ids: np.ndarray, rows: np.ndarray, repeated: np.ndarray) -> pa.Table:
    """One row of ADMITTED."""
    spread = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    columns = [pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int32()), pa.array([ids.tobytes()], pa.binary())]
    same = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), len(repeated), [None, pa.py_buffer(repeated.tobytes())]).cast(pa.binary())
    return pa.table([*columns, spread(pa.array(rows, pa.int64())), spread(same)], ["ns", "prefix", "ids", "rows", "repeated"])


def _admit(key: tuple, batch: pa.Table, index: pa.Table | None) -> pa.Table:
    """One prefix of a batch against the index's arrays for that prefix."""
    ids, rows = _keys(batch["id"]), batch["row"].to_numpy()
    order = np.argsort(ids, kind="stable")
    known = _known(ids, _stored(index["ids"]) if index is not None else [])
    novel = order[~known[order]]
    return _row(key, ids[novel], rows[novel], ids[known | (batch["n"].to_numpy() > 1)])


def _merge(key: tuple, index: pa.Table) -> pa.Table:
    """One prefix's arrays of several runs as one array."""
    runs = _stored(index["ids"])
    ids = np.sort(np.concatenate(runs), kind="stable") if runs else np.empty(0, f"S{WIDTH}")
    return _row(key, ids, np.empty(0, np.int64), np.empty(0, f"S{WIDTH}"))


class IdIndex:
    """The index below a shared path. Opening an existing path finds its complete runs; incomplete ones are ignored."""

    def __init__(self, spark: SparkSession, path: str, prefix_bits: int = 12, max_runs: int = 4):
        self.spark, self.path, self.bits, self.max_runs = spark, path, prefix_bits, max_runs

    def _fs(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def _complete(self) -> list[tuple[str, int, int, int, str]]:
        """(kind, first, last, bits, path) of every run that was written to its end."""
        fs, root = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        runs = [(*m.groups(), f"{self.path}/{name}") for name in names if (m := _RUN.match(name))]
        marker = self.spark._jvm.org.apache.hadoop.fs.Path
        return [(kind, int(a), int(b), int(bits), path) for kind, a, b, bits, path in runs if fs.exists(marker(f"{path}/_SUCCESS"))]

    def live(self) -> list[tuple[str, int, int, int, str]]:
        """The runs to search: those that no wider merged run covers."""
        runs = self._complete()
        merged = [r for r in runs if r[0] == "merged"]
        covered = lambda r: any(m is not r and m[1] <= r[1] and r[2] <= m[2] and (r[0] == "batch" or (m[1], m[2]) != (r[1], r[2])) for m in merged)
        return sorted((r for r in runs if not covered(r)), key=lambda r: r[1])

    def admit(self, batch: DataFrame, number: int) -> DataFrame:
        """Admit batch `number` with the columns ns, id (16 bytes), row (bigint); each ns is a set of identifiers of its own.

        Returns per (ns, prefix) the sorted novel ids, for each of these the least row that has it, and the ids that came
        more than once or had been seen in an earlier batch. A batch admitted before is not admitted again: its stored
        outcome is returned. Rows with a null id must be left out by the caller.
        """
        done = [r for r in self._complete() if r[0] == "batch" and r[1] == number]
        if done:
            return self.spark.read.schema(ADMITTED).parquet(done[0][4])
        if any(r[3] != self.bits for r in self.live()):
            self.merge()
        local = batch.groupBy("ns", "id").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"))
        groups = local.withColumn("prefix", hash_prefix(F.col("id"), self.bits)).groupBy("ns", "prefix")
        if runs := self.live():
            index = self.spark.read.schema(ADMITTED).parquet(*[r[4] for r in runs]).select("ns", "prefix", "ids")
            admit = lambda key, left, right: _admit(key, left, right)
            out = groups.cogroup(index.groupBy("ns", "prefix")).applyInArrow(lambda key, left, right: admit(key, left, right) if len(left) else _nothing(), ADMITTED)
        else:
            out = groups.applyInArrow(lambda key, left: _admit(key, left, None), ADMITTED)
        path = f"{self.path}/batch-{number:06d}-{number:06d}-b{self.bits:02d}"
        out.write.mode("overwrite").parquet(path)
        if len(self.live()) > self.max_runs:
            self.merge()
        return self.spark.read.schema(ADMITTED).parquet(path)

    def merge(self) -> None:
        """Merge all live runs into one, at the present number of prefixes."""
        runs = self.live()
        arrays = self.spark.read.schema(ADMITTED).parquet(*[r[4] for r in runs]).select("ns", "prefix", "ids")
        if any(r[3] != self.bits for r in runs):
            places = F.sequence(F.lit(0), F.floor(F.length("ids") / WIDTH).cast("int") - 1)
            each = F.explode(F.transform(places, lambda i: F.substring(F.col("ids"), i * WIDTH + 1, F.lit(WIDTH)))).alias("ids")
            arrays = arrays.filter(F.length("ids") > 0).select("ns", each).withColumn("prefix", hash_prefix(F.col("ids"), self.bits))
        merged = arrays.groupBy("ns", "prefix").applyInArrow(lambda key, left: _merge(key, left), ADMITTED)
        first, last = min(r[1] for r in runs), max(r[2] for r in runs)
        merged.write.mode("overwrite").parquet(f"{self.path}/merged-{first:06d}-{last:06d}-b{self.bits:02d}")


def _nothing() -> pa.Table:
    kinds = [pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary())]
    return pa.table([pa.array([], k) for k in kinds], ["ns", "prefix", "ids", "rows", "repeated"])


def in_waves(messages: DataFrame, waves: int) -> list[DataFrame]:
    """Split (ns, id, row, batch) by batch number into `waves` parts in order; null batches come first. No row is left out.

    Apart from the numbers, messages are read once: they are put down by wave, and each part reads its own.
    """
    if waves <= 1:
        return [messages]
    ends = {r["ns"]: (r["lo"], r["hi"]) for r in messages.groupBy("ns").agg(F.min("batch").alias("lo"), F.max("batch").alias("hi")).collect()}
    number = F.lit(0)
    for ns, (lo, hi) in ends.items():
        if lo is not None:
            number = F.when(F.col("ns") == ns, F.least(F.lit(waves - 1), F.floor((F.col("batch") - lo) * waves / (hi - lo + 1)))).otherwise(number)
    landed = written(messages.withColumn("__wave", F.coalesce(number, F.lit(0)).cast("int")), "waves", by="__wave")
    return [landed.filter(F.col("__wave") == i).drop("__wave") for i in range(waves)]


def admit_all(index: IdIndex, messages: DataFrame, waves: int = 6) -> DataFrame:
    """Admit (ns, id, row, batch) wave by wave; the outcomes of all waves, as of IdIndex.admit. Rows with a null id are left out.

    Six waves are more than an index keeps as runs of their own, so that the last ones are searched for in a merged run.
    """
    out = None
    for i, wave in enumerate(in_waves(messages, waves)):
        admitted = index.admit(wave.filter(F.col("id").isNotNull()).select("ns", "id", "row"), i)
        out = admitted if out is None else out.unionByName(admitted)
    return out


def repeated_ids(admitted: DataFrame) -> DataFrame:
    """(ns, id) of the identifiers held by more than one row."""
    return admitted.select("ns", F.explode("repeated").alias("id")).distinct()


def kept_rows(admitted: DataFrame) -> DataFrame:
    """(ns, row) of the one row kept per identifier: the least row number of the first batch that has it."""
    return admitted.select("ns", F.explode("rows").alias("row"))
