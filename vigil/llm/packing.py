"""Filling containers of fixed capacity with texts: harmonic packing.

A text of s tokens is of class k = floor(capacity / s), so k texts of its class fit into a container, whichever they are.
Every class up to CLASSES - 1 is numbered on its own, k texts to a container. Texts of at most capacity / CLASSES tokens form
the last class, which is laid end to end and cut where a text may no longer begin. A class is numbered in SHARES hash shares
side by side; the texts that do not make a full container there, fewer than k per class and share, are numbered together
afterwards. So work is spread however large a class is, only sizes are shuffled, and no Python is needed.

That leaves up to capacity / (k + 1) unused per container. With top_up=True the room that a class's fixed count leaves is
filled at once with the largest texts of smaller classes that fit, within shares of about TOP_UP_ROWS texts.

A text larger than the capacity is cut into full pieces, which are of class 1, and a rest, which is packed like any other text.
Null and empty texts have no tokens: they come out with a null container, so every document is in the result. Documents may
repeat and ids may be null; every row is packed. Tokens are bytes of the UTF-8 text, those of a byte-level tokenizer.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import written

CLASSES = 12
SHARES = 1024
TOP_UP_ROWS = 20_000
MAX_PROFILES = 1_000
PACKED = "pack_name string, container_id string, doc_id bigint, piece_no int, start_token bigint, tokens bigint"


def harmonic_bins(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size (all within 1..capacity): class by class k to a bin, then topped up. Ties go by position."""
    order = np.argsort(sizes, kind="stable")
    ascending = sizes[order].tolist()
    below = list(range(-1, len(ascending)))  # below[i + 1]: place of the largest unused item at or before i, by path halving
    bins = np.empty(len(ascending), np.int64)

    def unused(place: int) -> int:
        i = place + 1
        while below[i] != i - 1:
            below[i] = below[below[i] + 1]
            i = below[i] + 1
        return i - 1

    at, number = unused(len(ascending) - 1), 0
    while at >= 0:
        k, room, taken = capacity // ascending[at], capacity, 0
        while at >= 0:
            bins[at] = number
            below[at + 1] = at - 1
            room -= ascending[at]
            taken += 1
            same_class = unused(at)
            if taken < k and same_class >= 0 and capacity // ascending[same_class] == k:
                at = same_class
            else:
                at = unused(bisect_right(ascending, room) - 1) if room > 0 else -1
        number += 1
        at = unused(len(ascending) - 1)
    out = np.empty(len(bins), np.int64)
    out[order] = bins
    return out


def _pieces(docs: DataFrame, wanted: list[tuple[str, int]]) -> DataFrame:
    """(pack_name, capacity, doc_id, piece_no, start_token, tokens): every document cut as far as a profile requires."""
    profile = F.explode(F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("bigint").alias("capacity")) for n, c in wanted])).alias("p")
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"), profile).select("p.*", "doc_id", "size")
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / F.col("capacity")) - 1).cast("int")
    cut = sized.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last)))
    start = (F.col("piece_no") * F.col("capacity")).alias("start_token")
    return cut.select("pack_name", "capacity", "doc_id", "piece_no", start, F.least("capacity", F.col("size") - F.col("piece_no") * F.col("capacity")).alias("tokens"))


def _harmonic(pieces: DataFrame, shares: int) -> DataFrame:
    """PACKED for pieces with tokens, by classes alone."""
    k = F.least(F.floor(F.col("capacity") / F.col("tokens")), F.lit(CLASSES)).cast("int")
    placed = pieces.withColumn("k", k).withColumn("share", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shares)).cast("int"))
    # Texts of the last class begin within a stretch of the capacity less the largest of them.
    span = F.col("capacity") - F.floor(F.col("capacity") / CLASSES) + 1

    def bins(*keys: str) -> tuple:
        group = Window.partitionBy("pack_name", "k", *keys)
        line = group.orderBy("doc_id", "piece_no", "tokens")
        number = F.floor((F.row_number().over(line) - 1) / F.col("k"))
        begin = F.coalesce(F.sum("tokens").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return F.when(F.col("k") < CLASSES, number).otherwise(F.floor(begin / span)), group

    bin_no, group = bins("share")
    numbered = placed.withColumn("bin", bin_no)
    full = F.when(F.col("k") < CLASSES, (F.col("bin") + 1) * F.col("k") <= F.count(F.lit(1)).over(group)).otherwise(F.col("bin") < F.max("bin").over(group))
    numbered = written(numbered.withColumn("full", full), "classes")
    name = lambda *parts: F.concat_ws("-", F.concat(F.lit("class"), F.col("k")), *parts, F.col("bin")).alias("container_id")
    columns = ["doc_id", "piece_no", "start_token", "tokens"]
    rest = numbered.filter(~F.col("full")).withColumn("bin", bins()[0])
    return numbered.filter("full").select("pack_name", name(F.lit("share"), "share"), *columns).unionByName(rest.select("pack_name", name(F.lit("rest")), *columns))


def _topped(pieces: DataFrame, shares: int) -> DataFrame:
    """PACKED for pieces with tokens, classes being topped up within shares."""

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tokens", "doc_id", "piece_no"], kind="stable")
        bins = harmonic_bins(group["tokens"].to_numpy(), int(group["capacity"].iloc[0]))
        group["container_id"] = [f"topped-{int(group['share'].iloc[0])}-{b}" for b in bins]
        group["doc_id"] = group["doc_id"].astype("Int64")
        return group[["pack_name", "container_id", "doc_id", "piece_no", "start_token", "tokens"]]

    share = F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shares)).alias("share")
    return pieces.select("*", share).groupBy("pack_name", "share").applyInPandas(fill, PACKED)


def pack(docs: DataFrame, profiles: DataFrame, shares: int | None = None, top_up: bool = False) -> DataFrame:
    """A row per piece: pack_name, container_id, doc_id, piece_no, start_token, tokens, for each profile over all documents.

    docs has doc_id and text; profiles pack_name and capacity_tokens, at most MAX_PROFILES rows, with capacities above 0
    (others are left out, repeated rows count once, a name with two capacities is refused). Where shares is not given it is SHARES, and for top_up the next power of two that keeps a share near
    TOP_UP_ROWS texts, so that a few more documents move no text.
    """
    rows = profiles.select("pack_name", "capacity_tokens").filter("capacity_tokens > 0").distinct().limit(MAX_PROFILES + 1).collect()
    wanted = [(r[0], int(r[1])) for r in rows]
    if len(wanted) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} profiles")
    if len({name for name, _ in wanted}) < len(wanted):
        raise ValueError("a profile has two capacities")
    if not wanted:
        return docs.sparkSession.createDataFrame([], PACKED)
    pieces = _pieces(docs, wanted)
    if top_up:
        held = _topped(pieces.filter("tokens > 0"), shares or 1 << max(0, -(-docs.count() // TOP_UP_ROWS) - 1).bit_length())
    else:
        held = _harmonic(pieces.filter("tokens > 0"), shares or SHARES)
    nothing = F.lit(None).cast("string").alias("container_id")
    return held.unionByName(pieces.filter("tokens = 0").select("pack_name", nothing, "doc_id", "piece_no", "start_token", "tokens"))


def class_report(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per profile and class of a fixed count: texts and pieces, containers, tokens. The last class has no fixed count."""
    packed = pack(docs, profiles).filter(F.col("container_id").isNotNull())
    k = F.regexp_extract("container_id", "^class([0-9]+)-", 1).cast("int").alias("class")
    by_class = packed.select("*", k).filter(F.col("class") < CLASSES).groupBy("pack_name", "class")
    return by_class.agg(F.count(F.lit(1)).alias("pieces"), F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))


def fill_report(packed: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per profile: containers, their least possible number by total size, tokens, and the share of room used."""
    by_container = packed.groupBy("pack_name", "container_id").agg(F.sum("tokens").alias("tokens"))
    by_name = by_container.groupBy("pack_name").agg(F.count("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    joined = by_name.join(profiles.select("pack_name", "capacity_tokens").distinct(), "pack_name")
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers")
    return joined.select("pack_name", "capacity_tokens", "containers", least, "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("used_share"))


def properties(docs: DataFrame, packed: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per profile whether no container is over its capacity, every document is there once from end to end, and only documents
    larger than the capacity are cut."""
    room = profiles.select("pack_name", "capacity_tokens").distinct()
    loads = packed.filter(F.col("container_id").isNotNull()).groupBy("pack_name", "container_id").agg(F.sum("tokens").alias("load"))
    within = loads.join(room, "pack_name").groupBy("pack_name").agg(F.bool_and(F.col("load") <= F.col("capacity_tokens")).alias("within_capacity"))
    each = packed.groupBy("pack_name", "doc_id").agg(F.sum("tokens").alias("held"), F.max(F.col("start_token") + F.col("tokens")).alias("end"), F.count(F.lit(1)).alias("pieces"))
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    joined = each.join(sizes, "doc_id", "full").join(room, "pack_name", "left")
    whole = F.coalesce((F.col("held") == F.col("size")) & (F.col("end") == F.col("size")), F.lit(False))
    uncut = (F.col("pieces") == 1) | (F.col("size") > F.col("capacity_tokens"))
    return joined.groupBy("pack_name").agg(F.bool_and(whole).alias("all_whole"), F.bool_and(uncut).alias("cut_only_if_larger")).join(within, "pack_name")
