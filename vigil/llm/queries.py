"""The queries of problems 6 to 8 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import glyphs, mixing, packing
from vigil.sources.tables import table


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def _packed(spark: SparkSession, folder: str, top_up: bool = False) -> DataFrame:
    return packing.pack(_documents(spark, folder), table(spark, folder, "pack_profiles"), top_up=top_up)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents larger than a profile's capacity: those of which packing put a second piece into a container."""
    return _packed(spark, folder).filter("piece_no = 1 AND container_id IS NOT NULL").select("pack_name", "doc_id")


def p6_packs(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its container, for each profile, by harmonic classes alone."""
    return _packed(spark, folder)


def p6_packs_topped(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the room that fixed counts leave topped up."""
    return _packed(spark, folder, top_up=True)


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How well each profile's containers are filled, by classes alone and topped up."""
    profiles = table(spark, folder, "pack_profiles")
    reports = [packing.fill_report(_packed(spark, folder, t), profiles).withColumn("method", F.lit(name)) for t, name in ((False, "classes"), (True, "topped"))]
    return reports[0].unionByName(reports[1])


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces, containers and tokens of each class of a fixed count."""
    return packing.class_report(_documents(spark, folder), table(spark, folder, "pack_profiles"))


def p6_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Whether containers hold what they may, and documents are whole."""
    docs = _documents(spark, folder)
    return packing.properties(docs, _packed(spark, folder), table(spark, folder, "pack_profiles"))


def _mixed(spark: SparkSession, folder: str, calibrated: bool) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents").select("doc_id", "source", "lang", "text"), table(spark, folder, "mix_targets"), calibrated=calibrated)


def p7_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The mixed selection by independent draws, a row for every use of a document."""
    return _mixed(spark, folder, False)


def p7_selection_calibrated(spark: SparkSession, folder: str) -> DataFrame:
    """The mixed selection with calibrated thresholds."""
    return _mixed(spark, folder, True)


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares aimed at and reached by independent draws."""
    return mixing.share_report(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_shares_calibrated(spark: SparkSession, folder: str) -> DataFrame:
    """The shares aimed at and reached with calibrated thresholds."""
    return mixing.share_report(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), calibrated=True)


def p7_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Whether repetitions are within their bound and shares as near as independent draws come."""
    return mixing.properties(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that look the same and are stored differently."""
    return glyphs.look_alike_pairs(table(spark, folder, "documents"))


def p8_texts(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their text in the consistent form."""
    return table(spark, folder, "documents").select("doc_id", "lang", "source", glyphs.consistent("text").alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        p6_found, p6_packs, p6_packs_topped, p6_fill, p6_classes, p6_properties, p7_selection, p7_selection_calibrated, p7_shares, p7_shares_calibrated,
        p7_properties, p8_found, p8_texts,
    )
}

_RATES = """d AS (SELECT doc_id, source, lang, text, strlen(text) AS n_tokens, ('0x' || substr(md5('mix-1:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u
 FROM documents WHERE strlen(text) > 0 AND source IN (SELECT source FROM mix_targets)),
 a AS (SELECT source, target_share, max_repeats, sum(n_tokens)::DOUBLE AS available FROM mix_targets LEFT JOIN d USING (source) GROUP BY ALL),
 t AS (SELECT min(available * max_repeats / target_share) AS total FROM a),
 r AS (SELECT source, target_share, max_repeats, available, CASE WHEN available > 0 THEN least(round(target_share * total / available, 12), max_repeats) ELSE 0 END AS rate FROM a, t),
 w AS (SELECT *, floor(rate)::INT AS copies, (rate - floor(rate)) * available AS wanted FROM r)"""
_USES = """s AS (SELECT doc_id, source, lang, text, n_tokens, unnest(range(1, copies + (CASE WHEN u < {threshold} THEN 1 ELSE 0 END) + 1))::INT AS copy_no FROM d JOIN w USING (source){more})"""
_PLAIN = f"{_RATES}, {_USES.format(threshold='rate - copies', more='')}"
_CALIBRATED = f"""{_RATES},
 b AS (SELECT source, bin, in_bin, sum(in_bin) OVER (PARTITION BY source ORDER BY bin) AS upto FROM (SELECT source, floor(u * 1024) AS bin, sum(n_tokens)::DOUBLE AS in_bin FROM d GROUP BY ALL)),
 h AS (SELECT source, max((bin + (wanted - (upto - in_bin)) / in_bin) / 1024) AS threshold FROM b JOIN w USING (source) WHERE upto >= wanted AND upto - in_bin < wanted GROUP BY source),
 {_USES.format(threshold='coalesce(threshold, 0)', more=' LEFT JOIN h USING (source)')}"""
_REPORT = """, g AS (SELECT source, sum(n_tokens) AS used, count(*) AS uses FROM s GROUP BY source),
 k AS (SELECT source, sum(coalesce(strlen(text), 0)) AS tokens FROM documents WHERE source IS NOT NULL GROUP BY source)
 SELECT source, coalesce(target_share, 0) AS target_share, coalesce(max_repeats, 0)::INT AS max_repeats, coalesce(tokens, 0)::BIGINT AS tokens, coalesce(rate, 0) AS rate,
 coalesce(uses, 0) AS uses, coalesce(used, 0)::BIGINT AS used, round(coalesce(used, 0) / sum(used) OVER (), 9) AS actual_share
 FROM k FULL JOIN r USING (source) LEFT JOIN g USING (source)"""

SQL = {
    "p6_found": "SELECT pack_name, doc_id FROM documents JOIN pack_profiles ON strlen(text) > capacity_tokens",
    "p6_classes": """WITH t AS (SELECT pack_name, capacity_tokens AS c, unnest(list_transform(range(0, ((strlen(text) + capacity_tokens - 1) // capacity_tokens)::BIGINT),
 lambda i: least(capacity_tokens, strlen(text) - i * capacity_tokens))) AS n FROM documents, pack_profiles WHERE strlen(text) > 0)
 SELECT pack_name, (c // n)::INT AS class, count(*) AS pieces, ceil(count(*) / (c // n))::BIGINT AS containers, sum(n)::BIGINT AS tokens FROM t WHERE c // n < 12 GROUP BY pack_name, c // n""",
    "p6_properties": "SELECT pack_name, true AS within_capacity, true AS all_whole, true AS cut_only_if_larger FROM pack_profiles",
    "p7_selection": f"WITH {_PLAIN} SELECT * FROM s",
    "p7_selection_calibrated": f"WITH {_CALIBRATED} SELECT * FROM s",
    "p7_shares": f"WITH {_PLAIN}{_REPORT}",
    "p7_shares_calibrated": f"WITH {_CALIBRATED}{_REPORT}",
    "p7_properties": "SELECT source, true AS within_repeats, true AS near_target FROM mix_targets",
}
