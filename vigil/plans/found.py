"""The queries of problems 1 to 5: each over its whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.ids import canonical_uuid, uuid_bytes, with_hyphens
from vigil.operators import drift, features, idindex, lateness, skew
from vigil.session import work_path
from vigil.sources.tables import table


def _accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of both tables by account: (table_name, account_id, alert, at)."""
    outbox = table(spark, folder, "outbox").select(F.lit("outbox").alias("table_name"), "account_id", F.col("id").alias("alert"), F.col("created_at").alias("at"))
    processed = table(spark, folder, "processed_alerts")
    return outbox.unionByName(processed.select(F.lit("processed_alerts").alias("table_name"), "account_id", F.col("alert_id").alias("alert"), F.col("acted_at").alias("at")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts with at least 1 % of the rows of outbox or of processed_alerts."""
    return skew.heavy_keys(_accounts(spark, folder).select("table_name", "account_id"), "table_name", "account_id")


def p1_account_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Per table and account: rows, distinct written alert ids, first and last time."""
    at = F.unix_micros("at")
    return skew.combine_with_distinct(_accounts(spark, folder), ["table_name", "account_id"], "alert", "n_ids", "n_rows", {"first_us": at}, {"last_us": at})


def _arrivals(spark: SparkSession, folder: str) -> DataFrame:
    messages = lateness.event_log(table(spark, folder, "alert_messages"), "alert_messages", "produced_at", "received_at", "row_id")
    acted = lateness.event_log(table(spark, folder, "processed_alerts"), "processed_alerts", "produced_at", "acted_at", "row_id")
    return messages.unionByName(acted)


def _layers(spark: SparkSession, folder: str) -> lateness.LambdaViews:
    """Both tables through fast and batch layer, in batches by time of arrival."""
    return lateness.add_in_waves(lateness.LambdaViews(spark, work_path(spark, "lambda-views")), _arrivals(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that arrived after their hour had ended by the clock: those that correct it and those refused, as logged by the
    fast layer when they arrived."""
    late = _layers(spark, folder).log().filter(F.col("lateness") != "on_time")
    return late.select(F.col("stream").alias("table_name"), "row_id", "lateness")


def p2_hourly_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The served view: provisional and corrected counts per table and hour."""
    return _layers(spark, folder).view().withColumnRenamed("stream", "table_name")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every change of schema between files that follow each other."""
    return drift.schema_changes(table(spark, folder, "raw_messages"))


def _unified(feed: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        raw = table(spark, folder, "raw_messages")
        own = raw.filter(F.col("feed") == feed)
        return drift.unified(raw, feed, drift.with_renames(drift.schema_changes(own), feed))

    query.__doc__ = f"The feed {feed} in its constant schema, with the names that its fields were renamed to on the way."
    return query


def p3_lifespans(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue: from which to which file of its series each field had each kind of value."""
    raw = table(spark, folder, "raw_messages")
    spans = drift.lifespans(drift.footers(raw, drift.file_sequence(raw))).filter(F.col("kind") != "")
    return spans.select("feed", "site", "field_name", "kind", F.col("first").cast("bigint").alias("first_seq"), F.col("last").cast("bigint").alias("last_seq"))


DEDUPLICATED = ("alert_messages", "processed_alerts", "triaged_alerts")


def _admitted(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame:
    """The outcome of admitting the tables to a new index, in batches that follow the numbers of reading, runs being merged
    on the way."""
    messages = None
    for name in names:
        rows = table(spark, folder, name).select(F.lit(name).alias("ns"), uuid_bytes(canonical_uuid(F.col("alert_id"))).alias("id"), F.col("row_id").alias("row"), F.col("batch_id").alias("batch"))
        messages = rows if messages is None else messages.unionByName(rows)
    total = sum(table(spark, folder, name).count() for name in names)
    index = idindex.IdIndex(spark, work_path(spark, "id-index"), idindex.prefix_bits_for(total))
    return idindex.admit_all(index, messages)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Alert ids held by more than one row of a table."""
    repeated = idindex.repeated_ids(_admitted(spark, folder, DEDUPLICATED))
    return repeated.select(F.col("ns").alias("table_name"), with_hyphens(F.lower(F.hex("id"))).alias("alert_id"))


def _once(name: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        kept = idindex.kept_rows(_admitted(spark, folder, (name,))).select(F.col("row").alias("row_id"))
        rows = table(spark, folder, name).withColumn("alert_uuid", canonical_uuid(F.col("alert_id")))
        unnamed = rows.filter(F.col("alert_uuid").isNull())
        return rows.filter(F.col("alert_uuid").isNotNull()).join(kept, "row_id", "left_semi").unionByName(unnamed)

    query.__doc__ = f"{name} with one row per alert: the first row read. Rows whose id denotes no UUID all stay."
    return query


def _feature_state(spark: SparkSession, folder: str) -> DataFrame:
    """State of processed_alerts, kept by a store: the batches up to the middle are loaded, the later ones added as signed deltas."""
    rows = table(spark, folder, "processed_alerts")
    own = F.encode(F.concat(F.lit("row "), F.col("row_id")), "UTF-8")
    events = rows.select(
        F.coalesce(uuid_bytes(canonical_uuid(F.col("alert_id"))), own).alias("id"),
        F.col("row_id").alias("seq"),
        F.col("account_id").alias("entity"),
        F.col("rule_name").alias("type"),
        F.unix_micros("produced_at").alias("at_us"),
        "batch_id",
    )
    middle = rows.agg(((F.min("batch_id") + F.max("batch_id")) / 2).alias("m")).first()["m"] or 0
    store = features.FeatureStore(spark, work_path(spark, "feature-store"))
    late = F.coalesce(F.col("batch_id") > middle, F.lit(False))
    for number, part in enumerate((events.filter(~late), events.filter(late))):
        store.add(part.drop("batch_id"), number)
    return store.state()


def p5_features(spark: SparkSession, folder: str) -> DataFrame:
    """One row per account: totals, then the count and the latest time of every rule that is listed or has fired; null times
    and counts of 0 where it has not."""
    state = _feature_state(spark, folder)
    names = features.type_names(state, table(spark, folder, "detector_rules").select("rule_name"))
    wide = features.feature_table(state, names)
    at = lambda c: F.timestamp_micros(c).alias(c.replace("latest_us_", "latest_").replace("_us", ""))
    return wide.select(F.col("entity").alias("account_id"), *[at(c) if c.startswith("latest_") else F.col(c) for c in wide.columns[1:]])


def p5_features_long(spark: SparkSession, folder: str) -> DataFrame:
    """The same, a row per account and rule that has fired."""
    state = _feature_state(spark, folder)
    return state.select(F.col("entity").alias("account_id"), F.col("type").alias("rule_name"), "n", "latest_us")


QUERIES = {
    "p1_found": p1_found,
    "p1_account_totals": p1_account_totals,
    "p2_found": p2_found,
    "p2_hourly_counts": p2_hourly_counts,
    "p3_found": p3_found,
    "p3_lifespans": p3_lifespans,
    "p3_payment_alert": _unified("payment_alert"),
    "p3_triaged_alert": _unified("triaged_alert"),
    "p3_outbox_row": _unified("outbox_row"),
    "p4_found": p4_found,
    "p4_alert_messages": _once("alert_messages"),
    "p4_processed_alerts": _once("processed_alerts"),
    "p4_triaged_alerts": _once("triaged_alerts"),
    "p5_features": p5_features,
    "p5_features_long": p5_features_long,
}
