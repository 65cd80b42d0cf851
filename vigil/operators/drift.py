"""Schemas that drift between files: a catalogue of column lifespans, a log of changes, and one constant table per feed.

A file's footer here is the set of its top-level field names with the kinds of their values, combined from its lines before
anything is shuffled. Footers are exploded to one row per field and kind, and `lag` over the files of a producer finds
islands, unbroken runs of files that have the field. An island that starts after the producer's first file is a field that
came, one that ends before the last file is a field that went, and a field whose kinds start or end islands changed type.
A field that went and one that came in the same file are one renamed field if the records found in both files say so.

Bodies are parsed once, in the JVM, to VARIANT. A body counts if it is one JSON object; text that is no JSON, null, other
JSON values, and objects that repeat a name at one level do not. A file none of whose bodies counts is a file without fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.ids import canonical_uuid
from vigil.session import written

PRODUCER = ["feed", "site"]
FILE = [*PRODUCER, "file_no"]

#: Names that hold the alert id of a record, per feed, once lower-cased and without underscores.
ID_NAMES = {"payment_alert": ["alertid"], "triaged_alert": ["alertid"], "outbox_row": ["id", "outboxid", "alertid"]}

#: The alias table: feed, canonical column, type, names under which the value has been seen. Fixed values.
ALIASES = [
    ("payment_alert", "alert_id", "uuid", ["alertId", "alertID", "alert_id"]),
    ("payment_alert", "event_id", "string", ["eventId", "event_id", "sourceEventId"]),
    ("payment_alert", "account_id", "string", ["accountId", "AccountId", "account_id", "acct"]),
    ("payment_alert", "rule_name", "string", ["ruleName", "rule_name", "detector"]),
    ("payment_alert", "reason", "string", ["reason", "reasonText", "detail"]),
    ("payment_alert", "produced_at", "timestamp", ["producedAt", "produced_at", "eventTime"]),
    ("payment_alert", "schema_version", "version", ["schemaVersion", "SchemaVersion", "schema_version", "schemaVer", "v"]),
    ("triaged_alert", "alert_id", "uuid", ["alertId", "AlertId", "alert_id"]),
    ("triaged_alert", "event_id", "string", ["eventId", "event_id"]),
    ("triaged_alert", "account_id", "string", ["accountId", "account_id", "acct"]),
    ("triaged_alert", "rule_name", "string", ["ruleName", "rule_name", "rule"]),
    ("triaged_alert", "severity", "string", ["severity", "Severity", "level"]),
    ("triaged_alert", "narrative", "string", ["narrative", "summaryText", "story"]),
    ("triaged_alert", "evidence", "json", ["evidence", "findings"]),
    ("triaged_alert", "confidence", "double", ["confidence", "conf", "score"]),
    ("triaged_alert", "triage_status", "string", ["triageStatus", "triage_status", "state"]),
    ("triaged_alert", "prompt_version", "string", ["promptVersion", "prompt_version", "prompt"]),
    ("triaged_alert", "evidence_stripped", "boolean", ["evidenceStripped", "stripped"]),
    ("triaged_alert", "tool_rounds", "bigint", ["toolRounds", "tool_rounds", "rounds"]),
    ("triaged_alert", "degraded_reason", "string", ["degradedReason", "degraded_reason"]),
    ("triaged_alert", "triaged_at", "timestamp", ["triagedAt", "triaged_at", "decidedAt"]),
    ("triaged_alert", "schema_version", "version", ["schemaVersion", "schemaversion", "schema_version", "version"]),
    ("outbox_row", "id", "uuid", ["id", "ID", "outbox_id"]),
    ("outbox_row", "account_id", "string", ["account_id", "accountId", "acct"]),
    ("outbox_row", "payload", "json", ["payload", "body", "message"]),
    ("outbox_row", "status", "string", ["status", "state"]),
    ("outbox_row", "attempts", "bigint", ["attempts", "attempt_count", "tries"]),
    ("outbox_row", "created_at", "timestamp", ["created_at", "createdAt", "inserted_at"]),
    ("outbox_row", "traceparent", "trace", ["traceparent", "traceParent", "trace_parent", "w3c_parent"]),
    ("outbox_row", "tracestate", "string", ["tracestate", "trace_state"]),
]
MAX_RENAMES = 10_000
KINDS = ("boolean", "list", "number", "object", "text")
TYPES = {"uuid": "string", "json": "string", "version": "string", "trace": "string"}


def _bare(name: Column) -> Column:
    return F.translate(F.lower(name), "_-", "")


def _kind(value_type: Column) -> Column:
    """The JSON kind of a VARIANT by its type's name; null has none."""
    return (
        F.when(value_type == "STRING", "text")
        .when(value_type == "BOOLEAN", "boolean")
        .when(value_type.startswith("ARRAY"), "list")
        .when(value_type.startswith("OBJECT"), "object")
        .when(value_type == "VOID", None)
        .otherwise("number")
    )


def _object(body: str = "body") -> Column:
    """The body as VARIANT if it may be one JSON object, else null."""
    trimmed = F.trim(F.regexp_replace(body, r"^\s+|\s+$", ""))
    return F.when(trimmed.startswith("{") & trimmed.endswith("}"), F.try_parse_json(body))


def records(raw: DataFrame, *keep: str) -> DataFrame:
    """The lines whose body is a JSON object, with the object as VARIANT in `v`. Other columns of raw are left behind.

    Through an array, as a filter on the parsed body would be moved below the projection and parse every body twice.
    """
    return raw.select(*FILE, *keep, F.explode(F.array_compact(F.array(_object()))).alias("v"))


def _exploded(raw: DataFrame, *keep: str) -> DataFrame:
    """(file, keep, field_name, value, value_type): a row per top-level field of each body that is an object."""
    parsed = raw.select(*FILE, *keep, _object().alias("v"))
    names = ", ".join([*FILE, *keep])
    sql = f"SELECT {names}, key AS field_name, value, schema_of_variant(value) AS value_type FROM {{rows}}, LATERAL variant_explode(v)"
    return raw.sparkSession.sql(sql, rows=parsed)


def holds_id(feed: Column, name: Column) -> Column:
    """Whether a field of that name holds the alert id of its feed's records."""
    names = F.create_map(*[x for of, known in ID_NAMES.items() for x in (F.lit(of), F.array(*map(F.lit, known)))])
    return F.coalesce(F.array_contains(F.element_at(names, feed), _bare(name)), F.lit(False))


def fields(raw: DataFrame, picked: DataFrame) -> DataFrame:
    """(file, line_no, field_name, kind, h1, h2, own_id) of the fields of each record that are in `picked`, a table (file,
    field_name, valued, named); nothing is made of the others.

    kind is null for a null value. Where valued, h1 and h2 are a 128-bit hash of the value's canonical JSON text, in which objects
    have their names sorted and decimals no trailing zeros. Where named, own_id is the value itself if it is text, in one form if
    it denotes a UUID.
    """
    some = _exploded(raw, "line_no").join(picked, [*FILE, "field_name"])
    json = F.to_json("value")
    text = F.when(F.col("named") & (F.col("value_type") == "STRING"), F.variant_get(F.col("value"), "$", "string"))
    hashes = [F.when(F.col("valued"), F.xxhash64(json)).alias("h1"), F.when(F.col("valued"), F.xxhash64(F.lit(1), json)).alias("h2")]
    return some.select(*FILE, "line_no", "field_name", _kind(F.col("value_type")).alias("kind"), *hashes, F.coalesce(canonical_uuid(text), text).alias("own_id"))


def file_sequence(raw: DataFrame) -> DataFrame:
    """(file, seq, last_seq): the files of each producer in the order of file_no, counted from 1. One row per file."""
    files = raw.groupBy(*FILE).agg(F.lit(1).alias("one"))
    series = Window.partitionBy(*PRODUCER)
    return files.select(*FILE, F.row_number().over(series.orderBy("file_no")).alias("seq"), F.count(F.lit(1)).over(series).alias("last_seq"))


def footers(raw: DataFrame, sequence: DataFrame) -> DataFrame:
    """(producer, seq, last_seq, field_name, kinds): what a file's footer says of each field; kinds is sorted.

    Only names and kinds are looked at; a file's lines are combined to one set of bits per field before the shuffle.
    """
    bit = F.coalesce(*[F.when(_kind(F.col("value_type")) == kind, 1 << i) for i, kind in enumerate(KINDS)], F.lit(0))
    bits = _exploded(raw).select(*FILE, "field_name", bit.alias("bit")).groupBy(*FILE, "field_name").agg(F.bit_or("bit").alias("bits"))
    kinds = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(1 << i) != 0, kind) for i, kind in enumerate(KINDS)]))
    return bits.select(*FILE, "field_name", kinds.alias("kinds")).join(sequence, FILE).drop("file_no")


def islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, last_seq, first, last): unbroken runs of seq within the keys, by the gap that lag shows."""
    over = Window.partitionBy(*keys).orderBy("seq")
    gap = F.when(F.col("seq") - F.lag("seq").over(over) == 1, 0).otherwise(1)
    marked = rows.withColumn("gap", gap).withColumn("island", F.sum("gap").over(over))
    return marked.groupBy(*keys, "island").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.first("last_seq").alias("last_seq")).drop("island")


def lifespans(footer: DataFrame) -> DataFrame:
    """(producer, field_name, kind, first, last, last_seq) per island of a field and kind; kind '' is presence with any value."""
    typed = footer.select("*", F.explode(F.array_union(F.array(F.lit("")), F.col("kinds"))).alias("kind"))
    return islands(typed.select(*PRODUCER, "field_name", "kind", "seq", "last_seq"), [*PRODUCER, "field_name", "kind"])


def _ends(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Starts and endings as rows (producer, seq, field_name, kind), seq being that of the later file."""
    start = spans.filter(F.col("first") > 1).select(*PRODUCER, F.col("first").alias("seq"), "field_name", "kind")
    end = spans.filter(F.col("last") < F.col("last_seq")).select(*PRODUCER, (F.col("last") + 1).alias("seq"), "field_name", "kind")
    return start, end


def retyped(spans: DataFrame, footer: DataFrame) -> DataFrame:
    """(producer, seq, field_name): a kind starts or ends where the field has non-null values in both files."""
    start, end = _ends(spans.filter(F.col("kind") != ""))
    changed = start.unionByName(end).select(*PRODUCER, "seq", "field_name").distinct()
    valued = footer.filter(F.size("kinds") > 0).select(*PRODUCER, "seq", "field_name")
    keys = [*PRODUCER, "seq", "field_name"]
    return changed.join(valued, keys, "left_semi").join(valued.withColumn("seq", F.col("seq") + 1), keys, "left_semi")


def renamed(raw: DataFrame, sequence: DataFrame, footer: DataFrame, came: DataFrame, went: DataFrame) -> DataFrame:
    """(producer, seq, field_name, new_name): pairs of a field that went and one that came which agree in every record.

    A and B count the shared records in which the old and the new field have a value, M those in which both have the same;
    A = B = M > 0 says that the values agree wherever there is one. M comes from an equi-join on record and value, so no
    pair of fields is tried that has not a value in common. Only the bodies of files where fields went and came are read for
    their values, and of these only such fields; both are picked by tables of metadata before any record is shuffled. These
    tables are written, so that joins broadcast them exactly as far as their size allows.
    """
    at, role = [*PRODUCER, "seq"], lambda name: F.lit(name).alias("role")
    turns = came.select(*at).distinct().join(went.select(*at).distinct(), at, "left_semi")
    of = lambda shift: sequence.select(*FILE, (F.col("seq") + shift).alias("seq"))
    files = of(1).select("*", role("old")).unionByName(of(0).select("*", role("new"))).join(turns, at, "left_semi")
    files = written(files, "changed-files")
    changed = went.select(*at, "field_name", role("old")).unionByName(came.select(*at, "field_name", role("new")))
    picked = written(files.join(changed, [*at, "role"]), "changed-fields")
    record = [*FILE, "line_no", "seq", "role"]
    wanted = F.col("own_id").isNotNull() | F.col("kind").isNotNull()
    some = raw.join(files.select(*FILE), FILE, "left_semi")
    ids = footer.filter(F.array_contains("kinds", "text") & holds_id(F.col("feed"), F.col("field_name"))).join(sequence, at).select(*FILE, "field_name")
    yes, no = F.lit(True), F.lit(False)
    both = picked.select(*FILE, "field_name", yes.alias("valued"), no.alias("named")).unionByName(ids.join(files.select(*FILE).distinct(), FILE, "left_semi").select("*", no.alias("valued"), yes.alias("named")))
    both = written(both.groupBy(*FILE, "field_name").agg(F.bool_or("valued").alias("valued"), F.bool_or("named").alias("named")), "looked-at")
    cells = written(fields(some, both).filter(wanted), "cells")
    ids = written(cells.filter(F.col("own_id").isNotNull()).join(files, FILE).groupBy(*record).agg(F.min("own_id").alias("id")), "record-ids")
    shared = ids.groupBy(*at, "id").agg(F.min("role").alias("lo"), F.max("role").alias("hi")).filter("lo != hi").select(*at, "id")
    values = cells.filter(F.col("kind").isNotNull()).join(picked, [*FILE, "field_name"]).join(ids.join(shared, [*at, "id"], "left_semi"), record)
    values = written(values.select(*at, "id", "role", "field_name", "h1", "h2").distinct(), "changed-values")
    counts = values.groupBy(*at, "role", "field_name").agg(F.count(F.lit(1)).alias("n"))
    old, new = values.filter("role = 'old'").drop("role"), values.filter("role = 'new'").drop("role").withColumnRenamed("field_name", "new_name")
    old_n = counts.filter("role = 'old'").select(*at, "field_name", F.col("n").alias("a"))
    new_n = counts.filter("role = 'new'").select(*at, F.col("field_name").alias("new_name"), F.col("n").alias("b"))
    matches = old.join(new, [*at, "id", "h1", "h2"]).groupBy(*at, "field_name", "new_name").agg(F.count(F.lit(1)).alias("m"))
    agree = matches.join(old_n, [*at, "field_name"]).join(new_n, [*at, "new_name"])
    return agree.filter((F.col("a") == F.col("m")) & (F.col("b") == F.col("m"))).select(*at, "field_name", "new_name")


def schema_changes(raw: DataFrame) -> DataFrame:
    """(feed, site, file_no, change_kind, field_name, new_name): every change from a file to the producer's next one.

    change_kind is renamed, removed, added or retyped; new_name is '' unless renamed. No lines give no rows.
    """
    sequence = written(file_sequence(raw), "file-sequence")
    footer = written(footers(raw, sequence), "footers")
    spans = written(lifespans(footer), "lifespans")
    came, went = _ends(spans.filter(F.col("kind") == "").drop("kind").withColumn("kind", F.lit("")))
    came, went = came.drop("kind"), went.drop("kind")
    at = [*PRODUCER, "seq"]
    moved = written(renamed(raw, sequence, footer, came, went), "renamed")
    log = lambda rows, kind, new=F.lit(""): rows.select(*at, F.lit(kind).alias("change_kind"), "field_name", new.alias("new_name"))
    gone = went.join(moved.select(*at, "field_name"), [*at, "field_name"], "left_anti")
    fresh = came.join(moved.select(*at, F.col("new_name").alias("field_name")), [*at, "field_name"], "left_anti")
    changes = log(moved, "renamed", F.col("new_name")).unionByName(log(gone, "removed")).unionByName(log(fresh, "added"))
    changes = changes.unionByName(log(retyped(spans, footer), "retyped"))
    return changes.join(sequence.select(*FILE, "seq"), at).select(*FILE, "change_kind", "field_name", "new_name")


def _cast(value: Column, kind: str) -> Column:
    """The cast of a VARIANT to a canonical type, for every kind of value seen under any alias; null if it cannot be read."""
    text = F.try_variant_get(value, "$", "string")
    code = F.coalesce(F.try_variant_get(value, "$.code", "string"), text)
    if kind == "uuid":
        return F.coalesce(canonical_uuid(text), text)
    if kind == "json":
        return F.when(F.schema_of_variant(value) == "STRING", text).otherwise(F.to_json(value))
    if kind == "version":
        major = F.try_variant_get(value, "$.major", "string")
        return F.coalesce(major, text)
    if kind == "trace":
        parts = [F.try_variant_get(value, p, "string") for p in ("$.traceId", "$.spanId", "$.flags")]
        listed = [F.try_variant_get(value, f"$[{i}]", "string") for i in range(4)]
        joined = lambda cols: F.when(F.forall(F.array(*cols), lambda x: x.isNotNull()), F.concat_ws("-", *cols))
        return F.coalesce(joined([F.lit("00"), *parts]), joined(listed), F.when(F.schema_of_variant(value) == "STRING", text))
    if kind == "timestamp":
        number = F.when(text.rlike(r"\A-?[0-9]{1,18}\z|\A-?[0-8][0-9]{18}\z"), text).cast("bigint")
        digits = F.length(F.ltrim(text, F.lit("-")))
        whole_us = F.when(digits <= 11, number * 1_000_000).when(digits <= 15, number * 1000).when(digits <= 17, number)
        micros = F.coalesce(whole_us, F.when(number % 1000 == 0, F.floor(number / F.lit(1000)).cast("bigint")))
        return F.coalesce(F.timestamp_micros(micros), F.try_to_timestamp(F.when(~text.rlike(r"\A-?[0-9]+\z"), text)))
    if kind == "boolean":
        low = F.lower(text)
        return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)
    if kind == "string":
        return code
    return F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE]-?[0-9]+)?$"), text).try_cast(kind)


def _whole(value: Column, kind: str) -> Column:
    """Whether the cast takes all of a value: a scalar, or a list or object without members that the cast passes over."""
    if kind == "json":
        return F.lit(True)
    items, members = (F.size(F.try_variant_get(value, "$", of)) for of in ("array<variant>", "map<string,variant>"))
    part = {"string": "$.code", "version": "$.major", "trace": "$.traceId"}.get(kind, "$")
    parts = {"trace": 3}.get(kind, 1)
    inner = F.when(F.try_variant_get(value, part, "string").isNull(), kind == "string").otherwise(members == parts)
    shape = F.schema_of_variant(value)
    return F.when(shape.startswith("OBJECT"), inner).when(shape.startswith("ARRAY"), (items == 4) if kind == "trace" else F.lit(kind == "string")).otherwise(True)


def with_renames(changes: DataFrame, feed: str, aliases: list[tuple] = ALIASES) -> list[tuple]:
    """The alias table with the names to which the feed's columns were renamed according to schema_changes(), chains included.

    A name that would belong to two columns, or that a path cannot hold, is left out; its values stay in extra. The driver reads
    the distinct renames, at most MAX_RENAMES; more raise an error.
    """
    renames = changes.filter((F.col("change_kind") == "renamed") & (F.col("feed") == feed)).select("field_name", "new_name").distinct()
    links = [tuple(r) for r in renames.limit(MAX_RENAMES + 1).collect()]
    if len(links) > MAX_RENAMES:
        raise ValueError(f"more than {MAX_RENAMES} different renames")
    near: dict[str, set[str]] = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    listed = {name for of, _, _, names in aliases if of == feed for name in names}
    claims: dict[str, set[str]] = {}
    for of, column, _, names in aliases:
        reached, new = set(names), list(names) if of == feed else []
        while new:
            more = near.get(new.pop(), set()) - reached - listed
            reached |= more
            new += more
        for name in reached - set(names):
            claims.setdefault(name, set()).add(column)
    of_one = sorted(name for name, columns in claims.items() if len(columns) == 1 and not set(name) & set("'[]\\"))
    return [(of, column, kind, [*names, *(n for n in of_one if claims[n] == {column})] if of == feed else names) for of, column, kind, names in aliases]


def unified(raw: DataFrame, feed: str, aliases: list[tuple] = ALIASES) -> DataFrame:
    """One table with a constant schema for a feed: site, file_no, line_no, landed_at, the canonical columns, extra.

    The casts come from the alias table: a canonical column takes the first value among its aliases that can be cast, each
    according to its kind. extra has, as name -> JSON text, every other field, so that nothing is lost: fields in no alias
    list, further aliases of a column that had a value already, values that cannot be cast, and lists and objects of which
    a column takes only a part. Null values of listed fields are left out. Lines that are no JSON object are not in the table.

    A number is a time in seconds, milliseconds, microseconds or nanoseconds by its digits (up to 11, 15, 17, 19).
    """
    rows = records(raw.filter(F.col("feed") == feed), "line_no", "landed_at")
    known = [(column, kind, names) for of, column, kind, names in aliases if of == feed]

    def chosen(kind: str, names: list[str]) -> Column:
        """(name, value, whole) of the first alias whose value can be cast; casts are tried on aliases that are there only."""
        there = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), F.try_variant_get(F.col("v"), f"$['{n}']", "variant").alias("value")) for n in names]), lambda x: x["value"].isNotNull())
        tried = F.transform(there, lambda x: F.struct(x["name"].alias("name"), _cast(x["value"], kind).cast(TYPES.get(kind, kind)).alias("value"), _whole(x["value"], kind).alias("whole")))
        return F.try_element_at(F.filter(tried, lambda x: x["value"].isNotNull()), F.lit(1))

    picked = rows.select("*", *[chosen(kind, names).alias(f"__{column}") for column, kind, names in known])
    columns = [F.col(f"__{column}.value").alias(column) for column, _, _ in known]
    taken = [F.when(F.col(f"__{column}.whole"), F.col(f"__{column}.name")) for column, _, _ in known]
    listed, held = F.array(*[F.lit(name) for _, _, names in known for name in names]), F.array_compact(F.array(*taken))
    left = lambda name, value: ~F.array_contains(held, name) & ~(F.array_contains(listed, name) & F.is_variant_null(value))
    extra = F.transform_values(F.map_filter(F.col("v").cast("map<string,variant>"), left), lambda _, value: F.to_json(value))
    return picked.select("site", "file_no", "line_no", "landed_at", *columns, extra.alias("extra"))
