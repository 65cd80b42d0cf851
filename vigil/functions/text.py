"""Masks, reasons, headers and other small text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attempts are counted up to here, so that the next number is an int, too.
MOST_ATTEMPTS = 2**31 - 2


def mask(text: Column, shown: int) -> Column:
    """The last `shown` characters; **** for null and for shorter text."""
    return F.when(F.length(text) >= shown, F.right(text, F.lit(shown))).otherwise("****")


def header_text(headers: Column, name: str) -> Column:
    """The last header of that name in array<struct<key,value:binary>>, as UTF-8 text; null if there is none."""
    named = F.filter(headers, lambda h: h["key"] == name)
    return F.decode(F.try_element_at(named, F.lit(-1))["value"], "UTF-8")


def without_headers(headers: Column, names: list[str]) -> Column:
    """The headers but those of the given names, in their order."""
    return F.filter(headers, lambda h: ~h["key"].isin(*names))


def with_header(headers: Column, name: str, value: Column) -> Column:
    """The headers and one more at the end."""
    return F.concat(headers, F.array(F.struct(F.lit(name).alias("key"), F.encode(value, "UTF-8").alias("value"))))


def with_header_if(headers: Column, name: str, value: Column) -> Column:
    """with_header() where the value is not null, else the headers as they are."""
    return F.when(value.isNull(), headers).otherwise(with_header(headers, name, value))


def instant_text(us: Column) -> Column:
    """Microseconds since the epoch as ISO text in UTC with no, three or six digits after the second; the session's zone must be UTC."""
    second, rest = F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss"), F.pmod(us, F.lit(1_000_000))
    digits = lambda n, width: F.concat(F.lit("."), F.lpad(n.cast("string"), width, "0"))
    fraction = F.when(rest == 0, "").when(rest % 1000 == 0, digits((rest / 1000).cast("int"), 3)).otherwise(digits(rest, 6))
    return F.concat(second, fraction, F.lit("Z"))


def plain_number(value: Column, precision: int = 38, scale: int = 18) -> Column:
    """A number as plain digits with `scale` of them after the point, never with an exponent; null if it does not fit."""
    return value.try_cast(f"decimal({precision},{scale})").cast("string")


def trace_of(headers: Column) -> Column:
    """(traceparent, tracestate) of a record's headers, to be stored with what the record gives rise to; a trace parent without
    the form of one counts as none, and a trace state without a parent, too."""
    parent = header_text(headers, "traceparent")
    parent = F.when(is_traceparent(parent), parent)
    state = F.when(parent.isNotNull(), F.nullif(F.trim(header_text(headers, "tracestate")), F.lit("")))
    return F.struct(parent.alias("traceparent"), state.alias("tracestate"))


def with_trace(headers: Column, traceparent: Column, tracestate: Column) -> Column:
    """The headers of a record that goes on with a stored trace; without one they stay, and the publisher begins a trace."""
    bare = without_headers(headers, ["traceparent", "tracestate"])
    parent = F.when(is_traceparent(traceparent), traceparent)
    state = F.when(parent.isNotNull(), F.nullif(F.trim(tracestate), F.lit("")))
    return with_header_if(with_header_if(bare, "traceparent", parent), "tracestate", state)


def attempts(text: Column) -> Column:
    """A header's number of attempts; 0 if it is absent or no number, MOST_ATTEMPTS for any greater number."""
    digits = F.when(text.rlike(r"\A[0-9]+\z"), F.regexp_replace(text, r"\A0+(?=[0-9])", ""))
    small = F.when(F.length(digits) <= 10, F.least(digits.cast("bigint"), F.lit(MOST_ATTEMPTS))).when(digits.isNotNull(), MOST_ATTEMPTS)
    return F.coalesce(small, F.lit(0)).cast("int")


def is_traceparent(text: Column) -> Column:
    """Whether a text has the form of a W3C trace parent; false for null."""
    return F.coalesce(text.rlike("^00-[0-9a-f]{32}-[0-9a-f]{16}-[0-9a-f]{2}$"), F.lit(False))
