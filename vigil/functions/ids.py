"""Identifiers: one written form for UUIDs, and name-based (version 5) UUIDs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# \A and \z: $ also matches before a line break at the end.
_CANONICAL = r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
_BLANK = r"[\s\x{00a0}\x{200b}\x{feff}]"
_WRAPPING = rf"^{_BLANK}*(urn:)?(uuid:)?{_BLANK}*[{{(]?{_BLANK}*|{_BLANK}*[)}}]?{_BLANK}*$|-"


def with_hyphens(hex32: Column) -> Column:
    """32 hex digits as 8-4-4-4-12."""
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(hex32, at, n) for at, n in cuts])


def canonical_uuid(text: Column) -> Column:
    """The UUID that a text denotes, in lower case as 8-4-4-4-12; null for null and for text that denotes none.

    Letter case, surrounding blanks, braces or parentheses, a urn:uuid: prefix and absent hyphens make no difference.
    """
    plain = F.regexp_replace(F.lower(text), _WRAPPING, "")
    return F.when(text.rlike(_CANONICAL), text).when(plain.rlike(r"\A[0-9a-f]{32}\z"), with_hyphens(plain))


def uuid_bytes(canonical: Column) -> Column:
    """The 16 bytes of a canonical UUID text."""
    return F.unhex(F.translate(canonical, "-", ""))


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 version 5: SHA-1 of namespace bytes and name, with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
