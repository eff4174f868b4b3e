"""Repeatable identifiers in UUID form, and a check of the forms accepted for lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX = "[0-9a-fA-F]"
_DASHED = f"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}"
# plain, urn:uuid: prefixed, wrapped in one character on each side, or without dashes
_ACCEPTED = f"(?s)^({_DASHED}|(?i:urn:uuid:){_DASHED}|.{_DASHED}.|{_HEX}{{32}})$"


def dashed(hex32: Column) -> Column:
    """32 hexadecimal digits with dashes after the 8th, 12th, 16th and 20th."""
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(hex32, start, length) for start, length in cuts])


def stable_uuid(*parts: Column) -> Column:
    """UUID-shaped id derived from its parts: recomputing a partition yields the same id."""
    return dashed(F.md5(F.concat_ws("\x1f", *[p.cast("string") for p in parts])))


def parse_uuid(text: Column) -> Column:
    """Canonical lower-case dashed form, or NULL when the text is not an accepted UUID form."""
    fits = text.rlike(_ACCEPTED) & F.octet_length(text).isin(32, 36, 38, 45)
    core = (
        F.when(F.octet_length(text) == 45, F.substring(text, 10, 36))
        .when(F.octet_length(text) == 38, F.substring(text, 2, 36))
        .otherwise(text)
    )
    return F.when(fits, dashed(F.lower(F.regexp_replace(core, "-", ""))))
