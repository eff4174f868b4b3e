"""Text helpers measured in bytes, as the limits are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space code points.
WHITE_SPACE_POINTS = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WHITE_SPACE = "".join(chr(p) for p in WHITE_SPACE_POINTS)


def trim_space(text: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def cut_bytes(text: Column, limit: int) -> Column:
    """The first ``limit`` bytes and an ellipsis; a character split by the cut becomes U+FFFD."""
    head = F.make_valid_utf8(F.substring(text.cast("binary"), 1, limit).cast("string"))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(head, F.lit("...")))


def duration_text(ms: Column) -> Column:
    """A positive number of milliseconds as text such as ``250ms``, ``1.5s`` or ``1h0m30s``."""
    hours = F.floor(ms / 3_600_000)
    minutes = F.floor(ms / 60_000) % 60
    rest = ms % 60_000
    fraction = F.rtrim(F.lpad((rest % 1000).cast("string"), 3, "0"), F.lit("0"))
    seconds = F.concat(
        F.floor(rest / 1000).cast("string"),
        F.when(rest % 1000 == 0, F.lit("")).otherwise(F.concat(F.lit("."), fraction)),
        F.lit("s"),
    )
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, seconds)
        .when(ms < 3_600_000, F.concat(minutes.cast("string"), F.lit("m"), seconds))
        .otherwise(F.concat(hours.cast("string"), F.lit("h"), minutes.cast("string"), F.lit("m"), seconds))
    )
