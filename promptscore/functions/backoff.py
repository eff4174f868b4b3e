"""Delay before a retry: a server hint when there is one, else jittered exponential growth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptscore.options import Options

MAX_DOUBLINGS = 30


def ceiling_ms(attempt: Column, options: Options) -> Column:
    """Upper end of the jitter range; never below the base delay."""
    doublings = F.least(F.greatest(attempt, F.lit(1)) - 1, F.lit(MAX_DOUBLINGS)).cast("int")
    grown = F.call_function("shiftleft", F.lit(options.base_backoff_ms).cast("bigint"), doublings)
    return F.greatest(
        F.least(grown, F.lit(options.max_backoff_ms).cast("bigint")),
        F.lit(options.base_backoff_ms).cast("bigint"),
    )


def jitter_draw(*key: Column) -> Column:
    """A repeatable 32-bit draw from a key, so that a recomputed task reaches the same delay."""
    digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def delay_ms(attempt: Column, retry_after_ms: Column, draw: Column, options: Options) -> Column:
    """Delay for one retry: capped server hint, else base plus a draw below the ceiling."""
    base = F.lit(options.base_backoff_ms).cast("bigint")
    span = ceiling_ms(attempt, options) - base
    computed = F.when(span <= 0, base).otherwise(base + draw % F.greatest(span, F.lit(1)))
    hinted = F.least(retry_after_ms, F.lit(options.max_backoff_ms).cast("bigint"))
    return F.when(retry_after_ms > 0, hinted).otherwise(computed)
