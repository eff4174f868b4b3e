"""Keep costly columns from being computed more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hold(df: DataFrame, *columns: str) -> DataFrame:
    """Make later filters on these columns use the computed values.

    A filter on an ordinary column is pushed below its projection by copying the expression, which
    would parse a text again for each mention. The output of a generator is not copied, while
    filters on all other columns still reach the scan.
    """
    renamed = {c: f"held_{c}" for c in columns}
    values = [F.col(h).alias(c) for c, h in renamed.items()]
    held = df.withColumnsRenamed(renamed).select("*", F.inline(F.array(F.struct(*values))))
    return held.drop(*renamed.values())
