"""Send times under a token bucket, in closed form over all arrivals at once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptscore.options import Options

SPAN_US = 60_000_000
SLOTS = 64


def send_plan(arrivals: DataFrame, options: Options, span_us: int = SPAN_US) -> DataFrame:
    """Earliest send time of each (id, arrived_at) so that the rate and its burst are kept over all rows.

    With ``step`` microseconds per token and j the position by (arrival, id), the ideal time is
    j*step + max over earlier rows of (t - j*step); up to ``burst`` tokens of credit are taken off it.

    Positions and maxima are taken inside spans of time and carried over a small table with one row per
    span. Equal arrival times are cut into ``SLOTS`` by a hash of the id, so that a rush at one moment is
    spread as well; among equal times rows are ordered by (slot, id).
    """
    step = math.ceil(1_000_000 / options.rate_per_sec)
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("arrived_at"))
    placed = arrivals.select("id", "arrived_at", at.alias("arrived_us"))
    placed = placed.withColumns(
        {
            "slot": F.pmod(F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(SLOTS)),
            "minute": F.floor(F.col("arrived_us") / F.lit(span_us)).cast("bigint"),
        }
    )
    # rows of one span: the same stretch of time, or the same moment and slot where that is crowded
    keys = ["minute", "arrived_us", "slot"]
    order = Window.partitionBy(*keys).orderBy("id")
    ranked = placed.withColumn("local", F.row_number().over(order).cast("bigint") - 1)
    cells = ranked.groupBy(*keys).agg(F.count("*").alias("n"))
    within = Window.partitionBy("minute").orderBy("arrived_us", "slot").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("in_minute", F.coalesce(F.sum("n").over(within), F.lit(0).cast("bigint")))
    gap = F.col("arrived_us") - F.col("in_minute") * step  # of a cell's first row, its largest
    cells = cells.withColumn("gap_before", F.max(gap).over(within)).withColumn("gap", gap)
    minutes = cells.groupBy("minute").agg(F.sum("n").alias("n"), F.max("gap").alias("gap"))
    before = Window.orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = minutes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")))
    minutes = minutes.withColumn("earlier", F.max(F.col("gap") - F.col("offset") * step).over(before))
    cells = cells.join(minutes.select("minute", "offset", "earlier"), "minute").select(
        *keys,
        (F.col("offset") + F.col("in_minute")).alias("first"),
        F.greatest("earlier", F.col("gap_before") - F.col("offset") * step).alias("slack"),
    )
    joined = ranked.join(cells, keys).withColumn("position", F.col("first") + F.col("local"))
    own = F.when(F.col("local") > 0, F.col("arrived_us") - F.col("first") * step)
    ideal = F.coalesce(F.col("position") * step + F.greatest("slack", own), F.col("arrived_us"))
    send_us = F.greatest(F.col("arrived_us"), ideal - (max(options.burst, 1) - 1) * step)
    return joined.withColumn("wait_us", send_us - F.col("arrived_us")).select(
        "id",
        "position",
        "arrived_at",
        (F.col("arrived_at") + F.make_dt_interval(secs=F.col("wait_us") / F.lit(1_000_000).cast("decimal(18,6)"))).alias(
            "send_at"
        ),
        "wait_us",
    )
