"""Decision for attempts whose count is already known, one row at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptscore.functions import outcomes as o
from promptscore.functions.backoff import delay_ms, jitter_draw
from promptscore.options import Options

SUCCEED = "succeed"
REQUEUE = "requeue"
FAIL = "fail"
RECOVER = "recover"


def add_decision(rows: DataFrame, budget: Column) -> DataFrame:
    """Rate limiting always requeues; transient errors requeue while budget is left."""
    outcome = F.col("outcome")
    decision = (
        F.when(outcome == o.SUCCESS, SUCCEED)
        .when(outcome == o.ABANDONED, RECOVER)
        .when(outcome == o.RATE_LIMITED, REQUEUE)
        .when((outcome == o.TRANSIENT) & (F.col("attempt") < budget), REQUEUE)
        .otherwise(FAIL)
    )
    return rows.withColumn("decision", decision)


def add_retry_time(rows: DataFrame, options: Options) -> DataFrame:
    """``delay_ms`` and ``next_retry_at`` of requeued attempts; NULL for all others."""
    draw = jitter_draw(F.col("prompt_id"), F.col("round"))
    wait = delay_ms(F.col("attempt"), F.col("retry_after_ms"), draw, options)
    timed = rows.withColumn("delay_ms", F.when(F.col("decision") == REQUEUE, wait))
    due = F.timestamp_add("MILLISECOND", F.col("delay_ms").cast("int"), F.col("finished_at"))
    return timed.withColumn("next_retry_at", due)


def status_after(decision: Column) -> Column:
    return F.when(decision == SUCCEED, "succeeded").when(decision == FAIL, "failed").otherwise("pending")


def attempts_after(outcome: Column, attempt: Column) -> Column:
    """A rate-limited attempt is handed back, every other one stays counted."""
    return F.when(outcome == o.RATE_LIMITED, F.greatest(attempt - 1, F.lit(0))).otherwise(attempt)
