"""Batch validation: limits, first error wins, one bad prompt rejects its whole batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptscore.functions.text import trim_space
from promptscore.options import Options

EMPTY_BATCH = "empty_batch"
BATCH_TOO_LARGE = "batch_too_large"
EMPTY_PROMPT = "empty_prompt"
PROMPT_TOO_LONG = "prompt_too_long"
BODY_TOO_LARGE = "body_too_large"
NOT_AN_ARRAY = "not_an_array"

# The message and the caller class of each reject reason.
MESSAGES = {
    BODY_TOO_LARGE: "request body too large",
    NOT_AN_ARRAY: "request body must be a JSON array of prompts",
    EMPTY_BATCH: "batch must contain at least one prompt",
    BATCH_TOO_LARGE: "batch exceeds the maximum allowed size",
    EMPTY_PROMPT: "prompt text must not be empty",
    PROMPT_TOO_LONG: "prompt exceeds the maximum allowed length",
}
STATUS_CODES = {
    BODY_TOO_LARGE: 413,
    NOT_AN_ARRAY: 400,
    EMPTY_BATCH: 400,
    BATCH_TOO_LARGE: 400,
    EMPTY_PROMPT: 400,
    PROMPT_TOO_LONG: 400,
}

# Rows of one group and one span of the order column that are numbered together.
SPAN = 1 << 16


def _lookup(code: Column, values: dict) -> Column:
    result = F.lit(None)
    for key, value in values.items():
        result = F.when(code == key, F.lit(value)).otherwise(result)
    return result


def error_message(code: Column) -> Column:
    return _lookup(code, MESSAGES)


def status_code(code: Column) -> Column:
    """202 for an accepted request, else the status a caller would see."""
    return F.when(code.isNull(), F.lit(202)).otherwise(_lookup(code, STATUS_CODES))


def prompt_error(trimmed: Column, options: Options) -> Column:
    """Error code of one trimmed prompt, or NULL. The length limit is in bytes."""
    return F.when(trimmed == "", EMPTY_PROMPT).when(
        F.octet_length(trimmed) > options.max_prompt_bytes, PROMPT_TOO_LONG
    )


def size_error(total: Column, options: Options) -> Column:
    return F.when(total == 0, EMPTY_BATCH).when(total > options.max_batch_size, BATCH_TOO_LARGE)


def check_prompts(rows: DataFrame, options: Options) -> DataFrame:
    """Trim ``prompt_text`` and add ``error_code`` per row. Narrow."""
    trimmed = rows.withColumn("prompt_text", trim_space(F.coalesce(F.col("prompt_text"), F.lit(""))))
    return trimmed.withColumn("error_code", prompt_error(F.col("prompt_text"), options))


def _first_error(order: Column, code: Column) -> Column:
    """Least failing position with its code, as one number: fixed width keeps the aggregate hashed."""
    which = F.when(code == EMPTY_PROMPT, 0).otherwise(1)
    return F.min(F.when(code.isNotNull(), order * 2 + which))


def _first_code(first: Column) -> Column:
    return F.when(F.pmod(first, F.lit(2)) == 0, EMPTY_PROMPT).when(first.isNotNull(), PROMPT_TOO_LONG)


def batch_verdicts(rows: DataFrame, options: Options, batches: DataFrame | None = None) -> DataFrame:
    """One row per batch: ``total_count``, ``error_code`` and ``error_seq`` of the first failing prompt.

    ``rows`` is one row per prompt (batch_id, seq, prompt_text). ``batches`` adds batches that may
    have no rows at all. Only counts and one (seq, code) pair per map task and batch are shuffled,
    so a batch of any size costs its reducer one row per task.
    """
    checked = check_prompts(rows, options)
    first = _first_error(F.col("seq"), F.col("error_code"))
    per_batch = checked.groupBy("batch_id").agg(F.count("*").alias("total_count"), first.alias("first"))
    if batches is not None:
        per_batch = batches.select("batch_id").join(per_batch, "batch_id", "left")
    total = F.coalesce(F.col("total_count"), F.lit(0).cast("bigint"))
    by_size = size_error(total, options)
    return per_batch.select(
        "batch_id",
        total.alias("total_count"),
        F.coalesce(by_size, _first_code(F.col("first"))).alias("error_code"),
        F.when(by_size.isNull(), F.shiftright("first", 1)).alias("error_seq"),
    )


def accept_rows(rows: DataFrame, options: Options, order: str = "seq", span: int = SPAN) -> DataFrame:
    """Prompts of accepted batches with trimmed text and a dense 0-based ``seq``.

    ``order`` is a BIGINT column, unique inside a batch. Rows are numbered inside (batch, span of
    the order column), which holds at most ``span`` rows, and shifted by the count of the earlier
    spans; the same per-span summary carries the verdict. The text is shuffled once, on
    (batch, span), so a batch holding much of the table spreads over many tasks.
    """
    position = F.col(order)
    checked = check_prompts(rows, options).withColumn("span", position - F.pmod(position, F.lit(span)))
    spans = checked.groupBy("batch_id", "span").agg(
        F.count("*").alias("n"), F.count(F.col("error_code")).alias("bad")
    )
    whole = Window.partitionBy("batch_id")
    earlier = whole.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    good = (
        spans.withColumns(
            {
                "offset": F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("bigint")),
                "total_count": F.sum("n").over(whole),
                "bad": F.sum("bad").over(whole),
            }
        )
        .filter(size_error(F.col("total_count"), options).isNull() & (F.col("bad") == 0))
        .select("batch_id", "span", "offset", "total_count")
    )
    # numbering comes before the join: its sort order is the one the join needs as well
    inside = Window.partitionBy("batch_id", "span").orderBy(order)
    numbered = checked.drop("error_code").withColumn("local", F.row_number().over(inside) - 1)
    placed = numbered.join(good, ["batch_id", "span"])
    return (
        placed.withColumn("dense", F.col("offset") + F.col("local"))
        .drop("span", "offset", "local", "seq")
        .withColumnRenamed("dense", "seq")
    )


def reject_report(verdicts: DataFrame) -> DataFrame:
    """Rejected batches per reason with message and status; one partially aggregated group-by."""
    rejected = verdicts.filter(F.col("error_code").isNotNull())
    return (
        rejected.groupBy("error_code")
        .agg(F.count("*").alias("batches"), F.sum("total_count").cast("bigint").alias("prompts"))
        .select(
            "error_code",
            error_message(F.col("error_code")).alias("error"),
            status_code(F.col("error_code")).alias("status_code"),
            "batches",
            "prompts",
        )
    )
