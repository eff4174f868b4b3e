"""Per-batch counts, completion and result documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptscore.options import Options


def batch_counts(state: DataFrame, *more: Column) -> DataFrame:
    """total, succeeded, failed, remaining and done for every batch, pre-aggregated per map task.

    ``more`` are further aggregates to take in the same pass.
    """
    succeeded = F.count_if(F.col("status") == "succeeded").alias("succeeded")
    failed = F.count_if(F.col("status") == "failed").alias("failed")
    counts = state.groupBy("batch_id").agg(F.count("*").alias("total"), succeeded, failed, *more)
    return with_progress(counts)


def with_progress(counts: DataFrame) -> DataFrame:
    remaining = F.col("total") - F.col("succeeded") - F.col("failed")
    return counts.withColumn("remaining", remaining).withColumn(
        "done", (F.col("total") > 0) & (F.col("remaining") == 0)
    )


def succeeded_prompts(state: DataFrame) -> DataFrame:
    return state.filter(F.col("status") == "succeeded")


def newly_done(counts: DataFrame, completed: DataFrame | None) -> DataFrame:
    """Done batches not yet completed: the guard that completes each batch once."""
    done = counts.filter("done")
    return done if completed is None else done.join(completed.select("batch_id"), "batch_id", "left_anti")


def rfc3339(stamp: Column) -> Column:
    text = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit("Z"))


def document(as_of: Column) -> Column:
    """Result document of the current row as JSON text."""
    return F.to_json(
        F.struct(
            "batch_id",
            "total",
            "succeeded",
            "failed",
            rfc3339(as_of).alias("generated_at"),
            "results",
        )
    )


def result_documents(
    state: DataFrame,
    as_of: Column,
    options: Options,
    completed: DataFrame | None = None,
    part_rows: int | None = None,
) -> DataFrame:
    """Documents of newly done batches from (prompt_id, batch_id, seq, prompt_text, status, response).

    Every batch is cut in the same way: ``part`` is ``seq`` divided by ``part_rows``, which is the largest
    batch size unless given, so an accepted batch is one document. Part 0 always exists, other parts where
    a prompt succeeded; ``parts`` is their number. Every part has the counts of the whole batch, and no
    task gathers more than one part.

    Rows are counted per (batch, part); batch totals come from those counts. Rows then meet their
    batch's totals on (batch, part), so a very large batch is spread.
    """
    size = part_rows or options.max_batch_size
    rows = state.withColumn("part", F.floor(F.col("seq") / size).cast("bigint"))
    whole = Window.partitionBy("batch_id")
    per_part = rows.groupBy("batch_id", "part").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    has_any = (F.col("succeeded") > 0) | (F.col("part") == 0)
    counted = per_part.withColumns({"shown": has_any, "first": F.min("part").over(whole)}).withColumns(
        {c: F.sum(c).over(whole) for c in ("total", "succeeded", "failed")}
        | {"parts": F.sum(F.col("shown").cast("bigint")).over(whole) + F.when(F.col("first") > 0, 1).otherwise(0)}
    )
    todo = newly_done(with_progress(counted), completed)
    # a batch whose lowest part is not 0 gets its part 0 from that row, without results
    opened = F.when(F.col("first") == F.col("part"), F.array_distinct(F.array(F.lit(0).cast("bigint"), "part")))
    shelves = todo.withColumn("part", F.explode(F.coalesce(opened, F.array("part")))).select(
        "batch_id", "part", "total", "succeeded", "failed", "parts"
    )
    found = succeeded_prompts(rows).select("batch_id", "part", "seq", "prompt_id", "prompt_text", "response")
    placed = shelves.join(found, ["batch_id", "part"], "left")
    entry = F.when(
        F.col("seq").isNotNull(),
        F.struct("seq", "prompt_id", F.col("prompt_text").alias("prompt"), "response"),
    )
    parts = (
        placed.groupBy("batch_id", "part")
        .agg(
            *[F.any_value(c).alias(c) for c in ("total", "succeeded", "failed", "parts")],
            F.array_sort(F.collect_list(entry)).alias("entries"),
        )
        .where((F.col("part") == 0) | (F.size("entries") > 0))
    )
    shown = F.transform(
        "entries",
        lambda e: F.struct(e["prompt_id"].alias("prompt_id"), e["seq"].alias("seq"), e["prompt"].alias("prompt"),
                           e["response"].alias("response")),
    )
    return parts.withColumn("results", shown).select(
        "batch_id",
        "part",
        "parts",
        "total",
        "succeeded",
        "failed",
        as_of.alias("generated_at"),
        F.size("results").alias("n_results"),
        document(as_of).alias("result"),
    )


def completed_of(documents: DataFrame) -> DataFrame:
    """One row per completed batch: when, in how many parts, and its first document."""
    return documents.groupBy("batch_id").agg(
        F.max("generated_at").alias("completed_at"), F.max("parts").alias("parts"), F.min_by("result", "part").alias("result")
    )
