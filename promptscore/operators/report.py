"""Status views, lookups, integrity checks, purges and attempt metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptscore.functions import outcomes as o
from promptscore.functions.ids import parse_uuid
from promptscore.operators import settle
from promptscore.operators.finalize import batch_counts


def batch_status(batches: DataFrame, state: DataFrame, completed: DataFrame | None = None) -> DataFrame:
    """All batches with live counts. ``completed`` (batch_id, completed_at and whatever else it has,
    such as ``result``) sets status and time and adds its further columns."""
    counts = batch_counts(state).select("batch_id", "total", "succeeded", "failed")
    view = batches.join(counts, "batch_id", "left")
    if completed is not None:
        view = view.drop("completed_at").join(completed, "batch_id", "left")
        status = F.when(F.col("completed_at").isNotNull(), F.lit("completed")).otherwise(F.col("status"))
        view = view.withColumn("status", status)
    return view.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("total", "succeeded", "failed")})


def batch_lookup(ids: DataFrame, view: DataFrame) -> DataFrame:
    """Look up many ids (column ``id``) at once: ``found``, ``not_found`` or ``malformed`` for each.

    A bad id has no key, and equi-joins skip NULL keys, so it keeps its row without a match. Ids are
    made distinct before the join, so an id asked for very often is joined once.
    """
    keyed = ids.select("id", parse_uuid(F.col("id")).alias("batch_id"))
    hits = keyed.filter("batch_id is not null").select("batch_id").distinct().join(view, "batch_id")
    joined = keyed.join(hits.withColumn("hit", F.lit(True)), "batch_id", "left")
    status = (
        F.when(F.col("batch_id").isNull(), "malformed").when(F.col("hit"), "found").otherwise("not_found")
    )
    return joined.withColumn("lookup_status", status).drop("hit")


def orphan_prompts(prompts: DataFrame, batches: DataFrame) -> DataFrame:
    """Prompts whose batch does not exist."""
    return prompts.join(batches.select("batch_id"), "batch_id", "left_anti")


def visible_prompts(prompts: DataFrame, batches: DataFrame) -> DataFrame:
    """Prompts of fully written batches: the batch row is written last."""
    return prompts.join(batches.select("batch_id"), "batch_id", "left_semi")


def purge(rows: DataFrame, batch_ids: DataFrame) -> DataFrame:
    """Rows left after deleting batches together with everything that refers to them."""
    return rows.join(batch_ids.select("batch_id").distinct(), "batch_id", "left_anti")


def attempt_metrics(decided: DataFrame) -> DataFrame:
    """Attempts by outcome, requeues and delays per batch, over attempts made before settling."""
    kinds = (o.SUCCESS, o.RATE_LIMITED, o.TRANSIENT, o.PERMANENT, o.ABANDONED)
    live = decided.filter("live")
    return live.groupBy("batch_id").agg(
        F.count("*").alias("attempts"),
        *[F.count_if(F.col("outcome") == kind).alias(f"n_{kind}") for kind in kinds],
        F.count_if(F.col("decision") == settle.REQUEUE).alias("n_requeued"),
        F.round(F.avg("delay_ms"), 4).alias("mean_delay_ms"),
        F.max("delay_ms").alias("max_delay_ms"),
    )


def attempt_gaps(decided: DataFrame) -> DataFrame:
    """Mean time between the attempts of a prompt, per batch.

    The gaps of one prompt add up to its last time minus its first, so no row needs its neighbour.
    """
    per_prompt = decided.filter("live").groupBy("batch_id", "prompt_id").agg(
        F.min("finished_at").alias("first"), F.max("finished_at").alias("last"), F.count("*").alias("n")
    )
    spread = F.timestamp_diff("MILLISECOND", F.col("first"), F.col("last"))
    return per_prompt.groupBy("batch_id").agg(
        F.sum(F.col("n") - 1).cast("bigint").alias("gaps"),
        F.round(F.sum(spread) / F.nullif(F.sum(F.col("n") - 1), F.lit(0)), 4).alias("mean_gap_ms"),
    )


def recovery_counts(decided: DataFrame) -> DataFrame:
    """Attempts put back because no answer ever came, per batch."""
    put_back = decided.filter(F.col("live") & (F.col("decision") == settle.RECOVER))
    return put_back.groupBy("batch_id").agg(
        F.count("*").alias("recovered"), F.max("attempt").alias("max_attempt")
    )
