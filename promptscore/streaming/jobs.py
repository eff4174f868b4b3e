"""Streaming forms of ingest, counts, completion and the state fold.

Every query writes each micro-batch under its own epoch path, so a replayed epoch replaces its
earlier attempt instead of adding to it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from promptscore import schemas
from promptscore.operators import state as st
from promptscore.options import Options
from promptscore.sources import requests, tables


def start(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    every_ms: int | None = None,
) -> StreamingQuery:
    """Start a query; without ``every_ms`` it takes all available input and stops."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if every_ms is None else {"processingTime": f"{every_ms} milliseconds"}
    return writer.trigger(**trigger).start()


def epochs(spark: SparkSession, path: str) -> DataFrame:
    """All epochs written under a path, with their number in ``epoch``."""
    return spark.read.option("basePath", path).parquet(f"{path}/epoch=*")


# ---- ingest ---------------------------------------------------------------------------------


def ingest(stream: DataFrame, options: Options, root: str, checkpoint: str, every_ms: int | None = None) -> StreamingQuery:
    """Request bodies to prompts, rejects and batches, one delivery per epoch."""

    def write(batch: DataFrame, epoch: int) -> None:
        requests.store(batch, options, root, f"epoch={epoch}")

    return start(stream, write, checkpoint, every_ms=every_ms)


# ---- duplicates -----------------------------------------------------------------------------


def drop_redelivered(stream: DataFrame, keys: list[str], within: str | None = None, time: str | None = None) -> DataFrame:
    """One row per key. Without ``within`` every key is remembered and nothing is ever dropped as late.
    With it, state is kept for that long after ``time``; choose it where deliveries are closer together."""
    if within is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


# ---- counts ---------------------------------------------------------------------------------


def live_counts(stream: DataFrame) -> DataFrame:
    """Running terminal counts per batch from (prompt_id, batch_id, status); use update mode."""
    unique = drop_redelivered(stream, ["prompt_id"])
    return unique.groupBy("batch_id").agg(
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def write_counts(root: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, epoch: tables.put(batch, f"{root}/counts/epoch={epoch}")


def latest_counts(spark: SparkSession, root: str) -> DataFrame:
    """Counts of the last epoch that touched each batch."""
    newest = F.max(F.struct("epoch", "succeeded", "failed")).alias("newest")
    return epochs(spark, f"{root}/counts").groupBy("batch_id").agg(newest).select(
        "batch_id", "newest.succeeded", "newest.failed"
    )


# ---- completion -----------------------------------------------------------------------------

def completions(stream: DataFrame) -> DataFrame:
    """Running counts of settled prompts per batch from (prompt_id, batch_id, status, total_count), of batches
    that are complete; use update mode and ``write_completions``, which passes each batch on once."""
    unique = drop_redelivered(stream.select("prompt_id", "batch_id", "status", "total_count"), ["prompt_id"])
    counts = unique.groupBy("batch_id").agg(
        F.max("total_count").alias("total"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    return counts.filter((F.col("total") > 0) & (F.col("succeeded") + F.col("failed") >= F.col("total")))


def write_completions(root: str) -> Callable[[DataFrame, int], None]:
    """Writes batches that no earlier epoch has written."""

    def write(batch: DataFrame, epoch: int) -> None:
        new = batch
        if epoch:
            known = batch.sparkSession.read.schema("batch_id string, epoch bigint").parquet(f"{root}/completed")
            new = batch.join(known.filter(F.col("epoch") < epoch).select("batch_id"), "batch_id", "left_anti")
        tables.put(new, f"{root}/completed/epoch={epoch}")

    return write


# ---- fold -----------------------------------------------------------------------------------


BUCKETS = 64


def fold_epochs(options: Options, root: str, compact_every: int = 20, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer that folds new attempts into the states of the prompts they touch.

    Attempts are kept in a log by epoch and bucket of the prompt id. A micro-batch adds its rows, reads
    the log of the buckets it touches, and folds all attempts of its prompts anew, without copies. So
    attempts may be delivered again and in any order, also over several micro-batches, and the state is
    that of the whole log so far. Only touched prompts are written; every ``compact_every`` epochs the
    newest states are merged into a snapshot, so a lookup reads that and at most so many epochs.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("prompt_id"), F.lit(buckets)).cast("int").alias("bucket")
        batch.select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/log/epoch={epoch}")
        schema = T.StructType([*batch.schema.fields, T.StructField("epoch", T.LongType()), T.StructField("bucket", T.IntegerType())])
        every = spark.read.schema(schema).parquet(f"{root}/log").filter(F.col("epoch") <= epoch)
        mine = every.filter(F.col("epoch") == epoch)
        touched = [r.bucket for r in mine.select("bucket").distinct().collect()]  # at most ``buckets``
        ids = mine.select("prompt_id").distinct()
        log = every.filter(F.col("bucket").isin(touched)).join(ids, "prompt_id", "left_semi").drop("epoch", "bucket")
        tables.put(st.prompt_state(st.dedupe(log), options), f"{root}/state/epoch={epoch}")
        if (epoch + 1) % compact_every == 0:
            merged = states_before(spark, root, epoch + 1, compact_every, use_snapshot_at=epoch + 1 - compact_every)
            tables.put(merged, f"{root}/snapshot/upto={epoch + 1}")

    return write


def states_before(
    spark: SparkSession, root: str, epoch: int, compact_every: int, use_snapshot_at: int | None = None
) -> DataFrame | None:
    """Newest state per prompt written before an epoch: the last snapshot plus the epochs after it."""
    base = epoch - epoch % compact_every if use_snapshot_at is None else use_snapshot_at
    paths = [f"{root}/state/epoch={n}" for n in range(base, epoch)]
    schema = schemas.PROMPT_STATE
    parts = [tables.get(spark, p, schema).withColumn("at", F.lit(n)) for n, p in zip(range(base, epoch), paths)]
    if base > 0:
        parts.append(tables.get(spark, f"{root}/snapshot/upto={base}", schema).withColumn("at", F.lit(base - 1)))
    if not parts:
        return None
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    columns = [c for c in every.columns if c not in ("prompt_id", "at")]
    newest = F.max_by(F.struct(*columns), "at").alias("newest")
    return every.groupBy("prompt_id").agg(newest).select("prompt_id", "newest.*")


def due_now(
    spark: SparkSession,
    root: str,
    epoch: int,
    compact_every: int,
    as_of: Column,
    limit: int | None = None,
    queue: DataFrame | None = None,
    in_flight: DataFrame | None = None,
) -> DataFrame | None:
    """Prompts to claim now from the newest states: the durable retry timer of a polling loop.

    With ``queue`` prompts without any attempt are due as well; prompts of ``in_flight`` (prompt_id), which
    were claimed and have no answer yet, are not.
    """
    known = states_before(spark, root, epoch, compact_every)
    if queue is not None:
        empty = spark.createDataFrame([], schemas.PROMPT_STATE)
        known = st.with_unclaimed(queue, empty if known is None else known)
    if known is None:
        return None
    if in_flight is not None:
        known = known.join(in_flight.select("prompt_id"), "prompt_id", "left_anti")
    return st.claim(known, as_of, limit)


# ---- fold by keyed state ----------------------------------------------------------------------


def _plain(value, kind: T.DataType):
    """A pandas cell as the Python value of its field's type that state rows hold: a nullable integer
    column reaches pandas as floats."""
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    value = value.item() if hasattr(value, "item") else value
    return int(value) if isinstance(kind, T.IntegralType) else value


class AttemptLists(StatefulProcessor):
    """Keeps each prompt's attempts, without exact copies, in list state; for every prompt that a
    micro-batch touches it emits all of its attempts, so the fold reads those and nothing else."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def init(self, handle) -> None:
        self.attempts = handle.getListState("attempts", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        known = [tuple(r) for r in self.attempts.get()] if self.attempts.exists() else []
        seen, fresh = set(known), []
        for frame in rows:
            for row in frame[self.schema.fieldNames()].astype(object).itertuples(index=False, name=None):
                row = tuple(_plain(v, f.dataType) for v, f in zip(row, self.schema.fields))
                if row not in seen:
                    seen.add(row)
                    fresh.append(row)
        if fresh:
            self.attempts.appendList(fresh)
        every = known + fresh
        yield pd.DataFrame(every, columns=self.schema.fieldNames())

    def close(self) -> None:
        pass


def keyed_attempts(stream: DataFrame) -> DataFrame:
    """The whole attempt list of every prompt a micro-batch touches, from keyed state (RocksDB)."""
    return stream.groupBy("prompt_id").transformWithStateInPandas(
        statefulProcessor=AttemptLists(stream.schema), outputStructType=stream.schema, outputMode="Update", timeMode="None"
    )


def fold_touched(options: Options, root: str, compact_every: int = 20) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer over ``keyed_attempts``: folds the touched prompts' attempts into their states.

    The writer reads no log of its own: what an epoch costs follows the prompts it touches and their
    attempts, not the length of the stream. States and snapshots are laid out as ``fold_epochs`` lays them
    out, so ``states_before`` and ``due_now`` read either.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        tables.put(st.prompt_state(st.dedupe(batch), options), f"{root}/state/epoch={epoch}")
        if (epoch + 1) % compact_every == 0:
            merged = states_before(spark, root, epoch + 1, compact_every, use_snapshot_at=epoch + 1 - compact_every)
            tables.put(merged, f"{root}/snapshot/upto={epoch + 1}")

    return write
