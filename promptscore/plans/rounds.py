"""Retry rounds: claim what is due, score it, log the answers, carry on until every prompt is settled.

Tables under ``root``, one folder per round:

``claims/round=N``             claimed ids and the time of the round, written before any call
``slices/round=N``             the round's number of slices, fixed when first written
``leases/round=N/slice=K``     the claimed prompts with their text, partitioned by slice
``attempts/round=N/slice=K``   the raw responses of a slice, in files that its scoring tasks write as answers
                               arrive; the table ``_committed`` in it closes the slice
``settled/round=N``            prompts that the round settled
``active/round=N``             prompts still pending after the round
``documents/round=N``          result documents of batches that became done in the round

A slice is a fixed share of a round by hash of the prompt id, and reads only its own lease files. Each is
one job with its own commit; inside it, tasks keep their answers in files of their own, so a crash loses
the calls in flight and nothing else. A resumed run reads the number of slices back instead of deriving it
from its own ``slice_prompts``, so every claimed prompt belongs to exactly one slice. Only pending prompts
are carried from round to round; every attempt is decided once, and its result read back from the tables.
"""

from __future__ import annotations

import time
import uuid
import warnings
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from functools import partial

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptscore.clock import SystemClock
from promptscore.functions import outcomes as o
from promptscore.functions.once import hold
from promptscore.operators import finalize, scoring, settle, state
from promptscore.options import Options
from promptscore.sources import tables

SLICE_PROMPTS = 50_000
ANSWER_ROWS = 2_000
ANSWER_SECONDS = 10.0
_QUEUE = ["prompt_id", "batch_id", "seq", "prompt_text", "attempts", "max_attempts", "next_retry_at", "error"]
_STATE = ["prompt_id", "batch_id", "seq", "prompt_text", "status", "attempts", "response", "error", "next_retry_at"]


def _as_of(moment: datetime):
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def stepped(attempts: DataFrame, options: Options) -> DataFrame:
    """Decision and resulting state per logged attempt; the claim already counted the attempt."""
    rows = hold(o.classify(attempts), "outcome").withColumn("attempt", F.col("attempts"))
    rows = settle.add_retry_time(settle.add_decision(rows, F.col("max_attempts")), options)
    decision = F.col("decision")
    return rows.withColumns(
        {
            "status": settle.status_after(decision),
            "attempts": settle.attempts_after(F.col("outcome"), F.col("attempt")),
            "error": F.when(decision != settle.SUCCEED, F.coalesce("error", "last_error")),
            "next_retry_at": F.coalesce("next_retry_at", "due_at"),
        }
    )


def run_rounds(
    spark: SparkSession,
    prompts: DataFrame,
    options: Options,
    make_transport: Callable[[int], scoring.Transport],
    root: str,
    clock=None,
    max_rounds: int | None = None,
    deadline: datetime | None = None,
    limit: int | None = None,
    documents: bool = False,
    slice_prompts: int = SLICE_PROMPTS,
) -> DataFrame:
    """Run rounds until every prompt is settled, and return all states.

    ``clock`` gives the time a round claims by and stamps its answers; when nothing is due, the run waits
    for the least retry time, and rounds are at least the poll interval apart. ``max_rounds`` or
    ``deadline`` end a run early, with a warning; prompts left then stay pending. ``limit`` bounds the
    prompts of a round. With ``documents`` each round also writes the result documents of the batches
    that it completed. ``make_transport`` gets the round number.

    Starting again with the same ``root`` goes on where the run was cut off. Slices of a round whose
    calls were cut short are closed with unanswered attempts, which count against the budget like any
    other attempt without an answer; all others keep their answers.
    """
    if spark.conf.get("spark.speculation", "false") == "true":
        warnings.warn("speculative tasks repeat endpoint calls; turn spark.speculation off", stacklevel=2)
    clock = clock or SystemClock()
    if not tables.committed(spark, f"{root}/active/round=0"):
        queue = prompts.withColumn("error", F.lit(None).cast("string")).select(*_QUEUE)
        tables.put(queue, f"{root}/active/round=0")
    last = 0
    while True:
        number = last + 1
        if not tables.committed(spark, f"{root}/active/round={number}"):
            pending, least = _active(spark, root, last).agg(F.count("*"), F.min("next_retry_at")).first()
            if not pending:
                break
            if (max_rounds is not None and last >= max_rounds) or not _wait(clock, least, deadline):
                warnings.warn(f"stopped after round {last} with {pending} prompts pending", stacklevel=2)
                break
            _one_round(spark, options, make_transport, root, number, clock, limit, slice_prompts)
        elif max_rounds is not None and number > max_rounds:
            break
        if documents:
            _finalize(spark, options, root, number, clock.now())
        last = number
        clock.sleep_until(clock.now() + timedelta(milliseconds=options.poll_interval_ms))
    return final_state(spark, root, last)


def _wait(clock, least: datetime | None, deadline: datetime | None) -> bool:
    """Wait until something is due; false when that is after the deadline."""
    due = max(clock.now(), least or clock.now())
    if deadline is not None and due > deadline:
        return False
    clock.sleep_until(due)
    return True


def _active(spark: SparkSession, root: str, number: int) -> DataFrame:
    return tables.get(spark, f"{root}/active/round={number}").withColumn("status", F.lit("pending"))


def _slice_of(slices: int):
    return F.pmod(F.xxhash64("prompt_id"), F.lit(slices)).cast("int")


def _slices(spark: SparkSession, root: str, number: int, claimed: DataFrame, slice_prompts: int, clock) -> tuple[int, datetime]:
    """The round's number of slices and its time, fixed when first written: a resumed run keeps both,
    whatever its own ``slice_prompts``."""
    path = f"{root}/slices/round={number}"
    if not tables.committed(spark, path):
        n, as_of = claimed.agg(F.count("*"), F.max("claimed_at")).first()
        row = [(max(1, -(-n // slice_prompts)), as_of or clock.now())]
        tables.put(spark.createDataFrame(row, "slices int, as_of timestamp_ntz"), path)
    first = tables.get(spark, path).first()
    return first.slices, first.as_of


def _lease(spark: SparkSession, leases: str, k: int, schema) -> DataFrame:
    """The claimed prompts of slice ``k``: only the files of its folder are read."""
    folder = f"{leases}/slice={k}"
    if not tables.exists(spark, folder):
        return spark.createDataFrame([], schema)
    return tables.get(spark, folder, schema)


def write_answers(spark: SparkSession, scored: DataFrame, folder: str, rows: int = ANSWER_ROWS, seconds: float = ANSWER_SECONDS) -> None:
    """Runs the scoring plan; every task writes its answers to files of its own as they arrive.

    A file is written under a name that readers skip and renamed when complete, after ``rows`` answers or
    ``seconds`` since the last file, so a lost task or driver loses only the answers of calls in flight
    and of the file being filled. Files of a failed task attempt stay: their calls were made.
    """
    target = tables.uri(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(target)
        files.create_dir(base, recursive=True)
        held, count, since, written = [], 0, time.monotonic(), []

        def flush():
            name = f"part-{uuid.uuid4().hex}.parquet"
            with files.open_output_stream(f"{base}/_{name}", compression=None) as out:
                pq.write_table(pa.Table.from_batches(held), out)
            files.move(f"{base}/_{name}", f"{base}/{name}")
            written.append((name, count))

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= rows or time.monotonic() - since >= seconds:
                flush()
                held, count, since = [], 0, time.monotonic()
        if count:
            flush()
        if written:
            names, counts = zip(*written)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64())], names=["name", "rows"])

    scored.mapInArrow(run, "name string, rows long").write.format("noop").mode("overwrite").save()


def answers_in(spark: SparkSession, folder: str, schema, number: int) -> DataFrame:
    """The answers that tasks wrote to ``folder`` in round ``number``, one per prompt (the earliest)."""
    found = tables.get(spark, folder, schema) if tables.exists(spark, folder) else spark.createDataFrame([], schema)
    return state.dedupe(found.withColumn("round", F.lit(number).cast("bigint")))


def _close(spark: SparkSession, folder: str) -> None:
    """Closes a slice: a table of its own inside the slice's folder, which readers of the answers skip."""
    tables.put(spark.createDataFrame([], "closed boolean"), f"{folder}/_committed")


def _closed(spark: SparkSession, folder: str) -> bool:
    return tables.committed(spark, f"{folder}/_committed")


def _one_round(spark, options, make_transport, root, number, clock, limit, slice_prompts) -> None:
    path = lambda name: f"{root}/{name}/round={number}"
    active = _active(spark, root, number - 1)
    resumed = tables.committed(spark, path("claims"))
    if not resumed:
        now = _as_of(clock.now())
        chosen = state.claim(active, now, limit).select("prompt_id", "batch_id", now.alias("claimed_at"))
        tables.put(chosen, path("claims"))
    claimed = tables.get(spark, path("claims"))
    slices, as_of = _slices(spark, root, number, claimed, slice_prompts, clock)
    ids = claimed.select("prompt_id").withColumn("slice", _slice_of(slices))
    if not tables.committed(spark, path("leases")):
        # the claimed prompts with their text, written once and partitioned by slice
        leases = state.taken(active.join(ids, "prompt_id")).withColumns(
            {
                "last_error": F.col("error"),
                "due_at": F.col("next_retry_at"),
                "finished_at": _as_of(as_of),
                "round": F.lit(number).cast("bigint"),
            }
        ).drop("error", "next_retry_at", "status")
        leases.write.mode("overwrite").partitionBy("slice").parquet(path("leases"))
    schema = tables.get(spark, path("leases")).drop("slice").schema
    logged = None
    for k in range(slices):
        folder = f"{path('attempts')}/slice={k}"
        if _closed(spark, folder):
            continue
        own = _lease(spark, path("leases"), k, schema)
        if logged is None:
            logged = scoring.score(own.limit(0), lambda: None, None, clock.stamps_calls).drop("round").schema
        if resumed:
            # closed without new calls; the answers that tasks had written before the run stopped stay
            kept = answers_in(spark, folder, logged, number)
            lost = state.abandoned(own, kept, _as_of(clock.now())).select(*logged.fieldNames())
            lost.write.mode("append").parquet(folder)
        else:
            scored = scoring.score(own, partial(make_transport, number), options.pool_size, clock.stamps_calls)
            write_answers(spark, scored.drop("round"), folder)
        _close(spark, folder)

    # a task that was run twice may have logged a prompt twice: the earliest answer counts
    log = state.dedupe(tables.get(spark, path("attempts"), logged).withColumn("round", F.lit(number).cast("bigint")))
    decided = stepped(log, options)
    tables.put(decided.filter("status <> 'pending'").select(*_STATE), path("settled"))
    again = decided.filter("status = 'pending'").select(*_QUEUE)
    waiting = active.join(ids, "prompt_id", "left_anti").select(*_QUEUE)
    tables.put(again.unionByName(waiting), path("active"))


def _settled(spark: SparkSession, root: str, last: int) -> DataFrame:
    """Prompts settled up to a round; later rounds under the same root are left out."""
    paths = [f"{root}/settled/round={n}" for n in range(1, last + 1)]
    return spark.read.parquet(*paths).select(*_STATE)


def _finalize(spark: SparkSession, options: Options, root: str, number: int, now: datetime) -> None:
    """Documents of batches that the round completed: none pending, and some prompt settled just now."""
    path = f"{root}/documents/round={number}"
    if tables.committed(spark, path):
        return
    touched = tables.get(spark, f"{root}/settled/round={number}").select("batch_id").distinct()
    pending = _active(spark, root, number).select("batch_id")
    done = touched.join(pending, "batch_id", "left_anti")
    rows = _settled(spark, root, number).join(done, "batch_id", "left_semi")
    tables.put(finalize.result_documents(rows, _as_of(now), options), path)


def documents_of(spark: SparkSession, root: str) -> DataFrame:
    """All documents that a run with ``documents`` has written."""
    return tables.get(spark, f"{root}/documents").withColumn("round", F.col("round").cast("bigint"))


def attempt_log(spark: SparkSession, root: str) -> DataFrame:
    """The whole attempt log as written; ``round`` is a partition column. A scoring task that was run twice
    may have left a prompt twice in a round; ``state.dedupe`` keeps the earliest."""
    return tables.get(spark, f"{root}/attempts").withColumn("round", F.col("round").cast("bigint")).drop("slice")


def final_state(spark: SparkSession, root: str, last: int) -> DataFrame:
    """Prompts settled up to round ``last`` plus those still pending after it."""
    pending = _active(spark, root, last).withColumn("response", F.lit(None).cast("string")).select(*_STATE)
    return pending if last == 0 else _settled(spark, root, last).unionByName(pending)
