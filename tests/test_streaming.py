import sys
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from machine import SCHEMA, log_rows, replay
from promptscore import Options, new_work_dir
from promptscore.operators import finalize, state as st
from promptscore.sources import requests, tables
from promptscore.streaming import jobs
from test_state import random_logs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

START = datetime(2024, 1, 1)
SETTLED = "prompt_id string, batch_id string, status string, total_count bigint"


def deliver(spark, root, parts, schema, run):
    """Write one part at a time and run the query on what is new."""
    for i, rows in enumerate(parts):
        tables.put(spark.createDataFrame(rows, schema).coalesce(2), f"{root}/in/part-{i}")
        run(spark.readStream.schema(schema).parquet(f"{root}/in/*")).awaitTermination()


def test_ingest_equals_batch(spark):
    root = new_work_dir(spark, "t")
    bodies = ['["a"," b "]', "[]", '["c"]', '["d",1]', '[" "]', '["e"]']
    rows = [(f"r{i}", b, START + timedelta(minutes=i)) for i, b in enumerate(bodies)]
    schema = "request_id string, body string, received_at timestamp_ntz"
    deliver(spark, root, [rows[:3], rows[3:]], schema, lambda s: jobs.ingest(s, Options(), root, f"{root}/check"))
    parsed = requests.parse(spark.createDataFrame(rows, schema), Options())
    for name, want in {
        "prompts": requests.prompts_of(parsed, Options(), F.col("received_at")),
        "batches": requests.batches_of(parsed, F.col("received_at")),
        "rejects": requests.rejects_of(parsed),
    }.items():
        got = jobs.epochs(spark, f"{root}/{name}").drop("epoch")
        assert sorted(got.select(*want.columns).collect(), key=str) == sorted(want.collect(), key=str)


def settled(batches):
    return [(f"{b}-{i}", b, s, len(statuses)) for b, statuses in batches.items() for i, s in enumerate(statuses) if s != "pending"]


BATCHES = {
    "a": ["succeeded", "failed"], "b": ["succeeded"] * 40, "c": ["failed", "pending"], "d": ["failed"],
    **{f"m{i}": ["succeeded", "failed", "succeeded"] for i in range(30)},
}


def test_counts_ignore_redelivery(spark):
    root = new_work_dir(spark, "t")
    rows = settled(BATCHES)
    run = lambda s: jobs.start(jobs.live_counts(s), jobs.write_counts(root), f"{root}/check", mode="update")
    deliver(spark, root, [rows[:60], rows[30:90] * 3, rows[50:]], SETTLED, run)
    got = {r.batch_id: (r.succeeded, r.failed) for r in jobs.latest_counts(spark, root).collect()}
    assert got == {b: (s.count("succeeded"), s.count("failed")) for b, s in BATCHES.items()}


def test_completion_is_emitted_once(spark):
    root = new_work_dir(spark, "t")
    rows = settled(BATCHES)
    run = lambda s: jobs.start(jobs.completions(s), jobs.write_completions(root), f"{root}/check", mode="update")
    deliver(spark, root, [rows[:20], rows[10:70] * 2, rows[40:], rows], SETTLED, run)
    got = [(r.batch_id, r.total, r.succeeded, r.failed) for r in jobs.epochs(spark, f"{root}/completed").collect()]
    assert sorted(got) == sorted(
        (b, len(s), s.count("succeeded"), s.count("failed")) for b, s in BATCHES.items() if "pending" not in s)


def test_redelivery_inside_a_time_bound(spark):
    root = new_work_dir(spark, "t")
    schema = "prompt_id string, round bigint, at timestamp"
    rows = [("p", i, START + timedelta(seconds=i)) for i in range(50)]

    def run(stream):
        unique = jobs.drop_redelivered(stream, ["prompt_id", "round"], within="10 minutes", time="at")
        return jobs.start(unique, lambda batch, epoch: tables.put(batch, f"{root}/out/epoch={epoch}"), f"{root}/check")

    deliver(spark, root, [rows[:30] * 2, rows[10:]], schema, run)
    assert sorted(r.round for r in jobs.epochs(spark, f"{root}/out").collect()) == list(range(50))


@pytest.mark.parametrize("compact_every", [20, 2])
def test_fold_equals_batch_and_state_machine(spark, compact_every):
    root = new_work_dir(spark, "t")
    logs = random_logs(9, 120, 20)
    rows = sorted(log_rows(logs, START), key=lambda r: r[2])
    parts = [[r for r in rows if lo <= r[2] < hi] for lo, hi in ((0, 2), (2, 7), (7, 8), (8, 14), (14, 99))]
    parts[1] = parts[1] + parts[1][:40]  # some answers delivered twice
    run = lambda s: jobs.start(s, jobs.fold_epochs(Options(), root, compact_every), f"{root}/check")
    deliver(spark, root, parts, SCHEMA, run)
    newest = jobs.states_before(spark, root, 5, compact_every)
    got = {r.prompt_id: (r.status, r.attempts, r.last_round) for r in newest.collect()}
    assert got == {k: replay(v, 5) for k, v in logs.items()}
    whole = st.prompt_state(spark.createDataFrame(rows, SCHEMA), Options())
    columns = sorted(whole.columns)
    assert sorted(newest.select(*columns).collect(), key=str) == sorted(whole.select(*columns).collect(), key=str)
    due = jobs.due_now(spark, root, 5, compact_every, F.lit("2030-01-01").cast("timestamp_ntz"))
    assert due.count() == sum(1 for v in logs.values() if replay(v, 5)[0] == "pending")
    assert finalize.batch_counts(newest).agg(F.sum("total")).first()[0] == 120


def test_replayed_epoch_replaces_its_output(spark):
    root = new_work_dir(spark, "t")
    write = jobs.fold_epochs(Options(), root)
    first = spark.createDataFrame(list(log_rows({"b-a": ["transient"]}, START)), SCHEMA)
    second = first.withColumn("round", F.lit(1).cast("bigint"))
    write(first, 0)
    write(second, 1)
    write(second, 1)
    assert [(r.status, r.attempts) for r in jobs.states_before(spark, root, 2, 20).collect()] == [("pending", 2)]


def test_late_and_repeated_attempts_fold_to_the_same_state(spark):
    root = new_work_dir(spark, "t")
    write = jobs.fold_epochs(Options(), root, buckets=4)
    rows = {r[2]: r for r in log_rows({"b-a": ["abandoned", "transient", "success", "transient"]}, START)}
    late = [[rows[r] for r in part] for part in ([min(rows) + 1], [min(rows) + 1], [min(rows) + 3], [min(rows)], [min(rows) + 2])]
    seen = []
    for epoch, part in enumerate(late):
        write(spark.createDataFrame(part, SCHEMA), epoch)
        seen += part
        want = st.prompt_state(st.dedupe(spark.createDataFrame(seen, SCHEMA)), Options()).collect()
        assert jobs.states_before(spark, root, epoch + 1, 20).select("prompt_id", "status", "attempts").collect() == [
            (r.prompt_id, r.status, r.attempts) for r in want]


def test_new_prompts_are_due_and_claimed_ones_are_not(spark):
    root = new_work_dir(spark, "t")
    queue = spark.createDataFrame([(f"p{i}", "b", i, "t", "pending", 0, 5, START) for i in range(4)],
                                  "prompt_id string, batch_id string, seq bigint, prompt_text string, status string, "
                                  "attempts bigint, max_attempts int, next_retry_at timestamp_ntz")
    now = F.lit("2030-01-01").cast("timestamp_ntz")
    flying = spark.createDataFrame([("p1",)], "prompt_id string")
    assert jobs.due_now(spark, root, 0, 20, now) is None
    due = jobs.due_now(spark, root, 0, 20, now, queue=queue, in_flight=flying)
    assert sorted((r.prompt_id, r.attempts) for r in due.collect()) == [("p0", 1), ("p2", 1), ("p3", 1)]


def test_polling_trigger(spark):
    root = new_work_dir(spark, "t")
    tables.put(spark.createDataFrame(settled({"a": ["failed"]}), SETTLED), f"{root}/in/part-0")
    stream = spark.readStream.schema(SETTLED).parquet(f"{root}/in/*")
    query = jobs.start(jobs.live_counts(stream), jobs.write_counts(root), f"{root}/check", "update", Options().poll_interval_ms)
    query.processAllAvailable()
    query.stop()
    assert jobs.latest_counts(spark, root).count() == 1
