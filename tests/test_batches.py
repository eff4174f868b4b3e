import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from promptscore import Options
from promptscore.operators import finalize as fin
from promptscore.operators import pacing, report
from promptscore.sources import tables

def as_of():
    return F.lit("2024-01-20 10:00:00.5").cast("timestamp_ntz")

STATE = "prompt_id string, batch_id string, seq bigint, prompt_text string, status string, response string"


def state(spark, batches):
    rows = []
    for batch, statuses in batches.items():
        for i, status in enumerate(statuses):
            rows.append((f"{batch}-{i}", batch, i, f"ask {i}", status, f"say {i}" if status == "succeeded" else None))
    return spark.createDataFrame(rows, STATE)


BATCHES = {
    "open": ["succeeded", "failed", "pending"],
    "mixed": ["failed", "succeeded"],
    "none": ["failed", "failed"],
    "all": ["succeeded"] * 12,
}


def test_counts_and_done(spark):
    got = {r.batch_id: (r.total, r.succeeded, r.failed, r.remaining, r.done) for r in fin.batch_counts(state(spark, BATCHES)).collect()}
    assert got == {"open": (3, 1, 1, 1, False), "mixed": (2, 1, 1, 0, True), "none": (2, 0, 2, 0, True), "all": (12, 12, 0, 0, True)}
    empty = spark.createDataFrame([("x", 0, 0, 0)], "batch_id string, total bigint, succeeded bigint, failed bigint")
    assert fin.with_progress(empty).first().done is False


def test_documents(spark):
    docs = {r.batch_id: json.loads(r.result) for r in fin.result_documents(state(spark, BATCHES), as_of(), Options()).collect()}
    assert set(docs) == {"mixed", "none", "all"}
    assert list(docs["mixed"]) == ["batch_id", "total", "succeeded", "failed", "generated_at", "results"]
    assert docs["mixed"] == {
        "batch_id": "mixed", "total": 2, "succeeded": 1, "failed": 1, "generated_at": "2024-01-20T10:00:00.5Z",
        "results": [{"prompt_id": "mixed-1", "seq": 1, "prompt": "ask 1", "response": "say 1"}],
    }
    assert docs["none"]["results"] == []
    assert [r["seq"] for r in docs["all"]["results"]] == list(range(12))


def test_completed_batches_are_not_done_again(spark):
    completed = spark.createDataFrame([("all",), ("none",)], "batch_id string")
    docs = fin.result_documents(state(spark, BATCHES), as_of(), Options(), completed)
    assert [r.batch_id for r in docs.collect()] == ["mixed"]


@pytest.mark.parametrize("rows", [1, 3, 5, 10_000])
def test_large_batches_become_several_documents_with_every_result(spark, rows):
    rng = random.Random(2)
    batches = {f"b{i}": rng.choices(["succeeded", "failed"], [5, 1], k=rng.randint(1, 40)) for i in range(12)}
    batches["f"] = ["failed"] * 9
    docs = fin.result_documents(state(spark, batches), as_of(), Options(), part_rows=rows).collect()
    seen = {b: [] for b in batches}
    for doc in sorted(docs, key=lambda d: (d.batch_id, d.part)):
        seqs = [r["seq"] for r in json.loads(doc.result)["results"]]
        assert {s // rows for s in seqs} <= {doc.part} and (seqs or doc.part == 0)
        assert doc.parts == sum(d.batch_id == doc.batch_id for d in docs)
        assert doc.total == len(batches[doc.batch_id])
        seen[doc.batch_id] += seqs
    assert seen == {b: [i for i, s in enumerate(st) if s == "succeeded"] for b, st in batches.items()}
    assert len({(d.batch_id, d.part) for d in docs}) == len(docs)


def test_one_long_text_changes_no_part(spark):
    rows = state(spark, {"b": ["succeeded"] * 100})
    long = rows.withColumn("response", F.when(F.col("seq") == 7, F.repeat(F.lit("x"), 1_000_000)).otherwise(F.col("response")))
    docs = fin.result_documents(long, as_of(), Options()).collect()
    assert [(d.part, d.parts, d.n_results) for d in docs] == [(0, 1, 100)]


def test_a_batch_that_begins_late_has_a_first_part(spark):
    rows = state(spark, {"b": ["failed"] * 4 + ["succeeded"] * 4}).filter("seq >= 4")
    docs = fin.result_documents(rows, as_of(), Options(), part_rows=2).collect()
    assert sorted((d.part, d.parts, d.n_results, d.total) for d in docs) == [(0, 3, 0, 4), (2, 3, 2, 4), (3, 3, 2, 4)]


def test_documents_as_files(spark, tmp_path):
    docs = fin.result_documents(state(spark, BATCHES), as_of(), Options())
    tables.export_json(docs, str(tmp_path / "docs"))
    texts = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "docs")).collect()]
    assert {t["batch_id"] for t in texts} == {"mixed", "none", "all"}
    tables.put_results(docs, str(tmp_path), "run=1")
    again = fin.result_documents(state(spark, BATCHES), as_of(), Options(), spark.read.parquet(f"{tmp_path}/results"))
    assert again.count() == 0


def batches(spark):
    rows = [("mixed", "pending", datetime(2024, 1, 1)), ("empty", "pending", datetime(2024, 1, 1))]
    return spark.createDataFrame(rows, "batch_id string, status string, created_at timestamp_ntz")


def test_status_view(spark):
    completed = spark.createDataFrame([("mixed", datetime(2024, 1, 2))], "batch_id string, completed_at timestamp_ntz")
    got = {r.batch_id: (r.status, r.total, r.succeeded, r.failed, r.completed_at)
           for r in report.batch_status(batches(spark), state(spark, BATCHES), completed).collect()}
    assert got == {"mixed": ("completed", 2, 1, 1, datetime(2024, 1, 2)), "empty": ("pending", 0, 0, 0, None)}


def test_status_shows_the_first_document(spark):
    rows = state(spark, BATCHES)
    once = finalize_status(spark, rows, Options())
    assert json.loads(once["mixed"].result)["total"] == 2 and once["all"].parts == 1 and once["open"].result is None
    split = finalize_status(spark, rows, Options(max_batch_size=5))
    assert split["all"].parts == 3 and len(json.loads(split["all"].result)["results"]) == 5
    assert split["all"].status == "completed"


def finalize_status(spark, rows, options):
    known = spark.createDataFrame([(b, "pending", None) for b in BATCHES], "batch_id string, status string, completed_at timestamp_ntz")
    completed = fin.completed_of(fin.result_documents(rows, as_of(), options))
    return {r.batch_id: r for r in report.batch_status(known, rows, completed).collect()}


def test_lookup(spark):
    known, other = "b1f20c3d-0000-4000-8000-0123456789ab", "00000000-0000-4000-8000-0123456789ab"
    view = spark.createDataFrame([(known, 2)], "batch_id string, succeeded bigint")
    ids = spark.createDataFrame([(known,), (known.upper(),), (other,), ("not-a-uuid",), (None,)], "id string")
    got = {r.id: (r.lookup_status, r.succeeded) for r in report.batch_lookup(ids, view).collect()}
    assert got == {known: ("found", 2), known.upper(): ("found", 2), other: ("not_found", None),
                   "not-a-uuid": ("malformed", None), None: ("malformed", None)}


def test_orphans_visibility_and_purge(spark):
    rows = state(spark, BATCHES)
    assert {r.batch_id for r in report.orphan_prompts(rows, batches(spark)).collect()} == {"open", "none", "all"}
    assert {r.batch_id for r in report.visible_prompts(rows, batches(spark)).collect()} == {"mixed"}
    gone = spark.createDataFrame([("all",), ("all",), ("missing",)], "batch_id string")
    assert {r.batch_id for r in report.purge(rows, gone).collect()} == {"open", "mixed", "none"}


def test_publish_writes_batches_last(spark, tmp_path):
    tables.publish(state(spark, BATCHES), batches(spark), str(tmp_path))
    prompts = tables.get(spark, f"{tmp_path}/prompts")
    assert report.visible_prompts(prompts, tables.get(spark, f"{tmp_path}/batches")).count() == 2


def bucket(times, step, burst):
    """Token bucket with waiting: credit for ``burst`` calls, one more every ``step``."""
    out, free = [], None
    for t in times:
        earliest = t if free is None else max(t, free - (burst - 1) * step)
        out.append(earliest)
        free = (max(free, t) if free is not None else t) + step
    return out


@pytest.mark.parametrize("burst, rate", [(1, 50.0), (3, 20.0), (10, 400.0), (0, 5.0), (2, 3.0)])
def test_send_plan_equals_token_bucket(spark, burst, rate):
    rng = random.Random(burst)
    start = datetime(2024, 1, 1)
    times = {i: start + timedelta(microseconds=rng.choice([0, 5, 100, 1000, 90_000]) * rng.randint(0, 900)) for i in range(400)}
    df = spark.createDataFrame(list(times.items()), "id bigint, arrived_at timestamp_ntz")
    plan = pacing.send_plan(df, Options(rate_per_sec=rate, burst=burst), span_us=500_000)
    got = sorted((r.position, (r.arrived_at - start) // timedelta(microseconds=1), r.wait_us) for r in plan.collect())
    assert [p for p, _, _ in got] == list(range(400)) and [t for _, t, _ in got] == sorted(t for _, t, _ in got)
    want = bucket([t for _, t, _ in got], -(-1_000_000 // rate), max(burst, 1))
    assert [t + w for _, t, w in got] == want


def test_a_rush_gets_the_burst_once(spark):
    df = spark.range(2000).select("id", F.lit("2024-01-01").cast("timestamp_ntz").alias("arrived_at"))
    plan = pacing.send_plan(df, Options(rate_per_sec=20.0, burst=10))
    assert plan.filter("wait_us = 0").count() == 10
    assert plan.agg(F.max("wait_us")).first()[0] == 1990 * 50_000
