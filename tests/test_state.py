import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from machine import SCHEMA, log_rows, replay
from promptscore import Options
from promptscore.operators import state as st

START = datetime(2024, 1, 1)
DEFAULTS = Options()


def make_log(spark, logs):
    return spark.createDataFrame(list(log_rows(logs, START)), SCHEMA)


def folded(df):
    return {r.prompt_id: (r.status, r.attempts, r.last_round) for r in df.collect()}


VECTORS = [
    (["success"], "succeeded", 1),
    (["transient"] * 4 + ["success"], "succeeded", 5),
    (["transient"] * 5, "failed", 5),
    (["rate_limited"] * 20, "pending", 0),
    (["rate_limited"] * 20 + ["success"], "succeeded", 1),
    (["transient"] * 4 + ["rate_limited", "transient"], "failed", 5),
    (["abandoned"] * 5, "pending", 5),
    (["abandoned"] * 5 + ["transient"], "failed", 6),
    (["abandoned"] * 5 + ["success"], "succeeded", 6),
    (["permanent", "success"], "failed", 1),
]


@pytest.mark.parametrize("span", [1 << 20, 3])
def test_vectors(spark, span):
    logs = {f"b-{i}": outcomes for i, (outcomes, _, _) in enumerate(VECTORS)}
    got = folded(st.prompt_state(make_log(spark, logs), DEFAULTS, span=span))
    assert {k: v[:2] for k, v in got.items()} == {f"b-{i}": (s, a) for i, (_, s, a) in enumerate(VECTORS)}


def random_logs(seed, prompts, longest):
    rng = random.Random(seed)
    kinds = ["success", "permanent", "rate_limited", "transient", "abandoned"]
    weights = [1, 1, 6, 4, 3]
    return {
        f"b{i % 7}-{i}": rng.choices(kinds, weights, k=rng.randint(1, longest)) for i in range(prompts)
    }


@pytest.mark.parametrize("span", [1 << 20, 1, 4, 7])
def test_fold_equals_state_machine(spark, span):
    logs = random_logs(7, 400, 30)
    got = folded(st.prompt_state(make_log(spark, logs), DEFAULTS, span=span))
    assert got == {k: replay(v, 5) for k, v in logs.items()}


@pytest.mark.parametrize("span", [1 << 20, 5])
def test_one_prompt_holding_most_of_the_log(spark, span):
    logs = random_logs(3, 30, 10)
    logs["b0-hot"] = ["rate_limited"] * 900 + ["transient", "abandoned"] * 3 + ["success"] * 50
    got = folded(st.prompt_state(make_log(spark, logs), DEFAULTS, span=span))
    assert got == {k: replay(v, 5) for k, v in logs.items()}


@pytest.mark.parametrize("span", [1 << 20, 4])
def test_live_rows_and_decisions(spark, span):
    logs = random_logs(11, 200, 20)
    decided = st.decide(make_log(spark, logs), DEFAULTS, span=span)
    for row in decided.groupBy("prompt_id").agg(F.count_if("live").alias("n"), F.max(F.when(F.col("live"), F.col("round"))).alias("m")).collect():
        last = replay(logs[row.prompt_id], 5)[2]
        assert (row.n, row.m) == (last + 1, last)


@pytest.mark.parametrize("span", [1 << 20, 3])
def test_folding_in_parts_equals_folding_at_once(spark, span):
    logs = random_logs(5, 300, 24)
    log = make_log(spark, logs)
    whole = st.prompt_state(log, DEFAULTS)
    first = st.prompt_state(log.filter("round < 6"), DEFAULTS, span=span)
    second = st.prompt_state(log.filter("round >= 6"), DEFAULTS, span=span, prior=first)
    untouched = first.join(second, "prompt_id", "left_anti")
    both = untouched.unionByName(second)
    columns = sorted(whole.columns)
    assert sorted(both.select(*columns).collect(), key=str) == sorted(whole.select(*columns).collect(), key=str)


def test_budget_may_come_with_the_log(spark):
    log = make_log(spark, {"b-a": ["transient"] * 3, "b-b": ["transient"] * 3})
    log = log.withColumn("max_attempts", F.when(F.col("prompt_id") == "b-a", 2).otherwise(9))
    assert folded(st.prompt_state(log, DEFAULTS)) == {"b-a": ("failed", 2, 1), "b-b": ("pending", 3, 2)}


def test_error_and_retry_time_survive_an_unanswered_attempt(spark):
    row = st.prompt_state(make_log(spark, {"b-a": ["transient", "abandoned"]}), DEFAULTS).first()
    assert row.error == "retryable: server error (503): busy"
    assert row.next_retry_at == START + timedelta(milliseconds=250)
    row = st.prompt_state(make_log(spark, {"b-a": ["transient", "success"]}), DEFAULTS).first()
    assert row.error is None and row.response == "done"


@pytest.mark.parametrize(
    "attempts, outcome, status, after",
    [(5, "rate_limited", "pending", 4), (2, "transient", "pending", 2), (5, "transient", "failed", 5), (1, "permanent", "failed", 1)],
)
def test_decisions_at_the_budget(spark, attempts, outcome, status, after):
    logs = {"b-a": ["transient"] * (attempts - 1) + [outcome]}
    row = st.prompt_state(make_log(spark, logs), Options(base_backoff_ms=10, max_backoff_ms=100)).first()
    assert (row.status, row.attempts) == (status, after)
    if status == "pending":
        wait = row.next_retry_at - (START + timedelta(minutes=attempts - 1))
        assert timedelta(milliseconds=10) <= wait <= timedelta(milliseconds=100)


def test_claim_order_limit_and_count(spark):
    rows = [("p1", "b", 0, "pending", 0, START), ("p2", "b", 1, "pending", 2, START + timedelta(hours=2)),
            ("p3", "a", 5, "pending", 1, START), ("p4", "a", 1, "failed", 5, START), ("p5", "c", 0, "pending", 0, None)]
    state = spark.createDataFrame(
        rows, "prompt_id string, batch_id string, seq bigint, status string, attempts bigint, next_retry_at timestamp_ntz")
    as_of = F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")
    got = st.claim(state, as_of, 2).collect()
    assert [(r.prompt_id, r.status, r.attempts) for r in got] == [("p5", "processing", 1), ("p3", "processing", 2)]
    assert {r.prompt_id for r in st.claim(state, as_of).collect()} == {"p1", "p3", "p5"}


def test_abandoned_rows_are_claims_without_answer(spark):
    claims = spark.createDataFrame([("a", "b", 1), ("c", "b", 1), ("a", "b", 2)], "prompt_id string, batch_id string, round bigint")
    answered = spark.createDataFrame([("a", 1)], "prompt_id string, round bigint")
    lost = st.abandoned(claims, answered, F.lit("2024-01-01").cast("timestamp_ntz")).collect()
    assert {(r.prompt_id, r.round, r.http_status) for r in lost} == {("c", 1, None), ("a", 2, None)}


def test_dedupe_keeps_earliest(spark):
    log = make_log(spark, {"b-a": ["transient", "success"]})
    late = log.withColumn("finished_at", F.col("finished_at") + F.expr("interval 1 hour")).withColumn("http_status", F.lit(400))
    kept = st.dedupe(late.unionByName(log)).orderBy("round").collect()
    assert [r.http_status for r in kept] == [503, 200]


def test_unclaimed_prompts_keep_their_defaults(spark):
    queue = spark.createDataFrame(
        [("b-a", "b", "pending", 0, START), ("b-z", "b", "pending", 0, START)],
        "prompt_id string, batch_id string, status string, attempts bigint, next_retry_at timestamp_ntz")
    merged = st.with_unclaimed(queue, st.prompt_state(make_log(spark, {"b-a": ["success"]}), DEFAULTS))
    assert {(r.prompt_id, r.status, r.attempts) for r in merged.collect()} == {("b-a", "succeeded", 1), ("b-z", "pending", 0)}
