import io
import json
import sys
import time
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from machine import replay
from promptscore import Options, new_work_dir
from promptscore.clock import ScriptedClock, SystemClock
from promptscore.operators import scoring
from promptscore.plans import rounds
from promptscore.sources import tables
from promptscore.sources.endpoint import http_transport

cloudpickle.register_pickle_by_value(sys.modules[__name__])

START = datetime(2024, 1, 1)
QUEUE = "prompt_id string, batch_id string, seq bigint, prompt_text string, attempts bigint, max_attempts int, next_retry_at timestamp_ntz"
SCRIPT = {
    0: ["success"] * 9, 1: ["transient"] * 9, 2: ["rate_limited"] * 9, 3: ["permanent"] * 9,
    4: ["transient", "rate_limited", "success"] * 3, 5: ["rate_limited", "transient", "transient", "transient", "transient", "success"] * 2,
}
REPLIES = {
    "success": scoring.Response(200, '{"completion":"ok"}'), "transient": scoring.Response(503, "busy"),
    "rate_limited": scoring.Response(429, "wait", "3"), "permanent": scoring.Response(400, "no"),
}


def transport(number):
    return lambda prompts: [REPLIES[SCRIPT[int(p) % 6][number - 1]] for p in prompts]


def queue(spark, n=30):
    rows = [(f"p{i}", f"b{i % 4}", i // 4, str(i), 0, 5, START) for i in range(n)]
    return spark.createDataFrame(rows, QUEUE)


MINUTES = Options(pool_size=3, poll_interval_ms=60_000)


def run(spark, root, max_rounds=None, make=transport, start=START, **kwargs):
    """Rounds at least a minute apart, so that everything pending is due in each."""
    return rounds.run_rounds(spark, queue(spark), MINUTES, make, root, ScriptedClock(start), max_rounds, **kwargs)


@pytest.mark.parametrize("max_rounds", [1, 4, 9])
def test_rounds_equal_state_machine(spark, max_rounds):
    final = run(spark, new_work_dir(spark, "t"), max_rounds).collect()
    got = {r.prompt_id: (r.status, r.attempts) for r in final}
    assert got == {f"p{i}": replay(SCRIPT[i % 6][:max_rounds], 5)[:2] for i in range(30)}
    for r in final:
        assert (r.response == "ok") == (r.status == "succeeded")


def test_each_prompt_is_called_once_per_round(spark):
    root = new_work_dir(spark, "t")
    run(spark, root, 4)
    log = rounds.attempt_log(spark, root)
    assert log.groupBy("prompt_id", "round").count().filter("count > 1").count() == 0
    assert log.filter("round = 1").count() == 30
    # a pool smaller than the cluster is the number of scoring tasks, whatever adaptive execution would prefer
    assert log.filter("round = 1").select("_metadata.file_name").distinct().count() == 3


def test_limit_takes_the_longest_waiting(spark):
    root = new_work_dir(spark, "t")
    final = run(spark, root, 3, make=lambda number: lambda prompts: [REPLIES["success"]] * len(prompts), limit=8)
    assert final.filter("status = 'succeeded'").count() == 24
    assert final.count() == 30
    first = {r.prompt_id for r in rounds.attempt_log(spark, root).filter("round = 1").collect()}
    assert first == {f"p{i}" for i in range(0, 30, 4)}


def test_a_prompt_is_not_claimed_before_its_time(spark):
    root = new_work_dir(spark, "t")
    options = Options(pool_size=2, poll_interval_ms=1_000)
    rounds.run_rounds(spark, queue(spark), options, transport, root, ScriptedClock(START), 3)
    log = rounds.attempt_log(spark, root)
    limited = log.filter("http_status = 429").groupBy("prompt_id").count()
    assert limited.agg(F.max("count")).first()[0] == 1  # asked to wait 3 s, rounds are 1 s apart


def once_limited(number):
    """Limited in the first round, answered later."""
    reply = scoring.Response(429, "wait", "2") if number == 1 else REPLIES["success"]
    return lambda prompts: [reply] * len(prompts)


def test_waits_are_kept_on_a_real_clock(spark):
    root = new_work_dir(spark, "t")
    final = rounds.run_rounds(spark, queue(spark, 4), Options(pool_size=2), once_limited, root, SystemClock()).collect()
    assert {r.status for r in final} == {"succeeded"} and {r.attempts for r in final} == {1}
    times = {(r.prompt_id, r.round): r.finished_at for r in rounds.attempt_log(spark, root).collect()}
    assert len(times) == 8
    for i in range(4):
        assert times[f"p{i}", 2] - times[f"p{i}", 1] >= timedelta(seconds=2)


def test_runs_until_every_prompt_is_settled(spark):
    final = run(spark, new_work_dir(spark, "t"), make=lambda number: transport(min(number, 9)) if number < 9 else
                lambda prompts: [REPLIES["success"]] * len(prompts))
    assert final.filter("status = 'pending'").count() == 0


def test_a_deadline_ends_a_run(spark):
    with pytest.warns(UserWarning, match="5 prompts pending"):
        final = rounds.run_rounds(spark, queue(spark, 5), MINUTES, lambda n: lambda prompts: [REPLIES["rate_limited"]] * len(prompts),
                                  new_work_dir(spark, "t"), ScriptedClock(START), deadline=START + timedelta(minutes=2))
    assert final.filter("status = 'pending'").count() == 5


def test_only_open_slices_are_abandoned(spark):
    root = new_work_dir(spark, "t")

    def dies_in_round_2(number):
        if number == 2:
            raise SystemError("executor lost")
        return transport(number)

    calls = []
    put = tables.put

    def put_until(df, path):
        if "/attempts/round=2/slice=1" in path:
            raise KeyboardInterrupt
        calls.append(path)
        put(df, path)

    run(spark, root, 1, slice_prompts=8)
    rounds.tables.put = put_until
    try:
        with pytest.raises(KeyboardInterrupt):
            run(spark, root, 2, slice_prompts=8)
    finally:
        rounds.tables.put = put
    final = run(spark, root, 2, make=dies_in_round_2, slice_prompts=8)  # round 2 makes no more calls
    log = rounds.attempt_log(spark, root).filter("round = 2")
    kept = {r.prompt_id for r in log.filter("http_status is not null").collect()}
    lost = {r.prompt_id for r in log.filter("http_status is null").collect()}
    assert kept and lost and not kept & lost
    want = {}
    for i in range(30):
        outcomes = list(SCRIPT[i % 6][:2])
        if f"p{i}" in lost:
            outcomes[1] = "abandoned"
        want[f"p{i}"] = replay(outcomes, 5)[:2]
    assert {r.prompt_id: (r.status, r.attempts) for r in final.collect()} == want


def test_interrupted_round_is_closed_and_not_called_again(spark):
    root = new_work_dir(spark, "t")
    run(spark, root, 1)
    # round 2 got as far as writing its claims
    active = tables.get(spark, f"{root}/active/round=1")
    at = F.lit("2024-01-01 00:01:00").cast("timestamp_ntz").alias("claimed_at")
    tables.put(active.select("prompt_id", "batch_id", at), f"{root}/claims/round=2")

    def no_call_in_round_2(number):
        assert number != 2
        return transport(number)

    # a clock that was set back does not change what round 2 had claimed
    final = run(spark, root, 6, make=no_call_in_round_2, start=START - timedelta(hours=1))
    want = {}
    for i in range(30):
        outcomes = list(SCRIPT[i % 6][:6])
        outcomes[1] = "abandoned"
        want[f"p{i}"] = replay(outcomes, 5)[:2]
    assert {r.prompt_id: (r.status, r.attempts) for r in final.collect()} == want


def test_fewer_rounds_on_the_same_root(spark):
    root = new_work_dir(spark, "t")
    run(spark, root, 5)
    early = run(spark, root, 2)
    assert {r.prompt_id: (r.status, r.attempts) for r in early.collect()} == {
        f"p{i}": replay(SCRIPT[i % 6][:2], 5)[:2] for i in range(30)}


def test_batches_are_finalized_in_the_round_that_completes_them(spark):
    root = new_work_dir(spark, "t")
    run(spark, root, make=lambda n: lambda prompts: [REPLIES["success" if int(p) % 4 < n else "rate_limited"] for p in prompts],
        documents=True)
    done = {r.batch_id: (r["round"], r.succeeded) for r in rounds.documents_of(spark, root).filter("n_results > 0").collect()}
    assert done == {"b0": (1, 8), "b1": (2, 8), "b2": (3, 7), "b3": (4, 7)}


def test_finished_rounds_are_not_repeated(spark):
    root = new_work_dir(spark, "t")
    run(spark, root, 3)

    def only_later(number):
        assert number > 3
        return transport(number)

    final = run(spark, root, 5, make=only_later)
    assert {r.prompt_id: (r.status, r.attempts) for r in final.collect()} == {
        f"p{i}": replay(SCRIPT[i % 6][:5], 5)[:2] for i in range(30)}


def test_failing_transport_marks_its_prompts(spark):
    def broken():
        def call(prompts):
            raise TimeoutError("timed out")
        return call

    claims = queue(spark, 5)
    got = scoring.score(claims, broken, pool_size=2).collect()
    assert [(r.http_status, r.transport_error) for r in got] == [(None, "timed out")] * 5
    assert all(r.finished_at is not None for r in got)


def test_transport_is_called_in_chunks_and_keeps_order(spark):
    def echo():
        return lambda prompts: [scoring.Response(200, f"{p}/{len(prompts)}") for p in prompts]

    got = scoring.score(queue(spark, 10).coalesce(1), echo, call_size=4).collect()
    assert [r.body for r in got] == [f"{i}/{4 if i < 8 else 2}" for i in range(10)]


class Reply(io.BytesIO):
    def __init__(self, status, body, headers=(), fails_after=None, drip=0):
        super().__init__(body)
        self.status, self.headers, self.fails_after, self.drip = status, dict(headers), fails_after, drip

    def read1(self, size):
        if self.fails_after is not None and self.tell() >= self.fails_after:
            raise ConnectionResetError("reset")
        time.sleep(self.drip)
        return super().read1(1 if self.drip else size if self.fails_after is None else min(size, self.fails_after))


class Connection:
    """Stands in for an HTTP connection; counts how often it is opened and used."""

    sock = None

    def __init__(self, replies, sent):
        self.replies, self.sent = replies, sent

    def request(self, method, target, body, headers):
        self.prompt = json.loads(body)["prompt"]
        self.sent.append((id(self), method, target, self.prompt, headers["Content-Type"]))

    def getresponse(self):
        reply = self.replies[self.prompt]()
        if isinstance(reply, Exception):
            raise reply
        return reply

    def close(self):
        pass


def connected(replies, sent=None, **kwargs):
    sent = [] if sent is None else sent
    opened = []

    def connect(timeout):
        opened.append(Connection(replies, sent))
        return opened[-1]

    return http_transport("http://endpoint.invalid/infer?v=1", Options(**kwargs), connect)(), opened


def test_http_transport_without_a_network():
    replies = {
        "ok": lambda: Reply(200, b'{"completion":"hi"}'),
        "limited": lambda: Reply(429, b"slow", {"Retry-After": "7"}),
        "down": lambda: OSError("refused"),
        "big": lambda: Reply(200, b"x" * ((1 << 20) + 50)),
    }
    sent = []
    call, opened = connected(replies, sent)
    ok, again, limited, down, big = call(["ok", "ok", "limited", "down", "big"])
    assert ok == again == scoring.Response(200, '{"completion":"hi"}', None)
    assert limited == scoring.Response(429, "slow", "7")
    assert down.status is None and "refused" in down.error
    assert len(big.body) == (1 << 20) + 1
    assert sent[0][1:] == ("POST", "/infer?v=1", "ok", "application/json")
    assert len(opened) == 2  # kept open until a call failed


def test_one_bad_body_is_one_bad_answer():
    replies = {"ok": lambda: Reply(200, b'{"completion":"hi"}'), "bad": lambda: Reply(500, b"part of it", fails_after=4)}
    answers = connected(replies)[0](["ok", "bad", "ok"])
    assert [a.status for a in answers] == [200, 500, 200]
    assert answers[1].body == "part" and answers[2].body == '{"completion":"hi"}'


def test_a_dripping_body_ends_at_the_deadline():
    replies = {"drip": lambda: Reply(200, b"x" * 1000, drip=0.05), "ok": lambda: Reply(200, b"{}")}
    begin = time.monotonic()
    slow, ok = connected(replies, request_timeout_ms=300)[0](["drip", "ok"])
    assert time.monotonic() - begin < 3
    assert slow == scoring.Response(error="timed out") and ok.status == 200


def test_a_closed_idle_connection_is_opened_again():
    tries = iter([Reply(200, b"{}"), ConnectionResetError("closed"), Reply(200, b"{}")])
    call, opened = connected({"p": lambda: next(tries)})
    assert [a.status for a in call(["p", "p"])] == [200, 200] and len(opened) == 2


def test_length_echo_counts_bytes(spark):
    df = spark.createDataFrame([("abc",), ("é€",)], "p string")
    assert [r[0] for r in df.select(scoring.length_echo(F.col("p"))).collect()] == [
        "mock completion for prompt of 3 chars", "mock completion for prompt of 5 chars"]
