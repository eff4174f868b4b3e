"""Rounds cut off and resumed with other slice sizes: every prompt once, answers already received kept."""

import shutil
import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle

from promptscore import Options, new_work_dir
from promptscore.clock import ScriptedClock
from promptscore.operators import scoring
from promptscore.plans import rounds
from promptscore.sources import tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])

START = datetime(2024, 1, 1)
QUEUE = "prompt_id string, batch_id string, seq bigint, prompt_text string, attempts bigint, max_attempts int, next_retry_at timestamp_ntz"
OPTIONS = Options(pool_size=3, poll_interval_ms=60_000)
OK, BUSY = scoring.Response(200, '{"completion":"ok"}'), scoring.Response(503, "busy")


def queue(spark, n):
    return spark.createDataFrame([(f"p{i}", f"b{i % 3}", i // 3, str(i), 0, 5, START) for i in range(n)], QUEUE)


def answer(number):
    return lambda prompts: [OK if number > 1 or int(p) % 2 else BUSY for p in prompts]


def run(spark, root, n, max_rounds, slice_prompts, make=answer):
    return rounds.run_rounds(spark, queue(spark, n), OPTIONS, make, root, ScriptedClock(START), max_rounds, slice_prompts=slice_prompts)


def crash_at_slice(spark, root, n, slice_prompts, slice_number):
    """Runs round 1 and stops it when slice ``slice_number`` is about to be closed."""
    close = rounds._close

    def stop(spark_, folder):
        if folder.endswith(f"slice={slice_number}"):
            raise KeyboardInterrupt
        close(spark_, folder)

    rounds._close = stop
    try:
        with pytest.raises(KeyboardInterrupt):
            run(spark, root, n, 1, slice_prompts)
    finally:
        rounds._close = close


@pytest.mark.parametrize("again", [3, 20, 1000])
def test_resume_with_another_slice_size_gives_every_prompt_once(spark, again):
    root = new_work_dir(spark, "resume")
    crash_at_slice(spark, root, 40, 10, 2)
    final = run(spark, root, 40, 1, again)
    ids = [r.prompt_id for r in final.collect()]
    assert sorted(ids) == sorted(f"p{i}" for i in range(40))
    log = rounds.attempt_log(spark, root).filter("round = 1")
    assert log.select("prompt_id").distinct().count() == 40
    assert tables.get(spark, f"{root}/slices/round=1").first().slices == 4


def test_answers_received_before_a_crash_are_kept(spark):
    root = new_work_dir(spark, "resume")
    crash_at_slice(spark, root, 40, 10, 1)

    def no_calls(number):
        raise AssertionError("a resumed round makes no calls")

    run(spark, root, 40, 1, 7, make=no_calls)
    log = rounds.attempt_log(spark, root).filter("round = 1")
    answered = {r.prompt_id for r in log.filter("http_status is not null").collect()}
    slices = {r.prompt_id: r.slice for r in tables.get(spark, f"{root}/leases/round=1").select("prompt_id", "slice").collect()}
    assert log.count() == 40
    # slices 0 and 1 had been called: all their answers are there; 2 and 3 are closed unanswered
    assert answered == {p for p, k in slices.items() if k in (0, 1)}
    assert set(slices.values()) == {0, 1, 2, 3}


def test_a_slice_reads_only_its_own_leases(spark):
    root = new_work_dir(spark, "resume")
    run(spark, root, 40, 1, 10)
    schema = tables.get(spark, f"{root}/leases/round=1").drop("slice").schema
    for k in range(4):
        files = rounds._lease(spark, f"{root}/leases/round=1", k, schema).inputFiles()
        assert files and all(f"/slice={k}/" in f for f in files)


def test_an_answer_logged_twice_counts_once(spark):
    root = new_work_dir(spark, "resume")
    crash_at_slice(spark, root, 20, 10, 1)
    folder = f"{root}/attempts/round=1/slice=1"
    first = next(f for f in tables.get(spark, folder).inputFiles())
    path = first.split(":", 1)[1] if first.startswith("file:") else first
    shutil.copy(path.replace("///", "/"), path.replace("///", "/").replace("part-", "part-again-"))  # a task run twice
    final = run(spark, root, 20, 2, 10)
    assert sorted(r.prompt_id for r in final.collect()) == sorted(f"p{i}" for i in range(20))
    assert {r.attempts for r in final.collect()} <= {1, 2}
