"""Bodies to documents through the tables, as a user would run it."""

import json
import sys
from datetime import datetime

from pyspark import cloudpickle
from pyspark.sql import functions as F

from promptscore import Options, new_work_dir
from promptscore.clock import ScriptedClock
from promptscore.operators import finalize, report, scoring
from promptscore.plans import rounds
from promptscore.sources import requests, tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def flaky(number):
    """Every prompt is limited once, then answered; prompts with 'bad' in them are refused."""

    def answer(prompt):
        if "bad" in prompt:
            return scoring.Response(422, "refused")
        if number == 1:
            return scoring.Response(429, "", "1")
        return scoring.Response(200, json.dumps({"completion": prompt.upper()}))

    return lambda prompts: [answer(p) for p in prompts]


def test_bodies_to_documents(spark, tmp_path):
    start = datetime(2024, 1, 1)
    source = tmp_path / "bodies"
    source.mkdir()
    for name, body in {"a": '[" one ", "two", "bad one"]', "b": '["três"]', "c": '["x", " "]', "d": '["bad"]'}.items():
        (source / name).write_text(body)
    root, options = new_work_dir(spark, "t"), Options(pool_size=2)
    bodies = requests.from_files(spark.read, str(source)).withColumn("received_at", F.lit(start))
    bodies = bodies.withColumn("received_at", F.col("received_at").cast("timestamp_ntz"))
    requests.store(bodies, options, root, "delivery=1")
    batches, prompts = tables.get(spark, f"{root}/batches"), tables.get(spark, f"{root}/prompts")
    assert report.visible_prompts(prompts, batches).count() == prompts.count() == 5

    state = rounds.run_rounds(spark, prompts, options, flaky, root, ScriptedClock(start))
    tables.put(state, f"{root}/state")
    state = tables.get(spark, f"{root}/state")
    as_of = F.lit("2024-01-02").cast("timestamp_ntz")
    documents = finalize.result_documents(state, as_of, options)
    tables.put_results(documents, root, "run=1")
    results = tables.get(spark, f"{root}/results")
    assert finalize.result_documents(state, as_of, options, results).count() == 0

    found = [json.loads(r.result) for r in results.collect()]
    answers = sorted((d["total"], d["succeeded"], d["failed"], [r["response"] for r in d["results"]]) for d in found)
    assert answers == [(1, 0, 1, []), (1, 1, 0, ["TRÊS"]), (3, 2, 1, ["ONE", "TWO"])]

    completed = results.select("batch_id", F.col("generated_at").alias("completed_at"))
    view = report.batch_status(batches, state, completed).collect()
    assert {r.status for r in view} == {"completed"} and len(view) == 3
    assert all(r.total == r.total_count for r in view)  # counted prompts agree with the acknowledged number
    assert {r.attempts for r in state.collect()} == {1}  # being limited used up no budget

    left = report.purge(prompts, batches.limit(1))
    assert report.orphan_prompts(left, batches).count() == 0 and left.count() < 5
