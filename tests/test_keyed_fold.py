"""The streaming fold by keyed state: equal to the batch fold, and an epoch reads only what it touches."""

import sys

import pytest
from pyspark import cloudpickle

from machine import replay
from promptscore import Options, new_work_dir
from promptscore.operators import state as st
from promptscore.sources import tables
from promptscore.streaming import jobs
from test_streaming import SCHEMA, START, deliver, log_rows, random_logs

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.mark.parametrize("compact_every", [20, 2])
def test_keyed_fold_equals_batch_fold(spark, compact_every):
    root = new_work_dir(spark, "keyed")
    logs = random_logs(9, 120, 20)
    rows = sorted(log_rows(logs, START), key=lambda r: r[2])
    parts = [[r for r in rows if lo <= r[2] < hi] for lo, hi in ((0, 2), (2, 7), (7, 8), (8, 14), (14, 99))]
    parts[1] = parts[1] + parts[1][:40]  # some answers delivered twice
    parts[3] = parts[3] + parts[0][:25]  # early rounds delivered again, late
    run = lambda s: jobs.start(jobs.keyed_attempts(s), jobs.fold_touched(Options(), root, compact_every), f"{root}/check", mode="update")
    deliver(spark, root, parts, SCHEMA, run)
    newest = jobs.states_before(spark, root, 5, compact_every)
    assert {r.prompt_id: (r.status, r.attempts, r.last_round) for r in newest.collect()} == {k: replay(v, 5) for k, v in logs.items()}
    whole = st.prompt_state(spark.createDataFrame(rows, SCHEMA), Options())
    columns = sorted(whole.columns)
    assert sorted(newest.select(*columns).collect(), key=str) == sorted(whole.select(*columns).collect(), key=str)


def test_an_epoch_folds_only_the_prompts_it_touches(spark):
    root = new_work_dir(spark, "keyed")
    logs = random_logs(5, 60, 6)
    rows = log_rows(logs, START)
    ids = sorted({r[0] for r in rows})
    parts = [[r for r in rows if r[0] in ids[k::6]] for k in range(6)]  # every epoch new prompts, equal sizes
    fed = []

    def counting(batch, epoch):
        fed.append(batch.count())
        jobs.fold_touched(Options(), root)(batch, epoch)

    run = lambda s: jobs.start(jobs.keyed_attempts(s), counting, f"{root}/check", mode="update")
    deliver(spark, root, parts, SCHEMA, run)
    assert fed == [len(p) for p in parts]  # the last epoch folds as many rows as the first, not the whole log
    assert not tables.exists(spark, f"{root}/log")
