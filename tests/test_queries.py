import pytest

import __spark_entry__ as entry_points
from compare import connect, difference
from promptscore.plans.oracle import all_oracles
from promptscore.plans.queries import all_queries

QUERIES = all_queries()
ORACLES = all_oracles()


@pytest.fixture(scope="session")
def db(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, folder, db, name):
    assert difference(QUERIES[name](spark, folder), db, ORACLES[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_known_totals_of_the_log(spark):
    """Totals of the folded event log at sf0.01, found independently by a row-at-a-time machine."""
    rows = QUERIES["prompt_state"](spark, "/root/testdata/sf0.01").groupBy("status").count().collect()
    assert {r[0]: r[1] for r in rows} == {"succeeded": 731, "failed": 530, "pending": 237}
    assert QUERIES["done_batches"](spark, "/root/testdata/sf0.01").count() == 21


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# queries that may run Python: those that call an endpoint, a model, or keep streaming state
PYTHON = {"rounds_end_to_end", "score_model"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON - {"stream_ingest", "stream_fold", "stream_redelivery", "stream_counts", "stream_completions"}))
def test_plan_is_free_of_python_and_pair_joins(spark, folder, name):
    plan = plan_of(QUERIES[name](spark, folder))
    for bad in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "RoundRobin", "SinglePartition"):
        if bad == "SinglePartition" and name in ("claim_due", "send_plan"):
            continue
        assert bad not in plan, f"{bad} in {name}"


def test_bodies_are_parsed_once(spark, folder):
    assert plan_of(QUERIES["request_rejects"](spark, folder)).count("parseJson") == 2  # one per part of the union
    assert plan_of(QUERIES["prompt_state"](spark, folder)).count("from_json") == 2  # the two wrappers


def test_scans_read_only_what_is_needed(spark, folder):
    plan = plan_of(QUERIES["validate_prompts"](spark, folder))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in plan
    plan = plan_of(QUERIES["visible_prompts"](spark, folder))
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan
    plan = plan_of(QUERIES["conversation_results"](spark, folder))
    assert "EqualTo(role,user)" in plan and "EqualTo(role,assistant)" in plan


def test_a_top_k_keeps_k_rows_per_task(spark, folder):
    assert "TakeOrderedAndProject(limit=16" in plan_of(QUERIES["claim_due"](spark, folder))
