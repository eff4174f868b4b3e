"""Named queries over the test tables; each reads whole tables and returns flat columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptscore import schemas
from promptscore.clock import ScriptedClock
from promptscore.functions import outcomes as o
from promptscore.functions.backoff import ceiling_ms
from promptscore.operators import finalize, pacing, report, scoring, state, validate
from promptscore.options import Options
from promptscore.plans import rounds
from promptscore.session import configure, new_work_dir
from promptscore.sources import requests, standins, tables
from promptscore.streaming import jobs

DEFAULTS = Options()
SMALL = Options(max_batch_size=30)
ANY_LENGTH = Options(max_prompt_bytes=1 << 30)
BODIES = Options(max_batch_size=12, body_limit=40_000)
AS_OF = "2024-01-20 00:00:00"
CLAIM_SIZE = 16
PART_ROWS = 4
PACED = Options(poll_interval_ms=4_000)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    def prepared(spark: SparkSession, folder: str) -> DataFrame:
        return run(configure(spark), folder)

    _QUERIES[run.__name__] = prepared
    return run


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


# ---- ingest and validation --------------------------------------------------------------------


@query
def ingest_explode(spark, folder):
    parsed = requests.parse(standins.requests(spark, folder), DEFAULTS)
    prompts = requests.prompts_of(parsed, DEFAULTS, F.col("received_at"))
    return prompts.select("prompt_id", "batch_id", "seq", "prompt_text", "created_at")


@query
def request_triage(spark, folder):
    return requests.triage(requests.parse(standins.requests(spark, folder), BODIES))


@query
def request_rejects(spark, folder):
    return requests.rejects_of(requests.parse(standins.requests(spark, folder), BODIES))


@query
def trim_prompts(spark, folder):
    checked = validate.check_prompts(standins.document_prompts(spark, folder), DEFAULTS)
    return checked.select("batch_id", "seq", "prompt_text", F.octet_length("prompt_text").cast("bigint").alias("n_bytes"))


@query
def validate_prompts(spark, folder):
    checked = validate.check_prompts(standins.document_prompts(spark, folder), DEFAULTS)
    return checked.select("batch_id", "seq", "error_code")


@query
def validate_batches(spark, folder):
    return validate.batch_verdicts(standins.document_prompts(spark, folder), SMALL)


@query
def validate_known_batches(spark, folder):
    rows = standins.log_prompts(spark, folder)
    return validate.batch_verdicts(rows, DEFAULTS, standins.batches(spark, folder))


@query
def accepted_prompts(spark, folder):
    accepted = validate.accept_rows(standins.block_prompts(spark, folder), DEFAULTS)
    return accepted.select("batch_id", "seq", "prompt_text", "total_count")


@query
def accepted_by_source(spark, folder):
    """Batches that grow with the table, and prompts of any length."""
    accepted = validate.accept_rows(standins.document_prompts(spark, folder), ANY_LENGTH)
    return accepted.select("batch_id", "seq", "prompt_text", "total_count")


@query
def reject_report(spark, folder):
    verdicts = validate.batch_verdicts(standins.document_prompts(spark, folder), SMALL)
    return validate.reject_report(verdicts)


def _queue(spark, folder) -> DataFrame:
    accepted = validate.accept_rows(standins.block_prompts(spark, folder), DEFAULTS)
    return requests.queue_rows(accepted, DEFAULTS, _as_of())


@query
def enqueue_rows(spark, folder):
    return _queue(spark, folder)


# ---- scoring ----------------------------------------------------------------------------------


@query
def score_length_echo(spark, folder):
    documents = standins.read(spark, folder, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("item"), F.col("text").alias("prompt")
    )
    pages = standins.read(spark, folder, "pages").select(
        F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("item"), F.col("html").alias("prompt")
    )
    return documents.unionByName(pages).select("item", scoring.length_echo(F.col("prompt")).alias("response"))


def _linear_model():
    weights = (np.arange(64) * 37 % 64 - 31.5) / 64

    def predict(vectors: np.ndarray) -> np.ndarray:
        return vectors.astype(np.float64) @ weights

    return predict


@query
def score_model(spark, folder):
    predict = scoring.model_scorer(_linear_model, T.DoubleType(), batch_size=1024, input_shape=[64])
    vectors = standins.read(spark, folder, "embeddings")
    return vectors.select("vec_id", (F.round(predict("embedding"), 3) + 0.0).alias("score"))


def _scripted(number: int) -> scoring.Transport:
    def answer(prompt: str) -> scoring.Response:
        draw = hashlib.md5(f"{prompt}:{number}".encode()).digest()[0]
        if draw < 128:
            return scoring.Response(200, '{"completion":"scored in round %d"}' % number)
        if draw < 176:
            return scoring.Response(429, "slow down", "5")
        if draw < 240:
            return scoring.Response(503, "busy")
        return scoring.Response(400, "refused")

    return lambda prompts: [answer(p) for p in prompts]


@query
def rounds_end_to_end(spark, folder):
    """Until every prompt is settled: rounds are 4 s apart, and being limited asks for a wait of 5 s."""
    final = rounds.run_rounds(
        spark, _queue(spark, folder), PACED, _scripted, new_work_dir(spark, "rounds"), ScriptedClock(datetime(2024, 1, 20))
    )
    return final.select("prompt_id", "batch_id", "seq", "status", "attempts", "response", "error")


# ---- outcomes and retries ---------------------------------------------------------------------


def _log(spark, folder) -> DataFrame:
    return standins.attempt_log(spark, folder)


def _decided(spark, folder) -> DataFrame:
    return state.decide(_log(spark, folder), DEFAULTS)


@query
def classify_attempts(spark, folder):
    outcome = F.col("outcome")
    return o.classify(_log(spark, folder)).select(
        "prompt_id",
        "round",
        "outcome",
        outcome.isin(o.RATE_LIMITED, o.TRANSIENT).alias("retryable"),
        (outcome == o.RATE_LIMITED).alias("rate_limited"),
    )


@query
def decode_completion(spark, folder):
    answered = _log(spark, folder).filter("http_status = 200")
    decoded = o.decode_completions(answered, F.lit(True))
    text = F.col("response")
    return decoded.select("prompt_id", "round", text.alias("completion"), text.isNotNull().alias("decoded"))


@query
def retry_after(spark, folder):
    limited = _log(spark, folder).filter("http_status = 429")
    hint = o.retry_after_ms(F.coalesce("retry_after", F.lit("")), F.col("finished_at"))
    return limited.select("prompt_id", "round", "retry_after", hint.alias("retry_after_ms"))


@query
def error_messages(spark, folder):
    answers = _log(spark, folder).unionByName(standins.document_answers(spark, folder))
    return o.classify(answers).select("prompt_id", "round", "error")


@query
def backoff_bounds(spark, folder):
    decided = _decided(spark, folder).filter("decision = 'requeue'")
    hinted = F.col("retry_after_ms") > 0
    hint = F.least("retry_after_ms", F.lit(DEFAULTS.max_backoff_ms).cast("bigint"))
    return decided.select(
        "prompt_id",
        "round",
        "attempt",
        F.when(hinted, hint).otherwise(F.lit(DEFAULTS.base_backoff_ms).cast("bigint")).alias("low_ms"),
        F.when(hinted, hint).otherwise(ceiling_ms(F.col("attempt"), DEFAULTS)).alias("high_ms"),
    )


@query
def retry_schedule(spark, folder):
    decided = _decided(spark, folder).filter("decision = 'requeue'")
    return decided.select("prompt_id", "round", "delay_ms", "next_retry_at")


@query
def decide_attempts(spark, folder):
    return _decided(spark, folder).select("prompt_id", "round", "outcome", "attempt", "decision", "live")


@query
def dedupe_attempts(spark, folder):
    log = _log(spark, folder)
    again = log.withColumn("finished_at", F.col("finished_at") + F.expr("interval 1 second"))
    kept = state.dedupe(again.unionByName(log))
    return kept.select("prompt_id", "round", "finished_at", "http_status", "body", "transport_error")


@query
def prompt_state(spark, folder):
    return state.prompt_state(_log(spark, folder), DEFAULTS)


@query
def claim_due(spark, folder):
    claimed = state.claim(state.prompt_state(_log(spark, folder), DEFAULTS), _as_of(), CLAIM_SIZE)
    return claimed.select("prompt_id", "batch_id", "status", "attempts", "next_retry_at")


@query
def due_prompts(spark, folder):
    claimed = state.claim(state.prompt_state(_log(spark, folder), DEFAULTS), _as_of())
    return claimed.select("prompt_id", "batch_id", "status", "attempts", "next_retry_at")


@query
def recovery_counts(spark, folder):
    return report.recovery_counts(_decided(spark, folder))


@query
def unanswered_claims(spark, folder):
    """Claims of the whole log against its answered rows give back exactly the abandoned attempts."""
    log = _log(spark, folder)
    claims = log.select("prompt_id", "batch_id", "round")
    answered = log.filter("http_status is not null or transport_error is not null")
    lost = state.abandoned(claims, answered, _as_of())
    return o.classify(lost).select("prompt_id", "batch_id", "round", "finished_at", "outcome")


# ---- batches and results ----------------------------------------------------------------------


def _full_state(spark, folder) -> DataFrame:
    """State of the log's prompts with their queue columns."""
    folded = state.prompt_state(_log(spark, folder), DEFAULTS).drop("batch_id")
    return standins.log_prompts(spark, folder).join(folded, "prompt_id")


def _log_state(spark, folder) -> DataFrame:
    return state.prompt_state(_log(spark, folder), DEFAULTS)


@query
def queue_with_state(spark, folder):
    queue = requests.queue_rows(standins.log_prompts(spark, folder), DEFAULTS, F.col("created_at"))
    queue = queue.withColumn("prompt_id", F.concat("batch_id", F.col("seq").cast("string")).cast("bigint").cast("string"))
    users = standins.read(spark, folder, "customer").select(
        F.concat(F.lit("new"), F.col("c_custkey").cast("string")).alias("batch_id"),
        F.lit(0).cast("bigint").alias("seq"),
        F.col("c_custkey").cast("string").alias("prompt_text"),
    )
    queue = queue.unionByName(requests.queue_rows(users, DEFAULTS, _as_of()))
    merged = state.with_unclaimed(queue, _log_state(spark, folder))
    return merged.select("prompt_id", "batch_id", "seq", "status", "attempts", "response", "error", "next_retry_at")


@query
def batch_counts(spark, folder):
    return finalize.batch_counts(_log_state(spark, folder))


@query
def done_batches(spark, folder):
    counts = finalize.batch_counts(_log_state(spark, folder)).filter("done")
    return counts.select("batch_id", "total", "succeeded", "failed")


@query
def succeeded_prompts(spark, folder):
    rows = finalize.succeeded_prompts(_full_state(spark, folder))
    return rows.select("prompt_id", "batch_id", "seq", "prompt_text", "response", "attempts")


def _documents(spark, folder) -> DataFrame:
    completed = standins.completed_batches(spark, folder)
    return finalize.result_documents(_full_state(spark, folder), _as_of(), DEFAULTS, completed, PART_ROWS)


@query
def finalize_once(spark, folder):
    return _documents(spark, folder).select(
        "batch_id",
        F.lit("completed").alias("status"),
        F.col("part").cast("bigint").alias("part"),
        "total",
        "succeeded",
        "failed",
        F.col("n_results").cast("bigint").alias("n_results"),
        F.col("generated_at").alias("completed_at"),
    )


_DOCUMENT = (
    "batch_id string, total bigint, succeeded bigint, failed bigint, generated_at string, "
    "results array<struct<prompt_id:string,seq:bigint,prompt:string,response:string>>"
)


@query
def result_rows(spark, folder):
    """Read back from the JSON text of the documents."""
    docs = _documents(spark, folder).select(F.from_json("result", _DOCUMENT).alias("d"))
    rows = docs.select("d.batch_id", "d.total", "d.generated_at", F.explode("d.results").alias("r"))
    return rows.select("batch_id", "total", "generated_at", "r.seq", "r.prompt_id", "r.prompt", "r.response")


def _digest(documents: DataFrame) -> DataFrame:
    entry = lambda r: F.concat_ws(":", r["seq"].cast("string"), F.md5(r["prompt"]), F.md5(r["response"]))
    parsed = documents.withColumn("results", F.from_json("result", _DOCUMENT)["results"])
    return parsed.select(
        "batch_id",
        "part",
        "total",
        "succeeded",
        "failed",
        F.size("results").cast("bigint").alias("n_results"),
        F.md5(F.array_join(F.transform("results", entry), "|")).alias("digest"),
    )


@query
def result_digest(spark, folder):
    return _digest(_documents(spark, folder))


@query
def conversation_results(spark, folder):
    state_rows = standins.conversation_state(spark, folder)
    return _digest(finalize.result_documents(state_rows, _as_of(), DEFAULTS))


@query
def batch_status(spark, folder):
    return report.batch_status(
        standins.batches(spark, folder), _log_state(spark, folder), standins.completed_batches(spark, folder)
    )


@query
def status_with_result(spark, folder):
    """The status view right after a run, with the documents it wrote."""
    completed = finalize.completed_of(_documents(spark, folder))
    view = report.batch_status(standins.batches(spark, folder), _log_state(spark, folder), completed)
    results = F.from_json("result", _DOCUMENT)["results"]
    return view.select(
        "batch_id",
        "status",
        "total",
        "succeeded",
        "failed",
        "completed_at",
        "parts",
        F.size(results).cast("bigint").alias("n_results"),
    ).withColumn("n_results", F.when(F.col("parts").isNotNull(), F.col("n_results")))


@query
def batch_lookup(spark, folder):
    view = validate.batch_verdicts(standins.document_prompts(spark, folder), DEFAULTS).select(
        requests.stable_uuid(F.col("batch_id")).alias("batch_id"), "total_count", "error_code"
    )
    found = report.batch_lookup(standins.lookup_ids(spark, folder), view)
    return found.select("id", "batch_id", "lookup_status", "total_count", "error_code")


@query
def orphan_prompts(spark, folder):
    orphans = report.orphan_prompts(standins.log_prompts(spark, folder), standins.open_batches(spark, folder))
    return orphans.select("prompt_id", "batch_id", "seq")


@query
def visible_prompts(spark, folder):
    visible = report.visible_prompts(standins.log_prompts(spark, folder), standins.open_batches(spark, folder))
    return visible.select("prompt_id", "batch_id", "seq")


@query
def purge_batches(spark, folder):
    kept = report.purge(standins.log_prompts(spark, folder), standins.purge_list(spark, folder))
    return kept.select("prompt_id", "batch_id", "seq")


@query
def attempt_metrics(spark, folder):
    return report.attempt_metrics(_decided(spark, folder))


@query
def attempt_gaps(spark, folder):
    return report.attempt_gaps(_decided(spark, folder))


@query
def send_plan(spark, folder):
    arrivals = standins.read(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("arrived_at")
    )
    return pacing.send_plan(arrivals, Options(rate_per_sec=0.004, burst=3))


# ---- streaming --------------------------------------------------------------------------------


FILES_PER_BATCH = 4


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(path)


def _run(started) -> None:
    started.awaitTermination()


@query
def stream_ingest(spark, folder):
    root = new_work_dir(spark, "ingest")
    tables.put(standins.requests(spark, folder), f"{root}/requests")
    _run(jobs.ingest(_stream(spark, f"{root}/requests", schemas.REQUESTS), DEFAULTS, root, f"{root}/checkpoint"))
    prompts = jobs.epochs(spark, f"{root}/prompts")
    return prompts.select("prompt_id", "batch_id", "seq", "prompt_text", "created_at")


def _settled(spark, folder) -> DataFrame:
    """Settled prompts with the size of their batch, the input of the counting streams."""
    full = _log_state(spark, folder)
    totals = full.groupBy("batch_id").agg(F.count("*").alias("total_count"))
    settled = full.filter("status <> 'pending'").join(totals, "batch_id")
    return settled.select("prompt_id", "batch_id", "status", "total_count")


@query
def stream_counts(spark, folder):
    root = new_work_dir(spark, "counts")
    tables.put(_settled(spark, folder), f"{root}/settled")
    counted = jobs.live_counts(_stream(spark, f"{root}/settled", schemas.SETTLED).select("prompt_id", "batch_id", "status"))
    _run(jobs.start(counted, jobs.write_counts(root), f"{root}/checkpoint", mode="update"))
    return jobs.latest_counts(spark, root)


@query
def stream_completions(spark, folder):
    root = new_work_dir(spark, "completions")
    tables.put(_settled(spark, folder), f"{root}/settled")
    found = jobs.completions(_stream(spark, f"{root}/settled", schemas.SETTLED))
    _run(jobs.start(found, jobs.write_completions(root), f"{root}/checkpoint", mode="update"))
    return jobs.epochs(spark, f"{root}/completed").drop("epoch")


def _folded_stream(spark, folder, label, parts) -> DataFrame:
    """The log in deliveries, each one micro-batch; ``parts`` gives their row filters from the round cuts."""
    root = new_work_dir(spark, label)
    log = _log(spark, folder)
    first, last = log.agg(F.min("round"), F.max("round")).first()
    cuts = [first + (last + 1 - first) * k // 6 for k in range(7)]
    for k, (low, high) in enumerate(parts):
        tables.put(log.filter((F.col("round") >= cuts[low]) & (F.col("round") < cuts[high])), f"{root}/log-in/part-{k}")
        delivered = spark.readStream.schema(schemas.ATTEMPTS).parquet(f"{root}/log-in/*")
        _run(jobs.start(delivered, jobs.fold_epochs(DEFAULTS, root), f"{root}/checkpoint"))
    return jobs.states_before(spark, root, len(parts), 20)


@query
def stream_fold(spark, folder):
    """Three deliveries of rising rounds."""
    return _folded_stream(spark, folder, "fold", [(0, 2), (2, 4), (4, 6)])


@query
def stream_redelivery(spark, folder):
    """Deliveries that overlap, and earlier rounds that come after later ones, must fold to the same state."""
    return _folded_stream(spark, folder, "redelivery", [(2, 4), (0, 3), (3, 6)])


# ---- flagship ---------------------------------------------------------------------------------


@query
def scored_batches(spark, folder):
    """Documents to validated prompts, scored without Python, to per-batch status."""
    accepted = validate.accept_rows(standins.block_prompts(spark, folder), DEFAULTS)
    scored = accepted.select(
        "batch_id",
        F.lit("succeeded").alias("status"),
        F.octet_length(scoring.length_echo(F.col("prompt_text"))).cast("bigint").alias("n_bytes"),
    )
    size = F.sum("n_bytes").cast("bigint").alias("response_bytes")
    counts = finalize.batch_counts(scored, size)
    return counts.select("batch_id", "total", "succeeded", "failed", "done", "response_bytes")
