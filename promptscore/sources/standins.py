"""Requests, prompts, attempt logs and batches derived by Spark from the general test tables.

Each function reads a whole table; groups gathered into one row are bounded by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptscore.functions.ids import stable_uuid

DOCS_PER_BODY = 25
DOCS_PER_BLOCK = 1000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """One prompt per document, a batch per source and language; some padded, some blank."""
    key, text = F.col("doc_id"), F.col("text")
    raw = (
        F.when(key % 97 == 0, F.lit("  \n"))
        .when(key % 7 == 0, F.concat(F.lit("  \t"), text, F.lit("　\n")))
        .otherwise(text)
    )
    return read(spark, folder, "documents").select(
        F.concat_ws("/", "source", "lang").alias("batch_id"), key.alias("seq"), raw.alias("prompt_text")
    )


def block_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The same prompts in a batch per source, language and block of documents, so that the share of
    accepted batches does not depend on the table's size."""
    rows = document_prompts(spark, folder)
    block = F.floor(F.col("seq") / F.lit(DOCS_PER_BLOCK)).cast("string")
    return rows.withColumn("batch_id", F.concat_ws("/", "batch_id", block))


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Request bodies: one of several forms per event, and arrays of up to 25 whole documents."""
    kind, key = F.col("event_type"), F.col("event_id").cast("string")
    body = (
        F.when(kind == "view", F.col("props"))
        .when(kind == "signup", F.concat(F.lit('["sign up '), key, F.lit('", " \\t'), F.col("user_id").cast("string"), F.lit('\\n"]')))
        .when(kind == "error", F.concat(F.lit('["error '), key, F.lit('", null]')))
        .when(kind == "click", F.concat(F.lit('["click", '), F.col("value").cast("string"), F.lit("]")))
        .when(F.col("event_id") % 4 == 0, F.lit("[]"))
        .when(F.col("event_id") % 4 == 1, F.lit(" null"))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit('["cut off '), key))
        .otherwise(F.concat(F.lit('["trailing '), key, F.lit('"] and more')))
    )
    from_events = read(spark, folder, "events").select(
        F.concat(F.lit("e"), key).alias("request_id"), body.alias("body"), F.col("ts").alias("received_at")
    )
    group = F.floor(F.col("doc_id") / F.lit(DOCS_PER_BODY))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda d: d["text"])
    from_documents = (
        read(spark, folder, "documents")
        .groupBy(group.alias("g"), "lang")
        .agg(F.to_json(texts).alias("body"))
        .select(
            F.concat_ws("-", F.lit("d"), F.col("g").cast("string"), "lang").alias("request_id"),
            "body",
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("received_at"),
        )
    )
    return from_events.unionByName(from_documents)


def attempt_log(spark: SparkSession, folder: str) -> DataFrame:
    """Attempt log from events: ten prompts per user, the event id as the round."""
    kind, key = F.col("event_type"), F.col("event_id")
    unanswered = (kind == "click") & (key % 11 == 0)
    status = (
        F.when(kind == "view", 200)
        .when(kind == "signup", 429)
        .when(kind == "error", 503)
        .when(kind == "purchase", F.when((key % 3 == 1) & (key % 11 == 1), 400).otherwise(502))
    )
    seconds = F.floor("value")
    later = F.date_format(
        F.col("ts") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")), "EEE, dd MMM yyyy HH:mm:ss 'GMT'"
    )
    hint = F.when(kind == "signup", F.when(key % 3 == 0, seconds.cast("string")).when(key % 3 == 1, later))
    body = (
        F.when(key % 7 == 2, F.lit("not json"))
        .when(key % 7 == 3, F.lit('{"completion":5}'))
        .when(key % 7 == 4, F.col("props"))
        .otherwise(F.concat(F.lit('{"completion":"c'), key.cast("string"), F.lit('"}')))
    )
    return read(spark, folder, "events").select(
        (F.col("user_id") * 10 + key % 10).cast("string").alias("prompt_id"),
        F.col("user_id").cast("string").alias("batch_id"),
        key.alias("round"),
        F.col("ts").alias("finished_at"),
        status.alias("http_status"),
        hint.alias("retry_after"),
        F.when(kind != "click", body).alias("body"),
        F.when((kind == "click") & ~unanswered, F.lit("timeout")).alias("transport_error"),
    )


def log_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The prompts the attempt log refers to."""
    digit = F.col("event_id") % 10
    return (
        read(spark, folder, "events")
        .groupBy("user_id", digit.alias("seq"))
        .agg(F.min("ts").alias("created_at"))
        .select(
            (F.col("user_id") * 10 + F.col("seq")).cast("string").alias("prompt_id"),
            F.col("user_id").cast("string").alias("batch_id"),
            "seq",
            F.concat_ws(" ", F.lit("user"), F.col("user_id").cast("string"), F.lit("asks"), F.col("seq").cast("string")).alias(
                "prompt_text"
            ),
            "created_at",
        )
    )


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """A batch per customer; users without a customer have prompts but no batch."""
    return read(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("batch_id"),
        F.lit("pending").alias("status"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
    )


def open_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of all segments but one, whose prompts are then orphans."""
    customers = read(spark, folder, "customer").filter(F.col("c_mktsegment") != "MACHINERY")
    return customers.select(F.col("c_custkey").cast("string").alias("batch_id"))


def completed_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches that an earlier run has completed: one market segment."""
    return (
        read(spark, folder, "customer")
        .filter(F.col("c_mktsegment") == "BUILDING")
        .select(
            F.col("c_custkey").cast("string").alias("batch_id"),
            F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("completed_at"),
        )
    )


def purge_list(spark: SparkSession, folder: str) -> DataFrame:
    """Batches to delete: customers in debt."""
    return (
        read(spark, folder, "customer")
        .filter(F.col("c_acctbal") < 0)
        .select(F.col("c_custkey").cast("string").alias("batch_id"))
    )


def conversation_state(spark: SparkSession, folder: str) -> DataFrame:
    """User turns as prompts, the turn after it as the response when the assistant gave it.

    A turn finds its answer by an equi-join on (conversation, turn + 1), which is unique, so a very
    long conversation is no hot key.
    """
    talk = read(spark, folder, "conversations")
    asked = talk.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt_text"))
    answers = talk.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return asked.join(answers, ["conv_id", "turn"], "left").select(
        stable_uuid(F.col("conv_id"), F.col("turn")).alias("prompt_id"),
        F.col("conv_id").cast("string").alias("batch_id"),
        F.col("turn").alias("seq"),
        "prompt_text",
        F.when(F.col("response").isNull(), "failed").otherwise("succeeded").alias("status"),
        "response",
    )


def lookup_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids to look up: known and unknown batches in each accepted form, and texts that are no ids."""
    key = F.col("doc_id")
    known = stable_uuid(F.concat_ws("/", "source", "lang"))
    bare = F.regexp_replace(known, "-", "")
    return read(spark, folder, "documents").select(
        F.when(key % 7 == 0, known)
        .when(key % 7 == 1, F.upper(known))
        .when(key % 7 == 2, F.concat(F.lit("urn:uuid:"), known))
        .when(key % 7 == 3, F.concat(F.lit("{"), known, F.lit("}")))
        .when(key % 7 == 4, bare)
        .when(key % 7 == 5, stable_uuid(key))
        .otherwise(F.concat_ws("/", "source", "lang"))
        .alias("id")
    )


def document_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as bodies of failed answers, the status depending on the language."""
    lang = F.col("lang")
    status = F.when(lang == "en", 503).when(lang == "fr", 400).when(lang == "de", 429).otherwise(500)
    return read(spark, folder, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("prompt_id"),
        F.col("source").alias("batch_id"),
        F.lit(1).cast("bigint").alias("round"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("finished_at"),
        status.alias("http_status"),
        F.col("n_chars").cast("string").alias("retry_after"),
        F.col("text").alias("body"),
        F.lit(None).cast("string").alias("transport_error"),
    )
