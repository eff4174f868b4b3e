"""JSON-array request bodies: gate, parse, validate and explode, all without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from promptscore.functions.ids import stable_uuid
from promptscore.functions.once import hold
from promptscore.functions.text import trim_space
from promptscore.operators import validate as v
from promptscore.options import Options
from promptscore.sources import tables

# The shapes a body may have, as reported by ``schema_of_variant``.
_STRING_ARRAYS = ("ARRAY<STRING>", "ARRAY<VOID>")
_JSON_NULL = "VOID"
_TEXTS = ("STRING", "VOID")

# Strings above this many characters are beyond the variant parser.
_LONG_STRING = 20_000_000
_LONG_STRINGS = {"maxStringLen": str(2**31 - 1), "allowSingleQuotes": "false"}


def from_files(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    """One request per file, for ``spark.read`` and ``spark.readStream`` alike."""
    whole = reader.format("text").option("wholetext", True).load(path)
    return whole.select(
        F.col("_metadata.file_path").alias("request_id"),
        F.col("value").alias("body"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("received_at"),
    )


def parse(requests: DataFrame, options: Options) -> DataFrame:
    """Add ``prompts`` (trimmed), ``error_code`` and ``error_seq`` to each request row.

    A request is one row, so every check is an expression over its own array: the same code runs on
    a stream, and no batch is ever gathered from several rows. JSON null counts as an empty array and
    a null element as an empty prompt; text after the array is ignored. Bodies over the limit are not
    parsed; Spark's own limit for one parsed body is 128 MiB. Bodies that may hold a string too long for
    the variant parser are parsed element by element when it fails.
    """
    too_large = F.octet_length("body") > options.max_body_bytes
    value = requests.withColumn("value", F.when(~too_large, F.try_parse_json("body")))
    shaped = value.withColumn("shape", F.schema_of_variant("value"))
    texts = F.transform(
        F.try_variant_get("value", "$", "array<string>"), lambda x: trim_space(F.coalesce(x, F.lit("")))
    )
    long = ~too_large & F.col("value").isNull() & (F.octet_length("body") > _LONG_STRING) & F.ltrim("body").startswith("[")
    items = F.when(long, F.from_json("body", "array<variant>", _LONG_STRINGS))
    shaped = shaped.withColumn("items", items)
    all_texts = F.forall("items", lambda x: x.isNull() | F.schema_of_variant(x).isin(*_TEXTS))
    long_texts = F.transform(
        "items", lambda x: trim_space(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))
    )
    prompts = (
        F.when(F.col("shape").isin(*_STRING_ARRAYS), texts)
        .when(F.col("shape") == _JSON_NULL, F.array().cast("array<string>"))
        .when(all_texts, long_texts)
    )
    listed = shaped.withColumn("texts", prompts).drop("value", "shape", "items")
    codes = F.transform("texts", lambda p: v.prompt_error(p, options))
    judged = listed.withColumn("codes", codes)
    judged = judged.withColumn("bad_at", F.array_position(F.transform("codes", lambda c: c.isNotNull()), True))
    by_prompt = F.when(F.col("bad_at") > 0, F.try_element_at("codes", F.col("bad_at").cast("int")))
    by_size = v.size_error(F.size("texts").cast("bigint"), options)
    code = (
        F.when(too_large, v.BODY_TOO_LARGE)
        .when(F.col("texts").isNull(), v.NOT_AN_ARRAY)
        .otherwise(F.coalesce(by_size, by_prompt))
    )
    seq = F.when(~too_large & by_size.isNull() & by_prompt.isNotNull(), (F.col("bad_at") - 1).cast("int"))
    done = judged.withColumns({"prompts": F.col("texts"), "error_code": code, "error_seq": seq})
    return hold(done.drop("texts", "codes", "bad_at"), "prompts", "error_code", "error_seq")


def triage(parsed: DataFrame) -> DataFrame:
    """What a caller would be told about each request: an acknowledgement or the error."""
    code = F.col("error_code")
    accepted = code.isNull()
    return parsed.select(
        "request_id",
        v.status_code(code).alias("status_code"),
        "error_code",
        v.error_message(code).alias("error"),
        "error_seq",
        F.when(accepted, stable_uuid(F.col("request_id"))).alias("batch_id"),
        F.when(accepted, F.size("prompts").cast("bigint")).alias("accepted"),
        F.when(accepted, F.lit("pending")).alias("status"),
    )


def batches_of(parsed: DataFrame, as_of: Column) -> DataFrame:
    """One pending batch per accepted request."""
    return parsed.filter("error_code is null").select(
        stable_uuid(F.col("request_id")).alias("batch_id"),
        F.lit("pending").alias("status"),
        F.size("prompts").cast("bigint").alias("total_count"),
        as_of.alias("created_at"),
    )


def prompts_of(parsed: DataFrame, options: Options, as_of: Column) -> DataFrame:
    """One queue row per prompt of an accepted request; ``seq`` is the array position."""
    exploded = parsed.filter("error_code is null").select(
        stable_uuid(F.col("request_id")).alias("batch_id"),
        as_of.alias("at"),
        F.posexplode("prompts").alias("seq", "prompt_text"),
    )
    return queue_rows(exploded, options, F.col("at"))


def store(requests: DataFrame, options: Options, root: str, part: str) -> None:
    """Write one delivery of requests as prompts, rejects and batches, in this order.

    The parsed requests are written first and the three tables are read off them, so bodies are
    parsed once and a lost executor costs a re-read instead of a re-parse. Each table gets the
    delivery under its own ``part`` folder, and storing it again replaces it; the batch rows come
    last, so readers that ask for the batch row never see half a batch. Times are ``received_at``.
    """
    staged = f"{root}/parsed/{part}"
    tables.put(parse(requests, options).drop("body"), staged)
    parsed = tables.get(requests.sparkSession, staged)
    at = F.col("received_at")
    tables.put(prompts_of(parsed, options, at), f"{root}/prompts/{part}")
    tables.put(rejects_of(parsed), f"{root}/rejects/{part}")
    tables.put(batches_of(parsed, at), f"{root}/batches/{part}")


def rejects_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error_code is not null").select(
        "request_id", "error_code", v.error_message(F.col("error_code")).alias("error"), F.col("error_seq").alias("seq")
    )


def queue_rows(prompts: DataFrame, options: Options, as_of: Column) -> DataFrame:
    """Add the id and the defaults of a new queue row to (batch_id, seq, prompt_text)."""
    return prompts.select(
        stable_uuid(F.col("batch_id"), F.col("seq")).alias("prompt_id"),
        "batch_id",
        F.col("seq").cast("bigint").alias("seq"),
        "prompt_text",
        F.lit("pending").alias("status"),
        F.lit(0).cast("bigint").alias("attempts"),
        F.lit(options.max_attempts).alias("max_attempts"),
        as_of.alias("next_retry_at"),
        as_of.alias("created_at"),
    )
