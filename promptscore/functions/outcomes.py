"""From a raw endpoint response to an outcome, a completion, a server hint and an error text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptscore.functions.text import cut_bytes, duration_text

SUCCESS = "success"
RATE_LIMITED = "rate_limited"
TRANSIENT = "transient"
PERMANENT = "permanent"
ABANDONED = "abandoned"

BODY_READ_LIMIT = 1 << 20
MESSAGE_BYTES = 200
MAX_HINT_SECONDS = 9_223_372_036

_STRICT_JSON = {
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "columnNameOfCorruptRecord": "corrupt",
}

# English names in HTTP dates.
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_SHORT_DAYS = "(?:mon|tue|wed|thu|fri|sat|sun)"
_LONG_DAYS = "(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)"

_MONTH = "(" + "|".join(_MONTHS) + ")"
_CLOCK = r"(\d{1,2}):(\d{2}):([0-5]\d)"
# The date forms HTTP allows and how each is rewritten to "date year month day hour minute second".
# Two-digit years from 69 on belong to the last century.
_DATE_FORMS = [
    (rf"^(?i:{_SHORT_DAYS}, (\d{{2}}) {_MONTH} (\d{{4}}) {_CLOCK}) GMT$", "date $3 $2 $1 $4 $5 $6"),
    (rf"^(?i:{_LONG_DAYS}, (\d{{2}})-{_MONTH}-(69|[7-9]\d) {_CLOCK}) [A-Z]{{3,4}}$", "date 19$3 $2 $1 $4 $5 $6"),
    (rf"^(?i:{_LONG_DAYS}, (\d{{2}})-{_MONTH}-(\d{{2}}) {_CLOCK}) [A-Z]{{3,4}}$", "date 20$3 $2 $1 $4 $5 $6"),
    (rf"^(?i:{_SHORT_DAYS} {_MONTH} +(\d{{1,2}}) {_CLOCK} (\d{{4}}))$", "date $6 $1 $2 $3 $4 $5"),
]


def completion_fields(body: Column) -> tuple[Column, Column]:
    """Parse a response body into ``<v: map, corrupt: string>``, and count it as an array element.

    The body is parsed as a member of a wrapper object: a JSON ``null`` then differs from a parse
    failure, and text after the value makes the wrapper invalid. Keys and repeats are kept in order.
    A stray closing brace would end the wrapper early, but no array wrapper accepts it.
    """
    inside = F.from_json(F.concat(F.lit('{"v":'), body, F.lit("}")), "v map<string,variant>, corrupt string", _STRICT_JSON)
    alone = F.size(F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>", _STRICT_JSON)) == 1
    return inside, alone


def completion_text(inside: Column, alone: Column, body: Column) -> Column:
    """The completion of a parsed 200 body, or NULL when it cannot be decoded.

    Keys match in any letter case and the last string wins; JSON null and a missing key leave it
    empty; any other type, text after the value, or more than 1 MiB is a decode failure.
    """
    named = F.filter(F.map_entries(inside["v"]), lambda e: F.lower(e["key"]) == "completion")
    kinds = F.transform(named, lambda e: F.schema_of_variant(e["value"]))
    texts = F.filter(F.transform(named, lambda e: F.try_variant_get(e["value"], "$", "string")), lambda t: t.isNotNull())
    readable = (
        (F.octet_length(body) <= BODY_READ_LIMIT)
        & inside.isNotNull()
        & inside["corrupt"].isNull()
        & alone
        & ~F.coalesce(F.exists(kinds, lambda k: ~k.isin("STRING", "VOID")), F.lit(False))
    )
    last = F.coalesce(F.try_element_at(texts, F.lit(-1)), F.lit(""))
    return F.when(F.coalesce(readable, F.lit(False)), last)


def decode_completions(rows: DataFrame, wanted: Column) -> DataFrame:
    """Add ``response``: the decoded ``body`` where ``wanted``, NULL where it cannot be decoded."""
    body = F.coalesce(F.col("body"), F.lit(""))
    inside, alone = completion_fields(body)
    parsed = rows.withColumns({"inside": F.when(wanted, inside), "alone": F.when(wanted, alone)})
    text = completion_text(F.col("inside"), F.col("alone"), body)
    return parsed.withColumn("response", F.when(wanted, text)).drop("inside", "alone")


def http_date(text: Column) -> Column:
    """UTC timestamp of an HTTP date in any of its three forms, else NULL."""
    plain = F.when(~text.startswith("date "), text)
    for pattern, rewritten in _DATE_FORMS:
        plain = F.regexp_replace(plain, pattern, rewritten)
    months = F.split(F.lit(" ".join(_MONTHS)), " ")

    def stamp(fields: Column) -> Column:
        number = lambda i: F.get(fields, F.lit(i)).try_cast("int")
        month = F.array_position(months, F.lower(F.get(fields, F.lit(2)))).cast("int")
        return F.try_make_timestamp_ntz(number(1), month, number(3), number(4), number(5), number(6))

    # binding the fields to a lambda variable keeps the rewriting from running once per field
    dates = F.filter(F.array(plain), lambda p: p.startswith("date "))
    return F.get(F.transform(F.transform(dates, lambda p: F.split(p, " ")), stamp), F.lit(0))


def retry_after_ms(header: Column, now: Column) -> Column:
    """Milliseconds asked for by a Retry-After header: whole seconds or a date, else 0."""
    seconds = F.coalesce(header.try_cast("bigint"), F.lit(None))
    whole = header.rlike(r"^[+-]?[0-9]+\z")
    from_seconds = F.least(F.greatest(seconds, F.lit(0)), F.lit(MAX_HINT_SECONDS)) * 1000
    until = F.timestamp_diff("MILLISECOND", now.cast("timestamp_ntz"), http_date(header))
    return F.coalesce(
        F.when(whole, from_seconds).otherwise(F.greatest(until, F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"),
    )


def outcome_before_decode(http_status: Column, transport_error: Column) -> Column:
    """Outcome by status alone; ``success`` still depends on the body."""
    return (
        F.when(transport_error.isNotNull(), TRANSIENT)
        .when(http_status.isNull(), ABANDONED)
        .when(http_status == 200, SUCCESS)
        .when(http_status == 429, RATE_LIMITED)
        .when(http_status >= 500, TRANSIENT)
        .otherwise(PERMANENT)
    )


def uses_budget(http_status: Column, transport_error: Column) -> Column:
    """Whether the attempt counts against the retry budget of the attempts after it."""
    return outcome_before_decode(http_status, transport_error).isin(TRANSIENT, ABANDONED)


def error_text(outcome: Column, http_status: Column, body: Column, transport_error: Column, hint_ms: Column) -> Column:
    """Message stored with a failed attempt; NULL for success and for attempts without an answer."""
    # The message forms users match on.
    shown = cut_bytes(F.coalesce(body, F.lit("")), MESSAGE_BYTES)
    code = http_status.cast("string")
    limited = F.concat(F.lit("retryable: rate limited (429): "), shown)
    return (
        F.when(transport_error.isNotNull(), F.concat(F.lit("retryable: inference request failed: "), transport_error))
        .when(
            outcome == RATE_LIMITED,
            F.when(hint_ms > 0, F.concat(limited, F.lit(" (retry-after="), duration_text(hint_ms), F.lit(")"))).otherwise(
                limited
            ),
        )
        .when(outcome == TRANSIENT, F.concat(F.lit("retryable: server error ("), code, F.lit("): "), shown))
        .when((outcome == PERMANENT) & (http_status == 200), F.lit("decode response: not a completion object"))
        .when(outcome == PERMANENT, F.concat(F.lit("inference failed ("), code, F.lit("): "), shown))
    )


def classify(attempts: DataFrame) -> DataFrame:
    """Add ``outcome``, ``response``, ``retry_after_ms`` and ``error`` and drop the raw response.

    Narrow: bodies are reduced to a completion or a short message before anything is shuffled. To
    filter on the outcome right away, ``hold`` it first, or the filter parses the bodies once more.
    """
    status, failure = F.col("http_status"), F.col("transport_error")
    first = outcome_before_decode(status, failure)
    hint = F.when(first == RATE_LIMITED, retry_after_ms(F.col("retry_after"), F.col("finished_at"))).otherwise(
        F.lit(0).cast("bigint")
    )
    decoded = decode_completions(attempts, first == SUCCESS).withColumn("retry_after_ms", hint)
    outcome = F.when((first == SUCCESS) & F.col("response").isNull(), PERMANENT).otherwise(first)
    typed = decoded.withColumn("outcome", outcome)
    message = error_text(F.col("outcome"), status, F.col("body"), failure, F.col("retry_after_ms"))
    return typed.withColumn("error", message).drop("http_status", "retry_after", "body", "transport_error")
