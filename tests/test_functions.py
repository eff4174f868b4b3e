from datetime import datetime

import pytest
from pyspark.sql import functions as F

from promptscore import Options
from promptscore.functions import outcomes as o
from promptscore.functions.backoff import delay_ms, jitter_draw
from promptscore.functions.ids import parse_uuid, stable_uuid
from promptscore.functions.text import cut_bytes, duration_text, trim_space


def values(spark, inputs, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_trim_is_unicode(spark):
    assert values(spark, [" a　", "  \t", " a b\n", "​a", " x\u0085"], trim_space) == [
        "a", "", "a b", "​a", "x"]


def test_cut_counts_bytes_and_mends_characters(spark):
    cut = lambda c: cut_bytes(c, 5)
    assert values(spark, ["12345", "123456", "éééé", "ab€€"], cut) == ["12345", "12345...", "éé�...", "ab€..."]


def test_duration_text(spark):
    got = values(spark, [250, 1000, 1500, 59_123, 60_000, 90_000, 3_600_000, 3_661_010], duration_text, "bigint")
    assert got == ["250ms", "1s", "1.5s", "59.123s", "1m0s", "1m30s", "1h0m0s", "1h1m1.01s"]


def test_uuid_forms(spark):
    u = "b1f20c3d-0000-4000-8000-0123456789ab"
    given = [u, u.upper(), "urn:uuid:" + u, "URN:UUID:" + u, "{" + u + "}", u.replace("-", ""), "not-a-uuid", u[:-1], u + "0", ""]
    assert values(spark, given, parse_uuid) == [u] * 6 + [None] * 4


def test_stable_uuid_depends_on_every_part(spark):
    row = spark.range(1).select(
        stable_uuid(F.lit("a"), F.lit(1)), stable_uuid(F.lit("a"), F.lit(1)), stable_uuid(F.lit("a1"), F.lit("")),
        parse_uuid(stable_uuid(F.lit("x"))).isNotNull(),
    ).first()
    assert row[0] == row[1] and row[0] != row[2] and row[3]


@pytest.mark.parametrize(
    "attempt, hint, base, ceiling, expected",
    [(1, 2000, 100, 10_000, 2000), (1, 60_000, 100, 10_000, 10_000), (1, 0, 100, 10_000, 100), (1, 50, 100, 10_000, 50),
     (3, 0, 20_000, 10_000, 20_000)],
)
def test_backoff_values(spark, attempt, hint, base, ceiling, expected):
    options = Options(base_backoff_ms=base, max_backoff_ms=ceiling)
    row = spark.range(1).select(delay_ms(F.lit(attempt), F.lit(hint), F.lit(12345), options)).first()
    assert row[0] == expected


def test_backoff_range_property(spark):
    options = Options(base_backoff_ms=100, max_backoff_ms=10_000)
    grid = spark.range(41 * 50).select((F.col("id") % 41).alias("attempt"), F.col("id").alias("k"))
    draw = jitter_draw(F.col("attempt"), F.col("k"))
    draws = grid.select("attempt", delay_ms(F.col("attempt"), F.lit(0), draw, options).alias("d"))
    low, high = draws.agg(F.min("d"), F.max("d")).first()
    assert 100 <= low and high <= 10_000
    assert draws.filter("attempt = 4").agg(F.max("d")).first()[0] <= 800
    assert draws.filter("attempt <= 1").agg(F.max("d")).first()[0] == 100
    assert draws.filter("attempt = 30").select("d").distinct().count() > 40


NOW = datetime(2015, 10, 21, 7, 27)


@pytest.mark.parametrize(
    "header, ms",
    [("", 0), ("soon", 0), ("5.5", 0), ("-3", 0), (" 5", 0), ("0", 0), ("+5", 5000), ("120", 120_000),
     ("99999999999999999999", 0),
     ("Wed, 21 Oct 2015 07:28:00 GMT", 60_000), ("Wednesday, 21-Oct-15 07:28:00 GMT", 60_000),
     ("Wed Oct 21 07:28:00 2015", 60_000), ("wed, 21 oct 2015 07:28:00 GMT", 60_000),
     ("Wed, 21 Oct 2015 07:26:00 GMT", 0), ("Wednesday, 21-Oct-70 07:28:00 GMT", 0), ("Thu Oct  1 07:28:00 2015", 0),
     ("Wed, 31 Feb 2016 07:28:00 GMT", 0), ("Wed, 21 Oct 2015 07:28:60 GMT", 0), ("Wed, 21 Oct 2015 07:28:00 UTC", 0),
     ("date 2016 oct 21 7 28 0", 0), (None, 0)],
)
def test_retry_after(spark, header, ms):
    df = spark.createDataFrame([(header, NOW)], "h string, now timestamp_ntz")
    assert df.select(o.retry_after_ms(F.col("h"), F.col("now"))).first()[0] == ms


COMPLETIONS = [
    ('{"completion":"hi"}', "hi"), ("{}", ""), ("null", ""), ('{"completion":null}', ""), (" { } ", ""),
    ('{"x":{"completion":"no"},"completion":"z"}', "z"), ('{"Completion":"C"}', "C"),
    ('{"completion":"a","completion":"b"}', "b"), ('{"completion":"a","completion":null}', "a"),
    ('{"completion":"a\\u00e9"}', "aé"),
    ('{"completion":5}', None), ('{"completion":5,"completion":"b"}', None), ("[1]", None), ("not json", None), ("", None),
    ('"s"', None), ("5", None), ('{"completion":"a"} x', None), ('{"completion":"a"}}', None), ('{"completion":"a"}]', None),
    ('{"completion":"a"},{"completion":"b"}', None), ("{'completion':'q'}", None), ('{"completion":"a","n":NaN}', None),
    ('{"completion":["a"]}', None), ('{"completion":"a"', None),
]


def test_completions(spark):
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(COMPLETIONS)], "i int, body string")
    rows = o.decode_completions(df, F.lit(True)).orderBy("i").collect()
    assert [(r.body, r.response) for r in rows] == COMPLETIONS


def test_read_limit(spark):
    body = lambda n: F.concat(F.lit('{"completion":"'), F.repeat(F.lit("x"), n), F.lit('"}'))
    df = spark.range(1).select(F.explode(F.array(body((1 << 20) - 17), body((1 << 20) - 16))).alias("body"))
    lengths = [r[0] for r in o.decode_completions(df, F.lit(True)).select(F.length("response")).collect()]
    assert lengths == [(1 << 20) - 17, None]


ATTEMPTS = "http_status int, retry_after string, body string, transport_error string, finished_at timestamp_ntz"


@pytest.mark.parametrize(
    "status, hint, body, failure, outcome, response, error",
    [
        (200, None, '{"completion":"hi"}', None, "success", "hi", None),
        (200, None, "not json", None, "permanent", None, "decode response: not a completion object"),
        (201, None, "{}", None, "permanent", None, "inference failed (201): {}"),
        (304, None, None, None, "permanent", None, "inference failed (304): "),
        (404, None, "gone", None, "permanent", None, "inference failed (404): gone"),
        (429, "2", "wait", None, "rate_limited", None, "retryable: rate limited (429): wait (retry-after=2s)"),
        (429, None, "wait", None, "rate_limited", None, "retryable: rate limited (429): wait"),
        (500, "9", "x" * 201, None, "transient", None, "retryable: server error (500): " + "x" * 200 + "..."),
        (599, None, "e", None, "transient", None, "retryable: server error (599): e"),
        (None, None, None, "timeout", "transient", None, "retryable: inference request failed: timeout"),
        (None, None, None, None, "abandoned", None, None),
    ],
)
def test_classification(spark, status, hint, body, failure, outcome, response, error):
    row = o.classify(spark.createDataFrame([(status, hint, body, failure, NOW)], ATTEMPTS)).first()
    assert (row.outcome, row.response, row.error) == (outcome, response, error)
