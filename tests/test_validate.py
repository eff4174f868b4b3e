import random

import pytest
from pyspark.sql import functions as F

from promptscore import Options
from promptscore.operators import validate as v
from promptscore.sources import requests as rq

SMALL = Options(max_batch_size=3, max_prompt_bytes=10)


def rows(spark, batches):
    data = [(b, i, p) for b, prompts in batches.items() for i, p in enumerate(prompts)]
    return spark.createDataFrame(data, "batch_id string, seq bigint, prompt_text string")


VECTORS = [
    (["a", "b", "c", "d"], "batch_too_large", None),
    (["a", "   "], "empty_prompt", 1),
    (["x" * 11], "prompt_too_long", 0),
    (["a", "b", "c", " "], "batch_too_large", None),
    (["x" * 11, " "], "prompt_too_long", 0),
    (["éééééé"], "prompt_too_long", 0),
    (["  hello  ", "world"], None, None),
    ([" a　"], None, None),
]


def test_verdicts(spark):
    batches = {f"b{i}": prompts for i, (prompts, _, _) in enumerate(VECTORS)}
    known = spark.createDataFrame([(b,) for b in [*batches, "none"]], "batch_id string")
    got = {r.batch_id: (r.error_code, r.error_seq) for r in v.batch_verdicts(rows(spark, batches), SMALL, known).collect()}
    assert got == {f"b{i}": (c, s) for i, (_, c, s) in enumerate(VECTORS)} | {"none": ("empty_batch", None)}


def test_messages_and_status(spark):
    codes = [*v.MESSAGES, None]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    got = {r[0]: (r[1], r[2]) for r in df.select("c", v.error_message(F.col("c")), v.status_code(F.col("c"))).collect()}
    assert got["empty_batch"] == ("batch must contain at least one prompt", 400)
    assert got["body_too_large"] == ("request body too large", 413)
    assert got[None] == (None, 202)


@pytest.mark.parametrize("span", [1 << 16, 1, 3, 10])
def test_accept_rows_against_plain_python(spark, span):
    rng = random.Random(1)
    options = Options(max_batch_size=40, max_prompt_bytes=10)
    batches = {}
    for b in range(25):
        n = rng.choice([1, 5, 39, 40, 41])
        bad = {rng.randrange(n): rng.choice([" ", "y" * 11])} if rng.random() < 0.3 else {}
        batches[f"b{b}"] = [bad.get(i, f" p{i} ") for i in range(n)]
    gaps = rows(spark, batches).withColumn("key", F.col("seq") * 7 + 2).drop("seq")
    accepted = v.accept_rows(gaps, options, order="key", span=span)
    got = {}
    for r in accepted.collect():
        got.setdefault(r.batch_id, {})[r.seq] = (r.prompt_text, r.total_count)
    fine = {b: p for b, p in batches.items() if len(p) <= 40 and all(x.strip() and len(x.strip()) <= 10 for x in p)}
    assert got == {b: {i: (x.strip(), len(p)) for i, x in enumerate(p)} for b, p in fine.items()}


BODIES = [
    ('["hello","world"]', 1 << 20, None, None, ["hello", "world"]),
    ('{"not":"an array"}', 1 << 20, "not_an_array", None, None),
    ('["' + "x" * 100 + '"]', 16, "body_too_large", None, None),
    ('["a",1]', 1 << 20, "not_an_array", None, None),
    ('[["a"]]', 1 << 20, "not_an_array", None, None),
    ('"x"', 1 << 20, "not_an_array", None, None),
    ('["a"', 1 << 20, "not_an_array", None, None),
    ("", 1 << 20, "not_an_array", None, None),
    ("nullx", 1 << 20, "not_an_array", None, None),
    ("[true]", 1 << 20, "not_an_array", None, None),
    ("['a']", 1 << 20, "not_an_array", None, None),
    ("[]", 1 << 20, "empty_batch", None, []),
    ("null", 1 << 20, "empty_batch", None, []),
    (" null ", 1 << 20, "empty_batch", None, []),
    ('["a",null]', 1 << 20, "empty_prompt", 1, ["a", ""]),
    ('["a"] trailing', 1 << 20, None, None, ["a"]),
    ('["a","b","c","d"]', 1 << 20, "batch_too_large", None, ["a", "b", "c", "d"]),
    ('[" \\u00a0 a\\u3000\\n"]', 1 << 20, None, None, ["a"]),
    ('["a","12345678901"]', 1 << 20, "prompt_too_long", 1, ["a", "12345678901"]),
]


@pytest.mark.parametrize("limit", sorted({b[1] for b in BODIES}))
def test_bodies(spark, limit):
    cases = [b for b in BODIES if b[1] == limit]
    df = spark.createDataFrame([(str(i), b[0]) for i, b in enumerate(cases)], "request_id string, body string")
    parsed = rq.parse(df, Options(max_batch_size=3, max_prompt_bytes=10, body_limit=limit))
    got = {int(r.request_id): (r.error_code, r.error_seq, r.prompts) for r in parsed.collect()}
    assert got == {i: b[2:] for i, b in enumerate(cases)}


def test_body_at_the_limits(spark):
    """10,000 prompts of 8,192 bytes: a body of more than 80 MB is taken whole."""
    item = F.concat(F.lit('"'), F.repeat(F.lit("x"), 8192), F.lit('"'))
    body = F.concat(F.lit("["), F.array_join(F.array_repeat(item, 10_000), ","), F.lit("]"))
    df = spark.range(1).select(F.lit("big").alias("request_id"), body.alias("body"))
    row = rq.triage(rq.parse(df, Options())).first()
    assert (row.status_code, row.accepted) == (202, 10_000)


@pytest.mark.parametrize(
    "body, code, seq",
    [
        ('["{}"]', "prompt_too_long", 0),
        ('["short", "{}", null]', "prompt_too_long", 1),
        ('["{}", 5]', "not_an_array", None),
        ('["{}"', "not_an_array", None),
        ("['{}']", "not_an_array", None),
        ('{{"a": "{}"}}', "not_an_array", None),
    ],
)
def test_a_very_long_string_has_a_verdict_of_its_own(spark, body, code, seq):
    before, after = body.replace("{{", "{").replace("}}", "}").split("{}") if "{{" not in body else ('{"a": "', '"}')
    long = F.concat(F.lit(before), F.repeat(F.lit("x"), 21_000_000), F.lit(after))
    rows = spark.range(1).select(F.lit("r").alias("request_id"), long.alias("body"))
    got = rq.parse(rows.withColumn("received_at", F.lit("2024-01-01").cast("timestamp_ntz")), Options()).select("error_code", "error_seq")
    assert tuple(got.first()) == (code, seq)


def test_prompts_batches_rejects_partition_the_requests(spark):
    df = spark.createDataFrame([("r1", '["a"," b "]'), ("r2", "[]"), ("r3", '["c"]')], "request_id string, body string")
    parsed = rq.parse(df, Options())
    as_of = F.lit("2024-01-01").cast("timestamp_ntz")
    prompts = rq.prompts_of(parsed, Options(), as_of).orderBy("prompt_text").collect()
    assert [(p.prompt_text, p.seq, p.status, p.attempts, p.max_attempts) for p in prompts] == [
        ("a", 0, "pending", 0, 5), ("b", 1, "pending", 0, 5), ("c", 0, "pending", 0, 5)]
    assert {(b.batch_id, b.total_count) for b in rq.batches_of(parsed, as_of).collect()} == {
        (prompts[0].batch_id, 2), (prompts[2].batch_id, 1)}
    assert [(r.request_id, r.error_code) for r in rq.rejects_of(parsed).collect()] == [("r2", "empty_batch")]


def test_requests_from_files(spark, tmp_path):
    for name, body in {"a": '["x",\n "y"]', "b": "[]"}.items():
        (tmp_path / f"{name}.json").write_text(body)
    read = rq.from_files(spark.read, str(tmp_path))
    got = {r.request_id[-6:]: r.accepted for r in rq.triage(rq.parse(read, Options())).collect()}
    assert got == {"a.json": 2, "b.json": None}
    assert read.filter("received_at is null").count() == 0
    rq.store(read, Options(), str(tmp_path / "out"), "delivery=1")
    assert spark.read.parquet(f"{tmp_path}/out/prompts").count() == 2
    assert spark.read.parquet(f"{tmp_path}/out/batches").count() == 1
    assert spark.read.parquet(f"{tmp_path}/out/rejects").count() == 1
