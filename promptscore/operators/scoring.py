"""Scorers: a column expression, a batched model, or calls to an endpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Response(NamedTuple):
    """One answer of an endpoint; ``error`` is set when no answer arrived."""

    status: int | None = None
    body: str | None = None
    retry_after: str | None = None
    error: str | None = None


Transport = Callable[[list[str]], list[Response]]

CALL_SIZE = 64
TASKS_PER_CORE = 4


def length_echo(prompt: Column) -> Column:
    """Stand-in completion that tells the prompt's length in bytes; runs without Python."""
    # The completion text.
    return F.format_string("mock completion for prompt of %d chars", F.octet_length(prompt))


def model_scorer(make_predict: Callable, return_type: T.DataType, batch_size: int, input_shape: list[int]):
    """A model over numpy batches, loaded once per Python worker."""
    from pyspark.ml.functions import predict_batch_udf

    return predict_batch_udf(
        make_predict, return_type=return_type, batch_size=batch_size, input_tensor_shapes=[input_shape]
    )


def score(
    claims: DataFrame,
    make_transport: Callable[[], Transport],
    pool_size: int | None = None,
    finished_at: bool = True,
    call_size: int = CALL_SIZE,
) -> DataFrame:
    """Send every claimed prompt once and append the raw response columns.

    ``make_transport`` builds the transport once per task. A failing call marks its prompt with the
    error instead of failing the task. ``pool_size`` bounds the tasks that call at the same time: with
    fewer than the cluster has cores there are so many tasks, otherwise several per core, so that a
    lost one repeats little. A transport may have several calls in flight of its own; the bound on
    those is cores times the transport's. Run exactly one action over the result and write it: each
    further action would call the endpoint again.
    """
    if pool_size is not None:
        cores = claims.sparkSession.sparkContext.defaultParallelism
        claims = claims.repartition(pool_size if pool_size <= cores else TASKS_PER_CORE * cores, "prompt_id")
    kept = [f for f in claims.schema.fields if f.name != "finished_at"]
    added = [
        T.StructField("http_status", T.IntegerType()),
        T.StructField("retry_after", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("transport_error", T.StringType()),
    ]
    stamp = [T.StructField("finished_at", T.TimestampNTZType())]
    schema = T.StructType(kept + stamp + added)
    stamps = finished_at
    names = [f.name for f in kept]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transport = make_transport()
        for frame in frames:
            texts = frame["prompt_text"].tolist()
            for start in range(0, len(texts), call_size):  # each call's answers leave the task at once
                part = frame.iloc[start : start + call_size]
                answers = _call(transport, texts[start : start + call_size])
                now = datetime.now(timezone.utc).replace(tzinfo=None)
                out = part[names].copy()
                out["finished_at"] = pd.Series([now] * len(part), index=out.index) if stamps else part["finished_at"]
                out["http_status"] = pd.array([a.status for a in answers], dtype="Int32")
                out["retry_after"] = [a.retry_after for a in answers]
                out["body"] = [a.body for a in answers]
                out["transport_error"] = [a.error for a in answers]
                yield out

    return claims.mapInPandas(run, schema)


def _call(transport: Transport, prompts: list[str]) -> list[Response]:
    try:
        answers = list(transport(prompts))
    except Exception as error:  # a transport that can tell its prompts apart answers for each and never raises
        return [Response(error=str(error) or type(error).__name__)] * len(prompts)
    if len(answers) != len(prompts):
        raise ValueError(f"transport returned {len(answers)} responses for {len(prompts)} prompts")
    return answers
