"""Fold an append-only attempt log into decisions and prompt state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptscore.functions import outcomes as o
from promptscore.operators import settle
from promptscore.options import Options

# Rounds of one prompt that are folded in one piece. (prompt_id, round) is unique in the log, so
# this also bounds the rows of a piece.
SPAN = 1 << 20


def _budget(log: DataFrame, options: Options) -> Column:
    return F.col("max_attempts") if "max_attempts" in log.columns else F.lit(options.max_attempts)


def _piece(span: int) -> Column:
    """First round of the span a round lies in; whole numbers throughout."""
    return F.col("round") - F.pmod(F.col("round"), F.lit(span))


def _spends(outcome: Column) -> Column:
    return outcome.isin(o.TRANSIENT, o.ABANDONED)


def _settles_alone(outcome: Column) -> Column:
    return outcome.isin(o.SUCCESS, o.PERMANENT)


def _earlier(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``local``: the attempt's number among the budget-using attempts of its group."""
    spent = F.sum(_spends(F.col("outcome")).cast("bigint")).over(_earlier(keys, "round"))
    return rows.withColumn("local", F.lit(1).cast("bigint") + F.coalesce(spent, F.lit(0)))


def _carried_over(log: DataFrame, budget: Column, span: int, prior: DataFrame | None) -> DataFrame:
    """What each (prompt, piece) has to know of the pieces before it: attempts used, settled or not.

    Works on the status columns alone: whether a 200 body decodes does not matter here, as it
    settles the prompt either way. Only pieces with something to know are returned.
    """
    keys = ["prompt_id", "piece"]
    kind = o.outcome_before_decode(F.col("http_status"), F.col("transport_error"))
    slim = log.select("prompt_id", "round", _piece(span).alias("piece"), kind.alias("outcome"), budget.alias("budget"))
    outcome = F.col("outcome")
    pieces = _numbered(slim, keys).groupBy(*keys).agg(
        F.sum(_spends(outcome).cast("bigint")).alias("n"),
        F.max(_settles_alone(outcome)).alias("settles"),
        F.max(F.when(outcome == o.TRANSIENT, F.col("local"))).alias("tries"),
        F.max("budget").alias("budget"),
    )
    used, was_settled = F.lit(0).cast("bigint"), F.lit(False)
    if prior is not None:
        pieces = pieces.join(_known(prior), "prompt_id", "left")
        used, was_settled = F.coalesce(F.col("used"), used), F.coalesce(F.col("was_settled"), was_settled)
    across = _earlier(["prompt_id"], "piece")
    counted = pieces.withColumn("carried", used + F.coalesce(F.sum("n").over(across), F.lit(0)))
    ends = F.col("settles") | F.coalesce(F.col("tries") + F.col("carried") >= F.col("budget"), F.lit(False))
    closed = counted.withColumn("ended", was_settled | F.coalesce(F.max(ends).over(across), F.lit(False)))
    return closed.filter((F.col("carried") > 0) | F.col("ended")).select(*keys, "carried", "ended")


def _known(prior: DataFrame) -> DataFrame:
    settled = F.col("status").isin("succeeded", "failed")
    return prior.select("prompt_id", F.col("attempts").alias("used"), settled.alias("was_settled"))


def decide(
    log: DataFrame,
    options: Options,
    prior: DataFrame | None = None,
    span: int = SPAN,
) -> DataFrame:
    """Add ``outcome``, ``attempt``, ``decision``, ``delay_ms``, ``next_retry_at`` and ``live`` per attempt.

    ``attempt`` is one plus the earlier attempts that used budget; ``live`` is false for rows after
    the one that settled the prompt. ``prior`` is the state before this part of the log
    (prompt_id, status, attempts): counts continue from it, and rows of settled prompts are not live.

    Rows are numbered per (prompt, span of rounds), and a small table per span carries used budget and the
    fact of being settled from one span to the next, so a prompt with a large part of the log is spread
    over tasks by span. The wide rows are shuffled and sorted once: after the join with that table, which
    only has spans with something to carry over, nothing but arithmetic is left.
    """
    keys = ["prompt_id", "piece"]
    budget = _budget(log, options)
    outcome = F.col("outcome")

    rows = o.classify(log).withColumn("piece", _piece(span))
    inside = _earlier(keys, "round")
    rows = _numbered(rows, keys).withColumns(
        {
            "settled_before": F.coalesce(F.max(_settles_alone(outcome)).over(inside), F.lit(False)),
            "tries_before": F.max(F.when(outcome == o.TRANSIENT, F.col("local"))).over(inside),
        }
    )
    rows = rows.join(_carried_over(log, budget, span, prior), keys, "left")

    carried = F.coalesce(F.col("carried"), F.lit(0))
    spent_out = F.coalesce(F.col("tries_before") + carried >= budget, F.lit(False))
    over = F.col("settled_before") | spent_out | F.coalesce(F.col("ended"), F.lit(False))
    rows = rows.withColumns({"attempt": F.col("local") + carried, "live": ~over})
    rows = settle.add_retry_time(settle.add_decision(rows, budget), options)
    return rows.drop("piece", "local", "settled_before", "tries_before", "carried", "ended")


def fold(decided: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """One state row per prompt seen in ``decided``.

    Plain aggregates over the live rows, pre-aggregated in every map task. The last live row gives
    status and attempts; error text and retry time are the last ones written, as a recovered
    attempt leaves both unchanged.
    """
    live = decided.filter("live").withColumn("after", settle.attempts_after(F.col("outcome"), F.col("attempt")))
    by_prompt = live.groupBy("prompt_id").agg(
        F.any_value("batch_id").alias("batch_id"),
        F.max(F.struct("round", "decision", "after")).alias("last"),
        F.max(F.when(F.col("error").isNotNull(), F.struct("round", "error"))).alias("message"),
        F.max(F.when(F.col("next_retry_at").isNotNull(), F.struct("round", "next_retry_at"))).alias("due"),
        F.max("response").alias("response"),
    )
    decision = F.col("last.decision")
    state = by_prompt.select(
        "prompt_id",
        "batch_id",
        settle.status_after(decision).alias("status"),
        F.col("last.after").alias("attempts"),
        "response",
        F.when(decision != settle.SUCCEED, F.col("message.error")).alias("error"),
        F.col("due.next_retry_at").alias("next_retry_at"),
        F.col("last.round").alias("last_round"),
    )
    if prior is None:
        return state
    before = prior.select("prompt_id", F.col("error").alias("error0"), F.col("next_retry_at").alias("due0"))
    error = F.when(F.col("status") != "succeeded", F.coalesce("error", "error0"))
    return (
        state.join(before, "prompt_id", "left")
        .withColumns({"error": error, "next_retry_at": F.coalesce("next_retry_at", "due0")})
        .drop("error0", "due0")
    )


def prompt_state(log: DataFrame, options: Options, **kwargs) -> DataFrame:
    """State of every prompt in a log; see ``decide`` and ``fold``."""
    return fold(decide(log, options, **kwargs), kwargs.get("prior"))


def with_unclaimed(prompts: DataFrame, state: DataFrame) -> DataFrame:
    """State of all queue rows: those never attempted keep their initial values."""
    log_state = state.select("prompt_id", *[F.col(c).alias(f"s_{c}") for c in ("status", "attempts", "next_retry_at")],
                             "response", "error", "last_round")
    joined = prompts.join(log_state, "prompt_id", "left")
    return joined.withColumns(
        {c: F.coalesce(f"s_{c}", c) for c in ("status", "attempts", "next_retry_at")}
    ).drop("s_status", "s_attempts", "s_next_retry_at")


def due(state: DataFrame, as_of: Column) -> DataFrame:
    """Pending prompts whose retry time has come; a prompt without one is due at once."""
    time = F.col("next_retry_at")
    return state.filter((F.col("status") == "pending") & (time.isNull() | (time <= as_of)))


def claim(state: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """Due prompts with their attempt counted. A limit takes the longest due, ties by batch and seq.

    With a limit every task keeps only its best rows and the merge sees ``limit`` rows per task.
    """
    ready = due(state, as_of)
    if limit is not None:
        order = ["next_retry_at", "batch_id", "seq" if "seq" in state.columns else "prompt_id"]
        ready = ready.orderBy(*order).limit(limit)
    return taken(ready)


def taken(rows: DataFrame) -> DataFrame:
    """Claimed rows: the attempt is counted before it is made."""
    return rows.withColumns({"attempts": F.col("attempts") + 1, "status": F.lit("processing")})


def abandoned(claims: DataFrame, answered: DataFrame, finished_at: Column) -> DataFrame:
    """Log rows for claims of a finished round that never got an answer."""
    lost = claims.join(answered.select("prompt_id", "round"), ["prompt_id", "round"], "left_anti")
    empty = {name: F.lit(None).cast("string") for name in ("retry_after", "body", "transport_error")}
    return lost.withColumns({"finished_at": finished_at, "http_status": F.lit(None).cast("int"), **empty})


def dedupe(log: DataFrame) -> DataFrame:
    """Keep the earliest answer per (prompt, round) when work was delivered twice."""
    rest = [c for c in log.columns if c not in ("prompt_id", "round", "finished_at")]
    first = F.min(F.struct("finished_at", *rest)).alias("first")
    return log.groupBy("prompt_id", "round").agg(first).select("prompt_id", "round", "first.*").select(*log.columns)
