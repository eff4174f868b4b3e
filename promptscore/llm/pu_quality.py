"""Quality classifier learned from trusted positives and unlabelled text (positive-unlabelled learning).

Texts become a short vector of shares (letters, capitals, symbols, repeated words, repeated lines ...).
With g = w.x, positives P (labelled 1), unlabelled web text U (all documents of the training folds) and the
class prior p, the non-negative unbiased risk

    p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)]),    l(z) = log(1 + exp(-z))

is minimised by Newton steps on sums that Spark gathers over all rows (a few hundred numbers per step come
to the driver, whatever the input). While the second part is below zero, the step raises it instead.
The score is 1 / (1 + exp(-g)). The prior is estimated as the share of positives among training labels.

Nothing is sampled: the risk covers every positive and every unlabelled document. Labels, language, source
and id are never part of the vector; ids only say which rows are held out.

Defined cases: a null text scores as the empty one; a null id is in the training folds; several labels of
an id count as their largest, null labels are ignored; equal rows give equal rows; without any positive the
weights stay zero and every score is 0.5; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptscore.llm.words import split_join, written

FOLDS = 5
THRESHOLD = 0.3
STEPS = 10
RIDGE = 1e-3

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&", b"|<>", b"!?", b".,;:", b"\n", bytes(range(128, 256))]
_CLASS_OF = np.full(256, len(_CLASSES))
for _k, _members in enumerate(_CLASSES):
    _CLASS_OF[list(_members)] = _k


def features(text: str | None) -> np.ndarray:
    """The vector of one text; its first entry is 1."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(_CLASS_OF, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), len(_CLASSES) + 1)
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    shares = [
        *(counts[: len(_CLASSES)] / max(1, len(raw))),
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(words)) / n if words else 0.0,
        (m - len(set(lines))) / m if lines else 0.0,
        sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n,
        sum(w.isupper() for w in words) / n,
    ]
    shares = np.array(shares, np.float64)
    size = np.log1p(len(words))
    rest = [size, size * size / 10, min(1.0, len(words) / 20), min(20.0, len(raw) / n) / 10, np.log1p(len(raw) / m) / 5]
    return np.concatenate(([1.0], np.sqrt(shares), np.minimum(1.0, shares * 8), rest)).astype(np.float32)


WIDTH = len(features(""))


def held_out(id_col: str, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def vectors(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, x) for every row."""
    own = docs.select(F.col(id_col), F.col(text).alias("_text"))
    schema = T.StructType([own.schema[0], T.StructField("x", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [features(x.as_py()) for x in batch.column(1)]
            values = np.concatenate(flat) if flat else np.zeros(0, np.float32)
            offsets = np.arange(0, WIDTH * len(flat) + 1, WIDTH, dtype=np.int32)
            x = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=schema.names)

    return own.mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, WIDTH)


def _sums(rows: DataFrame, part) -> np.ndarray:
    """``part(x, positive)`` added over all rows; the addition is a Spark aggregate by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["slot", "value"])

    sums = rows.select("x", "positive").mapInArrow(run, "slot long, value double").groupBy("slot").agg(F.sum("value"))
    return np.array([v for _, v in sorted(sums.collect())])


def fit(rows: DataFrame, prior: float, steps: int = STEPS, ridge: float = RIDGE) -> np.ndarray:
    """Weights for raw vectors from (x, positive) rows of the training folds; all rows count as unlabelled."""

    def moments(x, positive):
        return np.concatenate(([len(x), positive.sum()], x.sum(axis=0), (x * x).sum(axis=0)))

    sums = _sums(rows, moments)
    if not len(sums) or not sums[1]:
        return np.zeros(WIDTH)
    n_all, n_pos = sums[:2]
    mean = sums[2 : 2 + WIDTH] / n_all
    scale = np.sqrt(np.maximum(sums[2 + WIDTH :] / n_all - mean * mean, 1e-12))
    mean[0], scale[0] = 0.0, 1.0
    weights = np.zeros(WIDTH)
    weights[0] = np.log(prior / (1 - prior))
    for _ in range(steps):

        def risk(x, positive, w=weights):
            z = (x - mean) / scale
            g = z @ w
            chance = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            curve = (z * (chance * (1 - chance))[:, None]).T @ z
            return np.concatenate(
                (
                    [np.logaddexp(0, g).sum(), np.logaddexp(0, g[positive]).sum()],
                    z[positive].sum(axis=0),
                    (z[positive] * chance[positive, None]).sum(axis=0),
                    z.T @ chance,
                    curve.ravel(),
                )
            )

        sums = _sums(rows, risk)
        pos_x, pos_gx, all_gx = (sums[2 + k * WIDTH : 2 + (k + 1) * WIDTH] for k in range(3))
        curve = sums[2 + 3 * WIDTH :].reshape(WIDTH, WIDTH) / n_all + ridge * np.eye(WIDTH)
        negative = sums[0] / n_all - prior * sums[1] / n_pos
        if negative < 0:
            step = -(all_gx / n_all - prior * pos_gx / n_pos)
        else:
            step = all_gx / n_all - prior * pos_x / n_pos + ridge * weights
        move = np.linalg.solve(curve, step)
        weights = weights - move * min(1.0, 4.0 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-4:
            break
    raw = weights / scale
    raw[0] = weights[0] - (weights[1:] * mean[1:] / scale[1:]).sum()
    return raw


def train(
    spark: SparkSession,
    vectors_: DataFrame,
    labels: DataFrame,
    root: str,
    id_col: str = "doc_id",
    label: str = "quality",
    folds: int = FOLDS,
) -> np.ndarray:
    """Weights from the training folds of ``vectors_``; labels of the held-out fold are never read."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, folds))
        .groupBy(id_col)
        .agg(F.max(label).alias("_label"))
    )
    share = known.agg(F.avg("_label")).first()[0]
    prior = min(0.99, max(0.01, share if share is not None else 0.5))
    rows = split_join(vectors_.where(~held_out(id_col, folds)), known, [id_col], "left").select(
        "x", F.coalesce(F.col("_label") == 1, F.lit(False)).alias("positive")
    )
    return fit(written(spark, rows, f"{root}/training"), prior)


def _chances(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def quality_scores(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    root: str,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    folds: int = FOLDS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``."""
    held = written(spark, vectors(docs, id_col, text), f"{root}/vectors")
    weights = train(spark, held, labels, root, id_col, label, folds)
    schema = T.StructType([held.schema[0], T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(_chances(_matrix(batch.column(1)), weights))
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=schema.names)

    return held.mapInArrow(score, schema).select(
        id_col,
        held_out(id_col, folds).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_quality(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    root: str,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    folds: int = FOLDS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``; texts are scored where they lie, without a join."""
    held = written(spark, vectors(docs, id_col, text), f"{root}/vectors")
    weights = train(spark, held, labels, root, id_col, label, folds)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([features(t.as_py()) for t in batch.column(at)]).astype(np.float64)
                yield batch.filter(pa.array(_chances(x, weights) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
