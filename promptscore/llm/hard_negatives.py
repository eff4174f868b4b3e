"""Hard negatives for anchors: exact, by lists shared per anchor cluster and walked until certified.

Rows are integer vectors (each component ``floor(256 * x)``) with a label. The anchors are a stated query set;
every anchor is scored against every row, but in blocks, and mostly not in full:

* Anchors are cut into chunks of at most ``chunk_anchors`` and rows into blocks of about ``block_rows``; the
  operator's unit of work is one (chunk, block) pair, so no task holds more than one chunk and one block,
  whatever the table's size; there are at least as many pairs as cores. The anchors travel to every block; the rows to every chunk.
* Inside a chunk the anchors are clustered (spherical k-means on the chunk, ``cluster_size`` anchors a
  cluster). For a cluster with centroid ``c`` and widest member angle ``t``, no member ``a`` scores more
  than ``|a| |r| cos(max(0, angle(c, r) - t))`` on row ``r``. The block's rows are sorted by that bound
  once per cluster, and every member walks the shared list in doubling steps, scoring exactly, until the bound of
  the next row shows that no row further down can change its answer (certified termination).
* The first pass finds each anchor's five best rows of its label in every block; the best five of those
  over all blocks are its positives. The second pass walks again with the windows of score
  ``[0.8 p, p]`` of the positives and keeps the best five different-label rows of every window and block;
  the best five over all blocks are the negatives.

Order everywhere: higher score first, then smaller ``vec_id``. Defined cases: rows with a null ``vec_id``, a null
label, a null vector, any null or non-finite component, or a component of absolute value above ``2**20`` (their
products would leave 64-bit integers) take no part; repeated rows count once; vectors of different lengths are compared as if
padded with zeros (an empty vector scores 0); a row whose ``vec_id`` equals the anchor's is never its
positive or negative; two anchor rows with one ``vec_id`` are two anchors; an empty table or one without
anchors gives no rows; an anchor with no positive, and a positive with no negative in its window, give no
rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_ANCHORS = 4096
BLOCK_ROWS = 16_384
CLUSTER_SIZE = 16
STEP = 256
TOP = 5
LIMIT = 2.0**20

_ANCHOR_OUT = "anchor_id long, vec_id long, score long"
_NEG_OUT = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def clean_rows(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v): the rows that take part, with the label changed where vec_id is divisible by 7."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) > LIMIT))
    present = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    taking = embeddings.select("vec_id", "label", "embedding").where(present & ~bad).dropDuplicates()
    label = F.col("label").cast("long")
    return taking.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v"),
    )


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _clusters(a: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster of each anchor, unit centroids, widest member angle of each cluster): deterministic."""
    norms = np.linalg.norm(a, axis=1)
    unit = np.divide(a, norms[:, None], out=np.zeros(a.shape), where=norms[:, None] > 0)
    k = max(1, math.ceil(len(a) / size))
    centroids = unit[np.linspace(0, len(a) - 1, k).astype(int)]
    for _ in range(6):
        member = np.argmax(unit @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, member, unit)
        lengths = np.linalg.norm(sums, axis=1)
        centroids = np.where(lengths[:, None] > 0, sums / np.maximum(lengths, 1e-300)[:, None], centroids)
    member = np.argmax(unit @ centroids.T, axis=1)
    angle = np.arccos(np.clip(np.sum(unit * centroids[member], axis=1), -1.0, 1.0))
    angle[norms == 0] = math.pi  # a zero anchor has no direction: its cluster gets the plain bound
    widest = np.zeros(k)
    np.maximum.at(widest, member, angle + 1e-9)
    return member, centroids, widest


def _bounds(rows: np.ndarray, centroid: np.ndarray, widest: float) -> np.ndarray:
    """Upper bound of a member's score on each row, divided by the member's norm."""
    norms = np.linalg.norm(rows, axis=1)
    cosine = np.divide(rows @ centroid, norms, out=np.ones(len(rows)), where=norms > 0)
    gap = np.maximum(0.0, np.arccos(np.clip(cosine, -1.0, 1.0)) - widest)
    return norms * np.cos(gap)


def _best(scores: np.ndarray, ids: np.ndarray, take: np.ndarray, top: int) -> np.ndarray:
    """Positions (into scores) of the ``top`` best rows among ``take``: higher score, then smaller id."""
    where = np.flatnonzero(take)
    order = np.lexsort((ids[where], -scores[where]))
    return where[order[:top]]


def _walks(anchors: pd.DataFrame, rows: pd.DataFrame, visit) -> list[tuple]:
    """Every anchor walks its cluster's shared list in steps that double (from ``STEP`` rows);
    ``visit(i, scores, ids, labels, next_bound)`` of anchor ``i`` says when to stop (``None``: go on) and
    what to give."""
    if anchors.empty or rows.empty:
        return []
    width = max(max(map(len, anchors["v"])), max(map(len, rows["v"])), 1)
    a, r = _matrix(anchors["v"], width), _matrix(rows["v"], width)
    ids, labels = rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
    member, centroids, widest = _clusters(a.astype(np.float64), CLUSTER_SIZE)
    found = []
    for c in range(len(centroids)):
        bound = _bounds(r.astype(np.float64), centroids[c], widest[c])
        order = np.lexsort((ids, -bound))  # the shared list, sorted once
        listed, listed_ids, listed_labels, bound = r[order], ids[order], labels[order], bound[order]
        for i in np.flatnonzero(member == c):
            norm, at, step, parts = float(np.linalg.norm(a[i])), 0, STEP, []
            while True:
                end = min(at + step, len(order))
                parts.append(listed[at:end] @ a[i])
                at, step = end, 2 * step
                ahead = norm * bound[at] * (1 + 1e-9) + 1e-6 if at < len(order) else -math.inf
                given = visit(i, np.concatenate(parts), listed_ids[:at], listed_labels[:at], ahead)
                if given is not None:
                    found += given
                    break
    return found


def _positives(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Each anchor's best rows of its label in this block."""
    label_count = rows["label"].value_counts().to_dict()
    same_id = rows.groupby(["vec_id", "label"]).size().to_dict()
    anchor_ids, anchor_labels = anchors["vec_id"].tolist(), anchors["label"].tolist()

    def visit(i, scores, ids, labels, ahead):
        me, label = anchor_ids[i], anchor_labels[i]
        own = (labels == label) & (ids != me)
        best = _best(scores, ids, own, TOP)
        everyone = label_count.get(label, 0) - same_id.get((me, label), 0)
        done = ahead == -math.inf or own.sum() >= everyone or (len(best) == TOP and scores[best[-1]] > ahead)
        return [(me, int(ids[j]), int(scores[j])) for j in best] if done else None

    return pd.DataFrame(_walks(anchors, rows, visit), columns=["anchor_id", "vec_id", "score"])


def _negatives(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """For each anchor and positive, the best different-label rows of the positive's window in this block."""
    anchor_ids, anchor_labels = anchors["vec_id"].tolist(), anchors["label"].tolist()
    windows = [list(zip(p, q)) for p, q in zip(anchors["positive_ids"], anchors["positive_scores"])]

    def visit(i, scores, ids, labels, ahead):
        me = anchor_ids[i]
        other = (labels != anchor_labels[i]) & (ids != me)
        out, done = [], True
        for positive, p in windows[i]:
            inside = other & (80 * p <= 100 * scores) & (scores <= p)
            best = _best(scores, ids, inside, TOP)
            out += [(me, int(positive), int(p), int(ids[j]), int(scores[j])) for j in best]
            certain = (len(best) == TOP and scores[best[-1]] > ahead) or 100 * ahead < 80 * p
            done = done and (ahead == -math.inf or certain)
        return out if done else None

    columns = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    return pd.DataFrame(_walks(anchors, rows, visit), columns=columns)


def _ranked(df: DataFrame, group: list[str], score: str, row: str, name: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(row))
    return df.withColumn(name, F.row_number().over(order)).where(F.col(name) <= TOP)


def hard_negatives(
    spark: SparkSession,
    embeddings: DataFrame,
    chunk_anchors: int = CHUNK_ANCHORS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor."""
    rows = clean_rows(embeddings)
    anchors = rows.where(F.col("vec_id") % 100 == 0)
    n_rows, n_anchors = rows.count(), anchors.count()
    # blocks of at most block_rows, and at least as many (chunk, block) tasks as cores, so that a small
    # table is not one task
    chunks = max(1, math.ceil(n_anchors / chunk_anchors))
    blocks = max(math.ceil(n_rows / block_rows), math.ceil(spark.sparkContext.defaultParallelism / chunks), 1)

    # both sides key by (chunk, block) as longs: keys of other types would not meet in the cogroup
    def keyed_rows() -> DataFrame:
        return rows.select(
            F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("long").alias("block"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"),
            *[F.col(c).alias(c) for c in ("vec_id", "label", "v")],  # new names: the plan joins rows twice
        )

    def keyed_anchors(df: DataFrame) -> DataFrame:
        return df.select(
            F.pmod(F.xxhash64("vec_id", F.lit("chunk")), F.lit(chunks)).cast("long").alias("chunk"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
            *[F.col(c).alias(c) for c in df.columns],
        )

    def cogrouped(left: DataFrame, fn, schema: str) -> DataFrame:
        sides = left.groupBy("chunk", "block").cogroup(keyed_rows().groupBy("chunk", "block"))
        return sides.applyInPandas(lambda a, r: fn(a.sort_values("vec_id", kind="stable"), r), schema)

    local = cogrouped(keyed_anchors(anchors), _positives, _ANCHOR_OUT)
    positives = _ranked(local, ["anchor_id"], "score", "vec_id", "p_rank")
    carried = positives.groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("p_rank", "vec_id", "score"))).alias("p")
    )
    with_windows = anchors.join(carried.withColumnRenamed("anchor_id", "vec_id"), "vec_id").select(
        "vec_id", "label", "v",
        F.col("p.vec_id").alias("positive_ids"),
        F.col("p.score").alias("positive_scores"),
    )
    local = cogrouped(keyed_anchors(with_windows), _negatives, _NEG_OUT)
    ranked = _ranked(local, ["anchor_id", "positive_id"], "negative_score", "negative_id", "rank")
    return ranked.select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score"
    )
